"""The pair occurrence index against the tokenizers library."""

import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from lshthemes.llm import bpe, chunks  # noqa: E402
from lshthemes.llm.queries import bpe_digests  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "'s", "'ll", "1", "23", "é", "ñ", "!", "..", "<|endoftext|>", "\x1c", "\x85"]
PARTS += ["᠎", "​", "　", "你", "🙂", "_", "aaaa", "\r\n", "İ", "²", "\x00", "word.", "word,", "Word\nNext"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(library):
    pick = random.Random(3)
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 30))) for _ in range(3000)]
    texts += ["", "a" * 5000, "ab " * 3000]
    model, tokens = bpe.PairIndexBpe(PATH, P.PATTERN), bpe.token_bytes(PATH)
    model.chunks.limit = 500  # forgets again and again
    for at in range(0, len(texts), 250):
        block = texts[at : at + 250]
        for text, ids in zip(block, model.encode(block), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert bpe.decode_ids(tokens, ids) == library.decode(want, skip_special_tokens=False)


def test_chunks_put_together_are_the_text():
    for text in ("", " ", "a b\nc", "a  b \n c\n", "\n\nx", "x \t y"):
        assert "".join(chunks.cut(text)) == text


def test_digests_of_nulls_and_empty_texts(docs):
    rows = bpe_digests(docs([None, "", "x y", "x y"])).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == [0, 0, 2, 2] and rows[0]["ids_sha256"] == rows[1]["ids_sha256"]
    assert rows[2]["decoded_sha256"] == rows[3]["decoded_sha256"]
    assert bpe_digests(docs([]).limit(0)).count() == 0


def test_digests_need_one_python_process_for_each_task(docs, library):
    texts = ["".join(PARTS), "x y", None, "<|endoftext|>", "你🙂"] * 300
    got = bpe_digests(docs(texts))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = {r["doc_id"]: r for r in got.collect()}
    for k, text in enumerate(texts[:5]):
        assert rows[k]["n_tokens"] == len(library.encode(text or "", add_special_tokens=False).ids)
    assert len(rows) == len(texts) and rows[0]["decoded_sha256"] == rows[5]["decoded_sha256"]
