"""Exact dedup, sharding and token files on small tables, against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lshthemes.llm import token_records
from lshthemes.llm.exact_dedup import drop_exact_copies, exact_groups
from lshthemes.llm.sharding import assign_shards
from lshthemes.llm.token_records import frame, token_layout, unframe, write_token_records
from lshthemes.sources.scratch import scratch_path

LONG = "word " * 40_000


def brute_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0))
    return groups


@pytest.mark.parametrize("hot_rows", [2, 256])
def test_exact_groups(docs, hot_rows):
    rows = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \t"), (6, "a b"), (7, LONG), (8, LONG + " "), (9, "ab c")]
    rows += [(100 + k, "same  text") for k in range(40)] + [(90, "sametext"), (91, "same text")]
    rows += [(None, "lonely"), (2, "ab"), (11, "Ab")]
    got = exact_groups(docs(rows), hot_rows=hot_rows).collect()
    groups = brute_groups(rows)
    assert len(got) == len(rows)
    for row in got:
        text = next(t for i, t in rows if i == row["doc_id"])
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        _, none, best = min(groups[norm])
        assert row["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
        assert row["keep_id"] == (None if none else best) and row["group_size"] == len(groups[norm])
    assert sum(r["kept"] for r in got) == len(groups)
    left = drop_exact_copies(docs(rows), hot_rows=hot_rows)
    assert left.columns == docs(rows).columns
    want = sorted((None if n else i) or -1 for n, i in ((min(g)[1], min(g)[2]) for g in groups.values()))
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == want


def test_empty_tables(docs, spark):
    none = docs([]).limit(0)
    assert exact_groups(none).count() == drop_exact_copies(none).count() == assign_shards(none).count() == 0


def jump(key, shards):
    b, j, key = -1, 0, key & (2**64 - 1)
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_are_the_published_ones(docs):
    rows = [(k, "x" * k) for k in range(300)] + [(-5, "ü"), (2**62, None), (None, "n"), (7, "x"), (7, "x")]
    got = assign_shards(docs(rows), shards=40).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, 40) and r["grown_shard"] == jump(r["doc_id"] or 0, 41)
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (-5, 2**62)}
    assert sizes == {(18, zlib.crc32("ü".encode())), (16, 0)}


def test_records_are_checked():
    record = frame(b"payload")
    assert unframe(record) == b"payload"
    for k in range(len(record)):
        damaged = record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :]
        with pytest.raises(ValueError, match="damaged"):
            unframe(damaged)


def test_chunks_are_encoded_many_to_a_text():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    model = token_records._Library(path)
    library, calls = model.library, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    model.library = Counted()
    words = [f"w{k:x}{c}" for k in range(700) for c in ("", "<|endoftext", "|>", "<|", "é🙂", "  ", "\n\n")]
    texts = [" ".join(words[k : k + 90]) for k in range(0, len(words), 90)] + ["", "a<|endoftext|>b", "<|endoftext|", "\x00 \x00"]
    got = model.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, model.width).tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(calls) < len(words) / 20  # before: a text for each chunk


def test_token_layout(docs, spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(5, "one two"), (3, None), (9, ""), (-1, "a  <|endoftext|>b\n\n c"), (4, LONG), (None, "first")]
    index = write_token_records(docs(rows), scratch_path(spark, "t"), path)
    got = {r["doc_id"]: r for r in token_layout(spark, index).collect()}
    start = 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)
    none = write_token_records(docs([]).limit(0), scratch_path(spark, "t"), path)
    assert token_layout(spark, none).count() == 0
