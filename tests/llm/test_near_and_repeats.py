"""SimHash groups, components, repeated passages, templates and archives against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lshthemes.llm import simhash, suffix_index, templates, warc
from lshthemes.llm.components import components
from lshthemes.sources.scratch import scratch_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def text_of(pick, n):
    return " ".join(pick.choice(WORDS) for _ in range(n))


def plain_print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    return [root(x) for x in range(len(prints))]


def test_groups_are_those_of_all_pairs(docs):
    pick = random.Random(5)
    texts = [text_of(pick, pick.randint(0, 60)) for _ in range(120)]
    texts += [t + " omega" for t in texts[:30]] + [t.replace("alpha", "Alpha ") for t in texts[30:50]] + [None, "", " ", "A", "a"]
    rows = [(1000 - k, t) for k, t in enumerate(texts)] + [(None, texts[0])]
    got = simhash.near_groups(docs(rows)).collect()
    prints = [plain_print(t or "") for _, t in rows]
    roots = plain_components(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, 10**9), 10**9 if i is None else i)
    want = {i: (p, least[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True)}
    assert len(got) == len(rows)
    for r in got:
        assert (r["fp"] % (1 << 64), r["component_id"]) == want[r["doc_id"]]
    kept = simhash.keep_one_of_each(docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values()) and kept.columns == docs(rows).columns
    assert simhash.near_groups(docs([]).limit(0)).count() == 0


def test_tree_leaves_out_no_link():
    pick = np.random.RandomState(1)
    points = pick.randint(0, 1 << 62, 3000, dtype=np.uint64)
    near = points[:500] ^ (np.uint64(1) << pick.randint(0, 62, 500).astype(np.uint64)) ^ np.uint64(6)
    dense = points[0] ^ (np.uint64(1) << pick.randint(0, 20, 400).astype(np.uint64))
    points = np.unique(np.concatenate([points, near, dense]))
    a, b = simhash.near_links(points, points, 3)
    assert (np.bitwise_count(a ^ b) >= 1).all() and len(a) < 2 * len(points)
    label = {int(p): int(p) for p in points}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        label[root(x)] = root(y)
    for x in points:
        for y in points[np.bitwise_count(points ^ x) <= 3]:
            assert root(int(x)) == root(int(y))
    tree = simhash.Tree(points[:800], 16, 3)
    row, shard, own = tree.places(points)
    assert np.bincount(row[own], minlength=len(points)).tolist() == [1] * len(points)
    home = dict(zip(row[own].tolist(), shard[own].tolist(), strict=True))
    asked = set(zip(row.tolist(), shard.tolist(), strict=True))
    for k, x in enumerate(points):
        for j in np.flatnonzero(np.bitwise_count(points ^ x) <= 3):
            assert (k, home[int(j)]) in asked


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components(df).collect()}
    want = dict.fromkeys(range(1, 61), 1) | dict.fromkeys(range(100, 160), 100) | {200: 200, 300: 200}
    assert got == want and components(df.limit(0)).count() == 0


def plain_cut(rows):
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if seen.setdefault(data[k : k + 100], (i, k)) != (i, k):
                gone[k : k + 100] = b"\1" * 100
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_are_those_of_all_strings(docs, monkeypatch):
    monkeypatch.setattr(suffix_index, "BATCH_STRINGS", 7)
    pick = random.Random(9)
    shared = [text_of(pick, n) for n in (20, 25, 40)]
    texts = ["".join((text_of(pick, pick.randint(0, 30)), pick.choice(shared)[pick.randint(0, 9) :], text_of(pick, 5))) for _ in range(60)]
    texts += ["é" * 300, "ab" * 400, "\x00" * 250, "x" * 99, shared[0][:100], shared[0][:99], None, "", "a" * 100]
    rows = [(500 - k, t) for k, t in enumerate(texts)] + [(None, texts[3]), (1000, texts[5]), (1000, texts[5])]
    want = plain_cut(rows[:-1])
    got = suffix_index.cut_repeats(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        assert (r["n_bytes"], removed, len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_id"]]
    assert suffix_index.cut_repeats(docs([]).limit(0)).count() == 0


def test_repeats_of_very_many_texts_without_an_identifier(docs):
    pick = random.Random(12)
    shared = [text_of(pick, 30) for _ in range(8)]
    texts = [f"{k} {text_of(pick, pick.randint(0, 9))}"[: pick.randint(1, 40)].ljust(40, ".") + pick.choice(shared) for k in range(1200)]
    texts = sorted(set(texts))
    order = docs(texts).selectExpr("doc_id", "xxhash64(text) AS h").collect()
    rank = [r["doc_id"] for r in sorted(order, key=lambda r: r["h"])]
    want = plain_cut([(k, texts[i]) for k, i in enumerate(rank)])
    got = suffix_index.cut_repeats(docs([(None, t) for t in texts])).collect()
    assert len({r & 0x7FFF for r in (x["h"] for x in order)}) < len(texts)  # 15 bits would not tell these apart
    found = sorted((r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got)
    assert found == sorted(want.values())


def test_an_owner_with_many_runs_is_dealt_by_string(docs, monkeypatch):
    monkeypatch.setattr(suffix_index, "HOT_RUNS", 5)
    pick = random.Random(21)
    shared, gathered, single = text_of(pick, 40), [], []
    texts = [text_of(pick, pick.randint(3, 9)) + shared + text_of(pick, pick.randint(0, 3)) for _ in range(90)]
    rows = [(k, t) for k, t in enumerate(texts + ["ab" * 300, "é" * 200])] + [(500, texts[0]), (500, texts[0])]
    spans, strings = suffix_index.open_spans, suffix_index._single_strings
    monkeypatch.setattr(suffix_index, "open_spans", lambda runs, shares: gathered.append(runs) or spans(runs, 3))
    monkeypatch.setattr(suffix_index, "_single_strings", lambda d, o: single.append(o) or strings(d, o))
    want = plain_cut(rows[:-1])
    for r in suffix_index.cut_repeats(docs(rows)).collect():
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        assert (r["n_bytes"], removed, len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_id"]]
    assert max(r["count"] for r in gathered[0].groupBy("g").count().collect()) <= 10  # 5 runs, of texts that may be told twice
    assert single[0].count() > 50


def test_runs_of_a_hot_owner_are_dealt_in_few_rows(docs, monkeypatch):
    monkeypatch.setattr(suffix_index, "HOT_RUNS", 1000)
    pick = random.Random(23)
    shared, opened, rows = "".join(chr(pick.randrange(33, 127)) for _ in range(90)), [], []
    texts = ["".join(chr(pick.randrange(33, 127)) for _ in range(60)) + shared + "".join(chr(pick.randrange(33, 127)) for _ in range(60)) for _ in range(1100)]
    texts += [x[40:] for x in texts[:20]]
    with_texts, settle = suffix_index._with_texts, suffix_index.settle_runs
    monkeypatch.setattr(suffix_index, "_with_texts", lambda d, o: opened.append(o) or with_texts(d, o))
    monkeypatch.setattr(suffix_index, "settle_runs", lambda found: rows.append(found) or settle(found))
    want = plain_cut(list(enumerate(texts)))
    for r in suffix_index.cut_repeats(docs(texts)).collect():
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        assert (r["n_bytes"], removed, len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_id"]]
    runs = opened[0].count()
    assert runs > 1000  # one owner has over a thousand
    assert sum(found.count() for found in rows[1:]) < 8 * runs  # before: a row for each of up to 77 strings


def test_index_family_keeps_few_levels():
    family = suffix_index.IndexFamily()
    pick = random.Random(2)
    strings = [bytes(pick.randrange(256) for _ in range(110)) for _ in range(300)]
    for at in range(0, 300, 10):
        assert not any(k.any() for k in family.add(strings[at : at + 10]))
    assert len(family.levels) <= 8 and sum(map(len, family.levels)) == 300 * 11
    assert all(k.all() for k in family.add(strings[50:60]))


QUESTION = "Alice has 12 red apples in 3 kg bags and Alice gives 5 of them to her friend every day of the long week"


def test_templates_find_exchanged_slots_and_refuse_contradictions(docs, spark):
    items = spark.createDataFrame([(1, QUESTION), (2, "too short"), (3, None), (4, "")], "item_id bigint, text string")
    other = QUESTION.replace("Alice", "Bob").replace("12", "40").replace("3 kg", "9 lb")
    torn = QUESTION.replace("Alice has", "Bob has").replace("Alice gives", "Carol gives").replace("12", "7").replace("5", "1")
    texts = [QUESTION, f"Before it. {other} after it.", torn, QUESTION.upper(), None, "", "something else entirely", QUESTION[:50]]
    hits = {r["doc_id"]: r for r in templates.benchmark_hits(docs(texts), items).collect()}
    assert set(hits) == {0, 1, 3} and hits[0]["replaced"] == 0 and hits[1]["replaced"] == 4
    assert {r["item_id"] for r in hits.values()} == {1}
    left = templates.drop_contaminated(docs([*texts, (None, QUESTION)]), items)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 6, 7] and left.columns == docs([]).columns
    assert templates.benchmark_hits(docs(texts), items.limit(0)).count() == 0
    assert templates.benchmark_hits(docs([]).limit(0), items).count() == 0


DENSE = (
    "Mary bought 3 kg of rice for 12 dollars and 5 kg of flour for 20 dollars. How much did Mary pay?",
    "Alice has 12 apples, Bob has 7 apples and Carol has 5 apples. How many apples do Alice, Bob and Carol have?",
)


def exchanged(text, slots):
    for old, new in slots.items():
        text = text.replace(old, new)
    return text


def test_templates_find_items_dense_with_placeholders(docs, spark):
    items = spark.createDataFrame(enumerate(DENSE), "item_id bigint, text string")
    told = [
        exchanged(DENSE[0], {"Mary": "Peter", "12 ": "40 ", "20 ": "64 ", "3 kg": "8 lb", "5 kg": "9 lb"}),
        exchanged(DENSE[1], {"Alice": "Dora", "Bob": "Emil", "Carol": "Fanny", "12 ": "31 ", "7 ": "44 ", "5 ": "90 "}),
    ]
    around = [f"Yes, 4 Tom Kim {t} 7 Max 3 Tim 9 And so on." for t in told]
    torn = exchanged(told[1], {"Dora,": "Ida,", "Emil and": "Jon and", "Fanny have?": "Kai have?"}).replace("44 apples and", "44 pears and")
    tables = ["Mary 3 kg 12 dollars Bob 5 kg 20 dollars " * 20, "1 2 3 4 5 6 7 8 9 " * 50, "Alice Bob Carol Dora Emil " * 50]
    hits = {(r["doc_id"], r["item_id"]) for r in templates.benchmark_hits(docs([*told, *around, torn, *tables]), items).collect()}
    assert hits == {(0, 0), (1, 1), (2, 0), (3, 1)}


def test_texts_are_cut_into_windows_once(docs, spark):
    items = spark.createDataFrame([(1, QUESTION)], "item_id bigint, text string")
    hits = templates.benchmark_hits(docs([QUESTION, None, "something else", QUESTION.replace("Alice", "Bob")]), items)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow cut(doc") < 2
    assert sorted((r["doc_id"], r["matched"], r["replaced"]) for r in hits.collect()) == [(0, 20, 0), (3, 20, 1)]


def test_clean_rows_stay_beside_contaminated_ones_of_their_identifier(docs, spark):
    items = spark.createDataFrame([(1, QUESTION)], "item_id bigint, text string")
    half = len(QUESTION) // 2
    rows = [(None, QUESTION), (None, "clean text without an identifier"), (7, "clean seven " * 9), (7, f"so {QUESTION} so")]
    rows += [(8, QUESTION[: half + 9]), (8, QUESTION[half - 9 :]), (None, None)]
    table = docs(rows)
    left = templates.drop_contaminated(table, items).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted((i or 0, t or "") for i, t in rows if QUESTION not in (t or ""))
    hits = templates.benchmark_hits(table, items).collect()
    assert sorted((r["doc_id"] or 0, r["coverage"]) for r in hits) == [(0, 1.0), (7, 1.0)]


def test_archives_give_back_every_page(spark):
    page = "<p>é " + "x" * 3000
    rows = [(k, f"http://h/{k}", page if k % 3 else f"own {k}") for k in range(60)]
    rows += [(100, None, None), (101, "a\r\nb", ""), (None, "u", "<p>"), (103, "u", "WARC/1.1\r\n\r\n\x1f\x8b")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS salt", "2 AS key")
    archives = warc.write_warc(pages, scratch_path(spark, "w"))
    for split in (64, 700, 1 << 20):
        got = {r["page_id"]: r for r in warc.read_warc(spark, archives, split).collect()}
        assert len(got) == len(rows)
        for i, _, html in rows:
            data = (html or "").encode()
            same = [j for j, _, other in rows if (other or "") == (html or "")]
            head = max(j if j is not None else -1 for j in same)
            kind = "response" if i is None or i == head else "revisit"
            r = got[i]
            assert (r["record_type"], r["refers_to"]) == (kind, None if kind == "response" else head)
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.digest(data))
            assert r["payload"] == (data if kind == "response" else None)
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0), scratch_path(spark, "w"))).count() == 0


def test_ranges_are_read_by_a_task_each(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    archives = warc.write_warc(pages, scratch_path(spark, "w"))
    split = 16 << 10
    ranges = sum(-(-r["bytes"] // split) for r in archives.collect())
    used = warc.read_warc(spark, archives, split).select(F.spark_partition_id().alias("task")).distinct().count()
    assert ranges >= 8 and used >= 0.8 * ranges
