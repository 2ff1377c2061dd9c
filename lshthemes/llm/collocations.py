"""Phrases whose words belong together, mined from a weighted de Bruijn graph of each language.

The longest grams, of three words, are the edges of the graph: each leads from its first two words to its last two.

1. Tasks walk texts piece by piece. Words of a block get numbers, edges are sorted and counted, and what a node or a word
   sends on is summed from the edges that leave it. Where a piece ends, the walk leaves over an edge without a word: that
   correction makes the outflow of a node the count of its two words, and the outflow of all nodes that begin with a word
   the count of that word. So no gram but the longest is ever counted.
2. One shuffle by node adds up the blocks. The few nodes that hold more than one edge in ``HOT_SHARE`` are spread by
   their last word as well; a sample finds them, which decides nothing but where rows go. Frequent edges stay with their node.
3. Unary paths are compacted: a node all of whose flow comes by one edge and leaves by one edge joins the two. Its words
   occur only within the path, so it is no phrase of its own.
4. Candidates look up the flow of their parts, and the best of each language are ranked from partial ranks.

Text is lower-cased from A to Z only and cut into pieces at ``.,;:!?`` and the line ends from newline to carriage return;
words are what stands between blanks and tabs.

Edge cases: null and empty texts have no words; a null language is ``und``. Texts of any length are counted whole, a text
at a time in memory. Pieces shorter than three words count by their ends alone. Repeated rows count each time. Ties are
settled by the phrase's bytes. An empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lshthemes.llm.lookups import look_up
from lshthemes.sources.scratch import scratch_path

MIN_COUNT = 10
CONTAINED_PCT = 50
TOP = 2_000
#: Words numbered and counted together; one longer text is a block by itself.
BLOCK_WORDS = 1 << 20
#: One text in so many is looked at to find nodes that hold more than one edge in ``HOT_SHARE``.
SAMPLE, HOT_SHARE = 64, 20_000
#: Candidates ranked by one task before ranks of a language are merged.
RANKED_ROWS = 200_000
_END = b"."
# Where a piece ends.
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _PIECE_ENDS, b"abcdefghijklmnopqrstuvwxyz" + _END * len(_PIECE_ENDS))
#: Stands between a node and its language, in one column; no word has it.
_KEY = "\t"
_SCHEMA = "key string, n bigint, tails string, hot boolean"


class _Numbers(dict):
    """Words of a block, numbered as they come; 0 stands for the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Walk:
    """What was read of one language in a block."""

    def __init__(self) -> None:
        self.numbers = _Numbers({_END: 0})
        self.steps: list[np.ndarray] = []

    def read(self, text: str) -> int:
        words = text.encode().translate(_LOWER).replace(_END, b" . ").split()
        walk = np.zeros(len(words) + 2, dtype=np.int64)
        walk[: len(words)] = list(map(self.numbers.__getitem__, words))
        self.steps.append(walk)
        return len(words)

    def edges(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words; numbers of the two words of each node; and of each edge its node, last word and count."""
        walk = np.concatenate(self.steps)
        size = len(self.numbers)
        first, second = walk[:-2], walk[1:-1]
        third = np.where(second > 0, walk[2:], 0)
        inside = first > 0
        nodes, node = np.unique(first[inside] * size + second[inside], return_inverse=True)
        edges, count = np.unique(node * size + third[inside], return_counts=True)
        words = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        return words, nodes, edges // size, edges % size, count


def _graph_rows(lang: str, walk: _Walk, hot: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of a block: every node with what follows it, ``tail:count`` in a text (a count of 1 goes without saying), and the
    counts of words and of all of them, each under its key. Of a hot node every tail has a row."""
    words, nodes, node, last, count = walk.edges()
    size = len(words)
    if not len(nodes):
        return

    def rows(key: pa.Array, n: np.ndarray, tails: pa.Array, hot: bool) -> Iterator[pa.RecordBatch]:
        columns = [pc.binary_join_element_wise(key, lang, _KEY), pa.array(n, pa.int64()), tails, pa.repeat(hot, len(key))]
        yield from pa.table(columns, ["key", "n", "tails", "hot"]).to_batches(max_chunksize=1 << 16)

    outflow = np.bincount(node, weights=count).astype(np.int64)
    of_word = np.bincount(nodes // size, weights=outflow, minlength=size).astype(np.int64)
    of_word[0] = of_word.sum()  # in place of a piece's end: all words of the language
    names = pa.concat_arrays([pa.array([""]), words.slice(1)])
    yield from rows(names, of_word, pa.repeat("", size), False)
    whole = nodes % size > 0  # nodes of one word and a piece's end are told by their word already
    if not whole.any():
        return
    phrase = pc.binary_join_element_wise(words.take(pa.array(nodes // size)), names.take(pa.array(nodes % size)), " ")
    spread = pc.is_in(phrase, value_set=hot).to_numpy(zero_copy_only=False) & whole
    told = last > 0
    tail = names.take(pa.array(last[told]))
    many = pc.binary_join_element_wise(tail, pa.array(count[told]).cast(pa.string()), ":")
    tail = pc.if_else(pa.array(count[told] > 1), many, tail)
    ends = np.concatenate(([0], np.cumsum(np.bincount(node[told], minlength=len(nodes)))))
    tails = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail), " ")
    plain = np.flatnonzero(whole & ~spread)
    yield from rows(phrase.take(pa.array(plain)), outflow[plain], tails.take(pa.array(plain)), False)
    if spread.any():
        at = np.flatnonzero(spread[node])
        place = np.where(told, np.cumsum(told) - 1, len(tail))[at]
        one = pa.concat_arrays([tail, pa.array([""])]).take(pa.array(place))
        yield from rows(phrase.take(pa.array(node[at])), count[at], one, True)


def _count_blocks(docs: DataFrame, lang: str, text: str, hot: dict[str, list[str]], block: int) -> DataFrame:
    nothing = pa.array([], pa.string())
    told = {k: pa.array(v, pa.string()) for k, v in hot.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[str, _Walk] = {}
        held = 0
        for batch in batches:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name not in walks:
                    walks[name] = _Walk()
                held += walks[name].read(line.as_py())
                if held >= block:
                    for k, walk in walks.items():
                        yield from _graph_rows(k, walk, told.get(k, nothing))
                    walks, held = {}, 0
        for k, walk in walks.items():
            yield from _graph_rows(k, walk, told.get(k, nothing))

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return rows.where(F.col("text").isNotNull()).mapInArrow(count, _SCHEMA)


def hot_nodes(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, list[str]]:
    """Nodes that hold more than one edge in ``HOT_SHARE`` of a sample: fewer than ``HOT_SHARE`` come to the driver."""
    sample = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(SAMPLE)) == 0)
    nodes = _count_blocks(sample, lang, text, {}, BLOCK_WORDS).groupBy("key").agg(F.sum("n").alias("n"))
    sums = nodes.select(*_node_and_lang(), "n").where(F.contains("node", F.lit(" ")))
    total = sums.agg(F.sum("n")).scalar()
    found: dict[str, list[str]] = {}
    for row in sums.where(F.col("n") * HOT_SHARE > total).collect():
        found.setdefault(row["lang"], []).append(row["node"])
    return found


def _node_and_lang() -> tuple[Column, Column]:
    node = F.substring_index("key", _KEY, 1)
    return node.alias("node"), F.substring("key", F.length(node) + 2, F.length("key")).alias("lang")


class _Sums:
    """Adds up rows that come sorted by key. Keys that occur too seldom go by in arrays; of the others, and of one that may
    go on in the next batch, the tails are counted."""

    def __init__(self, min_count: int) -> None:
        self.min_count = min_count
        self.key: str | None = None
        self.flow, self.tails = 0, Counter()

    def close(self) -> list[tuple[str, int, list[tuple[str, int]]]]:
        if self.key is None:
            return []
        out = [(self.key, self.flow, [x for x in self.tails.items() if x[1] >= self.min_count])]
        self.key, self.flow, self.tails = None, 0, Counter()
        return out

    def add(self, batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[tuple[str, int]]]]:
        """Keys that are done with this batch: those that occur often enough, or that only this task has a part of."""
        key, n, tails, hot = batch.columns
        rows = batch.num_rows
        fresh = np.ones(rows, dtype=bool)
        fresh[1:] = pc.not_equal(key.slice(1), key.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(fresh)
        flow = np.add.reduceat(n.to_numpy(), starts)
        wanted = (flow >= self.min_count) | hot.to_numpy(zero_copy_only=False)[starts]
        wanted[0] = wanted[-1] = True
        ends = np.append(starts[1:], rows)
        for k in np.flatnonzero(wanted).tolist():
            first, name = int(starts[k]), key[int(starts[k])].as_py()
            if name != self.key:
                yield from self.close()
                self.key = name
            self.flow += int(flow[k])
            for line in tails.slice(first, int(ends[k]) - first).to_pylist():
                for item in line.split(" ") if line else ():
                    tail, _, count = item.partition(":")
                    self.tails[tail] += int(count or 1)


def _summed(rows: DataFrame, min_count: int) -> DataFrame:
    """``(key, flow, tails)`` of rows that are sorted within their partitions."""
    schema = "key string, flow bigint, tails array<struct<tail:string,n:bigint>>"
    pair = pa.list_(pa.struct([("tail", pa.string()), ("n", pa.int64())]))

    def table(done: list) -> pa.RecordBatch:
        keys, flows, tails = zip(*done, strict=True)
        told = [[{"tail": t, "n": n} for t, n in some] for some in tails]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(flows, pa.int64()), pa.array(told, pair)], ["key", "flow", "tails"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(min_count)
        for batch in batches:
            if batch.num_rows and (done := list(sums.add(batch))):
                yield table(done)
        if done := sums.close():
            yield table(done)

    return rows.mapInArrow(add, schema)


def phrase_graph(
    docs: DataFrame, min_count: int = MIN_COUNT, lang: str = "lang", text: str = "text", block: int = BLOCK_WORDS
) -> DataFrame:
    """``(lang, node, flow, tails)``: nodes of two words and of one that occur ``min_count`` times, how often they do, and
    of two words those that follow as often, with their counts. The node without a word has the count of all words."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = _count_blocks(docs, lang, text, hot_nodes(docs, lang, text), block)
    tail = F.substring_index("tails", ":", 1)
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64(tail), F.lit(parts))).otherwise(F.lit(-1)).cast("int")
    dealt = counted.withColumn("spread", spread).repartition("key", "spread").drop("spread").sortWithinPartitions("key")
    kept = _stored(_summed(dealt, min_count), "phrase-nodes")
    node, language = _node_and_lang()
    # a hot node comes in parts
    whole = kept.groupBy("key").agg(F.sum("flow").alias("flow"), F.flatten(F.collect_list("tails")).alias("tails"))
    named = whole.select(language, node, "flow", "tails")
    return _stored(named.where((F.col("flow") >= min_count) | (F.col("node") == "")), "phrase-graph")


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _edges(graph: DataFrame) -> DataFrame:
    rows = graph.select("lang", "node", F.explode("tails").alias("t")).select("lang", "node", "t.tail", "t.n")
    edge = F.concat_ws(" ", "node", "tail")
    return rows.withColumn("edge", edge).withColumn("next", F.concat_ws(" ", F.substring_index("node", " ", -1), "tail"))


def compact_paths(graph: DataFrame) -> DataFrame:
    """``(lang, path, words, n, inner)``: maximal paths over nodes whose whole flow comes by one edge and leaves by one, so
    every word pair ``inner`` to a path occurs nowhere else. Edges that nothing joins are paths of three words.

    Predecessors are found by doubling. No path can close a circle, since a text must enter it somewhere, and none is
    longer than the longest piece."""
    edges = _stored(_edges(graph), "phrase-edges")
    into = edges.groupBy("lang", F.col("next").alias("node")).agg(
        F.count(F.lit(1)).alias("ways"), F.max("n").alias("inflow"), F.min("edge").alias("via")
    )
    out = F.get("tails", F.lit(0))
    through = graph.where((F.size("tails") == 1) & (out["n"] == F.col("flow")))
    unary = through.join(into.where("ways = 1"), ["lang", "node"]).where("inflow = flow")
    back = _stored(unary.select("lang", F.concat_ws(" ", "node", out["tail"]).alias("edge"), "via", F.lit(1).alias("far")), "path-back")
    while True:
        onward = back.select("lang", F.col("edge").alias("via"), F.col("via").alias("start"), F.col("far").alias("more"))
        jumped = back.join(onward, ["lang", "via"], "left")
        fresh = _stored(
            jumped.select("lang", "edge", F.coalesce("start", "via").alias("via"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("start").isNotNull().alias("moved")),
            "path-back",
        )
        back = fresh.drop("moved")
        if fresh.where("moved").isEmpty():
            break
    at = edges.join(back, ["lang", "edge"], "left").select(
        "lang", "n", "tail", F.coalesce("via", "edge").alias("head"), F.coalesce("far", F.lit(0)).alias("far")
    )
    steps = F.sort_array(F.collect_list(F.when(F.col("far") > 0, F.struct("far", "tail"))))
    paths = at.groupBy("lang", "head").agg(F.max("n").alias("n"), steps.alias("steps"))
    words = F.concat(F.split("head", " "), F.transform("steps", lambda s: s["tail"]))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda k: F.concat_ws(" ", F.get("w", k), F.get("w", k + 1)))
    return paths.select("lang", "n", words.alias("w")).select(
        "lang",
        F.array_join("w", " ").alias("path"),
        F.size("w").cast("bigint").alias("words"),
        "n",
        F.when(F.size("w") > 3, pairs).otherwise(F.array().cast("array<string>")).alias("inner"),
    )


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """Whole part of 1000000 * a * a / (l * r), in decimals of up to 38 digits."""
    wide = "decimal(15,0)"
    upper = a.cast(wide) * a.cast(wide) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", upper, l.cast(wide) * r.cast(wide))


def scored_phrases(graph: DataFrame, contained_pct: int = CONTAINED_PCT) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of every candidate that no longer one makes superfluous."""
    edges = _edges(graph)
    inner = compact_paths(graph).where(F.size("inner") > 0).select("lang", F.explode("inner").alias("phrase")).distinct()
    # a pair within a longer candidate, by the most frequent one that holds it
    holds = edges.select("lang", F.explode(F.array("node", "next")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    pairs = (
        graph.where(F.contains("node", F.lit(" ")))
        .select("lang", F.col("node").alias("phrase"), F.col("flow").alias("a"))
        .join(inner, ["lang", "phrase"], "left_anti")
        .join(holds, ["lang", "phrase"], "left")
        .where(F.coalesce(100 * F.col("most") < contained_pct * F.col("a"), F.lit(True)))
        .drop("most")
    )
    chosen = pairs.unionByName(edges.select("lang", F.col("edge").alias("phrase"), F.col("n").alias("a")))
    word = F.split("phrase", " ")

    def span(first: int, last: int) -> Column:
        return F.array_join(F.slice(word, first, last - first + 1), " ")

    def part(cut: int, side: str, gram: Column) -> Column:
        return F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), gram.alias("gram"))

    two = F.array(part(1, "l", span(1, 1)), part(1, "r", span(2, 2)))
    three = F.array(part(1, "l", span(1, 1)), part(1, "r", span(2, 3)), part(2, "l", span(1, 2)), part(2, "r", span(3, 3)))
    parts = _stored(
        chosen.select("lang", "phrase", "a", F.explode(F.when(F.size(word) == 2, two).otherwise(three)).alias("p")).select(
            "lang", "phrase", "a", "p.cut", "p.side", "p.gram"
        ),
        "phrase-parts",
    )
    flows = graph.select("lang", F.col("node").alias("gram"), F.col("flow").alias("f"))
    found = look_up(parts, ["lang", "gram"], flows)
    side = lambda cut, side: F.max(F.when((F.col("cut") == cut) & (F.col("side") == side), F.col("f")))
    wide = found.groupBy("lang", "phrase", "a").agg(
        side(1, "l").alias("l1"), side(1, "r").alias("r1"), side(2, "l").alias("l2"), side(2, "r").alias("r2")
    )
    cut = lambda k: F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    lowest = F.least(cut(1), F.when(F.col("l2").isNotNull(), cut(2)))
    return wide.select("lang", "phrase", "a", lowest.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(
    docs: DataFrame,
    top: int = TOP,
    min_count: int = MIN_COUNT,
    contained_pct: int = CONTAINED_PCT,
    lang: str = "lang",
    text: str = "text",
) -> DataFrame:
    """The first ``top`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``."""
    graph = phrase_graph(docs, min_count, lang, text)
    scored = _stored(scored_phrases(graph, contained_pct), "phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = scored.count() // RANKED_ROWS + 1
    dealt = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(spread)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    totals = graph.where("node = ''").select("lang", F.col("flow").alias("n"))
    kept = ranked.where(F.col("rank") <= top).join(F.broadcast(totals), "lang")
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
