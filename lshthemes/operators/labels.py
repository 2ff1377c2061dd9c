"""Labels of buckets: counted keywords, labels written elsewhere, and groups of similar labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lshthemes.functions.text import (
    clean_label,
    jaccard,
    label_tokens,
    substring_count,
    title_case,
)
from lshthemes.operators.items import sample_items
from lshthemes.operators.skew import every_block, hot_keys, own_block, with_blocks
from lshthemes.sources.scratch import scratch_path

# The default keywords, in the order that breaks ties.
KEYWORDS = (
    "password", "reset", "login", "account",
    "charge", "refund", "cancel", "billing",
    "payment", "order", "delivery", "shipping",
    "help", "support", "issue", "problem",
    "email", "phone", "app", "update",
    "service", "wifi", "internet", "connection",
)

# Labels grouped inside one row; longer lists are grouped in rounds.
GROUP_BLOCK = 256
# Open labels of one key that a round compares; Spark cuts to so many before it shuffles.
GROUP_WINDOW = 1_000
# Labels of a key from which on it may be hot: they are compared pair by pair.
HOT_ROWS = 1_000


def default_label(bucket: Column | str) -> Column:
    return F.concat(F.lit("Theme "), F.col(bucket) if isinstance(bucket, str) else bucket)


def _sampled(items: DataFrame, sample: int) -> DataFrame:
    """Sampled items; what is sampled already is only cut."""
    if "pos" in items.columns:
        return items.where(F.col("pos") <= sample)
    return sample_items(items, sample)


def keyword_counts(
    items: DataFrame, lexicon: Sequence[str] = KEYWORDS, sample: int = 10
) -> DataFrame:
    """Occurrences of every keyword in the first ``sample`` items of each bucket.

    A keyword counts wherever its letters occur, inside words too. ``keyword_pos`` is its place in the
    lexicon.
    """
    lines = F.sort_array(F.collect_list(F.struct("pos", F.lower("display_text").alias("line"))))
    texts = (
        _sampled(items, sample)
        .groupBy("bucket_id")
        .agg(F.array_join(F.transform(lines, lambda item: item["line"]), " ").alias("text"))
    )
    words = F.array(*[F.lit(w) for w in lexicon])
    return texts.select("bucket_id", "text", F.posexplode(words).alias("keyword_pos", "keyword")).select(
        "bucket_id",
        "keyword_pos",
        "keyword",
        substring_count(F.col("text"), F.col("keyword")).alias("n"),
    )


def theme_labels(
    items: DataFrame, lexicon: Sequence[str] = KEYWORDS, sample: int = 10
) -> DataFrame:
    """One label per bucket: its two most frequent keywords, or ``Theme`` and the id without any."""
    found = F.col("n") > 0
    ranked = F.sort_array(
        F.collect_list(
            F.when(found, F.struct((-F.col("n")).alias("order"), "keyword_pos", "keyword"))
        )
    )
    top = F.transform(F.slice(ranked, 1, 2), lambda k: k["keyword"])
    return (
        keyword_counts(items, lexicon, sample)
        .groupBy("bucket_id")
        .agg(title_case(F.array_join(top, " + ")).alias("label"))
        .select(
            "bucket_id",
            F.when(F.col("label") == "", default_label("bucket_id"))
            .otherwise(F.col("label"))
            .alias("label"),
        )
    )


def label_samples(items: DataFrame, n: int = 5) -> DataFrame:
    """Text to hand to a labeller outside: the first ``n`` items of each bucket, one line each."""
    line = F.concat(F.lit("- "), F.substring("display_text", 1, 100))
    lines = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return (
        _sampled(items, n)
        .groupBy("bucket_id")
        .agg(F.array_join(F.transform(lines, lambda item: item["line"]), "\n").alias("sample"))
    )


def clean_labels(raw: DataFrame) -> DataFrame:
    """Labels that came back, ``(bucket_id, raw_label)``, in tidy form."""
    return raw.select("bucket_id", clean_label("raw_label").alias("label"))


def coalesce_labels(external: DataFrame, fallback: DataFrame) -> DataFrame:
    """The external label of a bucket, or the fallback where that is missing or empty."""
    given = external.select("bucket_id", F.nullif("label", F.lit("")).alias("given"))
    return fallback.join(given, "bucket_id", "left").select(
        "bucket_id", F.coalesce("given", "label").alias("label")
    )


def label_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Every bucket with its label; unlabelled ones are named by their id."""
    return buckets.join(labels.select("bucket_id", "label"), "bucket_id", "left").select(
        "bucket_id", "count", F.coalesce("label", default_label("bucket_id")).alias("label")
    )


def _classes(tokens: DataFrame) -> DataFrame:
    """Labels ``(label, tokens)`` with their ``common`` tokens, which other labels have too, and how many are ``lonely``.

    A lonely token is shared with no label and counts in the size only, so labels with the same common tokens and as many
    lonely ones are a class: each is as much like any label outside as the others are.
    """
    words = tokens.select("label", F.explode("tokens").alias("token"))
    uses = words.groupBy("token").agg(F.count(F.lit(1)).alias("uses"), F.min("label").alias("label"))
    lonely = uses.where("uses = 1").groupBy("label").agg(F.collect_list("token").alias("lonely"))
    of_label = F.coalesce("lonely", F.array().cast("array<string>"))
    return (
        tokens.join(lonely, "label", "left")
        .withColumn("common", F.array_sort(F.array_except("tokens", of_label)))
        .withColumn("lonely", F.size("tokens") - F.size("common"))
    )


def _class_key() -> Column:
    return F.concat_ws(" ", F.array_join("common", " "), F.col("lonely").cast("string"))


def _own_likeness() -> Column:
    """How much two labels of a class are alike."""
    n = F.size("common")
    return F.when(n > 0, n / (n + 2 * F.col("lonely"))).otherwise(F.lit(0.0))


def _join_keys(tokens: DataFrame, threshold: float) -> DataFrame:
    """Keys at least one of which two labels share if their similarity reaches ``threshold``.

    Prefix filtering by size: labels of ``a`` and ``b`` tokens must share ``t / (1 + t) * (a + b)`` of them,
    so it is enough to compare all but that many, less one, of each, the rarest first; lonely tokens go before all others
    and are no keys. Common tokens are keys only between sizes where sharing them alone makes two labels similar. ``pos``
    is the token's place and ``needed`` how many the two must share. The ``label`` may stand for a class of them;
    then ``tokens`` are the common ones and a column tells how many are ``lonely``.
    """
    if "lonely" not in tokens.columns:
        tokens = tokens.withColumn("lonely", F.lit(0))
    words = tokens.select("label", F.explode("tokens").alias("token"))
    rarity = words.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    ordered = (
        words.join(rarity, "token")
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("uses", "token"))).alias("rare"))
        .join(tokens.select("label", "lonely"), "label")
        .withColumn("own", F.size("rare") + F.col("lonely"))
    )
    t = F.lit(float(threshold))
    sizes = F.sequence(
        F.ceil(t * F.col("own") - 1e-9).cast("int"), F.floor(F.col("own") / t + 1e-9).cast("int")
    )
    longest = tokens.agg(F.max(F.size("tokens") + F.col("lonely"))).scalar()
    needed = F.greatest(F.ceil(t / (1 + t) * (F.col("own") + F.col("other")) - 1e-9), F.lit(1))
    prefix = F.slice("rare", F.lit(1), F.greatest(F.col("own") - needed + 1 - F.col("lonely"), F.lit(0)).cast("int"))
    of_label = F.transform("rare", lambda r: r["token"])
    return (
        ordered.withColumn("other", F.explode(sizes))
        .where(F.col("other").between(1, longest))
        .select("label", "own", "other", "lonely", needed.cast("int").alias("needed"), of_label.alias("tokens"), F.posexplode(prefix).alias("pos", "rare"))
        .select("label", "own", "other", "needed", "tokens", (F.col("pos") + F.col("lonely")).alias("pos"), F.col("rare.token").alias("token"))
    )


def _settle(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _blocked(keys: DataFrame, hot_rows: int) -> DataFrame:
    """Keys with the block of their row. Rows of one key meet one another, so of a hot key every block meets every other in
    a place of its own."""
    group = ("token", "lo", "hi")
    met = keys.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    sizes = met.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    return with_blocks(met, hot_keys(sizes, group, hot_rows), group).withColumn("block", own_block("label"))


def _shared_over_all(a: str, b: str) -> Column:
    shared = F.size(F.array_intersect(f"{a}.tokens", f"{b}.tokens"))
    return shared / (F.col(f"{a}.own") + F.col(f"{b}.own") - shared)


def _alike(a: str, b: str, threshold: float) -> Column:
    """Whether rows of one key are similar. Counting from the place of the first token they share, the shorter rest bounds
    what they can share at all; that token brings every similar pair together."""
    rest = lambda side: F.col(f"{side}.own") - F.col(f"{side}.pos")
    return (F.least(rest(a), rest(b)) >= F.col(f"{a}.needed")) & (_shared_over_all(a, b) >= threshold)


def _on_key(a: str, b: str, *also: str) -> Column:
    on = F.lit(True)
    for c in ("token", "lo", "hi", *also):
        on = on & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return on & (F.col(f"{a}.own") == F.col(f"{b}.other")) & (F.col(f"{a}.other") == F.col(f"{b}.own"))


def similar_labels(labels: DataFrame, threshold: float = 0.5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of different labels whose token sets are at least ``threshold`` alike, each pair once.

    The threshold must be above 0; at 0 every label is like every other, which no list of pairs should
    spell out. Classes of labels are compared in place of labels, and pairs of them spelt out at the end. A token that
    very many classes share is compared block by block, from ``hot_rows`` on.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    tokens = labels.select("label").distinct().withColumn("tokens", label_tokens("label")).where(F.size("tokens") > 0)
    members = _settle(_classes(tokens).select("label", "common", "lonely", _class_key().alias("class")), "labels")
    sizes = members.groupBy("class").agg(F.first("common").alias("common"), F.first("lonely").alias("lonely"), F.count(F.lit(1)).alias("size"))
    classes = _settle(sizes, "label-classes")
    keys = _blocked(_settle(_join_keys(classes.withColumnsRenamed({"class": "label", "common": "tokens"}), threshold), "label-keys"), hot_rows)
    a = keys.withColumn("there", every_block()).alias("a")
    b = keys.withColumnRenamed("block", "there").withColumn("block", every_block()).alias("b")
    in_order = F.col("a.label") < F.col("b.label")
    unlike = (
        a.join(b, _on_key("a", "b", "block", "there") & in_order & _alike("a", "b", threshold))
        .select(F.col("a.label").alias("class_a"), F.col("b.label").alias("class_b"), _shared_over_all("a", "b").alias("jaccard"))
        .distinct()
    )
    within = classes.where(F.col("size") > 1).select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), _own_likeness().alias("jaccard"))
    pairs = unlike.unionByName(within.where(F.col("jaccard") >= threshold))
    hot = hot_keys(classes, ("class",), hot_rows)
    blocks = with_blocks(members, hot, ("class",)).groupBy("class", own_block("label").alias("block")).agg(F.collect_list("label").alias("labels"))
    blocks = _settle(blocks, "label-blocks")
    for side in "ab":
        pairs = pairs.join(blocks.toDF(f"class_{side}", f"block_{side}", f"labels_{side}"), f"class_{side}")
    apart = F.col("class_a") != F.col("class_b")
    told = (
        pairs.repartition("class_a", "block_a", "class_b", "block_b")
        .select(apart.alias("apart"), "jaccard", "labels_b", F.explode("labels_a").alias("one"))
        .select("apart", "jaccard", "one", F.explode("labels_b").alias("two"))
        .where(F.col("apart") | (F.col("one") < F.col("two")))
    )
    return told.select(F.least("one", "two").alias("label_a"), F.greatest("one", "two").alias("label_b"), "jaccard")


def _fold(ranked: DataFrame, threshold: float) -> DataFrame:
    """Group at most ``GROUP_BLOCK`` labels, held in one row, in the order of their rank."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "label", label_tokens("label").alias("tokens"))))

    def step(groups: Column, item: Column) -> Column:
        leads = F.filter(
            groups,
            lambda g: (g["label"] == g["leader"]) & (jaccard(g["tokens"], item["tokens"]) >= threshold),
        )
        leader = F.when(F.size(leads) > 0, F.get(leads, F.lit(0))["label"]).otherwise(item["label"])
        entry = F.struct(item["label"].alias("label"), leader.alias("leader"), item["tokens"].alias("tokens"))
        return F.concat(groups, F.array(entry))

    bounded = F.when(F.size("items") <= GROUP_BLOCK, F.col("items")).otherwise(
        F.raise_error(F.lit("too many labels for one row; group them with small=False"))
    )
    start = F.array().cast("array<struct<label:string,leader:string,tokens:array<string>>>")
    return (
        ranked.agg(listed.alias("items"))
        .select(F.explode(F.aggregate(bounded, start, step)).alias("g"))
        .select("g.label", "g.leader")
    )


def _grouping_by_rounds(ranked: DataFrame, threshold: float, window: int, hot_rows: int) -> DataFrame:
    """The same grouping for any number of labels: the leaders are the first maximal set of unlike labels in the order of
    rank, found in rounds that settle all labels at once.

    In a round every open label leads that is like no open label before it; those like a leader are open no more. The
    first open label always leads, and unlike labels all lead in the first round. Of a key that many labels share, the
    first ``window`` are compared in a round, and a label beyond them waits; so no round spells out the pairs of a dense
    group. The window doubles with each round, up to ``GROUP_WINDOW``, so that rounds stay few. Labels with the same tokens
    go through the rounds as one, and so does a class of labels that are like one another: all are like the same leaders,
    or the first of them leads the others. In the end each label joins the first leader it
    is like. Labels never come to the driver, and every round is written out, so a lost executor repeats one.
    """
    spark = ranked.sparkSession
    place = F.struct("rank", "label")
    rows = _settle(ranked.select("label", "rank", F.sort_array(label_tokens("label")).alias("tokens")), "labels")
    sets = rows.where(F.size("tokens") > 0).groupBy("tokens").agg(F.min(place).alias("first"))
    sets = _settle(sets.select("tokens", "first.rank", "first.label"), "label-sets")
    node = F.when(_own_likeness() >= threshold, F.concat(F.lit("="), _class_key())).otherwise(F.concat(F.lit(":"), "label"))
    sets = _settle(_classes(sets).withColumn("node", node), "label-classes")
    nodes = sets.groupBy("node").agg(F.min(place).alias("first"), F.first("common").alias("common"), F.first("lonely").alias("lonely"))
    nodes = _settle(nodes.select("node", "common", "lonely", "first.rank", "first.label"), "label-nodes")
    keys = _settle(_join_keys(nodes.withColumnRenamed("common", "tokens"), threshold), "label-keys")
    of_label = keys.groupBy("label").agg(F.count(F.lit(1)).alias("n_keys"))
    about = nodes.select("label", "rank").join(of_label, "label")
    keys = _settle(_blocked(keys, hot_rows).join(about, "label"), "label-keys")
    leaders_path, still_open = scratch_path(spark, "label-leaders"), keys
    in_key = Window.partitionBy("token", "lo", "hi").orderBy("rank", "label")
    before = F.struct("a.rank", "a.label") < F.struct("b.rank", "b.label")
    while True:
        first = _settle(still_open.withColumn("nth", F.row_number().over(in_key)).where(F.col("nth") <= window).drop("nth"), "label-window")
        beaten = (
            first.alias("a")
            .join(first.alias("b"), _on_key("a", "b") & before & _alike("a", "b", threshold))
            .select(F.col("b.label").alias("label"))
        )
        seen = first.groupBy("label", "n_keys").agg(F.count(F.lit(1)).alias("n")).where("n = n_keys")
        leaders = _settle(seen.select("label").join(beaten, "label", "left_anti"), "label-leaders")
        leaders.write.mode("append").parquet(leaders_path)
        leading = first.join(leaders, "label", "left_semi").withColumn("block", every_block())
        members = (
            still_open.alias("a")
            .join(leading.alias("b"), _on_key("a", "b", "block") & (F.col("a.label") != F.col("b.label")) & _alike("a", "b", threshold))
            .select(F.col("a.label").alias("label"))
        )
        still_open = _settle(still_open.join(leaders.unionByName(members), "label", "left_anti"), "labels-open")
        if still_open.isEmpty():
            break
        window = max(window, min(2 * window, GROUP_WINDOW))
    leaders = spark.read.schema("label string").parquet(leaders_path)
    leading = keys.join(leaders, "label", "left_semi").withColumn("block", every_block())
    first_alike = (
        keys.join(leaders, "label", "left_anti")
        .alias("a")
        .join(leading.alias("b"), _on_key("a", "b", "block") & _alike("a", "b", threshold))
        .groupBy(F.col("a.label").alias("label"))
        .agg(F.min(F.struct("b.rank", "b.label")).alias("lead"))
    )
    of_node = nodes.join(first_alike, "label", "left").select("node", F.coalesce("lead.label", "label").alias("leader"))
    of_set = sets.select("tokens", "node").join(of_node, "node")
    alike = F.lit(threshold <= 1)  # beyond 1 not even equal token sets are alike
    return rows.join(of_set, "tokens", "left").select("label", F.when(alike, F.coalesce("leader", "label")).otherwise(F.col("label")).alias("leader"))


def group_labels(
    ranked_labels: DataFrame,
    threshold: float = 0.5,
    small: bool | None = None,
    block: int = GROUP_WINDOW,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give every label a leader: the first one, by ``rank``, that it is like, or itself.

    A label is compared with leaders only. Few labels are grouped inside one row, which ``small=True``
    promises (and the plan checks); otherwise they are counted first, and many are grouped in rounds, each of
    which looks at the first ``block`` open labels of every key.
    """
    ranked = ranked_labels.select("label", "rank")
    if threshold <= 0:
        # Everything is like the first label.
        first = ranked.agg(F.min_by("label", "rank")).scalar()
        return ranked.select("label", first.alias("leader"))
    if small is None:
        small = ranked.limit(GROUP_BLOCK + 1).count() <= GROUP_BLOCK
    return _fold(ranked, threshold) if small else _grouping_by_rounds(ranked, threshold, block, hot_rows)
