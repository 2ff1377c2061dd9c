"""The operators of this subpackage on the given tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lshthemes.llm import bpe, quality_rules
from lshthemes.llm.collocations import collocations
from lshthemes.llm.exact_dedup import exact_groups
from lshthemes.llm.resampling import resample
from lshthemes.llm.sharding import assign_shards
from lshthemes.llm.simhash import near_groups
from lshthemes.llm.spelling import spelling_variants
from lshthemes.llm.suffix_index import cut_repeats
from lshthemes.llm.templates import benchmark_hits
from lshthemes.llm.token_records import token_layout, write_token_records
from lshthemes.llm.toxicity import THRESHOLD, toxicity, train_on
from lshthemes.llm.warc import read_warc, write_warc
from lshthemes.sources.scratch import scratch_path

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Ids of each text, and the text decoded from them, as digests."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    decoded = docs.select("doc_id", bpe.round_trip(path, pattern)("text").alias("bpe")).select("doc_id", "bpe.*")
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def op2_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-records")
    index = write_token_records(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY))
    return token_layout(spark, index)


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_suffix_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_warc(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def held_out(id: str = "doc_id") -> Column:
    """Documents whose labels are never learnt from."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    machine = train_on(docs, labels.where(~held_out()))
    scored = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), toxicity(machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("is_target"))
    return resample(_table(spark, sf_dir, "documents"), target)


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), shards=40)


def op11_reduced_alphabet_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_rules.train_on(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs, model).drop("probability")


def op13_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES = (
    op1_bpe_round_trip,
    op2_content_sort_dedup,
    op3_token_records,
    op4_template_decontamination,
    op5_suffix_index_dedup,
    op6_warc_round_trip,
    op7_simhash_groups,
    op8_toxicity,
    op9_importance_resampling,
    op10_jump_shards,
    op11_reduced_alphabet_variants,
    op12_quality_rules,
    op13_phrase_graph,
)

ORACLE = {
    "op2_content_sort_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op6_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS head FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM g""",
    "op13_phrase_graph": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram
  FROM w, (VALUES (1), (2), (3)) s(k)),
f AS MATERIALIZED (SELECT lang, k, gram, concat_ws(' ', lang, gram) AS key, count(*) AS f FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, k, gram AS phrase, string_split(gram, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= 10),
parts AS MATERIALIZED (
  SELECT lang, k, phrase, a, j, concat_ws(' ', lang, array_to_string(ws[1:j], ' ')) AS one,
         concat_ws(' ', lang, array_to_string(ws[j + 1:], ' ')) AS two
  FROM c, (VALUES (1), (2)) s(j) WHERE j < k),
cuts AS (
  SELECT p.lang, p.k, phrase, a, j, x.f AS l, y.f AS r, (1000000 * a::HUGEINT * a) // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN f x ON x.key = p.one JOIN f y ON y.key = p.two),
scored AS (
  SELECT lang, k, phrase, a, first(l ORDER BY score, j) AS l, first(r ORDER BY score, j) AS r, min(score) AS score
  FROM cuts GROUP BY ALL),
held AS (
  SELECT lang, pair, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS pair FROM c WHERE k = 3)
  GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN held h ON h.lang = s.lang AND h.pair = s.phrase
  WHERE s.k = 3 OR h.most IS NULL OR 100 * h.most < 50 * s.a),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
