"""SQL for DuckDB that answers the registered queries another way, over the same whole tables."""

from __future__ import annotations

from lshthemes.functions.hashing import hyperplanes, probe_masks
from lshthemes.operators.labels import KEYWORDS
from lshthemes.registry.tables import DIM, KEYWORDS_FOUND, WORD_PARTS

# Blanks that Unicode knows, for patterns in DuckDB.
_BLANK = r"[\x1c-\x1f\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _floats(values) -> str:
    return "[" + ",".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def _planes(dim: int, first: int = 0, last: int = 16) -> str:
    planes = hyperplanes(dim, last)[first:]
    return ", ".join(f"({i}, {_floats(p)})" for i, p in enumerate(planes))


def _hashed(name: str, source: str, dim: int = DIM) -> str:
    """CTE ``name(row_id, hash)`` over ``source(row_id, embedding)``."""
    return f"""{name} AS (
        SELECT row_id, sum(CASE WHEN isnan(d) OR d <= 0 THEN 0 ELSE 1::BIGINT << bit END)::BIGINT AS hash
        FROM (SELECT v.row_id, p.bit, list_dot_product(v.embedding::DOUBLE[], p.plane) AS d
              FROM {source} v CROSS JOIN (VALUES {_planes(dim)}) p(bit, plane))
        GROUP BY row_id)"""


def _encoded(name: str, table: str, key: str, dim: int = DIM, id_name: str = "row_id") -> str:
    """CTE ``name(id, embedding)``: signed counts of hashed words."""
    return f"""{name}_words AS (
        SELECT {key} AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM {table}),
    {name}_slots AS (
        SELECT id, x % {dim} AS slot, sum(CASE WHEN (x // {dim}) % 2 = 0 THEN 1 ELSE -1 END) AS weight
        FROM (SELECT id, ('0x' || left(md5(word), 8))::BIGINT AS x FROM {name}_words) GROUP BY ALL),
    {name} AS (
        SELECT b.{key} AS {id_name}, list(coalesce(s.weight, 0)::DOUBLE ORDER BY g.slot) AS embedding
        FROM {table} b CROSS JOIN range({dim}) g(slot)
        LEFT JOIN {name}_slots s ON s.id = b.{key} AND s.slot = g.slot
        GROUP BY b.{key})"""


_VECTORS = "vec AS (SELECT vec_id AS row_id, embedding FROM embeddings)"
_VECTOR_HASH = f"{_VECTORS}, {_hashed('hashed', 'vec')}"
_VECTOR_INDEX = f"{_VECTOR_HASH}, ix AS (SELECT hash & 255 AS bucket_id, hash, row_id FROM hashed)"
_SIZES = "sizes AS (SELECT bucket_id, count(row_id) AS size FROM ix GROUP BY bucket_id)"

_DOCS = _encoded("doc", "documents", "doc_id")
_ASKED = _encoded("asked", "benchmark", "item_id", id_name="query_id")
_DOC_INDEX = f"""{_DOCS}, {_hashed('doc_hash', 'doc')},
    ix AS (SELECT hash & 255 AS bucket_id, (hash >> 8) & 15 AS level1, hash, row_id FROM doc_hash)"""
_ASKED_HASH = f"""{_ASKED}, asked_row AS (SELECT query_id AS row_id, embedding FROM asked),
    {_hashed('asked_hash', 'asked_row')},
    q AS (SELECT a.query_id, a.embedding, h.hash & 255 AS bucket_id, (h.hash >> 8) & 15 AS level1
          FROM asked a JOIN asked_hash h ON h.row_id = a.query_id)"""
_SEARCH = f"{_DOC_INDEX}, {_SIZES}, {_ASKED_HASH}"
_MASKS = f"masks(mask) AS (VALUES {', '.join(f'({m})' for m in probe_masks())})"
_PROBES = (
    f"{_MASKS}, probes AS (SELECT q.query_id, q.bucket_id, xor(q.bucket_id, m.mask) AS probe_bucket "
    "FROM q CROSS JOIN masks m)"
)


def _cosine(a: str, b: str) -> str:
    norms = f"sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))"
    return f"CASE WHEN {norms} = 0 THEN NULL ELSE list_dot_product({a}, {b}) / ({norms}) END"


def _ranked(pairs: str, k: int) -> str:
    """Top ``k`` of the pairs ``(query_id, row_id)``, with titles."""
    return f"""scored AS (
        SELECT p.query_id, p.row_id, {_cosine('q.embedding', 'd.embedding')} AS similarity
        FROM ({pairs}) p JOIN q USING (query_id) JOIN doc d ON d.row_id = p.row_id),
    best AS (
        SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY round(similarity, 9) DESC NULLS LAST, row_id) AS rank FROM scored),
    found AS (
        SELECT b.query_id, b.rank, b.row_id, b.row_id::VARCHAR AS item_id, left(t.text, 100) AS title,
               round(b.similarity, 6) AS similarity
        FROM best b JOIN documents t ON t.doc_id = b.row_id WHERE b.rank <= {k})"""


_ALL_PAIRS = "SELECT q.query_id, d.row_id FROM q CROSS JOIN doc d"
_BUCKET_PAIRS = "SELECT q.query_id, ix.row_id FROM q JOIN ix ON ix.bucket_id = q.bucket_id"
_PROBE_PAIRS = "SELECT p.query_id, ix.row_id FROM probes p JOIN ix ON ix.bucket_id = p.probe_bucket"
# The density rule told over the candidates themselves: count, then filter, then fall back.
_DENSITY_PAIRS = """
    SELECT query_id, row_id FROM (
        SELECT q.query_id, ix.row_id, ix.level1 = q.level1 AS same,
               count(*) OVER (PARTITION BY q.query_id) AS size,
               count(*) FILTER (WHERE ix.level1 = q.level1) OVER (PARTITION BY q.query_id) AS n_same
        FROM q JOIN ix ON ix.bucket_id = q.bucket_id)
    WHERE size < 10 OR n_same = 0 OR same"""


def _search(pairs: str, k: int, probes: bool = False) -> str:
    extra = f", {_PROBES}" if probes else ""
    return f"WITH {_SEARCH}{extra}, {_ranked(pairs, k)} SELECT * FROM found"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _labels(lexicon: tuple[str, ...], sample: int = 10) -> str:
    """CTEs up to ``labels(bucket_id, label)`` for all buckets of the documents."""
    rows = ", ".join(
        f"({i}, {_quoted(w)}, {_quoted(w.title())})" for i, w in enumerate(lexicon)
    )
    return f"""{_DOC_INDEX}, {_SIZES},
    items AS (
        SELECT ix.bucket_id, ix.row_id, d.text,
               row_number() OVER (PARTITION BY ix.bucket_id ORDER BY ix.row_id) AS pos
        FROM ix JOIN documents d ON d.doc_id = ix.row_id),
    texts AS (
        SELECT bucket_id, string_agg(lower(text), ' ' ORDER BY pos) AS text
        FROM items WHERE pos <= {sample} GROUP BY bucket_id),
    lexicon(place, word, title) AS (VALUES {rows}),
    counts AS (
        SELECT bucket_id, place, word, title,
               ((length(text) - length(replace(text, word, ''))) // length(word))::BIGINT AS n
        FROM texts CROSS JOIN lexicon),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY n DESC, place) AS rank FROM counts),
    labels AS (
        SELECT bucket_id,
               coalesce(string_agg(title, ' + ' ORDER BY rank) FILTER (WHERE n > 0 AND rank <= 2),
                        'Theme ' || bucket_id) AS label
        FROM ranked GROUP BY bucket_id)"""


def _clean(raw: str) -> str:
    trimmed = f"regexp_replace({raw}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
    bare = f"regexp_replace(replace({trimmed}, '*', ''), '^[\"'']+|[\"'']+$', '', 'g')"
    line = f"split_part({bare}, chr(10), 1)"
    return f"CASE WHEN length({line}) > 50 THEN left({line}, 47) || '...' ELSE {line} END"


_GIVEN = f"""given AS (
    SELECT item_id AS bucket_id, {_clean("'  **\"' || text || '\"** ' || chr(10)")} AS label FROM benchmark)"""


def _tokens(label: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({label}), '[\\p{{L}}\\p{{N}}_]+'))"


def _jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
        f"ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END"
    )


def _groups(threshold: float) -> str:
    """CTEs from ``ranked_labels(label, place)`` to ``grouped(label, leader)``: one step per label."""
    return f"""listed AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY place) AS i, label, {_tokens('label')} AS tokens FROM ranked_labels),
    near AS MATERIALIZED (
        SELECT a.i, list(b.i ORDER BY b.i) AS before FROM listed a JOIN listed b ON b.i < a.i
        WHERE {_jaccard('a.tokens', 'b.tokens')} >= {threshold} GROUP BY a.i),
    steps AS MATERIALIZED (SELECT l.i, coalesce(n.before, []::BIGINT[]) AS before FROM listed l LEFT JOIN near n USING (i)),
    walk(i, leaders, leader) AS (
        SELECT 0::BIGINT, []::BIGINT[], 0::BIGINT
        UNION ALL
        SELECT s.i,
               CASE WHEN len(list_intersect(w.leaders, s.before)) = 0
                    THEN list_append(w.leaders, s.i) ELSE w.leaders END,
               coalesce(list_min(list_intersect(w.leaders, s.before)), s.i)
        FROM walk w JOIN steps s ON s.i = w.i + 1),
    grouped AS (
        SELECT l.label, lead.label AS leader
        FROM walk w JOIN listed l ON l.i = w.i JOIN listed lead ON lead.i = w.leader)"""


def _merge(lexicon: tuple[str, ...], threshold: float) -> str:
    return f"""WITH RECURSIVE {_labels(lexicon)},
    top AS (SELECT bucket_id, size AS count FROM sizes WHERE size >= 5 ORDER BY size DESC, bucket_id LIMIT 10),
    labelled AS (
        SELECT t.bucket_id, t.count, coalesce(l.label, 'Theme ' || t.bucket_id) AS label
        FROM top t LEFT JOIN labels l USING (bucket_id)),
    ranked_labels AS (
        SELECT label, min((-count, bucket_id)) AS place FROM labelled GROUP BY label),
    {_groups(threshold)},
    names AS (SELECT leader, arg_max(label, (length(label), label)) AS theme FROM grouped GROUP BY leader),
    members AS (
        SELECT b.*, n.theme,
               (SELECT count(*) FROM items i WHERE i.bucket_id = b.bucket_id) AS n_items
        FROM labelled b JOIN grouped g USING (label) JOIN names n USING (leader)),
    themes AS (
        SELECT theme AS label, list(DISTINCT label ORDER BY label) AS originals,
               list(bucket_id ORDER BY count DESC, bucket_id) AS ids,
               string_agg(bucket_id || ':' || count, ',' ORDER BY count DESC, bucket_id) AS buckets,
               sum(count)::BIGINT AS total_count, sum(n_items)::BIGINT AS n_items
        FROM members GROUP BY theme)"""


def _hex(value: str) -> str:
    return f"'0x' || lower(to_hex({value}))"


_THEME_ROWS = f"""
    SELECT label, array_to_string(originals, '|') AS original_labels, buckets, total_count, n_items,
           len(originals) > 1 AS is_merged,
           CASE WHEN len(ids) > 1
                THEN len(ids) || ' buckets: '
                     || array_to_string(list_transform(ids[1:3], lambda b: {_hex('b')}), ', ')
                     || CASE WHEN len(ids) > 3 THEN ', +' || (len(ids) - 3) || ' more' ELSE '' END
                ELSE 'bucket ' || {_hex('ids[1]')} END AS bucket_summary
    FROM themes"""


def _metadata() -> str:
    parts, selects = [], []
    for name, about, dim, bits in (
        ("words-16", "Smallest - 16 slots", 16, 8),
        ("words-32", "Balanced - 32 slots", 32, 8),
        ("words-64", "Finest", 64, 10),
        ("given", "As given - 64 slots", 64, 10),
    ):
        key = name.replace("-", "_")
        if name == "given":
            parts += [_VECTORS, _hashed("given_hash", "vec")]
        else:
            parts += [_encoded(key, "documents", "doc_id", dim), _hashed(f"{key}_hash", key, dim)]
        selects.append(
            f"""SELECT '{name}' AS model_name, '{about}' AS description, {dim}::BIGINT AS dimension,
                {bits}::BIGINT AS lsh_bits, count(*)::BIGINT AS num_buckets,
                round(count(*) / 256.0, 6) AS load_factor,
                count(*) FILTER (WHERE n >= 5)::BIGINT AS dense_buckets
            FROM (SELECT hash & {(1 << bits) - 1} AS b, count(*) AS n FROM {key}_hash GROUP BY b)"""
        )
    return f"WITH {', '.join(parts)}, metadata AS ({' UNION ALL '.join(selects)})"


def _corpus(title: str, display: str, preview: str, category: str, score: str, author: str) -> str:
    return f"""SELECT doc_id AS row_id, doc_id::VARCHAR AS item_id, {title} AS title, {display} AS display_text,
        {preview} AS preview, {category} AS category, {score}::DOUBLE AS score, {author} AS author FROM documents"""


_HEADLINE = "source || chr(10) || chr(10) || left(text, 200) || '...'"
_NO_TEXT = "NULL::VARCHAR"


def oracle_sql() -> dict[str, str]:
    plain = {}
    plain["vector_hash"] = (
        f"WITH {_VECTOR_HASH} SELECT row_id, hash, hash & 255 AS bucket_id, (hash >> 8) & 15 AS level1 FROM hashed"
    )
    plain["encode_documents"] = (
        f"WITH {_DOCS} SELECT row_id, "
        "array_to_string(list_transform(embedding, lambda x: x::BIGINT::VARCHAR), ',') AS embedding FROM doc"
    )
    plain["vector_cosine"] = f"""WITH {_VECTORS}, {_DOCS}
        SELECT row_id, round({_cosine('a', 'b')}, 6) AS similarity
        FROM (SELECT v.row_id, v.embedding::DOUBLE[] AS a, d.embedding AS b FROM vec v JOIN doc d USING (row_id))"""
    plain["probe_lists"] = f"WITH {_ASKED_HASH}, {_PROBES} SELECT * FROM probes"

    plain["corpus_tweets"] = _corpus(
        "left(text, 100)", "text", "CASE WHEN length(text) > 100 THEN text END",
        _NO_TEXT, "NULL", _NO_TEXT,
    )
    plain["corpus_papers"] = _corpus(
        "source", _HEADLINE,
        "CASE WHEN length(text) > 500 THEN left(text, 500) || '...' WHEN length(text) > 0 THEN text END",
        "lang", "NULL", _NO_TEXT,
    )
    plain["corpus_posts"] = _corpus(
        "source", _HEADLINE, "CASE WHEN length(text) > 0 AND text <> source THEN text END",
        "lang", "n_chars", "source",
    )
    plain["corpus_profile"] = " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, count(*) AS n_rows FROM {n}"
        for n in ("documents", "embeddings", "benchmark", "pages", "conversations")
    )

    dense = "SELECT bucket_id, size AS count FROM sizes WHERE size >= 5"
    plain["dense_buckets"] = f"WITH {_VECTOR_INDEX}, {_SIZES} {dense}"
    plain["stored_dense_buckets"] = plain["manifest_dense_buckets"] = plain["dense_buckets"]
    plain["top_buckets"] = (
        f"WITH {_VECTOR_INDEX}, {_SIZES} {dense} ORDER BY size DESC, bucket_id LIMIT 10"
    )
    plain["stored_index"] = f"""WITH {_VECTOR_INDEX}
        SELECT bucket_id, hash, 'embeddings' AS file_path, row_id, 31::BIGINT AS seed, 64::BIGINT AS dim,
               8::BIGINT AS bits FROM ix"""
    plain["partitioned_index"] = plain["stored_index"]
    plain["index_stats"] = plain["manifest_stats"] = f"""WITH {_VECTOR_INDEX}, {_SIZES}
        SELECT sum(size)::BIGINT AS total_entries, count(*) AS num_buckets,
               round(avg(size), 6) AS avg_bucket_size, round(count(*) / 256.0, 6)::DOUBLE AS load_factor FROM sizes"""
    plain["size_histogram"] = (
        f"WITH {_VECTOR_INDEX}, {_SIZES} SELECT size, count(bucket_id) AS count FROM sizes GROUP BY size"
    )
    plain["density_stats"] = f"""WITH {_DOC_INDEX}, {_SIZES}
        SELECT count(*) AS num_buckets, round(avg(size), 6) AS avg_size, max(size) AS max_size,
               count(*) FILTER (WHERE size >= 10) AS dense_buckets,
               count(*) FILTER (WHERE size < 10) AS sparse_buckets FROM sizes"""
    plain["inverted_lists"] = f"""WITH {_VECTOR_INDEX}
        SELECT bucket_id, row_id // 100 AS chunk, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS row_ids
        FROM ix GROUP BY bucket_id, chunk"""
    plain["dangling_entries"] = f"""WITH {_VECTOR_INDEX}
        SELECT bucket_id, row_id FROM ix WHERE row_id NOT IN (SELECT doc_id FROM labels)"""
    plain["index_health"] = f"""WITH {_VECTOR_INDEX}
        SELECT (SELECT count(*) FROM ix WHERE row_id IS NULL) AS null_rows,
               (SELECT count(*) FROM ix WHERE row_id NOT IN (SELECT doc_id FROM labels)) AS dangling_rows,
               (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS bad_vectors"""
    plain["merged_indexes"] = f"""WITH {_VECTOR_HASH}, {_DOCS}, {_hashed('doc_hash', 'doc')}
        SELECT bucket_id, count(*) AS count, count(DISTINCT part) AS parts FROM (
            SELECT hash & 255 AS bucket_id, 1 AS part FROM hashed
            UNION ALL SELECT hash & 255, 2 FROM doc_hash) GROUP BY bucket_id"""

    joined = "FROM ix JOIN documents d ON d.doc_id = ix.row_id"
    plain["bucket_items"] = f"""WITH {_DOC_INDEX}
        SELECT bucket_id, row_id, row_id::VARCHAR AS item_id, text AS display_text {joined}"""
    plain["top_bucket_items"] = f"""WITH {_DOC_INDEX}, {_SIZES},
        top AS ({dense} ORDER BY size DESC, bucket_id LIMIT 10)
        SELECT bucket_id, row_id, row_id::VARCHAR AS item_id, left(text, 100) AS title {joined}
        WHERE bucket_id IN (SELECT bucket_id FROM top)"""
    plain["sample_items"] = f"""WITH {_DOC_INDEX}
        SELECT * FROM (
            SELECT bucket_id, row_number() OVER (PARTITION BY bucket_id ORDER BY row_id) AS pos, row_id,
                   row_id::VARCHAR AS item_id {joined}) WHERE pos <= 3"""

    plain["search_exact"] = _search(_ALL_PAIRS, 10)
    plain["search_vectors"] = """WITH pairs AS (
            SELECT a.vec_id AS query_id, b.vec_id AS row_id,
                   list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
            FROM embeddings a CROSS JOIN embeddings b),
        best AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, row_id) AS rank FROM pairs)
        SELECT query_id, rank, row_id, round(s, 6) AS similarity FROM best WHERE rank <= 5"""
    plain["fetch_documents"] = f"""WITH {_SEARCH}, {_ranked(_ALL_PAIRS, 5)}
        SELECT f.query_id, f.rank, f.item_id, d.text AS body,
               CASE WHEN length(d.text) > 100 THEN d.text END AS preview
        FROM found f JOIN documents d ON d.doc_id = f.row_id"""
    plain["lsh_search"] = _search(_BUCKET_PAIRS, 10)
    plain["density_search"] = _search(_DENSITY_PAIRS, 5)
    plain["search_strategy"] = f"""WITH {_SEARCH},
        c AS (
            SELECT q.query_id, count(*) AS size, count(*) FILTER (WHERE ix.level1 = q.level1) AS same
            FROM q JOIN ix ON ix.bucket_id = q.bucket_id GROUP BY q.query_id)
        SELECT q.query_id, q.bucket_id,
               CASE WHEN size IS NULL THEN 'empty' WHEN size >= 10 THEN 'refined' ELSE 'sparse' END AS status,
               size::DOUBLE AS bucket_size, size::DOUBLE AS original_candidates,
               (CASE WHEN size >= 10 THEN q.level1 END)::DOUBLE AS level_1_hash,
               (CASE WHEN size >= 10 THEN same END)::DOUBLE AS refined_candidates,
               (CASE WHEN size >= 10 AND same > 0 THEN same ELSE size END)::DOUBLE AS final_candidates,
               coalesce(size >= 10 AND same = 0, false) AS fell_back,
               CASE WHEN size >= 10 THEN round((1 - same / size) * 100, 6) END AS reduction_pct
        FROM q LEFT JOIN c USING (query_id)"""
    plain["multi_probe_search"] = _search(_PROBE_PAIRS, 5, probes=True)
    plain["multi_probe_stats"] = f"""WITH {_SEARCH}, {_PROBES}, total AS (SELECT count(*) AS n FROM ix),
        c AS (
            SELECT p.query_id, count(*) FILTER (WHERE ix.bucket_id = p.bucket_id) AS own, count(ix.row_id) AS found,
                   count(DISTINCT p.probe_bucket) AS num_probes
            FROM probes p LEFT JOIN ix ON ix.bucket_id = p.probe_bucket GROUP BY p.query_id)
        SELECT query_id, own AS query_bucket_size, num_probes, found AS total_candidates,
               round(100 * found / n, 6) AS pct_candidates, round(n / greatest(found, 1), 6) AS speedup
        FROM c CROSS JOIN total"""
    plain["candidates"] = f"WITH {_SEARCH} {_BUCKET_PAIRS}"
    plain["refine_candidates"] = f"WITH {_SEARCH} {_DENSITY_PAIRS}"
    plain["multi_probe_candidates"] = f"WITH {_SEARCH}, {_PROBES} {_PROBE_PAIRS}"
    scored = f"""scored AS (
        SELECT q.query_id, d.row_id, {_cosine('q.embedding', 'd.embedding')} AS similarity FROM q CROSS JOIN doc d)"""
    order = "PARTITION BY query_id ORDER BY round(similarity, 9) DESC NULLS LAST, row_id"
    tops = ", ".join(
        f"""{mode} AS (SELECT query_id, row_id FROM (
            SELECT query_id, row_id, row_number() OVER ({order}) AS rank
            FROM scored JOIN ({pairs}) p USING (query_id, row_id)) WHERE rank <= 5)"""
        for mode, pairs in (
            ("exact_top", _ALL_PAIRS),
            ("bucket", _BUCKET_PAIRS),
            ("density", _DENSITY_PAIRS),
            ("probes_top", _PROBE_PAIRS),
        )
    )
    plain["recall_at_k"] = f"WITH {_SEARCH}, {_PROBES}, {scored}, {tops} " + " UNION ALL ".join(
        f"""SELECT '{mode}' AS mode, e.query_id, round(count(a.row_id) / count(*), 6) AS recall
            FROM exact_top e LEFT JOIN {name} a ON a.query_id = e.query_id AND a.row_id = e.row_id
            GROUP BY e.query_id"""
        for mode, name in (("bucket", "bucket"), ("density", "density"), ("probes", "probes_top"))
    )

    plain["narrow_search"] = _search(_BUCKET_PAIRS, 10)
    plain["density_search_ids"] = plain["found_texts"] = _search(_DENSITY_PAIRS, 5)
    plain["documents_by_id"] = """SELECT doc_id::VARCHAR AS item_id, left(text, 100) AS title FROM documents
        WHERE doc_id IN (SELECT item_id FROM benchmark)"""
    plain["corpus_files"] = "SELECT count(*) AS n_rows, count(*) AS n_identities FROM documents"
    plain["loaded_model"] = f"""WITH {_DOC_INDEX}, {_SIZES} {dense}"""
    plain["principal_axes"] = "SELECT count(*) > 0 AS x_first, count(*) > 0 AS y_next FROM embeddings"

    plain["keyword_counts"] = (
        f"WITH {_labels(KEYWORDS_FOUND)} SELECT bucket_id, word AS keyword, n FROM counts"
    )
    plain["theme_labels"] = f"WITH {_labels(KEYWORDS_FOUND)} SELECT * FROM labels"
    plain["theme_labels_word_parts"] = f"WITH {_labels(WORD_PARTS)} SELECT * FROM labels"
    plain["theme_labels_default"] = f"WITH {_labels(KEYWORDS)} SELECT * FROM labels"
    plain["label_samples"] = f"""WITH {_labels(KEYWORDS_FOUND)}
        SELECT bucket_id, string_agg('- ' || left(text, 100), chr(10) ORDER BY pos) AS sample
        FROM items WHERE pos <= 5 GROUP BY bucket_id"""
    plain["clean_labels"] = f"WITH {_GIVEN} SELECT * FROM given"
    plain["coalesce_labels"] = f"""WITH {_labels(WORD_PARTS)}, {_GIVEN}
        SELECT l.bucket_id, CASE WHEN g.label <> '' THEN g.label ELSE l.label END AS label
        FROM labels l LEFT JOIN given g USING (bucket_id)"""
    plain["label_buckets"] = f"""WITH {_VECTOR_INDEX}, {_SIZES}, {_GIVEN}
        SELECT bucket_id, size AS count, coalesce(g.label, 'Theme ' || bucket_id) AS label
        FROM sizes LEFT JOIN given g USING (bucket_id)"""
    for name, threshold in (("03", 0.3), ("05", 0.5), ("10", 1.0)):
        plain[f"similar_labels_{name}"] = f"""WITH {_labels(WORD_PARTS)},
            d AS (SELECT DISTINCT label, {_tokens('label')} AS tokens FROM labels),
            pairs AS (
                SELECT a.label AS label_a, b.label AS label_b, {_jaccard('a.tokens', 'b.tokens')} AS jaccard
                FROM d a JOIN d b ON a.label < b.label)
            SELECT label_a, label_b, round(jaccard, 6) AS jaccard FROM pairs WHERE jaccard >= {threshold}"""
    plain["label_token_sets"] = (
        f"SELECT item_id, array_to_string(list_sort({_tokens('text')}), ',') AS tokens FROM benchmark"
    )
    plain["group_labels"] = f"""WITH RECURSIVE {_labels(WORD_PARTS)},
        ranked_labels AS (SELECT label, min(bucket_id) AS place FROM labels GROUP BY label),
        {_groups(0.5)} SELECT * FROM grouped"""
    plain["group_many_labels"] = f"""WITH RECURSIVE
        ranked_labels AS (SELECT url AS label, page_id AS place FROM pages),
        {_groups(0.5)} SELECT * FROM grouped"""
    plain["similar_many_labels"] = f"""WITH d AS (SELECT url AS label, {_tokens('url')} AS tokens FROM pages),
        pairs AS (
            SELECT a.label AS label_a, b.label AS label_b, {_jaccard('a.tokens', 'b.tokens')} AS jaccard
            FROM d a JOIN d b ON a.label < b.label)
        SELECT label_a, label_b, round(jaccard, 6) AS jaccard FROM pairs WHERE jaccard >= 0.6"""
    for name, lexicon, threshold in (
        ("merge_themes_03", KEYWORDS_FOUND, 0.3),
        ("merge_themes_05", KEYWORDS_FOUND, 0.5),
        ("merge_themes_10", KEYWORDS_FOUND, 1.0),
        ("merge_themes_word_parts", WORD_PARTS, 1.0),
        ("merge_themes_default", KEYWORDS, 0.3),
    ):
        plain[name] = _merge(lexicon, threshold) + _THEME_ROWS
    plain["theme_samples"] = f"""{_merge(KEYWORDS_FOUND, 0.5)},
        placed AS (
            SELECT m.theme AS label, i.bucket_id, i.row_id, i.text AS display_text,
                   row_number() OVER (PARTITION BY m.theme ORDER BY m.count DESC, m.bucket_id, i.row_id) AS pos
            FROM members m JOIN items i ON i.bucket_id = m.bucket_id)
        SELECT p.*, greatest(t.n_items - 8, 0) AS more_items
        FROM placed p JOIN themes t USING (label) WHERE pos <= 8"""

    plain["model_metadata"] = f"{_metadata()} SELECT * FROM metadata"
    plain["compare_models"] = f"{_metadata()} SELECT * EXCLUDE (description) FROM metadata"
    plain["model_info"] = f"{_metadata()} SELECT * FROM metadata WHERE model_name = 'words-64'"
    plain["model_options"] = f"""{_metadata()}
        SELECT model_name || ': ' || split_part(description, ' - ', 1) AS option, model_name FROM metadata"""

    axes = ", ".join(
        f"round(list_dot_product(v.embedding::DOUBLE[], {_floats(p)}), 6) AS {name}"
        for name, p in zip("xyz", hyperplanes(DIM, 19)[16:])
    )
    plain["map_points"] = f"""WITH {_VECTOR_INDEX}, {_SIZES}
        SELECT row_id, {axes}, d.text, {_hex('bucket_id')} AS bucket, bucket_id AS bucket_int, size AS bucket_size
        FROM vec v JOIN ix USING (row_id) JOIN sizes USING (bucket_id) LEFT JOIN documents d ON d.doc_id = row_id"""
    plain["stored_map_points"] = plain["map_points"]
    plain["map_density"] = f"""WITH {_DOC_INDEX}, {_SIZES}
        SELECT max(size) AS max_size, min(size) AS min_size, round(avg(size), 6) AS avg_size,
               count(*) FILTER (WHERE size >= 10) AS num_dense,
               round(100.0 * count(*) FILTER (WHERE size >= 10) / count(*), 6)::DOUBLE AS pct_dense,
               count(DISTINCT bucket_id) AS unique_buckets
        FROM ix JOIN sizes USING (bucket_id)"""
    plain["map_density_sketch"] = f"""WITH density AS ({plain['map_density']})
        SELECT * REPLACE (unique_buckets > 0 AS unique_buckets) FROM density"""
    flips = "bit_count(xor(q.bucket_id, ix.bucket_id))"
    colour = f"CASE WHEN {flips} = 0 THEN 'red' WHEN {flips} <= 2 THEN 'orange' ELSE 'lightgray' END"
    every = f"SELECT q.query_id, ix.row_id, {colour} AS probe_class FROM q CROSS JOIN ix"
    plain["probe_classes"] = f"WITH {_SEARCH} {every} WHERE {flips} <= 2"

    plain["streamed_index"] = f"WITH {_VECTOR_INDEX} SELECT bucket_id, hash, row_id FROM ix"
    plain["stream_counts"] = (
        f"WITH {_VECTOR_INDEX}, {_SIZES} SELECT bucket_id, size AS count FROM sizes"
    )

    plain["model_report"] = (
        f"{_metadata()} SELECT model_name, printf('%.1f', load_factor * 100) || '%' AS load FROM metadata"
    )
    plain["search_report"] = f"""WITH plan AS ({plain['search_strategy']})
        SELECT query_id, {_hex('bucket_id')} AS bucket,
               CASE status WHEN 'empty' THEN 'No documents' WHEN 'refined' THEN 'Dense, refined'
                    ELSE 'Sparse, direct' END AS strategy,
               CASE WHEN status = 'refined' THEN {_hex('level_1_hash::BIGINT')} END AS level_1,
               CASE WHEN status = 'refined' THEN 'Reduced by ' || printf('%.0f', reduction_pct) || '%' END AS reduction
        FROM plan"""
    plain["probe_report"] = f"""WITH stats AS ({plain['multi_probe_stats']})
        SELECT query_id, total_candidates || ' (' || printf('%.1f', pct_candidates) || '% of dataset)' AS candidates,
               printf('%.1f', speedup) || 'x' AS speedup FROM stats"""
    plain["map_report"] = f"""WITH density AS ({plain['map_density']})
        SELECT unique_buckets || ' buckets' AS buckets,
               min_size || ' to ' || max_size || ' documents (avg: ' || printf('%.1f', avg_size) || ')' AS sizes,
               printf('%.1f', pct_dense) || '% of points in dense buckets' AS dense
        FROM density"""
    plain["manifest_strategy"] = plain["search_strategy"]
    plain["manifest_probe_stats"] = plain["multi_probe_stats"]
    return plain
