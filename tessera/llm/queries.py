"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, audit, brown, decontaminate, exact, mixing, pieces, pivots, quality, secret_scan, simhash, toxicity, warc
from .common import LOWER, UPPER, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_pieces, op3_mixing, op4_lm_scoring, op5_quality, op6_secrets, op7_simhash, op8_embeddings, op9_warc, op10_exact_dedup, op11_alignment, op12_decontamination, op13_filter_audit)
}


def _secret_sql() -> str:
    """Each rule's matches by the pieces between them, for DuckDB."""
    parts = []
    for i, r in enumerate(secret_scan.RULES):
        p, g = r.pattern.replace("'", "''"), r.group
        parts.append(
            f"SELECT rid, {i} AS k, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g, s FROM (SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, "
            f"regexp_extract_all(t, '{p}', {g}) AS g, string_split_regex(t, '{p}') AS s FROM d)"
        )
    base = "kind || ':' || a || ':' || b"
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE k = {i}) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(secret_scan.BASE))
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(secret_scan.RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT rid, k, kind, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a, length(m[i]) AS n, length(g[i]) AS l FROM raw),
spans AS (SELECT rid, k, kind, CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS b FROM placed WHERE l >= CASE k {least} END),
told AS (SELECT rid, {counts}, coalesce(string_agg({base}, ',' ORDER BY a, k) FILTER (WHERE k < {len(secret_scan.BASE)}), '') AS base, string_agg({base}, ',' ORDER BY a, k) AS spans FROM spans GROUP BY rid)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (rid)"""


def _audit_sql() -> str:
    """Every order of the filters as rows; a document meets the first filter of the order that it fails."""
    names = audit.FILTERS
    orders = ", ".join(f"f{i} AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l{i})" for i in range(5))
    apart = " AND ".join(f"l{i} <> l{j}" for i in range(5) for j in range(i))
    steps = " UNION ALL ".join(f"SELECT l0 || l1 || l2 || l3 || l4 AS filter_order, {i + 1} AS step, l{i} AS f, {' || '.join(["''", *(f'l{j}' for j in range(i))])} AS before FROM orders" for i in range(5))
    told = "concat(" + ", ".join(f"CASE WHEN {f} THEN '{f}' ELSE '' END" for f in names) + ")"
    return f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * len(regexp_extract_all(w.t, '[A-Z]')) > 2 * length(w.t) AS C,
    regexp_matches(w.t, '[#$%&*|]') AS D, coalesce(doc_id > first, FALSE) AS E FROM w JOIN first USING (t) LEFT JOIN said USING (doc_id)),
d AS (SELECT part, {told} AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM flags GROUP BY ALL),
{orders}, orders AS (SELECT * FROM f0, f1, f2, f3, f4 WHERE {apart}), steps AS ({steps}),
met AS (SELECT part, filter_order, step, f, fails, n, good, toxic, contains(fails, f) AS bad, translate(before, fails, '') <> before AS gone FROM d, steps),
sums AS (SELECT part, filter_order, step, f, sum(n) FILTER (WHERE NOT gone AND NOT bad) AS kept, sum(n) FILTER (WHERE bad AND NOT gone) AS removed, sum(n) FILTER (WHERE bad AND gone) AS redundant,
    sum(n) FILTER (WHERE fails = f) AS unique_fails, sum(good) FILTER (WHERE bad AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE bad AND NOT gone) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, step, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))}, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM sums"""


_WINDOWS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {decontaminate.WINDOW}) AS n, unnest(list_transform(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {decontaminate.WINDOW}) - 1], ' '))) AS x FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
starts AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM starts),
met AS (SELECT rid, n, i, item FROM dw JOIN bw USING (n, x)),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM met) GROUP BY rid),
told AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN told USING (rid)"""

ORACLE_SQL = {
    "op12_decontamination": _WINDOWS_SQL,
    "op13_filter_audit": _audit_sql(),
    "op6_secrets": _secret_sql(),
    "op8_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op9_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS keep FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id < keep THEN keep END AS refers_to FROM k""",
    "op10_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
}
