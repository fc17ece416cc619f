"""The whole gate and the lists of an overview question as queries. Documents stand for passages, their sources for works, whose
states are made of the sources' numbers; embeddings are vectors of the first configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import names as N
from tessera.functions import text as T
from tessera.operators import evidence as E
from tessera.operators import retrieve as R
from tessera.operators.index import Index
from tessera.operators.store import saved
from tessera.plans.lists import boosted
from tessera.plans.retrieval import STOP_SQL
from tessera.sources.tables import table

_WORKS = "SELECT source, CAST(substr(source, 4) AS INT) AS k FROM (SELECT DISTINCT source FROM {documents})"
#: The library's tables in SQL that both engines read.
TABLES = {
    "passages": "SELECT doc_id AS id, source FROM {documents}",
    "locations": "SELECT doc_id AS id, CASE WHEN doc_id % 10 = 1 THEN 'index' ELSE 'text' END AS page_kind, CAST(doc_id % 6 AS INT) AS scan FROM {documents}",
    "sources": f"SELECT source, concat(CASE WHEN k % 3 = 0 THEN 'moss' ELSE 'fern' END, '-', k) AS source_key, CASE WHEN k % 3 = 0 THEN 'A. Moss' ELSE 'B. Fern' END AS author, CASE WHEN k % 4 < 2 THEN concat('A Review of walls ', k) ELSE concat('Walls ', k) END AS title, CASE WHEN k % 9 = 4 THEN 'disabled' ELSE 'published' END AS status, CASE WHEN k % 10 = 7 THEN 'denied' ELSE 'allowed' END AS rights, CASE WHEN k % 11 = 5 THEN '2024' END AS superseded FROM ({_WORKS}) w",
    "publications": f"SELECT k AS publication, source FROM ({_WORKS}) w WHERE k % 17 <> 16",
    "runs": f"SELECT k AS run, k AS publication, CASE WHEN k % 13 = 9 THEN 2 ELSE 1 END AS config, CASE WHEN k % 8 = 6 THEN 'building' ELSE 'ready' END AS status FROM ({_WORKS}) w UNION ALL SELECT k + 1000, k, 1, 'ready' FROM ({_WORKS}) w",
    "active": f"SELECT k AS publication, CASE WHEN k % 6 = 3 THEN k + 1000 ELSE k END AS run FROM ({_WORKS}) w WHERE k % 12 <> 11",
    "vectors": "SELECT vec_id AS id, 1 AS config FROM {embeddings}",
    "items": f"SELECT source, k % 5 AS snapshot FROM ({_WORKS}) w WHERE k % 4 = 2",
}
_SNAPSHOTS, _LIVE = [(s, s % 2) for s in range(5)], [(0, 2), (1, 3)]


def library(spark: SparkSession, sf_dir: str) -> E.Library:
    documents, embeddings = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    made = {n: spark.sql(q, **{k: v for k, v in (("documents", documents), ("embeddings", embeddings)) if "{" + k + "}" in q}) for n, q in TABLES.items()}
    made["categories"] = documents.select(F.col("doc_id").alias("id"), F.array("lang").alias("categories"))
    made["snapshots"] = spark.createDataFrame(_SNAPSHOTS, "snapshot int, collection int")
    made["live"] = spark.createDataFrame(_LIVE, "collection int, snapshot int")
    return E.Library(**made)


_CTE = ", ".join(f"{n} AS ({q.replace('{', '').replace('}', '')})" for n, q in TABLES.items())
_CTE += f", snapshots(snapshot, collection) AS (VALUES {', '.join(map(str, _SNAPSHOTS))}), live(collection, snapshot) AS (VALUES {', '.join(map(str, _LIVE))}), categories AS (SELECT doc_id AS id, [lang] AS categories FROM documents)"


def _gate_sql(more: str = "true") -> str:
    return f"""SELECT c.id AS doc_id, c.source, s.author, s.title, p.scan FROM passages c JOIN locations p ON p.id = c.id JOIN sources s ON s.source = c.source JOIN categories cat ON cat.id = c.id
WHERE s.status = 'published' AND s.rights = 'allowed' AND s.superseded IS NULL AND p.page_kind = 'text'
AND NOT EXISTS (SELECT 1 FROM items i JOIN snapshots n ON n.snapshot = i.snapshot JOIN live l ON l.collection = n.collection WHERE i.source = s.source AND l.snapshot <> i.snapshot)
AND EXISTS (SELECT 1 FROM publications b JOIN runs r ON r.publication = b.publication JOIN active a ON a.publication = b.publication AND a.run = r.run WHERE b.source = s.source AND r.config = 1 AND r.status = 'ready')
AND EXISTS (SELECT 1 FROM vectors v WHERE v.id = c.id AND v.config = 1) AND ({more})"""


@query(f"WITH {_CTE} {_gate_sql()}")
def library_gate(spark, sf_dir):
    return E.eligible(library(spark, sf_dir), 1).withColumnRenamed("id", "doc_id")


_SCOPED = "(s.source_key LIKE 'moss-%' OR contains(lower(s.author), 'moss') OR contains(lower(s.title), 'moss')) AND s.source IN ('src0', 'src3', 'src12', 'src15', 'src18', 'src1') AND list_has_any(categories, ['en', 'de'])"


@query(f"WITH {_CTE} {_gate_sql(_SCOPED)}")
def library_gate_scoped(spark, sf_dir):
    """The gate within an author's scope, a selection of works and categories."""
    return E.eligible(library(spark, sf_dir), 1, "moss", ["src0", "src3", "src12", "src15", "src18", "src1"], ["en", "de"]).withColumnRenamed("id", "doc_id")


# the question of these queries asks for an overview of results; its terms, and words that stand for those of outcomes
QUESTION = "What did the study conclude, and with which result? "
OUTCOMES = ("and", "the", "der", "les")


def overview_lists(spark: SparkSession, sf_dir: str, gate: DataFrame, question, most: int = 40) -> list[DataFrame]:
    """(doc_id, rank) of three lists of a question, a column over the first benchmark item: its terms; if it asks for an overview,
    its terms in the first two scans of papers; and if it asks for outcomes too, the words for outcomes there."""
    own = Index.of(table(spark, sf_dir, "documents"), "plain")
    asked = table(spark, sf_dir, "benchmark").where("item_id = 0").select(F.lit(0).alias("question"), question.alias("q"))
    terms = asked.select("question", F.explode(T.query_terms(F.col("q"), most=1 << 30)).alias("lexeme")).distinct()
    overview = asked.where(N.overview_question(F.col("q"))).select("question", F.explode(T.query_terms(F.col("q"), most=1 << 30)).alias("lexeme")).distinct()
    outcome = asked.where(N.outcome_question(F.col("q"))).select("question", F.explode(F.array(*map(F.lit, OUTCOMES))).alias("lexeme"))
    papers = gate.where((F.col("scan") <= 1) & N.paper_title(F.col("title"))).select("doc_id")
    lists = [own.best(terms, most, gate.select("doc_id")), own.best(overview, most, papers), own.best(outcome, most, papers)]
    return [x.select(F.col("key").alias("doc_id"), "rank") for x in lists]


_TERMS = f"q AS (SELECT concat('{QUESTION}', text) AS q FROM benchmark WHERE item_id = 0), terms AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(q), '[a-z]+')) AS w FROM q) WHERE length(w) >= 3 AND w NOT IN ({STOP_SQL}))"
_PAPERS = "papers AS (SELECT * FROM gate WHERE scan <= 1 AND contains(lower(title), 'review'))"


def _list_sql(name: str, rows: str, terms: str) -> str:
    return f"{name} AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM (SELECT doc_id, count(*) AS n FROM words JOIN {rows} USING (doc_id) WHERE w IN ({terms}) GROUP BY doc_id) QUALIFY rank <= 40)"


_OUTCOMES = ", ".join(f"'{w}'" for w in OUTCOMES)
_LISTS = f"WITH {_CTE}, gate AS ({_gate_sql()}), {_PAPERS}, {_TERMS}, words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), {_list_sql('l0', 'gate', 'SELECT w FROM terms')}, {_list_sql('l1', 'papers', 'SELECT w FROM terms')}, {_list_sql('l2', 'papers', _OUTCOMES)}"


@query(f"{_LISTS} SELECT 0 AS list, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2")
def overview_ranks(spark, sf_dir):
    gate = saved(E.eligible(library(spark, sf_dir), 1).withColumnRenamed("id", "doc_id"), "gate")
    lists = overview_lists(spark, sf_dir, gate, F.concat(F.lit(QUESTION), F.col("text")))
    rows = [x.select(F.lit(i).alias("list"), "doc_id", "rank") for i, x in enumerate(lists)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""{_LISTS}, qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1),
v AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM (SELECT doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q), 9) AS s FROM gate JOIN embeddings e ON e.vec_id = doc_id, qv) WHERE s IS NOT NULL QUALIFY rank <= 40),
every AS (SELECT 0 AS i, * FROM v UNION ALL SELECT 1, * FROM l0 UNION ALL SELECT 2, * FROM l1 UNION ALL SELECT 3, * FROM l2),
fused AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM every GROUP BY doc_id),
raised AS (SELECT doc_id, source, s + CASE WHEN contains(lower(title), 'review') AND scan = 0 THEN 0.012 WHEN contains(lower(title), 'review') AND scan = 1 THEN 0.008 ELSE 0 END AS s FROM fused JOIN gate USING (doc_id)),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(s, 9) DESC, doc_id) AS p FROM raised) WHERE p <= 12 ORDER BY round(s, 9) DESC, doc_id LIMIT 24)
SELECT doc_id, source, round(s, 9) AS score FROM cut""")
def library_retrieve(spark, sf_dir):
    """All lists of an overview question behind the whole gate: vector, terms, overview and outcomes, fused, raised and cut."""
    gate = saved(E.eligible(library(spark, sf_dir), 1).withColumnRenamed("id", "doc_id"), "gate")
    vectors = table(spark, sf_dir, "embeddings")
    asked = F.broadcast(vectors.where("vec_id = 1").select(F.col("embedding").alias("q")).limit(1))  # one row
    near = gate.select("doc_id").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").join(asked)
    near = R.ranked(near, F.round(T.cosine(F.col("embedding"), F.col("q")), 9), 40).select("doc_id", "rank")
    fused = R.fuse([near, *overview_lists(spark, sf_dir, gate, F.concat(F.lit(QUESTION), F.col("text")))], [])
    rows = gate.join(F.broadcast(fused), "doc_id")  # at most 160 rows
    raised = boosted(rows, F.lit(QUESTION), F.col("title"), F.col("scan") + 1)
    return R.diversity_cut(raised.withColumn("score", F.round("score", 9))).select("doc_id", "source", "score")
