"""Retrieval queries: the gate, ranked lists, fusion, cuts and quotas. Benchmark items stand for questions, embeddings
for those of passages, and document sources for authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import text as T
from tessera.operators import postings as P
from tessera.operators import retrieve as R
from tessera.operators.index import Index
from tessera.sources.tables import table

ELIGIBLE = "elig AS (SELECT d.* FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND l.toxic = 0))"
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP)
TERMS = f"terms AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark WHERE item_id = 0) WHERE length(w) >= 3 AND w NOT IN ({STOP_SQL}))"
VECTOR = """qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1),
vec AS (SELECT e.doc_id, e.source, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q), 9) AS s FROM elig e JOIN embeddings v ON v.vec_id = e.doc_id, qv),
vlist AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM vec QUALIFY r <= 40)"""
LEXICAL = """lex AS (SELECT doc_id, source, 0.1::DOUBLE * count(*) AS s FROM (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM elig) JOIN terms USING (w) GROUP BY ALL),
llist AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM lex WHERE s > 0 QUALIFY r <= 40)"""
FUSED = """fused AS (SELECT coalesce(v.doc_id, l.doc_id) AS doc_id, coalesce(v.source, l.source) AS source,
coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + l.r), 0) AS score FROM vlist v FULL JOIN llist l ON v.doc_id = l.doc_id)"""
CUT = """cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS p FROM fused) WHERE p <= 12 ORDER BY score DESC, doc_id LIMIT 24)"""


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.eligible(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def vector_list(spark: SparkSession, sf_dir: str, most: int = 40, vec: int = 1) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    question = F.broadcast(vectors.where(F.col("vec_id") == vec).select(F.col("embedding").alias("q")).limit(1))
    rows = gate(spark, sf_dir).select("doc_id", "source").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").join(question)
    return R.ranked(rows, F.round(T.cosine(F.col("embedding"), F.col("q")), 9), most).select("doc_id", "source", "list_score", "rank")


def lexical_list(spark: SparkSession, sf_dir: str, most: int = 40, item: int = 0) -> DataFrame:
    """The list of one item by the occurrences of its terms, from the documents' index."""
    docs = table(spark, sf_dir, "documents")
    terms = T.query_terms(F.col("text"), most=1 << 30)
    asked = table(spark, sf_dir, "benchmark").where(F.col("item_id") == item).select(F.col("item_id").alias("question"), F.explode(terms).alias("lexeme")).distinct()
    found = Index.of(docs, "plain").best(asked, most, gate(spark, sf_dir).select("doc_id"))
    return docs.select("doc_id", "source").join(F.broadcast(found.withColumnRenamed("key", "doc_id")), "doc_id").select("doc_id", "source", (0.1 * F.col("hits")).alias("list_score"), "rank")  # `most` rows


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse([vector_list(spark, sf_dir), lexical_list(spark, sf_dir)], ["source"])


@query(f"WITH {ELIGIBLE} SELECT doc_id, source, lang FROM elig")
def gate_eligible_docs(spark, sf_dir):
    return gate(spark, sf_dir).select("doc_id", "source", "lang")


@query(f"WITH {ELIGIBLE}, {VECTOR} SELECT doc_id, round(s, 6) AS score, r AS rank FROM vlist")
def vector_topk(spark, sf_dir):
    return vector_list(spark, sf_dir).select("doc_id", F.round("list_score", 6).alias("score"), "rank")


@query(f"WITH {ELIGIBLE}, {TERMS}, {LEXICAL} SELECT doc_id, round(s, 6) AS score, r AS rank FROM llist")
def lexical_or_topk(spark, sf_dir):
    return lexical_list(spark, sf_dir).select("doc_id", F.round("list_score", 6).alias("score"), "rank")


@query(f"WITH {ELIGIBLE}, {TERMS}, {VECTOR}, {LEXICAL}, {FUSED}, {CUT} SELECT doc_id, source, round(score, 9) AS score FROM cut")
def diversity_cut(spark, sf_dir):
    return R.diversity_cut(fused(spark, sf_dir)).select("doc_id", "source", F.round("score", 9).alias("score"))


_QUOTA = """q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS pl, (SELECT count(DISTINCT source) FROM cut) AS n FROM cut),
pick AS (SELECT *, CASE WHEN pl > CASE WHEN n <= 1 THEN 10 ELSE ceil(10.0 / n) END THEN 1 ELSE 0 END AS late FROM q)
SELECT doc_id, source, round(score, 9) AS score, 'E' || row_number() OVER (ORDER BY late, score DESC, doc_id) AS label FROM pick ORDER BY late, score DESC, doc_id LIMIT 10"""


@query(f"WITH {ELIGIBLE}, {TERMS}, {VECTOR}, {LEXICAL}, {FUSED}, {CUT}, {_QUOTA}")
def rrf_retrieve(spark, sf_dir):
    """The flagship: gate, vector and lexical lists, fusion, diversity, evidence quota."""
    return R.evidence_quota(R.diversity_cut(fused(spark, sf_dir))).select("doc_id", "source", F.round("score", 9).alias("score"), "label")


@query(f"""WITH {ELIGIBLE}, m AS (SELECT e.doc_id, q.vec_id AS question, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) DESC, e.doc_id) AS r
FROM elig e JOIN embeddings v ON v.vec_id = e.doc_id JOIN embeddings q ON q.vec_id IN (1, 2, 3) QUALIFY r <= 40)
SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + min(r) FILTER (WHERE question = 1)), 0) + coalesce(1.0::DOUBLE / (60 + min(r) FILTER (WHERE question = 2)), 0) + coalesce(1.0::DOUBLE / (60 + min(r) FILTER (WHERE question = 3)), 0), 9) AS score FROM m GROUP BY doc_id""")
def rrf_multi_query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id in (1, 2, 3)").select(F.col("vec_id").alias("question"), F.col("embedding").alias("q")).limit(3)
    rows = gate(spark, sf_dir).select("doc_id").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").crossJoin(F.broadcast(asked))
    scored = rows.select("question", "doc_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 9).alias("score"))
    best = P.best(scored.where("score is not null"), "question", 40)  # one scan for all questions
    lists = [best.where(F.col("question") == v).select("doc_id", "rank") for v in (1, 2, 3)]
    return R.fuse(lists, []).select("doc_id", F.round("score", 9).alias("score"))


_ITEM_TERMS = f"terms AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) >= 3 AND w NOT IN ({STOP_SQL}))"


@query(f"""WITH {ELIGIBLE}, {_ITEM_TERMS}, words AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM elig),
lex AS (SELECT item_id, doc_id, source, CAST(count(*) AS BIGINT) AS hits FROM words JOIN terms USING (w) GROUP BY ALL),
own AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY hits DESC, doc_id) AS place FROM lex) WHERE place <= 5),
spare AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS place FROM elig ORDER BY doc_id LIMIT 10)
SELECT item_id, doc_id, source, hits, place, false AS fallback FROM own WHERE r <= 10
UNION ALL SELECT b.item_id, s.doc_id, s.source, 0, s.place, true FROM (SELECT DISTINCT item_id FROM benchmark) b, spare s WHERE NOT EXISTS (SELECT 1 FROM lex l WHERE l.item_id = b.item_id)""")
def worksheet_candidates(spark, sf_dir):
    """Candidates for every benchmark item, of one without hits the first eligible documents."""
    items = table(spark, sf_dir, "benchmark")
    terms = items.select("item_id", F.explode(T.query_terms(F.col("text"), most=1 << 30)).alias("lexeme")).distinct()
    eligible = gate(spark, sf_dir)
    met = Index.of(table(spark, sf_dir, "documents"), "plain").postings(terms).join(terms, "lexeme")
    hits = met.groupBy("item_id", F.col("key").alias("doc_id")).agg(F.sum("n").alias("hits")).join(eligible.select("doc_id", "source"), "doc_id")
    order = [F.desc("hits"), "doc_id"]
    near = hits.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "source").orderBy(*order)).cast("long")).where("place <= 5")
    own = near.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where("r <= 10").drop("r")
    spare = eligible.select("doc_id", "source").orderBy("doc_id").limit(10)
    spare = spare.withColumn("place", F.row_number().over(Window.orderBy("doc_id")).cast("long"))
    none = items.select("item_id").distinct().join(own.select("item_id"), "item_id", "left_anti")
    rest = none.crossJoin(F.broadcast(spare)).select("item_id", "doc_id", "source", F.lit(0).cast("long").alias("hits"), "place", F.lit(True).alias("fallback"))
    return own.select("item_id", "doc_id", "source", "hits", "place", F.lit(False).alias("fallback")).unionByName(rest)


@query("""WITH m AS (SELECT doc_id, source, lang FROM documents WHERE lower(text) LIKE '%the%')
SELECT doc_id, source, (SELECT count(*) FROM m) AS total FROM m ORDER BY lang, source, doc_id LIMIT 50 OFFSET 50""")
def paged_search_total(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where(F.instr(F.lower("text"), "the") > 0).select("doc_id", "source", "lang")
    total = F.broadcast(own.agg(F.count("*").alias("total")))
    return own.orderBy("lang", "source", "doc_id").offset(50).limit(50).select("doc_id", "source").join(total)
