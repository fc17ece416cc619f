"""More ranked lists, lookups and identity as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import names as N
from tessera.functions import text as T
from tessera.operators import identity
from tessera.plans.retrieval import ELIGIBLE, FUSED, LEXICAL, TERMS, VECTOR, fused, gate
from tessera.plans.scoping import held_names
from tessera.sources.tables import sql, table

# What passages of a trial or a protocol are looked for.
ANCHORS = {
    "primary_outcome": r"(?i)primary outcome",
    "observed_result": r"(?i)([0-9]+[.][0-9]+.{0,100}(days|weeks|months|%|mm|points)|p\s*[<=>]|confidence interval|95%\s*ci)",
    "not_started": r"(?i)not initiated|not started|no observed results",
}
OPENING = r"(?i)(preface|introduction|abstract)"
# What a paper's first and second scan gain when a question asks for an overview.
BOOST = {1: 0.012, 2: 0.008}


@query(rf"""WITH {ELIGIBLE}, q AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS q FROM benchmark)
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) AS rank FROM q JOIN elig ON contains(q, ' ' || lower(lang) || ' ') QUALIFY rank <= 40""")
def exact_name_list(spark, sf_dir):
    """Eligible texts under a name that the question holds as whole words; documents' languages stand for names."""
    own = gate(spark, sf_dir).select("doc_id", "lang", "n_chars")
    asked = held_names(table(spark, sf_dir, "benchmark").select("item_id", "text"), own.select(F.col("lang").alias("name")).distinct()).select("item_id", F.col("name").alias("lang"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n_chars"), "doc_id")).cast("long")
    return own.join(asked, "lang").select("item_id", "doc_id", place.alias("rank")).where("rank <= 40")


def boosted(rows, question, title, scan):
    """rows with score raised for the first scans of papers if the question asks for an overview."""
    gain = F.when(scan == 1, BOOST[1]).when(scan == 2, BOOST[2]).otherwise(0.0)
    return rows.withColumn("score", F.col("score") + F.when(N.overview_question(question) & N.paper_title(title), gain).otherwise(0.0))


@query(f"""WITH {ELIGIBLE}, {TERMS}, {VECTOR}, {LEXICAL}, {FUSED} SELECT doc_id, round(score + CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 0.012 WHEN doc_id % 3 = 0 AND doc_id % 5 = 1 THEN 0.008 ELSE 0 END, 9) AS score FROM fused""")
def overview_boost(spark, sf_dir):
    title = F.when(F.col("doc_id") % 3 == 0, "A Review").otherwise("Notes")
    rows = boosted(fused(spark, sf_dir), F.lit("What did the study find?"), title, F.col("doc_id") % 5 + 1)
    return rows.select("doc_id", F.round("score", 9).alias("score"))


_STUDY = "SELECT doc_id, source, concat(text, CASE doc_id % 5 WHEN 0 THEN ' The Primary Outcome was' WHEN 1 THEN ' fell by 12.5 in days' WHEN 2 THEN ' was not started' ELSE '' END) AS text, CASE WHEN source < 'src3' THEN 'a trial' ELSE 'notes' END AS title FROM {documents}"


@query(rf"""WITH d AS ({_STUDY.replace('{documents}', 'documents')}), papers AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) AS r FROM d WHERE title = 'a trial' GROUP BY source QUALIFY r <= 4),
k AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{p}')" for k, p in ANCHORS.items())}) t(kind, pattern))
SELECT source, kind, min(doc_id) AS doc_id FROM d JOIN papers USING (source) JOIN k ON regexp_matches(text, pattern) GROUP BY ALL""")
def study_anchors(spark, sf_dir):
    """Of the first four papers of a list, the first passage of each kind that a comparison needs; a missing kind is left out."""
    rows = sql(spark, sf_dir, _STUDY, "documents")
    papers = rows.where(N.paper_title(F.col("title"))).groupBy("source").agg(F.min("doc_id").alias("first")).orderBy("first").limit(4)
    kinds = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(k)) for k, p in ANCHORS.items())))
    own = rows.join(F.broadcast(papers.select("source")), "source").select("source", "doc_id", F.explode(kinds).alias("kind"))
    return own.groupBy("source", "kind").agg(F.min("doc_id").alias("doc_id"))


_HITS = "SELECT doc_id, text, 10 AS a, 60 AS b, CASE WHEN doc_id % 9 = 4 THEN 'other words' ELSE substring(text, 11, 50) END AS exact, sha2(CASE WHEN doc_id % 8 = 3 THEN concat(text, '.') ELSE text END, 256) AS sha FROM {documents}"


@query(f"""SELECT doc_id, CASE WHEN length(text) < 60 OR doc_id % 9 = 4 THEN 'offsets' WHEN doc_id % 8 = 3 THEN 'checksum' END AS problem FROM documents WHERE length(text) < 60 OR doc_id % 9 = 4 OR doc_id % 8 = 3""")
def hit_integrity(spark, sf_dir):
    """Hits whose passage is not their span of the page, or whose page is not the one that was stored; one in nine and one in
    eight are made so."""
    rows = sql(spark, sf_dir, _HITS, "documents")
    t = F.col("text")
    spans = (F.col("a") >= 0) & (F.col("b") <= F.length(t)) & (F.col("b") > F.col("a")) & (T.span_text(t, F.col("a"), F.col("b")) == F.col("exact"))
    problem = F.when(~spans, "offsets").when(F.sha2(t, 256) != F.col("sha"), "checksum")
    return rows.select("doc_id", problem.alias("problem")).where("problem is not null")


@query("""SELECT c_custkey, coalesce(string_agg('Order ' || o_orderkey || ': ' || o_orderstatus || '. ', '' ORDER BY o_orderkey), '') AS context FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def attached_context(spark, sf_dir):
    """Each hit's context: what is known of it, in order, as one text; empty where nothing is."""
    line = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(": "), "o_orderstatus", F.lit(". "))
    lines = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("s")))).alias("x"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(lines, "c_custkey", "left").select("c_custkey", F.coalesce(F.array_join("x.s", ""), F.lit("")).alias("context"))


@query(rf"""WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, CASE WHEN doc_id % 9 = 4 THEN 'ABSTRACT. ' || text ELSE text END AS text FROM documents)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN page < 30 AND regexp_matches(left(text, 160), '{OPENING}') THEN 0 ELSE 1 END, page) AS place FROM d QUALIFY place <= 3""")
def opening_passages(spark, sf_dir):
    """Each source's first three passages, those of a preface, introduction or abstract among its first pages before others."""
    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", page.alias("page"), F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("ABSTRACT. "), F.left("text", F.lit(160)))).otherwise(F.left("text", F.lit(160))).alias("head"))
    first = F.when((F.col("page") < 30) & F.left("head", F.lit(160)).rlike(OPENING), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("source").orderBy(first, "page"))
    return rows.select("source", "doc_id", place.alias("place")).where("place <= 3")


@query(r"""SELECT source, term, min(doc_id) AS doc_id FROM documents, (VALUES ('the'), ('die'), ('les'), ('que')) t(term) WHERE regexp_matches(text, '(?i)(^|[^0-9A-Za-z_])' || term || '($|[^0-9A-Za-z_])') GROUP BY ALL""")
def first_mentions(spark, sf_dir):
    """The first passage of each source that names a term as a whole word."""
    terms = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col("text").rlike(rf"(?i)(?<![0-9A-Za-z_]){t}(?![0-9A-Za-z_])").alias("held")) for t in ("the", "die", "les", "que"))))
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", terms.alias("t")).where("t.held")
    return rows.groupBy("source", "t.term").agg(F.min("doc_id").alias("doc_id"))


@query("""WITH c AS (SELECT c_nationkey AS k, string_agg('{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"}', ',' ORDER BY c_custkey) AS j, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1)
SELECT n_name AS name, '{"name":"' || n_name || '","members":[' || coalesce(j, '') || '],"count":' || coalesce(n, 0) || '}' AS detail FROM nation LEFT JOIN c ON k = n_nationkey""")
def catalog_detail(spark, sf_dir):
    """Each entry with its members as a nested document; an entry without members has an empty list."""
    members = F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))))
    own = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(members.alias("m"))
    rows = table(spark, sf_dir, "nation").join(own, "n_nationkey", "left")
    none = F.array().cast("array<struct<id:bigint,segment:string>>")
    return rows.select(F.col("n_name").alias("name"), F.to_json(F.struct(F.col("n_name").alias("name"), F.coalesce("m", none).alias("members"), F.coalesce(F.size("m"), F.lit(0)).alias("count"))).alias("detail"))


@query("""SELECT o_custkey AS search, event FROM (SELECT o_custkey, min(o_orderkey) AS event FROM orders GROUP BY o_custkey, o_orderpriority)""")
def first_writer(spark, sf_dir):
    """Of rows with one key the first in order stays."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("event")).select(F.col("o_custkey").alias("search"), "event")


_WORKS = "SELECT o_orderkey AS ref, CASE WHEN o_orderkey % 3 > 0 THEN concat('d', o_orderkey % 400) END AS doi, CASE WHEN o_orderkey % 4 > 0 THEN concat('p', o_orderkey % 350) END AS pmid, CASE WHEN o_orderkey % 7 = 0 THEN concat('c', o_orderkey % 100) END AS pmcid FROM {orders}"


def works(spark, sf_dir):
    return sql(spark, sf_dir, _WORKS, "orders")


@query()
def identity_in_order(spark, sf_dir):
    """Records of each search in the providers' order: duplicates go, contradictory ones stay and are flagged."""
    rows = works(spark, sf_dir)
    searches = max(1, rows.count() // 50)  # some fifty records each, whatever the corpus
    rows = rows.withColumn("search", F.col("ref") % searches)
    return identity.merge_in_order(rows, "search", "ref", ["doi", "pmid", "pmcid"], native="ref").select("search", "ref", "kept", "identity_conflict")


@query(f"""WITH w AS ({_WORKS.replace('{orders}', 'orders')}), known AS (SELECT ref AS id, doi, pmid, pmcid FROM w WHERE ref < 300), new AS (SELECT * FROM w WHERE ref >= 300),
m AS (SELECT n.ref, min(k.id) AS id, count(DISTINCT k.id) AS matches FROM new n JOIN known k ON n.doi = k.doi OR n.pmid = k.pmid OR n.pmcid = k.pmcid GROUP BY n.ref),
s AS (SELECT n.*, m.id, CASE WHEN m.id IS NULL THEN 'inserted' WHEN matches > 1 OR n.doi <> k.doi OR n.pmid <> k.pmid OR n.pmcid <> k.pmcid THEN 'conflict' ELSE 'updated' END AS state, k.doi AS kd, k.pmid AS kp, k.pmcid AS kc FROM new n LEFT JOIN m USING (ref) LEFT JOIN known k ON k.id = m.id)
SELECT ref, id, state, CASE state WHEN 'conflict' THEN kd ELSE coalesce(kd, doi) END AS doi, CASE state WHEN 'conflict' THEN kp ELSE coalesce(kp, pmid) END AS pmid, CASE state WHEN 'conflict' THEN kc ELSE coalesce(kc, pmcid) END AS pmcid FROM s""")
def works_upsert(spark, sf_dir):
    """New works beside known ones; works of the first 300 orders are known."""
    rows = works(spark, sf_dir)
    known = rows.where("ref < 300").withColumnRenamed("ref", "id")
    return identity.upsert(known, rows.where("ref >= 300"), ["doi", "pmid", "pmcid"])
