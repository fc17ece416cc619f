"""Integrity rules as queries of violations, identity merging and link graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import text as T
from tessera.operators import classify, graph, identity
from tessera.sources import html
from tessera.sources.tables import table


@query("SELECT doc_id FROM (SELECT doc_id, text, CASE WHEN doc_id % 13 = 5 THEN n_chars + doc_id % 3 - 1 ELSE n_chars END AS n_chars FROM documents) WHERE length(text) <> n_chars")
def v_text_length(spark, sf_dir):
    """Texts whose stored length is not theirs; some lengths are made one too long or short, some of these stay right."""
    told = F.when(F.col("doc_id") % 13 == 5, F.col("n_chars") + F.col("doc_id") % 3 - 1).otherwise(F.col("n_chars"))
    return table(spark, sf_dir, "documents").where(F.length("text") != told).select("doc_id")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, vec_id % 17 AS k FROM embeddings),
p AS (SELECT vec_id, CASE k WHEN 3 THEN list_transform(e, lambda x: 0.0::DOUBLE) WHEN 4 THEN e[1:63] WHEN 5 THEN list_append(e[1:63], NULL) WHEN 6 THEN list_append(e[1:63], 'nan'::DOUBLE) WHEN 7 THEN list_append(e[1:63], 0.0::DOUBLE) WHEN 8 THEN NULL WHEN 9 THEN list_append(e[1:63], 'inf'::DOUBLE) ELSE e END AS e FROM e)
SELECT vec_id FROM p WHERE e IS NULL OR len(e) <> 64 OR len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 OR len(list_filter(e, lambda x: x <> 0)) = 0""")
def v_vectors(spark, sf_dir):
    """Vectors that are missing, of another length, all zero, or with a missing or endless component; some are made so."""
    e, k = F.col("embedding").cast("array<double>"), F.col("vec_id") % 17
    last = lambda x: F.concat(F.slice(e, 1, 63), F.array(F.lit(x).cast("double")))
    made = F.when(k == 3, F.transform(e, lambda x: F.lit(0.0))).when(k == 4, F.slice(e, 1, 63)).when(k == 5, last(None)).when(k == 6, last("nan")).when(k == 7, last(0.0)).when(k == 8, F.lit(None)).when(k == 9, last("inf")).otherwise(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", made.alias("e")).where(~F.coalesce(T.sound_vector(F.col("e"), 64), F.lit(False))).select("vec_id")


_CHUNKS = "SELECT doc_id, a, a + 400 AS b, CASE WHEN (doc_id + a) % 11 = 0 THEN upper(substring(text, CAST(a + 1 AS INT), 400)) ELSE substring(text, CAST(a + 1 AS INT), 400) END AS exact FROM "


@query(f"WITH c AS ({_CHUNKS}(SELECT doc_id, text, unnest(range(0, length(text), 400)) AS a FROM documents)) SELECT c.doc_id, a FROM c JOIN documents d ON d.doc_id = c.doc_id WHERE exact <> substring(text, a + 1, 400)")
def v_passage_text(spark, sf_dir):
    """Passages that differ from their span of the text. The tables hold no passages, so they are made of the texts, one in
    eleven of them in capitals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.sequence(F.lit(0).cast("long"), F.length("text").cast("long") - 1, F.lit(400).cast("long"))
    chunks = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(spans).alias("a")).selectExpr(*_CHUNKS.removeprefix("SELECT ").removesuffix(" FROM ").split(", ", 3))
    return chunks.join(docs, "doc_id").where(T.span_text(F.col("text"), F.col("a").cast("int"), F.col("b").cast("int")) != F.col("exact")).select("doc_id", "a")


@query("""WITH l AS (SELECT CASE WHEN doc_id % 19 = 4 THEN -doc_id - 1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 23 = 6 THEN 2 WHEN doc_id % 23 = 7 THEN NULL ELSE quality END AS quality, CASE WHEN doc_id % 29 = 8 THEN -1 ELSE toxic END AS toxic FROM labels)
SELECT l.doc_id, d.doc_id IS NULL AS unknown FROM l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR coalesce(l.quality, 9) NOT IN (0, 1) OR coalesce(l.toxic, 9) NOT IN (0, 1)""")
def v_labels(spark, sf_dir):
    """Labels of no document, or that are not 0 or 1; some are made so."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        F.when(d % 19 == 4, -d - 1).otherwise(d).alias("doc_id"), F.when(d % 23 == 6, 2).when(d % 23 == 7, F.lit(None)).otherwise(F.col("quality")).alias("quality"), F.when(d % 29 == 8, -1).otherwise(F.col("toxic")).alias("toxic")
    )
    known = table(spark, sf_dir, "documents").select("doc_id").withColumn("there", F.lit(True))
    wrong = lambda c: ~F.coalesce(F.col(c).isin(0, 1), F.lit(False))
    return rows.join(known, "doc_id", "left").where(F.col("there").isNull() | wrong("quality") | wrong("toxic")).select("doc_id", F.col("there").isNull().alias("unknown"))


@query("SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def v_unique_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH a AS (SELECT CASE WHEN doc_id % 10 = 2 THEN -doc_id ELSE doc_id END AS doc_id, source, CASE WHEN doc_id % 10 = 1 THEN lang || '2' ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 0),
d AS (SELECT doc_id, 1 AS gone, 0 AS new FROM (SELECT doc_id, source, lang FROM documents EXCEPT ALL SELECT * FROM a) UNION ALL SELECT doc_id, 0, 1 FROM (SELECT * FROM a EXCEPT ALL SELECT doc_id, source, lang FROM documents))
SELECT doc_id, CASE WHEN max(gone) = 1 AND max(new) = 1 THEN 'changed' WHEN max(gone) = 1 THEN 'gone' ELSE 'new' END AS change FROM d GROUP BY doc_id""")
def v_snapshot_difference(spark, sf_dir):
    """All documents against a derived second state that drops, renames (one goes, one comes) and changes some of them."""
    before = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    last = F.col("doc_id") % 10
    after = before.where(last != 0).select(
        F.when(last == 2, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), "source", F.when(last == 1, F.concat("lang", F.lit("2"))).otherwise(F.col("lang")).alias("lang")
    )
    return snapshot_changes(before, after)


def snapshot_changes(before, after):
    """(doc_id, change) of two states with the same columns: gone, new, or changed where the id has rows on both sides."""
    gone, new = before.exceptAll(after).select("doc_id", F.lit(1).alias("s")), after.exceptAll(before).select("doc_id", F.lit(2).alias("s"))
    sides = F.array_join(F.array_sort(F.collect_set(F.col("s").cast("string"))), "")
    return gone.unionByName(new).groupBy("doc_id").agg(sides.alias("s")).select("doc_id", F.when(F.col("s") == "12", "changed").when(F.col("s") == "1", "gone").otherwise("new").alias("change"))


@query()
def html_blocks(spark, sf_dir):
    return html.blocks(table(spark, sf_dir, "pages"))


@query()
def page_links(spark, sf_dir):
    return html.links(table(spark, sf_dir, "pages")).withColumn("relation", T.link_relation(F.concat_ws(" ", "anchor", "rel")))


_ENTITIES = "replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"


@query(f"SELECT page_id, trim(regexp_replace({_ENTITIES}, '\\s+', ' ', 'g')) AS title FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS x FROM pages)")
def page_titles(spark, sf_dir):
    return html.titles(table(spark, sf_dir, "pages"))


@query()
def page_roles(spark, sf_dir):
    """What each page is: a candidate for content, an index or neither, its kinds of literature and of evidence, and a sample."""
    rows = html.inspect(table(spark, sf_dir, "pages"))
    kinds = classify.literature(F.col("evidence"))
    return rows.select("page_id", "role", "blocks", "excluded", "sample", F.size("anchors").alias("anchors"), kinds["categories"].alias("categories"), classify.evidence_type(F.col("evidence")).alias("evidence_type"))


@query("""WITH RECURSIVE e AS (SELECT d.doc_id AS f, t.doc_id AS t, k AS number FROM documents d, range(1, 4) r(k), documents t WHERE t.doc_id = d.doc_id * 3 + k - (d.doc_id % 2)), up AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth, CAST(NULL AS BIGINT) AS parent, '' AS ordinal
UNION ALL SELECT t, depth + 1, f, ordinal || '.' || lpad(CAST(number AS VARCHAR), 8, '0') FROM up JOIN e ON f = node WHERE depth < 5 AND t > f)
SELECT node, min(depth) AS depth, arg_min(parent, ordinal) AS parent, min(ordinal) AS ordinal FROM (SELECT *, min(depth) OVER (PARTITION BY node) AS least FROM up) WHERE depth = least GROUP BY node""")
def link_graph(spark, sf_dir):
    """Breadth-first levels over links between documents, three from each, some of which lead to one document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    links = docs.select(F.col("doc_id").alias("from"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("number"))
    links = links.withColumn("to", F.col("from") * 3 + F.col("number") - F.col("from") % 2).where("`to` > `from`")
    edges = links.join(docs.select(F.col("doc_id").alias("to")), "to", "left_semi")
    return graph.levels(edges, docs.where("doc_id = 0").select(F.col("doc_id").alias("node")), most_depth=5)


@query()
def crawl_links(spark, sf_dir):
    """The links of a bounded crawl over documents, with their states: limits on depth and documents, redirects to one address,
    failures, links out of scope and missing anchors."""
    d = F.col("doc_id")
    name = lambda x: F.concat(F.lit("d"), x.cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    items = docs.select(name(d).alias("url"), F.when(d % 17 == 16, name(d - 1)).otherwise(name(d)).alias("final_url"), F.when(d % 13 == 5, "failed").otherwise("fetched").alias("state"), F.array(F.lit("top")).alias("anchors"))
    ways = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("number")
    to = F.when(F.col("number") == 0, F.expr("doc_id div 3")).otherwise(d * 3 + F.col("number"))
    links = docs.select("doc_id", ways).select(name(d).alias("url"), "number", name(to).alias("target"), F.when(d % 5 == 0, "top").when(d % 5 == 1, "end").otherwise("").alias("fragment"), (to % 7 != 6).alias("allowed"))
    return graph.crawl(items, links, "d0", most_depth=4, most_documents=60)[1]


@query("""WITH k AS (SELECT o_orderkey AS id, o_custkey % 500 AS doi, o_orderkey % 700 AS pmid FROM orders), f AS (SELECT *, min(id) OVER (PARTITION BY doi) AS a, min(id) OVER (PARTITION BY pmid) AS b FROM k)
SELECT id, least(a, b) AS first, a <> b AND least(a, b) < id AS conflict FROM f""")
def identity_merge(spark, sf_dir):
    """First record that shares either identifier, and whether the identifiers disagree on it."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 500).alias("doi"), (F.col("o_orderkey") % 700).alias("pmid"))
    return identity.first_match(rows, "id", ["doi", "pmid"])
