"""Reports, hierarchies and maintenance queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import graph, ocr_rules
from tessera.sources.tables import table


@query("""SELECT source, lang, count(*) AS citations, (SELECT string_agg(p, ',' ORDER BY i) FROM (SELECT n_chars % 7 AS p, min(doc_id) AS i FROM documents e WHERE e.source IS NOT DISTINCT FROM d.source AND e.lang IS NOT DISTINCT FROM d.lang GROUP BY 1)) AS pages FROM documents d GROUP BY source, lang""")
def citations_grouped(spark, sf_dir):
    """Citations by work, with its distinct pages in the order in which they are first cited."""
    first = table(spark, sf_dir, "documents").groupBy("source", "lang", (F.col("n_chars") % 7).alias("page")).agg(F.min("doc_id").alias("i"), F.count("*").alias("n"))
    pages = F.transform(F.array_sort(F.collect_list(F.struct("i", "page"))), lambda x: x["page"].cast("string"))
    return first.groupBy("source", "lang").agg(F.sum("n").alias("citations"), F.array_join(pages, ",").alias("pages"))


@query("""SELECT d.lang AS category, count(*) FILTER (WHERE l.doc_id IS NULL) AS waiting, count(*) FILTER (WHERE l.quality = 1 AND l.toxic = 0) AS ready, count(*) FILTER (WHERE l.quality = 0 OR l.toxic = 1) AS rejected FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def category_states(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return rows.groupBy(F.col("lang").alias("category")).agg(F.count_if(F.col("known").isNull()).alias("waiting"), F.count_if(good).alias("ready"), F.count_if((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("rejected"))


@query("""SELECT coalesce(CASE WHEN doc_id % 5 > 0 THEN 'c' || doc_id % 40 END, 's' || doc_id) AS book, count(*) AS parts, min(doc_id) AS first, string_agg(doc_id, ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1""")
def books(spark, sf_dir):
    i = F.col("doc_id")
    book = F.coalesce(F.when(i % 5 > 0, F.concat(F.lit("c"), (i % 40).cast("string"))), F.concat(F.lit("s"), i.cast("string")))
    members = F.array_join(F.array_sort(F.collect_list(i)).cast("array<string>"), ",")
    return table(spark, sf_dir, "documents").groupBy(book.alias("book")).agg(F.count("*").alias("parts"), F.min(i).alias("first"), members.alias("members"))


@query("""SELECT DISTINCT source AS chapter FROM documents d WHERE lang = 'en' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)""")
def chapters_in_scope(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").where("lang = 'en'").join(good, "doc_id", "left_semi").select(F.col("source").alias("chapter")).distinct()


@query("""WITH s AS (SELECT DISTINCT d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 0) SELECT d.source, count(*) AS pages FROM documents d WHERE EXISTS (SELECT 1 FROM s WHERE s.source = d.source) AND length(text) < 2000 GROUP BY d.source""")
def requeue_suspects(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    suspect = docs.select("doc_id", "source").join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi").select("source").distinct()
    return docs.where(F.length("text") < 2000).select("source").join(suspect, "source", "left_semi").groupBy("source").agg(F.count("*").alias("pages"))


@query("""SELECT o_custkey AS request, min(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS chosen, count(*) AS attempts, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END) AS cause
FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5) GROUP BY o_custkey""")
def first_valid_candidate(spark, sf_dir):
    """The first valid of at most five candidates in order, with what was tried."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    cause = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    rows = table(spark, sf_dir, "orders").withColumn("place", place).where("place <= 5")
    return rows.groupBy(F.col("o_custkey").alias("request")).agg(F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("chosen"), F.count("*").alias("attempts"), F.max(cause).alias("cause"))


@query("""SELECT s.source, n, unready, sizes, n > 0 AND unready = 0 AND sizes = 1 AS complete FROM (SELECT d.source, count(*) AS n, count(*) FILTER (WHERE e.vec_id IS NULL) AS unready, count(DISTINCT len(e.embedding)) AS sizes FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source) s""")
def activation_gate(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("size"))
    own = table(spark, sf_dir, "documents").select("doc_id", "source").join(vectors, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("size").isNull()).alias("unready"), F.count_distinct("size").alias("sizes"))
    return own.withColumn("complete", (F.col("n") > 0) & (F.col("unready") == 0) & (F.col("sizes") == 1))


@query("""WITH RECURSIVE tree AS (SELECT doc_id AS id, doc_id // 4 AS parent, lang AS heading FROM documents WHERE doc_id > 0), page AS (SELECT id, heading FROM tree QUALIFY row_number() OVER (PARTITION BY heading ORDER BY id) <= 50),
path AS (SELECT id, id AS node, 0 AS depth FROM page UNION ALL SELECT p.id, t.parent, depth + 1 FROM path p JOIN tree t ON t.id = p.node WHERE t.parent > 0 AND depth < 100),
totals AS (SELECT heading, count(*) AS total FROM tree GROUP BY heading), kids AS (SELECT parent, count(*) AS n, count(DISTINCT heading) AS kinds FROM tree GROUP BY parent)
SELECT p.id, any_value(page.heading) AS heading, any_value(total) AS total, string_agg(node, '/' ORDER BY depth DESC) AS full_path, any_value(coalesce(k.n, 0)) AS children, any_value(coalesce(k.kinds, 0)) AS kinds FROM path p JOIN page ON page.id = p.id JOIN totals USING (heading) LEFT JOIN kids k ON k.parent = p.id GROUP BY p.id""")
def rubric_search(spark, sf_dir):
    """The first page of every heading's matches in a tree, each with the number of all, its path from the root, its number of
    children and of their kinds; paths are made for the pages only."""
    tree = table(spark, sf_dir, "documents").where("doc_id > 0").select(F.col("doc_id").alias("id"), F.expr("doc_id div 4").alias("parent"), F.col("lang").alias("heading"))
    totals = tree.groupBy("heading").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("heading").orderBy("id"))
    page = tree.select("id", "heading", place.alias("place")).where("place <= 50").drop("place")
    above = tree.select("id", F.when(F.col("parent") > 0, F.col("parent")).alias("parent"))
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node")), asc=False), lambda x: x["node"].cast("string")), "/")
    paths = graph.ancestors(above, page).groupBy("id").agg(path.alias("full_path"))
    kids = tree.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"), F.count_distinct("heading").alias("kinds"))
    rows = page.join(totals, page["heading"].eqNullSafe(totals["heading"])).select("id", page["heading"], "total").join(paths, "id").join(kids, "id", "left")
    return rows.select("id", "heading", "total", "full_path", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("kinds", F.lit(0)).alias("kinds"))


@query("""SELECT a.doc_id, a.lang FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 4 AND a.doc_id > 0 WHERE a.lang <> b.lang AND b.lang <> 'en'""")
def v_tree_kinds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    parents = docs.where("lang <> 'en'").select(F.col("doc_id").alias("parent"), F.col("lang").alias("above"))
    return docs.where("doc_id > 0").withColumn("parent", F.expr("doc_id div 4")).join(parents, "parent").where("lang <> above").select("doc_id", "lang")


@query("""SELECT user_id, count(*) AS words, count(*) = 0 OR (count(*) >= 8 AND ((count(*) FILTER (WHERE value < 60) >= 5 AND count(*) FILTER (WHERE value < 60) > 0.15 * count(*)) OR (count(*) FILTER (WHERE value < 35) >= 3 AND count(*) FILTER (WHERE value < 35) > 0.05 * count(*)))) AS low FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def low_confidence_pages(spark, sf_dir):
    words = table(spark, sf_dir, "events").where("value is not null").select("user_id", F.col("value").alias("confidence"))
    return ocr_rules.low_confidence(words, "user_id", count="words")


@query("""SELECT conv_id, CASE WHEN a > 0 AND NOT u THEN 'no question' WHEN s > 0 AND a = 0 THEN 'no answer' WHEN t > 20 THEN 'long' END AS blocker FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS a, bool_or(role = 'user') AS u, count(*) FILTER (WHERE role = 'system') AS s, count(*) AS t FROM conversations GROUP BY conv_id)""")
def deletion_blockers(spark, sf_dir):
    role = F.col("role")
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(role == "assistant").alias("a"), F.bool_or(role == "user").alias("u"), F.count_if(role == "system").alias("s"), F.count("*").alias("t"))
    blocker = F.when((F.col("a") > 0) & ~F.col("u"), "no question").when((F.col("s") > 0) & (F.col("a") == 0), "no answer").when(F.col("t") > 20, "long")
    return own.select("conv_id", blocker.alias("blocker"))
