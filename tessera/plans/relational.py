"""Predicates, joins, aggregates, windows, sets and recursion of the reference, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions.rules import non_nulls
from tessera.operators import graph
from tessera.sources.tables import sql, table


@query("SELECT doc_id, source FROM documents WHERE lang IN ('en', 'de') AND (source ILIKE '%SRC1%' OR source = 'src2')")
def scope_filter(spark, sf_dir):
    scope = F.col("source").ilike("%SRC1%") | (F.col("source") == "src2")
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de") & scope).select("doc_id", "source")


@query("SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS v FROM events WHERE event_type IS DISTINCT FROM 'view' AND len(json_keys(props)) > 0")
def json_first_property(spark, sf_dir):
    keys = F.json_object_keys("props")
    rows = table(spark, sf_dir, "events").where(~F.col("event_type").eqNullSafe("view")).withColumn("k", keys).where("size(k) > 0")
    value = F.try_element_at(F.from_json("props", "map<string,string>"), F.element_at("k", 1))
    return rows.select("event_id", value.alias("v"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unreviewed_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def not_in_null_aware(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT c_nationkey FROM {customer} WHERE c_acctbal > 9900)", "supplier", "customer")


@query("""SELECT 'page' AS origin, p.page_id AS id, CAST(length(p.html) AS BIGINT) AS size, p.url AS place FROM pages p
UNION ALL SELECT 'block', d.doc_id, length(d.text), NULL FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1""")
def evidence_locations_union(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("size"), F.col("url").alias("place"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    blocks = table(spark, sf_dir, "documents").join(good, "doc_id").select(F.lit("block").alias("origin"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("size"), F.lit(None).cast("string").alias("place"))
    return pages.unionByName(blocks)


@query("""SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'poor' END, d.lang) AS category, CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 'section' ELSE 'source' END AS level
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def section_else_source_category(spark, sf_dir):
    own = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(own, "lang").alias("category"), F.when(own.isNotNull(), "section").otherwise("source").alias("level"))


def _windows(spark, sf_dir, step: int, size: int, shift: int = 0):
    """(doc_id, a, b): spans of a size at every step of each text, from arithmetic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n")).where(F.col("n") > shift)
    return docs.select("doc_id", F.explode(F.sequence(F.lit(shift).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("a")).withColumn("b", F.col("a") + size)


@query("""WITH c AS (SELECT doc_id, unnest(range(0, length(text), 400)) AS a FROM documents), e AS (SELECT doc_id, unnest(range(100, length(text), 1500)) AS a FROM documents WHERE length(text) > 100)
SELECT c.doc_id, c.a AS chunk, e.a AS entry FROM c JOIN e ON c.doc_id = e.doc_id AND c.a >= e.a AND c.a + 400 <= e.a + 1500""")
def span_containment(spark, sf_dir):
    """Chunks that lie wholly in an entry: an equi-join on the origin and a key of the entry's length, as a chunk that lies
    in an entry begins in the entry's own grid cell or the next one."""
    step = 1500
    c = _windows(spark, sf_dir, 400, 400).withColumn("cell", F.floor((F.col("a") - 100) / step))
    e = _windows(spark, sf_dir, step, step, 100).select("doc_id", F.col("a").alias("ea"), F.col("b").alias("eb")).withColumn("cell", F.floor((F.col("ea") - 100) / step))
    return c.join(e, ["doc_id", "cell"]).where("a >= ea and b <= eb").select("doc_id", F.col("a").alias("chunk"), F.col("ea").alias("entry"))


@query("""WITH c AS (SELECT doc_id, unnest(range(0, length(text), 700)) AS a FROM documents)
SELECT x.doc_id, x.a AS first, y.a AS second FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.a < y.a AND x.a < y.a + 1000 AND y.a < x.a + 1000""")
def span_overlap(spark, sf_dir):
    """Pairs of overlapping spans: each span is put in every grid cell that it touches; a pair counts in its first common cell."""
    return _overlaps(table(spark, sf_dir, "documents"))


def _overlaps(docs):
    docs = docs.select("doc_id", F.length("text").cast("long").alias("n")).where("n > 0")
    own = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(700).cast("long"))).alias("a")).withColumn("b", F.col("a") + 1000)
    cells = own.withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") / 1000), F.floor((F.col("b") - 1) / 1000))))
    x, y = cells.select("doc_id", "cell", F.col("a").alias("a1"), F.col("b").alias("b1")), cells.select("doc_id", "cell", F.col("a").alias("a2"), F.col("b").alias("b2"))
    near = x.join(y, ["doc_id", "cell"]).where("a1 < a2 and a1 < b2 and a2 < b1 and cell = floor(a2 / 1000)")
    return near.select("doc_id", F.col("a1").alias("first"), F.col("a2").alias("second"))


@query("SELECT c_custkey, o.o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) o ON true")
def lateral_latest(spark, sf_dir):
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(F.col("o_orderdate"), -F.col("o_orderkey"))).alias("o_orderkey"))
    return table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last).select("user_id", "e.event_id", "e.event_type")


@query("SELECT item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS label FROM benchmark")
def regex_label_explode(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("label"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE value > 50) AS high_users,
round(coalesce(sum(value), 0), 4) AS total, round(avg(value), 6) AS mean, max(ts) AS last FROM events GROUP BY event_type HAVING count(*) > 0""")
def filtered_counts(spark, sf_dir):
    high = F.col("value") > 50
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(high).alias("high"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(high, F.col("user_id"))).alias("high_users"),
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("last"),
    ).where("n > 0")


@query("""SELECT source, count(*) FILTER (WHERE length(text) < 1000) AS b0, count(*) FILTER (WHERE length(text) BETWEEN 1000 AND 9999) AS b1,
count(*) FILTER (WHERE length(text) BETWEEN 10000 AND 29999) AS b2, count(*) FILTER (WHERE length(text) >= 30000) AS b3 FROM documents GROUP BY source""")
def bucketed_counts(spark, sf_dir):
    n = F.length("text")
    bounds = [(0, 1000), (1000, 10000), (10000, 30000), (30000, 1 << 31)]
    return table(spark, sf_dir, "documents").groupBy("source").agg(*(F.count_if((n >= a) & (n < b)).alias(f"b{i}") for i, (a, b) in enumerate(bounds)))


@query("SELECT source, '[' || string_agg('{\"id\":' || doc_id || ',\"lang\":\"' || lang || '\"}', ',' ORDER BY doc_id) || ']' AS j FROM documents GROUP BY source")
def ordered_nested_json(spark, sf_dir):
    items = F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("id"), "lang")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.to_json(items).alias("j"))


@query("SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def object_agg(spark, sf_dir):
    own = table(spark, sf_dir, "documents").groupBy("source", "lang").count()
    m = F.map_from_entries(F.collect_list(F.struct("lang", "count")))
    pairs = F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at("m", k).cast("string")))
    return own.groupBy("source").agg(m.alias("m")).select("source", F.array_join(pairs, ",").alias("counts"))


@query("""SELECT source, string_agg(text, '|' ORDER BY r) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, text) AS r FROM documents) WHERE r <= 30 GROUP BY source""")
def first_n_string_agg(spark, sf_dir):
    """The whole texts of each source's first 30 documents."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.asc_nulls_last("doc_id"), F.asc_nulls_last("text")))
    first = table(spark, sf_dir, "documents").select("source", "text", place.alias("r")).where("r <= 30")
    return first.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("x")).select("source", F.array_join("x.text", "|").alias("texts"))


@query("""WITH w AS (SELECT user_id, event_id, event_type = 'error' AS miss, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, CAST(max(n) AS BIGINT) AS longest, max(n) < 5 AS ok FROM (SELECT user_id, g, count(*) AS n FROM w WHERE miss GROUP BY user_id, g) GROUP BY user_id""")
def miss_runs(spark, sf_dir):
    """Longest run of consecutive misses by key: gaps and islands by two row numbers."""
    miss = F.col("event_type") == "error"
    order = ["ts", "event_id"]
    g = F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - F.row_number().over(Window.partitionBy("user_id", miss).orderBy(*order))
    runs = table(spark, sf_dir, "events").withColumn("g", g).where(miss).groupBy("user_id", "g").count()
    return runs.groupBy("user_id").agg(F.max("count").alias("longest")).withColumn("ok", F.col("longest") < 5)


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading,
event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events""")
def carry_forward_heading(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    heading = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select("event_id", heading.alias("heading"), (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).alias("changed"))


@query("SELECT DISTINCT lang, source FROM documents UNION SELECT lang, 'any' FROM documents EXCEPT SELECT 'fr', 'any'")
def set_operations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    every = docs.select("lang", "source").union(docs.select("lang", F.lit("any").alias("source"))).distinct()
    return every.subtract(spark.createDataFrame([("fr", "any")], "lang string, source string"))


@query("""WITH RECURSIVE up AS (SELECT doc_id, doc_id AS node, 0 AS depth FROM documents UNION ALL SELECT doc_id, node // 3, depth + 1 FROM up WHERE node > 0 AND depth < 100)
SELECT doc_id, string_agg(node, '>' ORDER BY depth DESC) AS path, CAST(max(depth) AS INTEGER) AS depth FROM up GROUP BY doc_id""")
def ancestors_recursive(spark, sf_dir):
    """Every document's path from the root of a tree over the ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    tree = docs.select("id", F.when(F.col("id") > 0, F.expr("id div 3")).alias("parent"))
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node")), asc=False), lambda x: x["node"].cast("string")), ">")
    return graph.ancestors(tree, docs).groupBy(F.col("id").alias("doc_id")).agg(path.alias("path"), F.max("depth").alias("depth"))


@query("""WITH RECURSIVE hit AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT d.doc_id FROM documents d JOIN hit h ON d.doc_id // 3 = h.doc_id AND d.doc_id > 0) SELECT doc_id FROM hit""")
def lineage_recursive(spark, sf_dir):
    """Documents below a withdrawn one."""
    tree = table(spark, sf_dir, "documents").where("doc_id > 0").select(F.col("doc_id").alias("id"), F.expr("doc_id div 3").alias("parent"))
    return graph.descendants(tree, table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))).select(F.col("id").alias("doc_id"))


@query("""SELECT doc_id, kind FROM (SELECT doc_id, 'toxic' AS kind, 0 AS first FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'poor', 1 FROM labels WHERE quality = 0) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY first) = 1""")
def first_blocking_notice(spark, sf_dir):
    """Of two tables of notices the first that has one for a document."""
    labels = table(spark, sf_dir, "labels")
    first = labels.where("toxic = 1").select("doc_id", F.struct(F.lit(0).alias("o"), F.lit("toxic").alias("kind")).alias("n"))
    other = labels.where("quality = 0").select("doc_id", F.struct(F.lit(1).alias("o"), F.lit("poor").alias("kind")).alias("n"))
    return first.unionByName(other).groupBy("doc_id").agg(F.min("n").alias("n")).select("doc_id", "n.kind")


@query("""SELECT count(*) AS n, min(event_id) AS first, max(event_id) + 1 AS next FROM events WHERE event_type = 'error' HAVING count(*) > 0""")
def global_having(spark, sf_dir):
    """An aggregate over everything that gives no row where there is nothing, and the next number of a series."""
    own = table(spark, sf_dir, "events").where("event_type = 'error'").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), (F.max("event_id") + 1).alias("next"))
    return own.where("n > 0")


@query("""SELECT event_id, json_extract_string(json_merge_patch(props, '{"seen": 1}'), '$.seen') AS seen, len(json_keys(props)) + 1 AS keys, CASE WHEN length(trim(event_type)) < 5 THEN 'short' ELSE nullif(event_type, 'click') END AS kind, list_concat([event_type], ['x'])[2] AS added, (event_id % 2 = 0) <> (value > 50) AS either FROM events""")
def json_and_nulls(spark, sf_dir):
    """JSON merged and its keys counted, values that count as none, arrays with one more element, exactly one of two."""
    merged = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("seen"), F.lit("1")))
    kind = F.when(F.length(F.trim("event_type")) < 5, "short").otherwise(F.nullif(F.col("event_type"), F.lit("click")))
    even, high = F.when(F.col("event_id") % 2 == 0, 1), F.when(F.col("value") > 50, 1)
    return table(spark, sf_dir, "events").select(
        "event_id", F.element_at(merged, "seen").alias("seen"), F.size(merged).cast("long").alias("keys"), kind.alias("kind"), F.element_at(F.array_append(F.array("event_type"), F.lit("x")), 2).alias("added"), (non_nulls(even, high) == 1).alias("either")
    )


@query("""SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY l_suppkey""")
def inner_join_chain(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp '1995-01-01'").select("o_orderkey", "o_custkey")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey")
    people = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("revenue"))


@query("""SELECT nation.n_name AS nation, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, CAST(count(o_orderkey) AS BIGINT) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def scalar_counts(spark, sf_dir):
    """Counts by a parent: children are counted before the join, as a correlated count would be."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    own = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_nationkey", "c_mktsegment", "n")
    rows = own.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    lines = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))  # a customer without orders still makes one row
    return rows.groupBy(F.col("n_name").alias("nation")).agg(F.sum(F.when(F.col("c_mktsegment") == "BUILDING", lines).otherwise(0)).alias("building"), F.sum(F.coalesce("n", F.lit(0))).alias("orders"))
