"""Deletions over references, crawls under every limit, and table functions of SQL as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import tables
from tessera.operators import graph
from tessera.operators.deletion import Reference, delete
from tessera.sources.tables import sql, table

_REFERENCES = [Reference("orders", "o_custkey", "customer", "cascade"), Reference("lines", "l_orderkey", "orders", "cascade"), Reference("notes", "order", "orders", "block"), Reference("visits", "customer", "customer", "clear"), Reference("customer", "c_nationkey", "nation", "own")]


@query("""WITH roots AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0 OR c_nationkey < 5),
held AS (SELECT DISTINCT o_custkey AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 45),
gone AS (SELECT k FROM roots WHERE k NOT IN (SELECT k FROM held)),
left_ AS (SELECT * FROM customer WHERE c_custkey NOT IN (SELECT k FROM gone))
SELECT 'blocked' AS what, k AS key FROM roots WHERE k IN (SELECT k FROM held) UNION ALL SELECT 'customer', c_custkey FROM left_
UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'lines', l_orderkey * 10 + l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'visits', event_id FROM events WHERE user_id NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey IN (SELECT k FROM gone)) OR EXISTS (SELECT 1 FROM left_ WHERE c_nationkey = n_nationkey)""")
def deletion_closure(spark, sf_dir):
    """Customers to be deleted with their orders and lines, unless a note keeps an order; what is left of every table, visits that
    still name a customer, and nations that only deleted customers were of."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_orderkey")
    notes = t("lineitem").where("l_returnflag = 'R' and l_quantity > 45").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("note"), F.col("l_orderkey").alias("order"))
    own = {
        "customer": t("customer").select("c_custkey", "c_nationkey"), "orders": t("orders").select("o_orderkey", "o_custkey"), "lines": lines, "notes": notes,
        "visits": t("events").select("event_id", F.col("user_id").alias("customer")), "nation": t("nation").select("n_nationkey"),
    }
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lines": "line", "notes": "note", "visits": "event_id", "nation": "n_nationkey"}
    done = delete(own, keys, _REFERENCES, "customer", own["customer"].where("c_custkey % 3 = 0 or c_nationkey < 5").select("c_custkey"))
    out = done.blocked.select(F.lit("blocked").alias("what"), F.col("root").cast("long").alias("key"))
    for name in ("customer", "orders", "lines", "visits", "nation"):
        rows = done.tables[name]
        rows = rows.where("customer is not null") if name == "visits" else rows
        out = out.unionByName(rows.select(F.lit(name).alias("what"), F.col(keys[name]).cast("long").alias("key")))
    return out


_CRAWL_LINKS = "SELECT concat('d', doc_id) AS url, CAST(k AS INT) AS number, concat('d', CASE WHEN k = 0 THEN doc_id DIV 3 ELSE doc_id * 3 + k END) AS target, '' AS fragment, (doc_id + k) % 7 <> 6 AS allowed FROM {documents} LATERAL VIEW explode(sequence(0, 3)) e AS k"


@query()
def crawl_budgets(spark, sf_dir):
    """The documents and links of a crawl over all documents under limits on documents, bytes, time and links at once."""
    docs = table(spark, sf_dir, "documents")
    items = docs.select(F.concat(F.lit("d"), "doc_id").alias("url"), F.concat(F.lit("d"), "doc_id").alias("final_url"), F.when(F.col("doc_id") % 13 == 5, "failed").otherwise("fetched").alias("state"), F.array().cast("array<string>").alias("anchors"), F.octet_length("text").alias("bytes"), (F.col("doc_id") % 4).alias("seconds"))
    limits = {"most_depth": 4, "most_documents": 80, "most_bytes": 400_000, "most_seconds": 110, "most_links": 200}
    documents, links = graph.crawl(items, sql(spark, sf_dir, _CRAWL_LINKS, "documents"), "d0", **limits)
    return documents.select("url", "state", F.lit(None).cast("string").alias("target")).unionByName(links.select("url", "state", "target"))


@query("""WITH RECURSIVE cuts AS (SELECT doc_id, text, 0 AS number, CAST(0 AS BIGINT) AS start FROM (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z0-9]', '1', 'g')) AS text FROM documents)
UNION ALL SELECT doc_id, text, number + 1, start + 200 FROM cuts WHERE start + 200 < length(text))
SELECT doc_id, CAST(number AS INTEGER) AS number, CAST(start AS INTEGER) AS start, substr(text, start + 1, 200) AS passage FROM cuts WHERE length(text) > 0""")
def lateral_passages(spark, sf_dir):
    """Passages by a table function of SQL, of texts without white space or sentence ends, which are cut at the limit."""
    tables.register(spark)
    text = "SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z0-9]', '1')) AS text FROM {documents}"
    return spark.sql("SELECT d.doc_id, p.number, p.start, p.passage FROM {rows} d, LATERAL passages(d.text, 200) p", rows=sql(spark, sf_dir, text, "documents"))
