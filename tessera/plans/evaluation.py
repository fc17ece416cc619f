"""Evaluation metrics, cost ledgers, job states and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.operators import jobs
from tessera.sources.tables import table


@query("""WITH lists AS (SELECT l_suppkey AS c, l_partkey AS part, max(l_quantity) AS q, bool_or(l_returnflag = 'R') AS gold FROM lineitem GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY q DESC, part) AS r FROM lists)
SELECT c AS case_id, count(*) FILTER (WHERE gold) AS gold, round(count(*) FILTER (WHERE gold AND r <= 10) / nullif(count(*) FILTER (WHERE gold), 0), 6) AS recall FROM top GROUP BY c""")
def recall_at_10(spark, sf_dir):
    """Recall of the first ten of each ranked list against the set that is wanted; null where nothing is."""
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("case_id"), F.col("l_partkey").alias("part")).agg(F.max("l_quantity").alias("q"), F.bool_or(F.col("l_returnflag") == "R").alias("wanted"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("q"), "part"))
    own = lists.withColumn("place", place).groupBy("case_id").agg(F.count_if("wanted").alias("gold"), F.count_if(F.col("wanted") & (F.col("place") <= 10)).alias("hit"))
    return own.select("case_id", "gold", F.round(F.try_divide("hit", "gold"), 6).alias("recall"))


@query("""WITH c AS (SELECT o_custkey AS id, count(*) AS claims, count(*) FILTER (WHERE o_orderstatus = 'F') AS held, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS points, sum(o_totalprice) AS took FROM orders GROUP BY 1)
SELECT round(sum(held) / sum(claims), 6) AS support, round(avg(points / claims), 6) AS coverage, round(median(took), 4) AS median_took, sum(held) / sum(claims) >= 0.95 AND avg(points / claims) >= 0.9 AS gate FROM c""")
def claim_gates(spark, sf_dir):
    """Claim support over all claims, mean coverage of points, the median time and the gate on both shares."""
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("claims"), F.count_if(F.col("o_orderstatus") == "F").alias("held"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("points"), F.sum("o_totalprice").alias("took"))
    support, coverage = F.sum("held") / F.sum("claims"), F.avg(F.col("points") / F.col("claims"))
    return own.agg(F.round(support, 6).alias("support"), F.round(coverage, 6).alias("coverage"), F.round(F.median("took"), 4).alias("median_took"), ((support >= 0.95) & (coverage >= 0.9)).alias("gate"))


@query("""SELECT round(avg(CASE WHEN role = 'assistant' THEN length(text) END), 6) AS mean_length, round(median(length(text)), 6) AS median_length, bool_and(length(text) > 0) AS none_empty,
count(DISTINCT conv_id) AS cases, round(avg(CASE WHEN text LIKE '%?%' THEN 1.0 ELSE 0.0 END), 6) AS asked, avg(CASE WHEN text LIKE '%?%' THEN 1.0 ELSE 0.0 END) >= 0.9 AS gate FROM conversations""")
def eval_gates(spark, sf_dir):
    n, asks = F.length("text"), F.when(F.instr("text", "?") > 0, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "conversations").agg(
        F.round(F.avg(F.when(F.col("role") == "assistant", n)), 6).alias("mean_length"), F.round(F.median(n), 6).alias("median_length"), F.bool_and(n > 0).alias("none_empty"),
        F.count_distinct("conv_id").alias("cases"), F.round(F.avg(asks), 6).alias("asked"), (F.avg(asks) >= 0.9).alias("gate"),
    )


@query("""SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 4) AS known_cost, count(*) FILTER (WHERE event_type <> 'purchase') AS unknown_cost, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE event_type = 'click') / count(*) ELSE 0 END, 6) AS coverage FROM events GROUP BY user_id""")
def cost_ledger(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(F.sum(F.when(kind == "purchase", F.col("value"))), 4).alias("known_cost"), F.count_if(kind != "purchase").alias("unknown_cost"), F.round(F.count_if(kind == "click") / F.count("*"), 6).alias("coverage")
    )


@query("""SELECT k AS category, count(doc_id) AS n, count(doc_id) > 0 AS present FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('it')) c(k) LEFT JOIN documents ON lang = k GROUP BY k""")
def category_census(spark, sf_dir):
    known = spark.createDataFrame([(k,) for k in ("en", "de", "fr", "es", "it")], "category string")
    n = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("c"))
    return F.broadcast(known).join(n, "category", "left").select("category", F.coalesce("c", F.lit(0)).alias("n"), (F.coalesce("c", F.lit(0)) > 0).alias("present"))


@query("""WITH j AS (SELECT event_id, user_id % 6 AS attempts, ts AS at_time, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'waiting' ELSE 'running' END AS s FROM events)
SELECT event_id, CASE WHEN s = 'running' AND at_time + INTERVAL 90 SECOND < TIMESTAMP '2024-01-02' THEN CASE WHEN attempts >= 5 THEN 'failed' ELSE 'waiting' END WHEN s = 'failed' AND attempts < 5 THEN 'waiting' ELSE s END AS state,
CASE WHEN s = 'failed' AND attempts < 5 THEN at_time + to_minutes(attempts * attempts) END AS run_after FROM j""")
def retry_backoff_state(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "waiting").otherwise("running")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 6).cast("int").alias("attempts"), F.col("ts").alias("at"), kind.alias("status"))
    return jobs.settle(rows, F.lit("2024-01-02").cast("timestamp")).select("event_id", "state", "run_after")


@query("""WITH j AS (SELECT event_id, user_id % 6 AS attempts, ts AS at_time, CASE WHEN value > 90 THEN 0 WHEN value > 50 THEN 1 ELSE 2 END AS priority, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'waiting' ELSE 'running' END AS s FROM events)
SELECT event_id FROM j WHERE s = 'waiting' OR (s = 'running' AND attempts < 5 AND at_time + INTERVAL 90 SECOND < TIMESTAMP '2024-01-02') OR (s = 'failed' AND attempts < 5 AND at_time + to_minutes(attempts * attempts) <= TIMESTAMP '2024-01-02')
ORDER BY priority, at_time, event_id LIMIT 20""")
def next_claimable(spark, sf_dir):
    """The next twenty jobs: waiting ones, those whose lease has run out, and failures whose time has come again."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "waiting").otherwise("running")
    priority = F.when(F.col("value") > 90, 0).when(F.col("value") > 50, 1).otherwise(2)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 6).cast("int").alias("attempts"), F.col("ts").alias("at"), kind.alias("status"), priority.alias("priority"))
    return jobs.claimable(rows, F.lit("2024-01-02").cast("timestamp"), 20).select(F.col("id").alias("event_id"))


@query("""SELECT event_id, CASE WHEN user_id % 6 < 3 THEN ts + to_seconds((user_id % 6) * (user_id % 6)) END AS run_after FROM events WHERE event_type = 'error'""")
def capture_retries(spark, sf_dir):
    """Captures wait attempts squared seconds and are tried three times."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", (F.col("user_id") % 6).cast("int").alias("attempts"), F.col("ts").alias("at"), F.lit("failed").alias("status"))
    settled = jobs.settle(rows, F.lit("2024-01-02").cast("timestamp"), most=3, unit="secs")
    return settled.select("event_id", "run_after")


@query("""SELECT user_id, event_id, before, event_type AS after FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""")
def transition_log(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.lag("event_type").over(w).alias("before"), F.col("event_type").alias("after"))
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


@query("""SELECT d.source, len(list_filter([CASE WHEN count(*) FILTER (WHERE l.doc_id IS NULL) > 0 THEN 'unreviewed documents' END, CASE WHEN count(*) FILTER (WHERE l.toxic = 1) > 0 THEN 'toxic documents' END, CASE WHEN count(*) FILTER (WHERE l.quality = 0) > 0 THEN 'poor documents' END], lambda x: x IS NOT NULL)) AS blockers,
array_to_string(list_filter([CASE WHEN count(*) FILTER (WHERE l.doc_id IS NULL) > 0 THEN 'unreviewed documents' END, CASE WHEN count(*) FILTER (WHERE l.toxic = 1) > 0 THEN 'toxic documents' END, CASE WHEN count(*) FILTER (WHERE l.quality = 0) > 0 THEN 'poor documents' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source""")
def publication_blockers(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    rules = {"unreviewed documents": F.col("known").isNull(), "toxic documents": F.col("toxic") == 1, "poor documents": F.col("quality") == 0}
    reasons = F.array_compact(F.array(*(F.when(F.count_if(c) > 0, F.lit(r)) for r, c in rules.items())))
    return rows.groupBy("source").agg(reasons.alias("r")).select("source", F.size("r").cast("long").alias("blockers"), F.array_join("r", "; ").alias("reasons"))


@query("""WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, CAST(count(*) FILTER (WHERE p = role) AS BIGINT) AS repeated FROM t GROUP BY role""")
def conversation_report(spark, sf_dir):
    p = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("p", p).groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"), F.count_if(F.col("p") == F.col("role")).alias("repeated"))


@query("""SELECT conv_id, string_agg(CASE WHEN changed THEN coalesce(role, '') || chr(10) ELSE '' END || coalesce(text, ''), chr(10) ORDER BY place) AS exported FROM (
SELECT *, place = 1 OR role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY place) AS changed FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations)) GROUP BY conv_id""")
def plain_text_export(spark, sf_dir):
    """Every conversation as one text: whole turns in order, each role as a heading where it changes."""
    w = Window.partitionBy("conv_id").orderBy(*(F.asc_nulls_last(c) for c in ("turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").withColumn("place", F.row_number().over(w))
    changed = (F.col("place") == 1) | ~F.col("role").eqNullSafe(F.lag("role").over(w))
    line = F.concat(F.when(changed, F.concat(F.coalesce("role", F.lit("")), F.lit("\n"))).otherwise(""), F.coalesce("text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    return rows.withColumn("line", line).groupBy("conv_id").agg(lines.alias("x")).select("conv_id", F.array_join("x.line", "\n").alias("exported"))
