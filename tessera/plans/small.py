"""Small rules, cues and reports as queries, over texts and names made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import rules as R
from tessera.functions import text as T
from tessera.operators import classify
from tessera.sources.tables import sql, table

_NOTE = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('Like the others, ', lang) WHEN 1 THEN ' as  with rain' WHEN 2 THEN concat('wo[rd ', lang) WHEN 3 THEN 'Liked by some' WHEN 4 THEN concat('search_document: ', lang) ELSE 'similar to � x' END AS note, CASE doc_id % 5 WHEN 0 THEN 'A small green river mountain' WHEN 1 THEN 'Small green river mountain lakes' WHEN 2 THEN 'green green Green river' WHEN 3 THEN concat('The small river in ', substring(text, 1, 30)) ELSE 'The old road' END AS title, CASE WHEN doc_id % 2 = 0 THEN 'By a River, a small and GREEN mountain stands' ELSE concat('river small ', text) END AS body FROM {documents}"


@query(rf"""WITH n AS ({_NOTE.replace('{documents}', 'documents')}), w AS (SELECT *, list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+'), lambda x: strlen(x) >= 4) AS long, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS said FROM n)
SELECT doc_id, regexp_matches(lower(ltrim(note)), '^(like|as\s+with|similar\s+to)(\s|$)') AS opens, contains(note, chr(65533)) OR regexp_matches(note, '\p{{L}}[\[\]{{}}]\p{{L}}') AS damaged, regexp_replace(note, '^search_document: ', '') AS input,
len(list_distinct(long)) >= 3 AND len(list_distinct(list_filter(long, lambda x: list_contains(said, x)))) * 5 >= len(list_distinct(long)) * 4 AS matches, len(long) >= 3 AS long FROM w""")
def text_rules(spark, sf_dir):
    """Openings that compare, damaged words, inputs of an embedding model, and titles that a text holds."""
    rows = sql(spark, sf_dir, _NOTE, "documents")
    note = F.col("note")
    return rows.select(
        "doc_id", T.opening_comparison(note).alias("opens"), T.suspicious(note).alias("damaged"), R.embedding_input(note).alias("input"), T.title_matches(F.col("title"), F.col("body")).alias("matches"),
        (F.size(F.filter(T.tokens(F.col("title")), lambda w: F.octet_length(w) >= 4)) >= 3).alias("long"),
    )


_LINES = "SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'Mind.— quiet' WHEN 1 THEN ' urinary organs: x' WHEN 2 THEN 'Headlong words' WHEN 3 THEN concat('ROOT AND LEAF (', upper(o_orderstatus), ')') WHEN 4 THEN 'RELATIONSHIPS -- here' WHEN 5 THEN 'ONE TWO THREE FOUR FIVE SIX SEVEN' WHEN 6 THEN 'Skin' ELSE CASE WHEN o_orderkey % 3 = 0 THEN concat(upper(o_orderstatus), CAST(o_custkey AS STRING)) WHEN o_orderkey % 3 = 1 THEN upper(o_orderpriority) ELSE concat(o_orderstatus, 'B') END END AS line FROM {orders}"


@query(rf"""WITH l AS ({_LINES.replace('{orders}', 'orders')}), k AS (SELECT id, line, lower(regexp_extract(line, '(?i)^[\s\p{{Z}}]*({'|'.join(T.SECTION_LABELS)})[\s\p{{Z}}]*(?:$|[.:—]|--)', 1)) AS label, regexp_replace(line, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS bare FROM l)
SELECT id, label, label <> '' OR (regexp_full_match(bare, '(\p{{Lu}}|[\s\p{{Z}}]|[()-])+') AND len(regexp_extract_all(bare, '\p{{Lu}}')) >= 3 AND len(string_split_regex(bare, '[\s\p{{Z}}]+')) <= 6 AND length(bare) <= 80) AS heading FROM k""")
def line_kinds(spark, sf_dir):
    """The section label that opens a line, and whether the line is a heading."""
    rows = sql(spark, sf_dir, _LINES, "orders")
    return rows.select("id", T.section_label(F.col("line")).alias("label"), T.is_heading(F.col("line")).alias("heading"))


_CUED = "SELECT doc_id, concat(text, CASE doc_id % 7 WHEN 0 THEN ' A Materia Medica with MODALITIES.' WHEN 1 THEN ' repertory, rubrics, rubric' WHEN 2 THEN ' a proving by a prover' WHEN 3 THEN ' a randomised meta-analysis with a confidence interval' WHEN 4 THEN ' vital force' WHEN 5 THEN ' therapeutics: indications for the organon, aphorism 3' ELSE '' END) AS text FROM {documents}"
_TABLE = ", ".join(f"('{k}', '{c}')" for k, cues in classify.CUES.items() for c in cues)


@query(f"WITH d AS ({_CUED.replace('{documents}', 'documents')}) SELECT doc_id, kind, CAST(count(*) AS INTEGER) AS score FROM d JOIN (VALUES {_TABLE}) c(kind, cue) ON contains(lower(text), cue) GROUP BY ALL HAVING count(*) >= 2")
def cue_categories(spark, sf_dir):
    """The kinds of literature whose cues a text holds, two or more of one kind, with their number."""
    rows = sql(spark, sf_dir, _CUED, "documents").select("doc_id", F.lower("text").alias("low"))
    scores = F.array(*(F.struct(F.lit(k).alias("kind"), classify.cue_score(F.col("low"), cues).alias("score")) for k, cues in classify.CUES.items()))
    return rows.select("doc_id", F.explode(scores).alias("s")).select("doc_id", "s.*").where("score >= 2")


_PLACE = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN ' CC-BY' WHEN 1 THEN 'cc0-1.0' WHEN 2 THEN 'cc-by-nc' ELSE 'cc-by-4.0' END AS licence, CASE o_orderkey % 3 WHEN 0 THEN 'publishedVersion' WHEN 1 THEN 'acceptedVersion' ELSE 'submittedVersion' END AS version, CASE o_orderkey % 5 WHEN 0 THEN 'landing' WHEN 1 THEN 'xml' ELSE 'pdf' END AS form, concat('http://h/', o_orderkey) AS url, CASE o_orderkey % 6 WHEN 0 THEN 'https://creativecommons.org/licenses/by/4.0/' WHEN 1 THEN 'HTTP://CREATIVECOMMONS.ORG/publicdomain/zero/1.0/' WHEN 2 THEN 'https://creativecommons.org/licenses/by-nd/4.0/' ELSE 'https://other.org/licenses/by/4.0/' END AS address FROM {orders}"


@query(rf"""SELECT id, CASE WHEN lower(trim(licence)) IN ({', '.join(f"'{x}'" for x in R.LICENCES)}) AND version IN ({', '.join(f"'{x}'" for x in R.VERSIONS)}) AND form IN ('pdf', 'html', 'landing') THEN url || ' ' || CASE form WHEN 'landing' THEN 'html' ELSE form END END AS place,
regexp_matches(lower(address), '^https?://creativecommons\.org/(licenses/by(-sa)?|publicdomain/zero)/') AS open FROM ({_PLACE.replace('{orders}', 'orders')})""")
def open_places(spark, sf_dir):
    """Where papers may be fetched, by licence, version and format, and whether a licence's address is an open one."""
    rows = sql(spark, sf_dir, _PLACE, "orders")
    place = R.open_location(*(F.col(c) for c in ("licence", "version", "form", "url")))
    return rows.select("id", F.concat(place["url"], F.lit(" "), place["format"]).alias("place"), T.open_licence(F.col("address")).alias("open"))


@query("SELECT event_id, user_id = 7 OR user_id % 10 = 3 AS readable FROM events WHERE user_id % 10 = 3 OR user_id = 7")
def readable_answers(spark, sf_dir):
    """Answers that reader 7 may read: their own, and those of groups where they are an administrator."""
    admin = F.col("user_id") % 10 == 3
    rows = table(spark, sf_dir, "events").select("event_id", R.may_read(F.col("user_id"), F.lit(7), admin).alias("readable"))
    return rows.where("readable")


@query("""WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page, quality = 0 AS suspect, quality IS NULL AS missing FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, page, doc_id, coalesce(suspect, false) AS attention FROM p WHERE coalesce(suspect, false) OR page BETWEEN 0 AND 29""")
def page_windows(spark, sf_dir):
    """Each source's first window of thirty pages, and beyond it the pages that need attention."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("attention"))
    page = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long")
    rows = table(spark, sf_dir, "documents").select("source", "doc_id").join(labels, "doc_id", "left").withColumns({"page": page, "attention": F.coalesce("attention", F.lit(False))})
    return rows.where((F.col("page") < 30) | F.col("attention")).select("source", "page", "doc_id", "attention")


@query("""WITH r AS (SELECT source, count(*) FILTER (WHERE quality = 0) AS poor, count(*) AS pages FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source), j AS (SELECT source, CASE WHEN sum(n_chars) % 2 = 0 THEN 'done' ELSE 'waiting' END AS state FROM documents GROUP BY source)
SELECT source, CASE WHEN poor > 0 THEN 'waiting' ELSE state END AS state, CASE WHEN poor > 0 THEN poor ELSE NULL END AS total, CASE WHEN poor > 0 THEN 10 ELSE 0 END AS priority FROM r JOIN j USING (source)""")
def requeue_upsert(spark, sf_dir):
    """Jobs after suspect pages have been put in the queue again: a source with some gets or takes over one job, with the number
    of its pages and a priority; the other jobs stay."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    again = docs.join(labels.where("quality = 0"), "doc_id").groupBy("source").agg(F.count("*").alias("total"))
    jobs = docs.groupBy("source").agg(F.when(F.sum("n_chars") % 2 == 0, "done").otherwise("waiting").alias("state"))
    hit = F.col("total").isNotNull()
    return jobs.join(again, "source", "left").select("source", F.when(hit, "waiting").otherwise(F.col("state")).alias("state"), "total", F.when(hit, 10).otherwise(0).alias("priority"))


@query("""SELECT c.conv_id, count(*) FILTER (WHERE role = 'assistant') AS candidates, count(*) FILTER (WHERE role = 'assistant' AND length(text) > 300) AS cited, round(CASE WHEN count(*) FILTER (WHERE role = 'assistant') > 0 THEN count(*) FILTER (WHERE role = 'assistant' AND length(text) > 300) / count(*) FILTER (WHERE role = 'assistant') ELSE 0 END, 6) AS coverage,
left(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user'), 500) AS question, '[' || string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) || ']' AS turns FROM conversations c GROUP BY c.conv_id""")
def answer_report(spark, sf_dir):
    """The report of each answer: candidates, how many are cited and their share, the question's beginning as a report shows it,
    and its turns in order."""
    mine, long = F.col("role") == "assistant", F.length("text") > 300
    asked = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"]), " ")
    n, cited = F.count_if(mine), F.count_if(mine & long)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        n.alias("candidates"), cited.alias("cited"), F.round(F.when(n > 0, cited / n).otherwise(0.0), 6).alias("coverage"), F.nullif(F.left(asked, F.lit(500)), F.lit("")).alias("question"), F.to_json(F.array_sort(F.collect_list("turn"))).alias("turns")
    )
