"""Edited reviews, front matter, the reader and balanced choices as queries. Lines of documents stand for blocks and title pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import front
from tessera.functions.review import review
from tessera.sources import reader
from tessera.sources.tables import table

_BLOCKS = r"""b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS number, x AS original FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS l FROM documents)) WHERE length(x) > 0)"""
# an edit leaves out every fifth block, trims every third to its first half, and ends in strange words for some documents
_EDITED = """e AS (SELECT doc_id, list(p ORDER BY number) AS ps FROM (SELECT doc_id, number, trim(CASE WHEN number % 3 = 1 THEN substr(original, 1, CAST(ceil(length(original) / 2.0) AS INTEGER)) ELSE original END, ' ') AS p FROM b WHERE number % 5 <> 2) GROUP BY doc_id)"""


@query(f"""WITH RECURSIVE {_BLOCKS}, {_EDITED},
t AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN list_append(coalesce(ps, []), 'words that no block holds') ELSE coalesce(ps, []) END AS ps, n FROM (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id) LEFT JOIN e USING (doc_id)),
walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS number, CAST(0 AS BIGINT) AS p, CAST(NULL AS VARCHAR) AS excerpt, ps, n FROM t
UNION ALL SELECT w.doc_id, b.number, p + CASE WHEN p < len(ps) AND contains(b.original, ps[p + 1]) THEN 1 ELSE 0 END, CASE WHEN p < len(ps) AND contains(b.original, ps[p + 1]) THEN ps[p + 1] END, ps, n FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.number = w.number + 1),
bad AS (SELECT doc_id FROM walk WHERE number = n AND p < len(ps))
SELECT w.doc_id, CAST(w.number AS INTEGER) AS number, CAST(strpos(b.original, excerpt) - 1 AS INTEGER) AS start, excerpt, false AS refused FROM walk w JOIN b USING (doc_id, number) WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = w.doc_id)
UNION ALL SELECT doc_id, NULL, NULL, NULL, true FROM bad""")
def review_mapping(spark, sf_dir):
    """Every document's lines as blocks, an edit of them, and what each block keeps, or that the edit is refused."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).select("doc_id", "i", F.trim("x").alias("original")).where("original <> ''")
    blocks = lines.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")).alias("number"), "original")
    half = F.substring("original", F.lit(1), F.ceil(F.length("original") / 2).cast("int"))
    part = F.when(F.col("number") % 5 != 2, F.trim(F.when(F.col("number") % 3 == 1, half).otherwise(F.col("original"))))
    texts = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("number", part.alias("p"))))), lambda x: x["p"]), "\n\n").alias("edited"))
    strange = F.when(F.col("doc_id") % 11 == 0, F.concat("edited", F.lit("\n\nwords that no block holds"))).otherwise(F.col("edited"))
    rows = review(blocks.withColumnRenamed("doc_id", "key"), texts.select(F.col("doc_id").alias("key"), strange.alias("edited")))
    return rows.select(F.col("key").alias("doc_id"), "number", "start", "excerpt", F.col("problem").isNotNull().alias("refused"))


_PAGE = "CASE doc_id % 4 WHEN 0 THEN concat('Digitized by a library', chr(10), text, chr(10), 'Third Edition') WHEN 1 THEN concat(text, chr(10), 'by the late Anna Moss') WHEN 2 THEN concat('vol. iv', chr(10), 'BY', chr(10), source, ' Fern', chr(10), text) ELSE text END"
_SQUEEZED = r"list_filter(list_transform(string_split(replace(raw, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(x, '[\t\n\x0b\f\r ]+', ' ', 'g'), ' ')), lambda x: x <> '')"


@query(rf"""WITH p AS (SELECT doc_id, {_PAGE} AS raw FROM documents), l AS (SELECT doc_id, raw, {_SQUEEZED} AS l FROM p),
f AS (SELECT doc_id, raw, list_filter(list_transform(list_filter(l[1:10], lambda x: strlen(x) BETWEEN 8 AND 120 AND NOT regexp_matches(x, '(?is)^(digitized|google|copyright|library|by |by$)|http')), lambda x: trim(x, ' .;,:')), lambda x: x <> '') AS t,
list_filter(list_transform(l, lambda x, i: CASE WHEN regexp_extract(x, '{front.AUTHOR.replace("'", "''")}', 1) <> '' THEN trim(regexp_extract(x, '{front.AUTHOR.replace("'", "''")}', 1), ' .;,:') WHEN lower(x) = 'by' THEN trim(coalesce(l[i + 1], ''), ' .;,:') ELSE '' END), lambda x: x <> '' AND length(x) <= 300) AS a FROM l)
SELECT doc_id, coalesce(t[1], '') AS title, coalesce(a[1], '') AS author, CASE WHEN regexp_matches(raw, '{front.EDITION}') THEN trim(regexp_extract(raw, '{front.EDITION}', 0), ' .;,:') WHEN regexp_extract(raw, '{front.VOLUME}', 1) <> '' THEN 'Volume ' || upper(regexp_extract(raw, '{front.VOLUME}', 1)) ELSE '' END AS edition FROM f""")
def front_matter(spark, sf_dir):
    """Title, author and edition of every document as a title page, some with lines of our own before or behind."""
    d, nl, text = F.col("doc_id") % 4, F.lit("\n"), F.col("text")
    raw = F.when(d == 0, F.concat(F.lit("Digitized by a library\n"), text, F.lit("\nThird Edition"))).when(d == 1, F.concat(text, F.lit("\nby the late Anna Moss"))).when(d == 2, F.concat(F.lit("vol. iv\nBY\n"), "source", F.lit(" Fern"), nl, text)).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", front.front_matter(raw).alias("f")).select("doc_id", "f.title", "f.author", "f.edition")


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&#34;')"


@query(f"""WITH d AS (SELECT doc_id, text AS original, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'the', '<the> "it''s" & more') ELSE text END AS r, CAST(doc_id % 50 AS INTEGER) - 1 AS s, CAST(doc_id % 50 + doc_id % 7 * 40 AS INTEGER) - 1 AS e FROM documents)
SELECT doc_id, CASE WHEN s >= 0 AND e > s AND e <= length(r) THEN '<section id="saved-passage"><h2>Passage</h2>' || CASE WHEN original = r THEN '' ELSE '<p>This block was corrected; compare it with the original below.</p>' END || '<pre>' || {_ESC.format('substr(r, 1, s)')} || '<mark>' || {_ESC.format('substr(r, s + 1, e - s)')} || '</mark>' || {_ESC.format('substr(r, e + 1)')} || '</pre></section>' END AS shown FROM d""")
def reader_targets(spark, sf_dir):
    """A passage of every document as the reader shows it; a third are corrected, some spans are none."""
    d = F.col("doc_id")
    changed = F.when(d % 3 == 0, F.replace("text", F.lit("the"), F.lit("<the> \"it's\" & more"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("o"), changed.alias("r"), ((d % 50).cast("int") - 1).alias("s"), ((d % 50 + d % 7 * 40).cast("int") - 1).alias("e"))
    return rows.select("doc_id", reader.target(F.col("o"), F.col("r"), F.col("s"), F.col("e")).alias("shown"))


@query()
def reader_pages(spark, sf_dir):
    """Every page as the reader shows it."""
    return reader.shown_pages(table(spark, sf_dir, "pages"))


def supplements(hits, most: int = 6, question: str = "question", label: str = "rank", author: str = "author"):
    """(question, author, rank, turn) of what a draft leaves unused and is asked for next, at most `most` of a question: in a
    first round the authors that no cited hit is of, in the order of their first hit; then hits left over in their order.

    hits: (question, rank, author, used). Hits without an author share one.
    """
    own = Window.partitionBy(question, author)
    rows = hits.withColumn("__shown", F.max(F.col("used").cast("int")).over(own)).where(~F.col("used"))
    first = F.row_number().over(own.orderBy(label)) == 1
    rows = rows.withColumn("round", F.when((F.col("__shown") == 0) & first, 1).otherwise(2))
    turn = F.row_number().over(Window.partitionBy(question).orderBy("round", label))
    return rows.withColumn("turn", turn.cast("int")).where(F.col("turn") <= most).select(question, author, label, "round", "turn")


@query("""WITH h AS (SELECT o_custkey AS question, o_orderkey AS rank, o_orderkey % 5 AS author, o_totalprice < 100000 AS used FROM orders),
m AS (SELECT *, bool_or(used) OVER (PARTITION BY question, author) AS shown, row_number() OVER (PARTITION BY question, author, used ORDER BY rank) AS n FROM h),
r AS (SELECT *, CASE WHEN NOT shown AND n = 1 THEN 1 ELSE 2 END AS round FROM m WHERE NOT used)
SELECT question, author, rank, CAST(round AS INTEGER) AS round, CAST(row_number() OVER (PARTITION BY question ORDER BY round, rank) AS INTEGER) AS turn FROM r QUALIFY turn <= 6""")
def balanced_supplements(spark, sf_dir):
    """Orders stand for hits, customers for questions: which unused hits are asked for next, authors not shown yet first."""
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("rank"), (F.col("o_orderkey") % 5).alias("author"), (F.col("o_totalprice") < 100000).alias("used"))
    return supplements(hits)
