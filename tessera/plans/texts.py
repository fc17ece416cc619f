"""Text functions, passages, classifiers and quality checks as queries."""

from __future__ import annotations

from collections import Counter
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import passages as P
from tessera.functions import text as T
from tessera.operators import classify as C
from tessera.operators.page_text import checked_pages as P_checked
from tessera.operators.page_text import measured
from tessera.sources.tables import sql, table


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM documents")
def norm_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_name(F.col("text")).alias("norm"))


@query(f"""WITH w AS (SELECT item_id, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS x FROM benchmark)),
f AS (SELECT item_id, w, min(i) AS i FROM w WHERE length(w) >= 3 AND w NOT IN ({', '.join(f"'{w}'" for w in T.STOP)}) GROUP BY ALL)
SELECT b.item_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS terms FROM benchmark b LEFT JOIN (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i) <= 16) f ON f.item_id = b.item_id GROUP BY b.item_id""")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query(r"""SELECT doc_id, contains(' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ', ' of the ') AS hit FROM documents""")
def phrase_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.holds_phrase(F.col("text"), F.lit("Of  the")).alias("hit"))


@query(r"SELECT conv_id, turn, octet_length(encode(text)) <= 1000 AND regexp_matches(text, '[\p{L}\p{N}]{3,}') AS ok FROM conversations")
def valid_questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.valid_question(F.col("text")).alias("ok"))


@query("SELECT doc_id, sha256(text) AS sha, substring(text, 11, 30) AS span, length(text) AS n FROM documents")
def content_identity(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), T.span_text(t, F.lit(10), F.lit(40)).alias("span"), F.length("text").cast("long").alias("n"))


@query()
def split_passages(spark, sf_dir):
    return P.passages(table(spark, sf_dir, "documents"))


@query()
def locate_quote(spark, sf_dir):
    """A few words from within each document, asked for without its punctuation: their exact place."""
    words = T.tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.array_join(F.slice(words, 11, 6), " ").alias("quote"))
    return rows.select("doc_id", "quote", P.located(F.col("text"), F.col("quote")).alias("at")).select("doc_id", "quote", F.col("at")[0].alias("start"), F.col("at")[1].alias("end"))


@query()
def classify_literature(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", C.literature(F.col("text")).alias("c"))
    return rows.select("doc_id", "c.categories", "c.state")


def _evidence_sql() -> str:
    some = lambda cues: "(" + " OR ".join(f"contains(t, '{c}')" for c in cues) + ")"
    whens = []
    for kind, one, also, never in C.EVIDENCE:
        parts = [some(one), *([some(also)] if also else []), *([f"NOT {some(never)}"] if never else [])]
        whens.append(f"WHEN {' AND '.join(parts)} THEN '{kind}'")
    return f"SELECT doc_id, CASE {' '.join(whens)} ELSE 'unknown' END AS category FROM (SELECT doc_id, lower(coalesce({', '.join(f'TRY(decode(array_slice(encode(text), 1, {8000 - k})))' for k in range(4))})) AS t FROM documents)"


@query(_evidence_sql())
def classify_evidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.evidence_type(F.col("text")).alias("category"))


_SIDES = r"""a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents) GROUP BY ALL)"""


@query(f"""WITH {_SIDES}, p AS (SELECT doc_id + 1 AS doc_id, w, n FROM a), m AS (SELECT a.doc_id, sum(least(a.n, p.n)) AS hit FROM a JOIN p USING (doc_id, w) GROUP BY a.doc_id), t AS (SELECT doc_id, sum(n) AS n FROM a GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(hit, 0) AS BIGINT) AS matched, CAST(t.n AS BIGINT) AS words, round(coalesce(hit, 0) / t.n, 6) AS coverage FROM t LEFT JOIN m USING (doc_id)""")
def multiset_coverage(spark, sf_dir):
    """Share of each document's words, as a multiset, that the document before it holds. A document's words go once to its own
    number and once to the next, as one row; where they lie, they are counted one document after the other."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("w")).where("w <> ''")
    sides = words.select("doc_id", F.lit(True).alias("own"), "w").unionByName(words.where("doc_id is not null").select(F.col("doc_id") + 1, F.lit(False), "w").toDF("doc_id", "own", "w"))
    rows = sides.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_overlaps, "doc_id long, matched long, words long")
    return rows.select("doc_id", "matched", "words", F.round(F.col("matched") / F.col("words"), 6).alias("coverage"))


def _overlaps(batches):
    """(doc_id, matched, words) of rows (doc_id, own, w) in the order of doc_id: w are words of the document itself or of the one
    before it. Rows of a document add up; those that have no words of their own are left out."""
    sides = ((d, own, w) for batch in batches for a in range(0, len(batch), 100) for d, own, w in zip(*(c.to_pylist() for c in batch.slice(a, 100).columns)))
    out = []
    for d, rows in groupby(sides, itemgetter(0)):
        counts = {True: Counter(), False: Counter()}
        for _, own, w in rows:
            counts[own].update(w.split(" "))
        if n := counts[True].total():
            before = counts[False]
            out.append((d, sum(min(k, before[w]) for w, k in counts[True].items() if w in before), n))
        if len(out) == 10_000:
            yield _counted(out)
            out = []
    if out:
        yield _counted(out)


def _counted(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "matched", "words"])


_PAGES = """SELECT doc_id AS page_id, CASE WHEN doc_id % 11 = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN concat(text, ' wo[rd ') ELSE text END AS stored, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN replace(text, 'an', 'on') WHEN 2 THEN concat('one two three four five six ', text) WHEN 3 THEN concat(text, ' ', text) ELSE replace(text, 'e', 'c') END AS fresh,
CASE doc_id % 3 WHEN 0 THEN 'low confidence' WHEN 1 THEN '' ELSE 'dark' END AS warning, CASE WHEN doc_id % 2 = 0 THEN 'PDF text' ELSE 'OCR' END AS method, 0.0001 * (doc_id % 4) AS dark, 0.001 AS edges FROM {documents}"""
_W = r"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+')"


@query(rf"""WITH p AS ({_PAGES.replace('{documents}', 'documents')}), t AS (SELECT page_id, {_W.format(x='stored')} AS o, {_W.format(x='fresh')} AS n FROM p),
oc AS (SELECT page_id, w, count(*) AS c FROM (SELECT page_id, unnest(o) AS w FROM t) GROUP BY ALL), nw AS (SELECT page_id, unnest(n) AS w, unnest(range(len(n))) AS i FROM t), nc AS (SELECT page_id, w, count(*) AS c FROM nw GROUP BY ALL),
mt AS (SELECT page_id, CAST(sum(least(oc.c, nc.c)) AS BIGINT) AS matched FROM nc JOIN oc USING (page_id, w) GROUP BY page_id),
k AS (SELECT nw.page_id, i, len(n) AS size, oc.w IS NOT NULL AS known, length(nw.w) AS l FROM nw JOIN t ON t.page_id = nw.page_id LEFT JOIN oc ON oc.page_id = nw.page_id AND oc.w = nw.w),
r AS (SELECT page_id, count(*) FILTER (WHERE known AND i < 12) AS f, count(*) FILTER (WHERE known AND i >= size - 12) AS l FROM k GROUP BY page_id),
g AS (SELECT page_id, known, l, count(*) FILTER (WHERE known) OVER (PARTITION BY page_id ORDER BY i) AS island FROM k), run AS (SELECT page_id, max(c) AS run FROM (SELECT page_id, island, count(*) FILTER (WHERE NOT known AND l >= 3) AS c FROM g GROUP BY ALL) GROUP BY page_id),
m AS (SELECT p.*, len(o) AS a, len(n) AS b, coalesce(matched, 0) AS matched, coalesce(f, 0) AS f, coalesce(r.l, 0) AS l, coalesce(run, 0) AS run, contains(stored, chr(65533)) OR regexp_matches(stored, '\p{{L}}[\[\]{{}}]\p{{L}}') AS damaged FROM p JOIN t USING (page_id) LEFT JOIN mt USING (page_id) LEFT JOIN r USING (page_id) LEFT JOIN run USING (page_id)),
c AS (SELECT *, CASE WHEN b > 0 AND NOT damaged AND b >= 8 THEN matched / b ELSE 0.0 END AS share, CASE WHEN damaged THEN 'damaged' WHEN b < 8 THEN 'unread' WHEN a < b * 0.7 THEN 'shorter' WHEN matched / b < 0.88 OR abs(a - b) > greatest(12, b * 0.35) THEN 'different' WHEN b >= 40 AND f < 6 THEN 'opening' ELSE 'agrees' END AS why FROM m),
d AS (SELECT *, CASE WHEN warning = '' THEN why WHEN warning = 'low confidence' AND method = 'PDF text' AND NOT damaged AND matched >= 0.8 * b AND a >= 80 AND b >= 80 AND a / greatest(b, 1) BETWEEN 0.9 AND 1.2 AND run < 5 AND f >= 4 AND l >= 4 THEN 'isolated' WHEN why <> 'agrees' THEN why ELSE warning END AS reason, length(trim(stored)) < 10 AS bare FROM c)
SELECT page_id, CASE WHEN NOT bare THEN 'text' WHEN dark <= 0.0002 AND edges <= 0.0067 THEN 'blank' ELSE 'unclassified' END AS kind, CASE WHEN bare THEN CASE WHEN dark <= 0.0002 AND edges <= 0.0067 THEN 'auto_checked' ELSE 'needs_review' END WHEN reason IN ('agrees', 'isolated') THEN 'auto_checked' ELSE 'needs_review' END AS review,
CASE WHEN NOT bare THEN reason END AS reason, CASE WHEN NOT bare THEN round(share, 6) END AS coverage FROM d""")
def checked_pages(spark, sf_dir):
    """Pages whose stored text and fresh reading are made from each document, judged by both and by their scan's measures."""
    return P_checked(sql(spark, sf_dir, _PAGES, "documents"))


@query("""SELECT doc_id, CAST((contains(lower(text), 'password')) AS INTEGER) + CAST(contains(lower(text), 'token') AS INTEGER) + CAST(contains(lower(text), 'license') AS INTEGER) AS score FROM documents""")
def cue_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.cue_score(F.lower("text"), ("password", "token", "license")).alias("score"))


_RUBRICS = "SELECT doc_id, concat('  ', lang, ' roots: Moss., Fern.', chr(10), source, ': Pine.;Ash-t. ', chr(10), 'bad: Moss.,, Fern.', chr(10), 'same: Moss., Moss.', chr(10), text, chr(10), 'Last: Oak.') AS text FROM {documents}"


@query(rf"""WITH l AS (SELECT doc_id, unnest(x) AS whole, unnest(range(len(x))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM ({_RUBRICS.replace('{documents}', 'documents')}))),
o AS (SELECT *, coalesce(sum(length(whole) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM l),
r AS (SELECT doc_id, line, trim(whole) AS exact, base + length(whole) - length(ltrim(whole)) AS start, trim(split_part(trim(whole), ':', 1)) AS heading, list_transform(string_split_regex(substr(trim(whole), instr(trim(whole), ':') + 1), '[,;]'), lambda x: trim(x)) AS names FROM o WHERE contains(whole, ':'))
SELECT doc_id, CAST(line AS INTEGER) AS line, heading, array_to_string(names, ' ') AS names, CAST(start AS INTEGER) AS start, exact FROM r
WHERE heading <> '' AND length(heading) <= 200 AND NOT regexp_matches(heading, '[.;]') AND len(string_split(heading, ' ')) <= 12 AND len(list_distinct(names)) = len(names) AND len(list_filter(names, lambda x: NOT regexp_matches(x, '^\p{{L}}[\p{{L}}\p{{N}}-]{{0,29}}\.$'))) = 0""")
def rubric_rows(spark, sf_dir):
    """Rows of a heading and abbreviated names on pages made of the documents with such rows around them."""
    rows = P.rubric_rows(sql(spark, sf_dir, _RUBRICS, "documents"))
    return rows.select("doc_id", "line", "heading", F.array_join("notations", " ").alias("names"), "start", "exact")


@query(r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(regexp_replace(text, '-\s*\n\s*', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents), q AS (SELECT doc_id, w, CASE doc_id % 3 WHEN 0 THEN array_to_string(w[11:16], ' ') WHEN 1 THEN array_to_string(w[11:13], ' ') ELSE array_to_string(w[11:14], '-, ') || ' elsewhere' END AS quote FROM w)
SELECT doc_id, length(quote) <= 500 AND len(regexp_extract_all(quote, '[\p{L}\p{N}]+')) >= 4 AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(regexp_extract_all(quote, '[\p{L}\p{N}]+'), ' ') || ' ') AS held FROM q""")
def quotes_held(spark, sf_dir):
    """Whether documents hold quotations of some of their words, of too few, and of words that are not theirs."""
    w = F.regexp_extract_all(F.lower(F.regexp_replace("text", r"-\s*\n\s*", "")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    quote = F.when(F.col("doc_id") % 3 == 0, F.array_join(F.slice(w, 11, 6), " ")).when(F.col("doc_id") % 3 == 1, F.array_join(F.slice(w, 11, 3), " ")).otherwise(F.concat(F.array_join(F.slice(w, 11, 4), "-, "), F.lit(" elsewhere")))
    return table(spark, sf_dir, "documents").select("doc_id", P.holds_quote(F.col("text"), quote).alias("held"))


@query()
def entry_passages(spark, sf_dir):
    """Passages that cross no bound of an entry; an entry for every 2,500 characters of a text."""
    docs = table(spark, sf_dir, "documents")
    starts = F.sequence(F.lit(0), F.length("text"), F.lit(2500))
    entries = docs.where("text is not null").select("doc_id", F.explode(starts).alias("start"), F.length("text").alias("n")).select("doc_id", "start", F.least(F.col("start") + 2400, F.col("n")).alias("end"))
    return P.entry_passages(docs, entries).select("doc_id", "number", "start", "end")
