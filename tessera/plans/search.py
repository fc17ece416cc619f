"""Full-text search as queries: postings, and lists of every benchmark item by any and by all of its lexemes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import text as T
from tessera.operators import postings as P
from tessera.operators.index import Index
from tessera.operators.store import saved
from tessera.plans.retrieval import ELIGIBLE, STOP_SQL, gate
from tessera.sources.tables import table

EVERY = 1 << 30
_WORDS = r"""words AS (SELECT doc_id, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS x FROM elig)),
kept AS (SELECT doc_id, w, least(p, 16383) AS p FROM words QUALIFY row_number() OVER (PARTITION BY doc_id, w ORDER BY p) <= 256 AND count(*) FILTER (WHERE p >= 16383) OVER (PARTITION BY doc_id, w ORDER BY p) <= 1)"""
_ASKED = f"asked AS (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS x FROM benchmark)) WHERE length(w) >= 3 AND w NOT IN ({STOP_SQL}) GROUP BY item_id, w)"


def asked(spark, sf_dir, most: int, english: bool = False):
    """(item_id, lexeme, wanted): the distinct lexemes of the first `most` terms of each benchmark item."""
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.query_terms(F.col("text"), most=most)).alias("n", "lexeme"))
    if english:

        @F.pandas_udf("string")
        def stems(words):
            return words.map(lambda w: next(iter(P.lexemes(w, True)), None))

        terms = terms.select("item_id", stems("lexeme").alias("lexeme")).where("lexeme is not null")
    terms = terms.select("item_id", "lexeme").distinct()
    return terms.join(terms.groupBy("item_id").agg(F.count("*").alias("wanted")), "item_id")


def found(spark, sf_dir, own, english: bool):
    """(lexeme, doc_id, n, positions) of the items' lexemes, read from the index of the documents."""
    rows = Index.of(table(spark, sf_dir, "documents"), "english" if english else "simple").postings(own)
    return rows.select("lexeme", F.col("key").alias("doc_id"), "n", "positions")


def matched(spark, sf_dir, rows, own):
    """Postings without positions beside the items that ask for them, in documents that pass the gate. They are dealt by document
    first: what follows for an item and document needs no further shuffle, of a row for each item."""
    slim = rows.select("lexeme", "doc_id", "n").repartition("doc_id")
    return slim.join(gate(spark, sf_dir).select("doc_id"), "doc_id", "left_semi").join(own, "lexeme")


def ranked_any(spark, sf_dir, english: bool):
    own = asked(spark, sf_dir, 16, english)
    return P.rank_any(matched(spark, sf_dir, found(spark, sf_dir, own, english), own), ["item_id", "doc_id"])


def ranked_all(spark, sf_dir, english: bool):
    """(item_id, doc_id, score) of texts that hold all of an item's lexemes: which they are is told by counts, and positions are
    read of these alone."""
    own = asked(spark, sf_dir, EVERY, english)
    rows = found(spark, sf_dir, own, english)
    held = matched(spark, sf_dir, rows, own).groupBy("item_id", "doc_id").agg(F.count("*").alias("held"), F.first("wanted").alias("wanted"))
    whole = saved(held.where("held = wanted").select("item_id", "doc_id"), "whole")
    met = rows.join(whole, "doc_id").join(own, ["item_id", "lexeme"])
    return P.rank_all(met, ["item_id", "doc_id"], F.col("wanted"))


@query(f"WITH {ELIGIBLE}, {_WORDS} SELECT w AS lexeme, doc_id, CAST(count(*) AS INTEGER) AS n, CAST(min(p) AS INTEGER) AS first, CAST(max(p) AS INTEGER) AS last FROM kept GROUP BY ALL")
def postings_simple(spark, sf_dir):
    own = P.postings(gate(spark, sf_dir).select("doc_id", "text"), english=False)
    return own.select("lexeme", "doc_id", F.size("positions").alias("n"), F.array_min("positions").alias("first"), F.array_max("positions").alias("last"))


@query(f"""WITH {ELIGIBLE}, {_WORDS}, {_ASKED}, few AS (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i) <= 16), hit AS (SELECT item_id, doc_id, 0.1::DOUBLE * count(*) AS s FROM kept JOIN few USING (w) GROUP BY ALL)
SELECT item_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM hit QUALIFY rank <= 40""")
def fts_any(spark, sf_dir):
    """The lexical list of every item: texts that hold any of its terms."""
    return P.best(ranked_any(spark, sf_dir, False), "item_id").select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {ELIGIBLE}, {_WORDS}, {_ASKED}, want AS (SELECT item_id, count(*) AS n FROM asked GROUP BY item_id),
whole AS (SELECT item_id, doc_id FROM kept JOIN asked USING (w) JOIN want USING (item_id) GROUP BY item_id, doc_id, n HAVING count(DISTINCT w) = n),
met AS (SELECT item_id, doc_id, w, p, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY p) AS i FROM kept JOIN asked USING (w) JOIN whole USING (item_id, doc_id)),
last AS (SELECT e.item_id, e.doc_id, e.i AS e, m.w, max(m.i) AS s FROM met e JOIN met m ON m.item_id = e.item_id AND m.doc_id = e.doc_id AND m.i <= e.i GROUP BY ALL),
span AS (SELECT item_id, doc_id, e, min(s) AS s FROM last JOIN want USING (item_id) GROUP BY item_id, doc_id, e, n HAVING count(*) = n),
cover AS (SELECT item_id, doc_id, s, min(e) AS e FROM span GROUP BY ALL)
SELECT c.item_id, c.doc_id, round(sum(0.1::DOUBLE / (1 + b.p - a.p - (e - s))), 6) AS score FROM cover c JOIN met a ON a.item_id = c.item_id AND a.doc_id = c.doc_id AND a.i = s JOIN met b ON b.item_id = c.item_id AND b.doc_id = c.doc_id AND b.i = e GROUP BY ALL""")
def fts_all(spark, sf_dir):
    """Texts that hold all of an item's terms, by cover density: every text, not only the best."""
    return ranked_all(spark, sf_dir, False).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query()
def fts_english(spark, sf_dir):
    """The lexical list of every item by English stems."""
    return P.best(ranked_any(spark, sf_dir, True), "item_id").select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def fts_english_all(spark, sf_dir):
    """Texts that hold the stems of all of an item's terms, by cover density."""
    return P.best(ranked_all(spark, sf_dir, True), "item_id").select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")
