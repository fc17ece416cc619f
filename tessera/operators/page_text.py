"""Stored page texts against fresh readings: how they differ, whether a warning is resolved, and what becomes of a page."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Bounds of agreement between a stored text and a fresh reading.
FEWEST, SHARE, SHORTER, OPENING, AGREED, LONG = 8, 0.88, 0.7, 6, 0.80, 80
_MEASURES = "old int, new int, matched int, opening int, first int, last int, run int"


def measures(stored: list[str], fresh: list[str]) -> tuple[int, ...]:
    """Numbers of words, the size of their common multiset, known words among the first and last twelve fresh ones, and the
    longest run of unknown ones; unknown words of one or two letters neither lengthen nor end a run."""
    had, left, run, worst = set(stored), Counter(stored), 0, 0
    matched = 0
    for w in fresh:
        if left[w] > 0:
            left[w] -= 1
            matched += 1
        if w in had:
            run = 0
        elif len(w) >= 3:
            run += 1
            worst = max(worst, run)
    known = lambda words: sum(w in had for w in words)
    return len(stored), len(fresh), matched, known(fresh[:12]), known(fresh[:12]), known(fresh[max(0, len(fresh) - 12) :]), worst


def measured(stored: Column, fresh: Column) -> Column:
    """struct of measures() of two texts; null texts have no words."""
    words = lambda x: T.tokens(F.coalesce(x, F.lit("")))

    @F.pandas_udf(_MEASURES)
    def of(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measures(list(x), list(y)) for x, y in zip(a, b)], columns=[x.split()[0] for x in _MEASURES.split(", ")])

    return of(words(stored), words(fresh))


def text_check(stored: Column, m: Column) -> Column:
    """struct<suspect, coverage, reason>: whether a stored text lacks too much of a fresh reading, from its measures."""
    coverage = F.when(m["new"] > 0, m["matched"] / m["new"]).otherwise(0.0)
    say = lambda suspect, share, why: F.struct(F.lit(suspect).alias("suspect"), share.alias("coverage"), F.lit(why).alias("reason"))
    apart = (coverage < SHARE) | (F.abs(m["old"] - m["new"]) > F.greatest(F.lit(12.0), m["new"] * 0.35))
    return (
        F.when(T.suspicious(stored), say(True, F.lit(0.0), "damaged"))
        .when(m["new"] < FEWEST, say(True, F.lit(0.0), "unread"))
        .when(m["old"] < m["new"] * SHORTER, say(True, coverage, "shorter"))
        .when(apart, say(True, coverage, "different"))
        .when((m["new"] >= 40) & (m["opening"] < OPENING), say(True, coverage, "opening"))
        .otherwise(say(False, coverage, "agrees"))
    )


def agrees_throughout(stored: Column, m: Column) -> Column:
    """Whether embedded text and a reading agree over the whole page, so that doubts about single words may rest."""
    ratio = m["old"] / F.greatest(m["new"], F.lit(1))
    long = (m["old"] >= LONG) & (m["new"] >= LONG) & (ratio >= 0.9) & (ratio <= 1.2)
    return ~T.suspicious(stored) & (m["matched"] >= AGREED * m["new"]) & long & (m["run"] < 5) & (m["first"] >= 4) & (m["last"] >= 4)


def resolved(check: Column, stored: Column, m: Column, warning: Column, method: Column, doubt: str) -> Column:
    """The check after a reader's warning: doubts (`doubt`) about embedded text rest where it agrees throughout; any other
    warning makes a page suspect."""
    say = lambda suspect, why: F.struct(F.lit(suspect).alias("suspect"), check["coverage"].alias("coverage"), why.alias("reason"))
    rests = (warning == doubt) & (method == "PDF text") & agrees_throughout(stored, m)
    return F.when(F.coalesce(warning, F.lit("")) == "", check).when(rests, say(False, F.lit("isolated"))).when(check["suspect"], check).otherwise(say(True, warning))


def checked_pages(pages: DataFrame, doubt: str = "low confidence") -> DataFrame:
    """pages (page_id, stored, fresh, warning, method, dark, edges) with kind, review and reason: almost empty texts are
    judged by their scan's measures, the others by the fresh reading."""
    empty = F.length(F.trim(F.coalesce("stored", F.lit("")))) < 10
    own = pages.withColumn("m", measured(F.col("stored"), F.col("fresh")))
    check = resolved(text_check(F.col("stored"), F.col("m")), F.col("stored"), F.col("m"), F.col("warning"), F.col("method"), doubt)
    own = own.withColumn("c", check)
    blank = T.blank_scan(F.col("dark"), F.col("edges"))
    kind = F.when(empty, blank).otherwise("text")
    review = F.when(empty, F.when(blank == "blank", "auto_checked").otherwise("needs_review")).when(F.col("c.suspect"), "needs_review").otherwise("auto_checked")
    return own.select("page_id", kind.alias("kind"), review.alias("review"), F.when(empty, F.lit(None)).otherwise(F.col("c.reason")).alias("reason"), F.when(~empty, F.round("c.coverage", 6)).alias("coverage"))
