"""Passages, quotations and sentences with exact offsets: functions of one text, and their table forms."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import SECTION_LABELS, SPACE

_LABEL = re.compile(rf"\s*(?:{'|'.join(SECTION_LABELS)})\s*(?:$|[.:—]|--)", re.I)
_WORD = re.compile(r"[^\W_]+")
_HYPHEN = re.compile(r"-\s*\n\s*")
_STRONG = re.compile(r"\n(?=\n)|[.!?;](?=\s)")
# The form of an abbreviated name, and how long a row's heading may be in characters and words.
ABBREVIATION, HEADING_CHARACTERS, HEADING_WORDS, MOST_NAMES, MOST_ROWS = r"^\p{L}[\p{L}\p{N}-]{0,29}\.$", 200, 12, 200, 50


def entry_heading(line: str) -> bool:
    """A short line of capitals that is not a section label."""
    bare = line.strip()
    letters = [c for c in bare if c.isalpha()]
    if len(letters) < 3 or len(bare) > 80 or len(bare.split()) > 6 or _LABEL.match(bare):
        return False
    return all(c.isupper() for c in letters) and all(c.isalpha() or c.isspace() or c in "-()" for c in bare)


def split_passages(text: str, limit: int = 1800) -> list[tuple[int, int]]:
    """Spans of at most limit characters that cover every visible character and cross no entry heading.

    Within an entry, a span ends at the last paragraph or sentence end in its second half, else at the last white
    space there, else at the limit.
    """
    if limit < 1:
        return []
    entries = [0, *(m.start() for m in re.finditer(r"(?<=\n)[^\n]*", text) if entry_heading(m[0])), len(text)]
    strong = [m.end() + (m[0] == "\n") for m in _STRONG.finditer(text)]
    weak = [m.start() for m in re.finditer(r"\s", text)]
    out = []
    for first, stop in zip(entries, entries[1:]):
        at = first
        while at < stop:
            if text[at].isspace():
                at += 1
                continue
            end = min(at + limit, stop)
            if end < stop:
                for breaks in (strong, weak):
                    k = bisect_right(breaks, end)
                    if k and breaks[k - 1] > at + limit // 2:
                        end = breaks[k - 1]
                        break
            out.append((at, at + len(text[at:end].rstrip())))
            at = end
    return out


def _words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case words, and their places in the text, with words that a hyphen splits over lines joined."""
    kept, gone = [], 0
    for m in [*_HYPHEN.finditer(text), None]:
        kept += range(gone, m.start() if m else len(text))
        gone = m.end() if m else gone
    clean = "".join(text[i] for i in kept)
    found = list(_WORD.finditer(clean))
    return [m[0].lower() for m in found], [(kept[m.start()], kept[m.end() - 1] + 1) for m in found]


def locate_quote(passage: str, quote: str, least: int = 4) -> tuple[int, int] | None:
    """Where the quotation's words first stand in the passage, whatever stands between them."""
    (own, places), (asked, _) = _words(passage), _words(quote)
    if len(asked) < least:
        return None
    joined, needle = "\0" + "\0".join(own) + "\0", "\0" + "\0".join(asked) + "\0"
    at = joined.find(needle)
    if at < 0:
        return None
    first = joined.count("\0", 0, at)
    return places[first][0], places[first + len(asked) - 1][1]


def recover_quote(passage: str, quote: str, least: int = 4) -> str | None:
    """The quotation if the passage holds it, else its longest run of words there if that is half of it or more."""
    if len(quote) > 500:
        return None
    (own, places), (asked, _) = _words(passage), _words(quote)
    if len(asked) < least:
        return None
    at: dict[str, list[int]] = {}
    for j, w in enumerate(own):
        at.setdefault(w, []).append(j)
    best, run = (0, 0), {}  # length and first word of the longest run; runs that end at each place of the passage
    for i, w in enumerate(asked):
        run = {j: run.get(j - 1, 0) + 1 for j in at.get(w, ())}
        longest = max(run.values(), default=0)
        if longest > best[0]:
            best = longest, i - longest + 1
    n, first = best
    if n == len(asked):
        return quote
    if n < least or 2 * n < len(asked):
        return None
    start, end = locate_quote(passage, " ".join(asked[first : first + n]), 1)
    return passage[start:end]


def with_heading(passage: str, claim: str, start: int, reach: int = 220) -> int:
    """Where an excerpt begins if the line of capitals before it that names the claim's subject is taken in."""
    if start < 1:
        return start
    place, low = 0, claim.lower()
    for line in passage[:start].split("\n"):
        letters = [c for c in line if c.isalpha()]
        capitals = sum(map(str.isupper, letters))
        if len(letters) >= 5 and capitals * 5 >= len(letters) * 4 and start - place <= reach:
            if any(len(w) >= 5 and w in low for w in _WORD.findall(line.lower())):
                return place
        place += len(line) + 1
    return start


def excerpt(passage: str, quote: str, claim: str) -> tuple[int, int, str] | None:
    """(start, end, text) of what supports a claim: the quotation, or what of it the passage holds, with its heading."""
    own = recover_quote(passage, quote)
    at = own and locate_quote(passage, own)
    if not at:
        return None
    start = with_heading(passage, claim, at[0])
    return start, at[1], passage[start : at[1]]


def entry_spans(text: str, bounds: list[int], limit: int = 1800) -> list[tuple[int, int]]:
    """Passages that cross no bound of an approved entry: the text is cut at all bounds and each piece is split by itself."""
    cuts = sorted({0, len(text), *(b for b in bounds if 0 <= b <= len(text))})
    return [(a + x, a + y) for a, b in zip(cuts, cuts[1:]) for x, y in split_passages(text[a:b], limit)]


def passages(docs: DataFrame, limit: int = 1800) -> DataFrame:
    """(doc_id, number, start, end, passage) of every text; passages come from exact offsets, null texts have none."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, a, b, t[a:b]) for i, t in zip(frame["doc_id"], frame["text"]) for n, (a, b) in enumerate(split_passages(t, limit))]
            yield pd.DataFrame(rows, columns=["doc_id", "number", "start", "end", "passage"])

    return docs.where("text is not null").select("doc_id", "text").mapInPandas(task, "doc_id long, number int, start int, end int, passage string")


def rubric_rows(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, heading, notations, start, end, exact) of a page's (key, text) first rows of a heading and abbreviated names
    behind a colon; offsets are those of the row without the white space around it."""
    lines = pages.select(key, F.posexplode(F.split("text", "\n", -1)).alias("line", "whole"))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("whole") + 1).over(before), F.lit(0))
    exact = F.regexp_replace("whole", rf"^{SPACE}+|{SPACE}+$", "")
    lead = F.length("whole") - F.length(F.regexp_replace("whole", rf"^{SPACE}+", ""))
    rows = lines.select(key, "line", exact.alias("exact"), (offset + lead).cast("int").alias("start")).where(F.instr("exact", ":") > 0)
    heading = F.trim(F.substring_index("exact", ":", 1))
    names = F.transform(F.split(F.substr(F.col("exact"), F.instr("exact", ":") + 1), "[,;]", -1), lambda x: F.trim(x))
    rows = rows.withColumns({"heading": heading, "notations": names, "end": F.col("start") + F.length("exact")})
    titled = F.length("heading").between(1, HEADING_CHARACTERS) & (F.size(F.split("heading", rf"{SPACE}+")) <= HEADING_WORDS) & ~F.col("heading").rlike("[.;]")
    named = F.forall("notations", lambda x: x.rlike(ABBREVIATION)) & (F.size(F.array_distinct("notations")) == F.size("notations")) & (F.size("notations") <= MOST_NAMES)
    place = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return rows.where(titled & named).withColumn("place", place).where(F.col("place") <= MOST_ROWS).select(key, "line", "heading", "notations", "start", "end", "exact")


def entry_passages(docs: DataFrame, entries: DataFrame, limit: int = 1800) -> DataFrame:
    """(doc_id, number, start, end, passage) of every text, cut at the bounds of its entries (doc_id, start, end); entries that
    do not lie in the text are left out."""
    bounds = entries.groupBy("doc_id").agg(F.flatten(F.collect_list(F.when((F.col("start") >= 0) & (F.col("end") > F.col("start")), F.array("start", "end")))).alias("bounds"))
    rows = docs.where("text is not null").select("doc_id", "text").join(bounds, "doc_id", "left")

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = [(i, n, a, b, t[a:b]) for i, t, x in zip(frame["doc_id"], frame["text"], frame["bounds"]) for n, (a, b) in enumerate(entry_spans(t, [] if x is None else [int(v) for v in x], limit))]
            yield pd.DataFrame(own, columns=["doc_id", "number", "start", "end", "passage"])

    return rows.mapInPandas(task, "doc_id long, number int, start int, end int, passage string")


def holds_quote(passage: Column, quote: Column, least: int = 4, longest: int = 500) -> Column:
    """Whether a passage holds a quotation of four words or more, whatever stands between the words; hyphens at line ends join."""
    words = lambda x: F.regexp_extract_all(F.lower(F.regexp_replace(x, r"-\s*\n\s*", "")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    pad = lambda x: F.concat(F.lit(" "), F.array_join(words(x), " "), F.lit(" "))
    return (F.length(quote) <= longest) & (F.size(words(quote)) >= least) & F.contains(pad(passage), pad(quote))


def _udf(f, kind: str):
    @F.pandas_udf(kind)
    def of(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*x) if None not in x else None for x in zip(*columns)], dtype=object)

    return of


def located(passage: Column, quote: Column) -> Column:
    """array<int> of start and end, or null."""
    return _udf(lambda p, q: locate_quote(p, q), "array<int>")(passage, quote)


def recovered(passage: Column, quote: Column) -> Column:
    return _udf(lambda p, q: recover_quote(p, q), "string")(passage, quote)


def excerpted(passage: Column, quote: Column, claim: Column) -> Column:
    """struct<start, end, text> of the excerpt of a passage that supports a claim, or null."""

    @F.pandas_udf("array<string>")
    def of(passages: pd.Series, quotes: pd.Series, claims: pd.Series) -> pd.Series:
        found = [excerpt(*x) if None not in x else None for x in zip(passages, quotes, claims)]
        return pd.Series([f and [str(f[0]), str(f[1]), f[2]] for f in found], dtype=object)

    x = of(passage, quote, claim)
    return F.when(x.isNotNull(), F.struct(x[0].cast("int").alias("start"), x[1].cast("int").alias("end"), x[2].alias("text")))
