"""What the first pages of a scan say of it: title, author, edition, publication, repository and address.

The rules read an array of cleaned lines, as expressions: a library's catalogue card, then a journal's cover, then a title
page. What they do not find is empty; a person fills it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, marks and limits that title pages, catalogue cards and journal covers are read by.
ORDINAL = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|[1-9][0-9]?(?:st|nd|rd|th)"
EDITION = rf"(?i)\b({ORDINAL})\s+(?:revised\s+)?edition\b"
VOLUME = r"(?i)\b(?:vol\.?|volume)\s+([ivxlcdm]+|[1-9][0-9]?)\b"
AUTHOR = r"(?i)\bby\s+(?:the\s+late\s+)?([A-Z][A-Za-z. '\-]+)"
NO_TITLE = r"(?is)^(digitized|google|copyright|library|by |by$)|http"
YEARS = r"\b[12][0-9]{3}(?:-[0-9]{0,4})?\.?$"
NUMBERS = r"^[0-9*,\s]+$"
MARKS = r"\s+[0-9]+(?:,[0-9]+)*\*?"
CARD_URL, CARD_REPOSITORY = "https://wellcomecollection.org/works/", "Wellcome Collection"
SERIES, SERIES_REPOSITORY = "Systematic Reviews", "Systematic Reviews / BMC"
TITLE_LINES, CARD_LINES, COVER_LINES, ABSTRACT_LINES, COVER_TITLE = 10, 8, 12, 15, 6


def clean_lines(raw: Column) -> Column:
    """The lines of a text with single spaces, without empty ones."""
    own = F.transform(F.split(F.regexp_replace(raw, "\r", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(own, lambda x: x != "")


def let(value: Column, then) -> Column:
    """then(value), with value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _clean(text: Column, most: int) -> Column:
    bare = F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" .;,:"))
    return F.when(F.length(bare) <= most, bare).otherwise("")


def _name(line: Column) -> Column:
    """A contributor's name in reading order, without years."""
    first = F.regexp_replace(F.trim(F.regexp_extract(line, "^[^,]*,(.*)$", 1)), YEARS, "")
    return F.when(F.contains(line, F.lit(",")), _clean(F.concat(first, F.lit(" "), F.trim(F.substring_index(line, ",", 1))), 300)).otherwise(_clean(line, 300))


def _behind(lines: Column, mark: str) -> Column:
    """The line behind the last one that is the mark."""
    own = F.size(lines) - F.array_position(F.reverse(lines), F.lit(mark)) + 1
    return F.when(F.array_contains(lines, F.lit(mark)), F.get(lines, own.cast("int")))


def _card(lines: Column) -> dict[str, Column]:
    at = (F.size(lines) - F.array_position(F.reverse(lines), F.lit("Contributors")) + 1).cast("int")  # its place from 1
    title = F.when(F.array_contains(lines, F.lit("Contributors")) & at.between(2, CARD_LINES), _clean(F.substring_index(F.array_join(F.slice(lines, 1, F.greatest(at - 1, F.lit(1))), " "), " / by ", 1), 300))
    url = _behind(lines, "Persistent URL")
    sound = F.startswith(url, F.lit(CARD_URL))
    found = {"title": title, "author": _name(_behind(lines, "Contributors")), "publication": _clean(_behind(lines, "Publication/Creation"), 500), "repository": F.when(sound, CARD_REPOSITORY), "source_url": F.when(sound, url)}
    return {k: F.coalesce(v, F.lit("")) for k, v in found.items()}


def _cover(lines: Column) -> Column:
    """A journal's cover: what lies between the mark of a research article and its abstract; all is empty without both."""
    head = F.slice(lines, 1, COVER_LINES + ABSTRACT_LINES)
    marks = F.transform(head, lambda x, i: F.when((i < COVER_LINES) & F.contains(F.lower(x), F.lit("research")) & F.contains(F.lower(x), F.lit("open access")), i))
    ends = F.array_compact(F.transform(head, lambda x, i: F.when(F.lower(x) == "abstract", i)))

    def bounds(marks: Column) -> Column:
        pairs = F.transform(ends, lambda i: F.struct(F.array_max(F.filter(marks, lambda m: m < i)).alias("start"), i.alias("end")))
        return F.get(F.filter(pairs, lambda p: p["end"] < p["start"] + ABSTRACT_LINES), F.lit(0))

    def told(at: Column) -> Column:
        first, n = at["start"], at["end"] - at["start"]
        inner = F.filter(F.slice(lines, first + 2, F.greatest(n - 1, F.lit(0))), lambda x: ~x.rlike(NUMBERS) & ~F.contains(x, F.lit("@")))
        return let(F.slice(inner, 1, COVER_TITLE + 1), lambda kept: parts(kept, F.slice(lines, 1, first), n))

    def parts(kept: Column, above: Column, n: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda x: F.contains(x, F.lit(",")) & F.contains(x, F.lit(" and "))), F.lit(True)).cast("int")
        series = F.filter(above, lambda x: F.contains(x, F.lit(SERIES)) & F.contains(x, F.lit("(20")))
        found = {
            "title": _clean(F.array_join(F.slice(kept, 1, F.greatest(at - 1, F.lit(0))), " "), 300), "author": _clean(F.regexp_replace(F.get(kept, at - 1), MARKS, ""), 300), "edition": F.lit(""),
            "publication": _clean(F.regexp_replace(F.try_element_at(series, F.lit(-1)), "^et al\\. ", ""), 500), "repository": F.when(F.size(series) > 0, SERIES_REPOSITORY),
            "source_url": F.try_element_at(F.filter(above, lambda x: F.startswith(x, F.lit("https://doi.org/"))), F.lit(-1)),
        }
        return F.when((n >= 3) & (at > 0), F.struct(*(F.coalesce(v, F.lit("")).alias(k) for k, v in found.items())))

    return let(bounds(F.array_compact(marks)), lambda at: F.when(at.isNotNull(), told(at)))


def front_matter(raw: Column) -> Column:
    """struct<title, author, edition, publication, repository, source_url> of the text of a scan's first pages."""
    return let(clean_lines(raw), lambda lines: let(F.struct(F.struct(*(v.alias(k) for k, v in _card(lines).items())).alias("card"), _cover(lines).alias("cover")), lambda x: _front(raw, lines, x["card"], x["cover"])))


def _front(raw: Column, lines: Column, card: Column, cover: Column) -> Column:
    volume = F.regexp_extract(raw, VOLUME, 1)
    edition = F.when(raw.rlike(EDITION), _clean(F.regexp_extract(raw, EDITION, 0), 100)).when(volume != "", F.concat(F.lit("Volume "), F.upper(volume))).otherwise("")
    named = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"(?i)\bby\b"), F.struct(x.alias("line"), F.get(lines, i + 1).alias("next")))), lambda x: x.isNotNull())
    by = F.transform(named, lambda x: F.when(x["line"].rlike(AUTHOR), _clean(F.regexp_extract(x["line"], AUTHOR, 1), 300)).when(F.lower(x["line"]) == "by", _clean(x["next"], 300)))
    author = F.coalesce(F.get(F.filter(by, lambda x: x.isNotNull() & (x != "")), F.lit(0)), F.lit(""))
    titles = F.transform(F.filter(F.slice(lines, 1, TITLE_LINES), lambda x: F.octet_length(x).between(8, 120) & ~x.rlike(NO_TITLE)), lambda x: _clean(x, 300))
    title = F.coalesce(F.get(F.filter(titles, lambda x: x != ""), F.lit(0)), F.lit(""))
    whole = (card["title"] != "") & (card["author"] != "")
    either = lambda a, b: F.when(whole | (a != ""), a).otherwise(b)
    page = F.struct(either(card["title"], title).alias("title"), either(card["author"], author).alias("author"), edition.alias("edition"), *(card[k].alias(k) for k in ("publication", "repository", "source_url")))
    return F.when((cover["title"] != "") & (cover["author"] != ""), cover).otherwise(page)


def of_scans(pages: DataFrame, most: int = 6, ocr: int = 4) -> DataFrame:
    """(source, title, ...) of scans from their first pages (source, page from 0, text, read): all that was typeset (read:
    "text") together, and for a title, author or edition that this lacks, the first recognised page (read: "ocr") that has it."""
    own = pages.where((F.col("page") < most) & ((F.col("read") == "text") | (F.col("page") < ocr)))
    texts = own.groupBy("source").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("read") == "text", F.struct("page", "text")))), lambda x: x["text"]), "\n").alias("typeset"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("read") == "ocr", F.struct("page", "text")))), lambda x: x["text"]).alias("read"),
    )
    rows = texts.select("source", front_matter(F.col("typeset")).alias("f"), F.transform("read", front_matter).alias("r"))
    first = lambda k: F.coalesce(F.nullif(F.col(f"f.{k}"), F.lit("")), F.get(F.filter(F.transform("r", lambda x: x[k]), lambda x: x != ""), F.lit(0)), F.lit(""))
    return rows.select("source", *(first(k).alias(k) for k in ("title", "author", "edition")), "f.publication", "f.repository", "f.source_url")
