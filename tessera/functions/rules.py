"""Small rules over identifiers, addresses, licences, notices and scanned pages. Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import query_terms, suspicious

# Words that are no terms of a worksheet's searches.
WORKSHEET_STOP = (
    "what", "which", "does", "about", "describe", "describes", "compare", "each", "their", "them", "with", "from", "the", "and", "for", "who", "how",
    "nash", "farrington", "book", "books", "prepared", "source", "selected", "homoeopathic", "homeopathic", "materia", "medica",
)
# Ways in which a source sets a name, and licences and versions that may be fetched.
STYLES = ("unknown", "ordinary", "italic", "bold", "bold_italic", "other")
LICENCES, VERSIONS = ("cc-by", "cc-by-4.0", "cc0", "cc0-1.0"), ("publishedVersion", "acceptedVersion")
# Notices by severity.
NOTICES = {4: ("retraction", "withdrawal", "removal"), 3: ("partial_retraction", "expression_of_concern"), 2: ("correction", "corrigendum", "erratum")}
LOGIN = ("sign in", "log in", "access denied", "not found", "404")
_URL = r"^(?i:(https?))://([^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::\d*)?([^?#]*)(?:\?[^#]*)?(?:#(.*))?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def squeezed(x: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"[\s\x{85}\p{Z}]+", " "))


def word_count(x: Column) -> Column:
    return F.regexp_count(F.lower(x), F.lit(r"[\p{L}\p{N}]+"))


def embedding_input(text: Column) -> Column:
    """A text without the marks that some embedding models want before it."""
    return F.regexp_replace(F.regexp_replace(text, "^search_document: ", ""), "^search_query: ", "")


def worksheet_terms(question: Column) -> Column:
    return F.array_join(query_terms(question, WORKSHEET_STOP, 3, 6), " | ")


def scheme_shown(scheme: Column, texts: Column) -> Column:
    """Whether one of the evidence texts literally holds a grade scheme."""
    return (F.trim(scheme) != "") & F.exists(texts, lambda t: F.contains(t, scheme))


def pmcid(x: Column) -> Column:
    own = F.upper(F.trim(x))
    return F.when((own != "") & ~own.startswith("PMC"), F.concat(F.lit("PMC"), own)).otherwise(own)


def licence_started(parts: Column, today: Column) -> Column:
    """Whether a licence's start, [[year, month, day]] with month and day open, is not after today; without one it has started."""
    d = F.try_element_at(parts, F.lit(1))
    month, day = F.coalesce(F.try_element_at(d, F.lit(2)), F.lit(1)), F.coalesce(F.try_element_at(d, F.lit(3)), F.lit(1))
    first = F.make_date(F.try_element_at(d, F.lit(1)), F.when(month.between(1, 12), month).otherwise(1), F.lit(1))
    begun = F.date_add(first, day - 1) <= today  # the 31st of a short month is the next month's beginning
    return F.when(F.coalesce(F.size(d), F.lit(0)) == 0, True).otherwise(F.coalesce(month.between(1, 12) & day.between(1, 31) & begun, F.lit(False)))


def open_location(licence: Column, version: Column, form: Column, url: Column) -> Column:
    """struct<url, format, version, license> of a place where a paper may be fetched, or null."""
    own, kind = F.lower(F.trim(licence)), F.when(form == "landing", "html").otherwise(form)
    return F.when(own.isin(*LICENCES) & version.isin(*VERSIONS) & kind.isin("pdf", "html"), F.struct(url.alias("url"), kind.alias("format"), version.alias("version"), own.alias("license")))


def notice_priority(kind: Column) -> Column:
    return reduce(lambda out, n: F.when(kind.isin(*NOTICES[n]), n).otherwise(out), sorted(NOTICES), F.lit(1))


def non_nulls(*columns: Column) -> Column:
    return reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in columns))


def natural_id(*columns: Column) -> Column:
    """An id that follows from a row's key, so that a rerun names the row alike."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(c.cast("string"), F.lit("\1")) for c in columns)), 256)


def may_read(owner: Column, reader: Column, admin: Column) -> Column:
    return F.coalesce(admin | (owner == reader), F.lit(False))


# -- scanned pages


def prefer_retry(original: Column, retry: Column, warning: Column) -> Column:
    """Whether a second reading of a page takes the place of the first: sound, without warning, and hardly shorter."""
    n = word_count(retry)
    return (F.coalesce(warning, F.lit("")) == "") & ~suspicious(retry) & (n >= 8) & (n * 10 >= word_count(original) * 9)


def first_quality(raw: Column, warning: Column) -> Column:
    """struct<status, review, reason> of a freshly read page."""
    say = lambda status, review, why: F.struct(F.lit(status).alias("status"), F.lit(review).alias("review"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    few = F.regexp_count(raw, F.lit(r"[\p{L}\p{N}]+")) < 40
    return F.when(F.coalesce(warning, F.lit("")) != "", say("suspect", "needs_review", warning)).when(few, say("suspect", "needs_review", "too few words were read")).otherwise(say("passed", "auto_checked", "enough words were read"))


def printed_label(raw: Column) -> Column:
    """A page number, in digits or Roman, that stands alone on the first or last of three lines or more; null if none does."""
    lines = F.split(raw, "\n", -1)
    own = F.filter(F.array(F.trim(F.get(lines, F.lit(0))), F.trim(F.element_at(lines, -1))), lambda x: x.rlike("(?i)^(?:[0-9]{1,4}|[ivxlcdm]{1,12})$"))
    return F.when(F.size(lines) >= 3, F.get(own, F.lit(0)))


# -- addresses


def likely_document(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin("", ".htm", ".html", ".txt")


def linked_volume(prefix: Column, target: Column) -> Column:
    """Whether a path lies in a numbered sibling of a folder: book, book1, book2 and no other folder beside them."""
    base = F.regexp_replace(prefix, "/$", "")
    stem, parent = F.regexp_extract(base, r"([^/]*?)[0-9]*$", 1), F.regexp_extract(base, r"^(.*/)[^/]*$", 1)
    rest = F.call_function("substr", target, F.length(parent) + 1)
    folder = F.regexp_extract(rest, "^([^/]*)/", 1)
    return (base != "") & (stem != "") & target.startswith(parent) & (F.instr(rest, "/") > 0) & (F.regexp_replace(folder, "[0-9]+$", "") == stem)


def url_allowed(url: Column, hosts: tuple[str, ...], prefixes: tuple[str, ...], volumes: bool = False) -> Column:
    """Whether an address lies in a collection's scope: a plain web address without user, fragment or ambiguous path, of one of
    the hosts, below one of the path prefixes (or, if volumes, in a sibling volume of one)."""
    path, low = _part(url, 4), F.lower(_part(url, 4))
    plain = url.rlike(_URL) & (_part(url, 2) == "") & (_part(url, 5) == "")
    clear = ~low.rlike("%2f|%5c|%2e|%25") & ~path.rlike(r"//|/\.{1,2}(?:/|$)")
    below = F.lit(False)
    for p in prefixes:
        stem = p.removesuffix("/") + "/"
        below = below | (path == p) | path.startswith(stem) | (linked_volume(F.lit(p), path) if volumes else F.lit(False))
    return F.coalesce(plain & clear & F.lower(_part(url, 3)).isin(*(h.lower() for h in hosts)) & below, F.lit(False))


# -- texts as they are shown


def clean_query(raw: Column) -> Column:
    return squeezed(F.regexp_replace(raw, r"[^\p{L}\p{Nd}\s]", " "))


def detected_text(x: Column, most: int) -> Column:
    """A text without marks at its ends; empty if it is longer than `most` characters."""
    own = F.btrim(squeezed(x), F.lit(" .;,:"))
    return F.when(F.length(own) <= most, own).otherwise("")


def contributor(line: Column, most: int = 300) -> Column:
    """A name that a catalogue gives last name first, with or without years, in its usual order."""
    first = F.regexp_replace(F.trim(F.regexp_extract(line, "^[^,]*,(.*)$", 1)), r"\b[12][0-9]{3}(?:-[0-9]{0,4})?\.?$", "")
    return F.when(F.instr(line, ",") > 0, detected_text(F.concat(first, F.lit(" "), F.trim(F.substring_index(line, ",", 1))), most)).otherwise(detected_text(line, most))


def first_bytes(x: Column, most: int) -> Column:
    """The longest beginning of a text of at most `most` bytes of UTF-8 that cuts no character."""
    raw = F.encode(x, "UTF-8")
    return F.when(F.octet_length(x) <= most, x).otherwise(F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(4))))


def short_text(x: Column, most: int = 400) -> Column:
    return first_bytes(squeezed(x), most)


def login_page(x: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(x).contains(w) for w in LOGIN))


def review_hash(blocks: Column, mark: str = "\0") -> Column:
    """The digest of reviewed blocks (id, status, text) in their order, each part ended by a mark."""
    end = F.lit(mark)
    return F.sha2(F.array_join(F.transform(blocks, lambda b: F.concat(b["id"].cast("string"), end, b["status"], end, b["text"], end)), ""), 256)


def editor_lines(original: Column) -> Column:
    return F.regexp_replace(original, "\r\n?", "\n")


def editor_offset(original: Column, at: Column) -> Column:
    """Where a byte offset of editor_lines(original) lies in original: each pair of return and newline became one byte."""
    pieces = F.split(original, "\r\n", -1)  # a pair stands behind each but the last
    end = lambda s, x: s["end"] + F.octet_length(x) + 1
    step = lambda s, x: F.struct(end(s, x).alias("end"), (s["pairs"] + (end(s, x) <= at).cast("int")).alias("pairs"))
    return at + F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.struct(F.lit(0).alias("end"), F.lit(0).alias("pairs")), step)["pairs"]
