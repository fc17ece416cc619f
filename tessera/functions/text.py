"""Scalar text functions as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no query terms.
STOP = (
    "which", "what", "does", "with", "about", "from", "there", "these", "those", "the", "and", "for", "how", "was", "are", "its", "their",
    "this", "that", "each", "any", "page", "pages", "inspected", "selected", "were", "main", "cite", "supporting", "point", "note", "authors", "report",
)

# Labels that open a section of an entry, in the order in which they are tried.
SECTION_LABELS = (
    "mental symptoms", "respiratory organs", "urinary organs", "female organs", "male organs", "extremities", "generalities", "relationship",
    "relationships", "modalities", "aggravation", "amelioration", "abdomen", "stomach", "vertigo", "throat", "rectum", "urinary", "female", "male",
    "chest", "heart", "sleep", "fever", "mouth", "mind", "head", "eyes", "ears", "nose", "face", "back", "skin", "dose",
)

SPACE = r"[\s\x{85}\p{Z}]"
LICENCES = r"^https?://creativecommons\.org/(licenses/by(-sa)?|publicdomain/zero)/"


def norm_name(x: Column) -> Column:
    """Lower case, one space for every run of anything but letters and numbers."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(q: Column, stop: tuple[str, ...] = STOP, least: int = 3, most: int = 16) -> Column:
    found = F.regexp_extract_all(F.lower(q), F.lit("[a-z]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*stop))), 1, most)


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whether the normalised text holds the normalised phrase as whole words."""
    pad = lambda x: F.concat(F.lit(" "), norm_name(x), F.lit(" "))
    return (norm_name(phrase) != "") & (F.instr(pad(text), pad(phrase)) > 0)


def valid_question(q: Column) -> Column:
    return (F.octet_length(q) <= 1000) & q.rlike(r"[\p{L}\p{N}]{3,}")


def section_label(line: Column) -> Column:
    """The label that opens a line, followed by nothing or a mark; empty if there is none."""
    pattern = rf"(?i)^{SPACE}*({'|'.join(SECTION_LABELS)}){SPACE}*(?:$|[.:—]|--)"
    return F.lower(F.regexp_extract(line, pattern, 1))


def is_heading(line: Column) -> Column:
    """A section label, or a short line of capitals."""
    bare = F.regexp_replace(line, rf"^{SPACE}+|{SPACE}+$", "")
    capitals = bare.rlike(rf"^(?=(?:.*\p{{Lu}}){{3}})(?:\p{{Lu}}|{SPACE}|[()-])+$")
    few = F.size(F.split(bare, SPACE + "+")) <= 6
    return (section_label(line) != "") | (capitals & few & (F.length(bare) <= 80))


def span_text(text: Column, start: Column, end: Column) -> Column:
    """The characters [start, end) by code points."""
    return F.substring(text, start + 1, end - start)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where it is undefined."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def sound_vector(v: Column, size: int) -> Column:
    return F.coalesce((F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def doi(x: Column) -> Column:
    """A DOI without its address or prefix, in lower case; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(x), r"^https://doi\.org/", ""), r"^http://doi\.org/", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^https://dx\.doi\.org/", ""), r"^http://dx\.doi\.org/", "")
    bare = F.lower(F.trim(F.regexp_replace(bare, "^(?i:doi:)", "")))
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/[^\s?#]{1,250}$") & ~bare.rlike(r"[<>\\\"'%]|\.\."), bare)


def open_licence(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(LICENCES), F.lit(False))


def blank_scan(dark: Column, edges: Column) -> Column:
    return F.when((dark <= 0.0002) & (edges <= 0.0067), "blank").otherwise("unclassified")


def suspicious(text: Column) -> Column:
    """A replacement character, or a bracket inside a word."""
    return text.contains("�") | text.rlike(r"\p{L}[\[\]{}]\p{L}")


def title_matches(title: Column, text: Column) -> Column:
    """At least three words of four bytes or more, of which four fifths stand in the text."""
    own = F.array_distinct(F.filter(tokens(title), lambda w: F.octet_length(w) >= 4))
    return (F.size(own) >= 3) & (F.size(F.array_intersect(own, tokens(text))) * 5 >= F.size(own) * 4)


def opening_comparison(text: Column) -> Column:
    """Whether a text begins with a comparison, so that its subject stands in the text before it."""
    return F.lower(text).rlike(rf"^{SPACE}*(?:like|as{SPACE}+with|similar{SPACE}+to)(?:{SPACE}|$)")


def link_relation(text: Column) -> Column:
    """What a link leads to, by its text and its rel attribute."""
    low = F.lower(text)
    return F.when(low.rlike("next|previous|prev"), "pagination").when(low.rlike("index|contents"), "index").when(low.rlike("chapter|section"), "section").otherwise("linked_document")
