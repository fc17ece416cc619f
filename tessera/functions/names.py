"""Questions, names and titles: what a question asks for, whom it names and which source it means. Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import holds_phrase, norm_name

# Words and patterns that tell the intent of a question or the kind of a title.
OVERVIEW = ("study", "review", "result", "finding", "conclusion", "included")
OUTCOME = ("result", "finding", "conclusion")
PAPER = ("review", "trial", "study", "meta-analysis", "meta-analyses")
GRADED = r"(?i)\b(repertori[sz]ation|repertori[sz]e|(grade|score|rank|weight).{0,80}(rubric|remed)|(rubric|remed).{0,80}(grade|score|rank|weight)|remed(?:y|ies).{0,50}under.{0,30}rubric)\b"
SECTION = r"(?i)\b([a-z][a-z-]+)'s\s+([a-z][a-z -]{1,40}?)\s+section\b"
ASKS_SOURCE = r"(?i)\b(book|source|paper|article|work)\b"
ASKS_AUTHOR = r"(?i)^\s*(?:who wrote|who authored|who is the author of)\b"
PERSON = r"(?i)^\s*(?:who is|who was|who's|tell me about|what do you know about)\s+(.+?)\s*\??\s*$"
TITLE = r"(?i)^(?:(?:dr|doctor|professor|prof)\.?\s+)+"
FIELD = r"(?i)\s+in\s+(?:homeopathy|homoeopathy|medicine|the medical field)$"
GIVEN_NAMES = r"^([^,]+),\s*[A-Z](?:\.\s*[A-Z])?\.\s*\(([^)]+)\)"
RELATED = (
    r"(?i)^\s*how (?:is|was|are|were) (.+?) related to (.+?)\s*\??\s*$",
    r"(?i)^\s*what (?:is|was) the relationship between (.+?) and (.+?)\s*\??\s*$",
    r"(?i)^\s*are (.+?) and (.+?) related\s*\??\s*$",
)
QUOTES = "?\"'“”‘’ "


def _some(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(text).contains(w) for w in words))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _extract(text: Column, pattern: Column, group: int) -> Column:
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def overview_question(q: Column) -> Column:
    return _some(q, OVERVIEW)


def outcome_question(q: Column) -> Column:
    return overview_question(q) & _some(q, OUTCOME)


def paper_title(title: Column) -> Column:
    return _some(title, PAPER)


def protocol_comparison(q: Column) -> Column:
    """Whether a question sets a protocol against a finished trial or study."""
    return _some(q, ("protocol",)) & _some(q, ("trial", "study")) & _some(q, ("outcome", "result"))


def graded_question(q: Column) -> Column:
    """Whether a question asks for rubrics with grades, which passages cannot answer."""
    return q.rlike(GRADED)


def only_scope(q: Column, names: tuple[str, ...]) -> Column:
    """The one of the names that a question holds; empty for none or several."""
    found = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower(q), n))
    return F.when(F.size(found) == 1, found[0]).otherwise("")


def search_plan(raw: Column, original: Column) -> Column:
    """The two searches of a JSON plan, or null: they must have 8 to 160 bytes, stand on one line, and differ from each other
    and from the question. Nothing may stand before or behind the plan: it is read within an object whose last value, which
    no plan can know, must be met."""
    seal = F.sha2(raw, 256)
    whole = F.from_json(F.concat(F.lit('{"plan":'), raw, F.lit(',"seal":"'), seal, F.lit('"}')), "plan struct<queries:array<string>>, seal string")
    asked = F.transform(F.when(whole["seal"] == seal, whole["plan"]["queries"]), lambda x: F.trim(x))
    own = F.transform(asked, lambda x: F.lower(x))
    sound = F.forall(asked, lambda x: F.octet_length(x).between(8, 160) & ~x.rlike(r"[\r\n]"))
    return F.when((F.size(asked) == 2) & sound & (own[0] != own[1]) & ~F.array_contains(own, F.lower(F.trim(original))), asked)


def author_mentioned(question: Column, author: Column) -> Column:
    """Whether a question holds a word of four letters or more of an author's name."""
    return F.exists(F.split(F.lower(author), "[^a-z]+"), lambda w: (F.length(w) >= 4) & F.contains(F.lower(question), w))


def several_authors(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, several): whether a question (key, question) names two or more of its hits' authors (author)."""
    named = F.when(author_mentioned(F.col("question"), F.col("author")), F.lower("author"))
    return rows.groupBy(key).agg((F.count_distinct(named) >= 2).alias("several"))


def in_named_sections(rows: DataFrame, key: str = "item_id", row: str = "doc_id") -> DataFrame:
    """rows (key, row, question, author, title) without other sections of an author whose section the question names, where
    that section is among the question's rows; a title's part behind its last colon is its section."""
    pairs = F.arrays_zip(F.regexp_extract_all("question", F.lit(SECTION), F.lit(1)).alias("author"), F.regexp_extract_all("question", F.lit(SECTION), F.lit(2)).alias("section"))
    asked = rows.select(key, row, "author", "title", F.posexplode(pairs).alias("number", "named"))
    own = F.lower("author").contains(F.lower(F.col("named.author")))
    there = F.lower(F.trim(F.substring_index("title", ":", -1))) == F.lower(F.trim(F.col("named.section")))
    told = asked.select(key, row, "number", own.alias("own"), there.alias("there")).where("own")
    found = told.where("there").select(key, "number").distinct()
    out = told.where("not there").join(found, [key, "number"], "left_semi").select(key, row).distinct()
    return rows.join(out, [key, row], "left_anti")


def expanded_term(passage: Column, term: Column) -> Column:
    """What a passage says a short form stands for, before or behind it in brackets; empty if it does not say."""
    quoted = F.concat(F.lit("\\Q"), term, F.lit("\\E"))
    behind = _extract(passage, F.concat(F.lit(r"(?i)\b"), quoted, F.lit(r"\b\s*(?:tool\s*)?\(([^()\n]{5,110})\)")), 1)
    before = _extract(passage, F.concat(F.lit(r"(?i)([A-Za-z][A-Za-z -]{5,110})\s*\("), quoted, F.lit(r"\)")), 1)
    clean = lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(" .,;:"))
    sound = lambda x: F.when((F.size(F.split(clean(x), " ")) >= 2) & (F.octet_length(clean(x)) <= 110), clean(x))
    return F.coalesce(sound(behind), sound(before), F.lit(""))


def source_meant(question: Column, title: Column, author: Column) -> Column:
    """Whether a question means a source: by its title, by three long words of it when it asks for an author, or by its
    author's surname when it asks for a work."""
    name = F.regexp_replace(F.regexp_replace(norm_name(title), "^a ", ""), "^the ", "")
    held = F.filter(_words(name), lambda w: (F.octet_length(w) >= 5) & holds_phrase(question, w))
    surname = norm_name(F.when(F.instr(author, ",") > 0, F.substring_index(F.trim(author), ",", 1)).otherwise(F.regexp_extract(F.trim(author), r"(\S+)$", 1)))
    by_title = (F.size(_words(name)) >= 2) & holds_phrase(question, name)
    by_words = question.rlike(ASKS_AUTHOR) & (F.size(held) >= 3) & F.exists(held, lambda w: F.octet_length(w) >= 8)
    return by_title | by_words | (question.rlike(ASKS_SOURCE) & (F.octet_length(surname) >= 4) & holds_phrase(question, surname))


def authors_on_page(author: Column, passage: Column) -> Column:
    """Whether a passage holds the last name of every author of a line."""
    parts = F.when(F.instr(author, ",") > 0, F.split(author, ",")).otherwise(F.split(author, " and "))
    return F.forall(parts, lambda p: holds_phrase(passage, F.element_at(F.split(norm_name(p), " "), -1)))


def author_is(author: Column, person: Column) -> Column:
    """Whether every word of a person's name stands in an author's, the last of four bytes or more."""
    own = _words(norm_name(person))
    return (F.size(own) > 0) & (F.size(F.array_except(own, _words(norm_name(author)))) == 0) & (F.octet_length(F.try_element_at(own, F.lit(-1))) >= 4)


def author_shown(author: Column, person: Column) -> Column:
    """An author's name as it is shown: given names in brackets come first; a list of names gives way to the person asked for."""
    given = F.regexp_extract(author, GIVEN_NAMES, 2)
    return F.when(given != "", F.concat(given, F.lit(" "), F.regexp_extract(author, GIVEN_NAMES, 1))).when(F.instr(author, ",") == 0, author).otherwise(person)


def physician_named(passage: Column, surname: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), surname, F.lit("\\E"))
    return F.call_function("rlike", passage, F.concat(F.lit(r"(?is)\b"), quoted, F.lit(r"\b.{0,20}\bm\s*\.?\s*d\.?\b|\bdr\.?\s+[a-z. ]{0,40}\b"), quoted, F.lit(r"\b")))


def _bare_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.btrim(x, F.lit(QUOTES))), TITLE, ""))


def person_asked(question: Column) -> Column:
    """The name of whom a question asks about, without titles and field; empty if it asks for something else."""
    name = F.trim(F.regexp_replace(_bare_name(F.regexp_extract(question, PERSON, 1)), FIELD, ""))
    few = F.size(_words(norm_name(name))).between(1, 4)
    return F.when(few & ~holds_phrase(name, F.lit("author of")) & ~name.rlike(ASKS_SOURCE), name).otherwise("")


def related_names(question: Column) -> Column:
    """struct<first, second>: the two people whose relation a question asks for, or null."""

    def pair(pattern: str) -> Column:
        first, second = (_bare_name(F.regexp_extract(question, pattern, k)) for k in (1, 2))
        few = lambda x: F.size(F.split(x, r"\s+")) <= 4
        sound = (first != "") & (second != "") & few(first) & few(second) & (norm_name(first) != norm_name(second))
        return F.when(sound, F.struct(first.alias("first"), second.alias("second")))

    out = F.lit(None)
    for pattern in reversed(RELATED):
        out = F.when(question.rlike(pattern), pair(pattern)).otherwise(out)
    return out
