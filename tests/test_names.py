"""Questions, names and small rules, case by case."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.functions import rules as R


@pytest.fixture(scope="module")
def told(spark):
    def of(f, *rows):
        """f over columns a, b, ... of rows of texts."""
        schema = ", ".join(f"{c} string" for c in "abcd"[: len(rows[0])])
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
        return [r.x for r in frame.select("i", f(*(F.col(c) for c in "abcd"[: len(rows[0])])).alias("x")).orderBy("i").collect()]

    return of


def test_plans_must_differ_and_fit(told):
    plan = lambda *q: '{"queries": [' + ", ".join(f'"{x}"' for x in q) + "]}"
    rows = [(plan("one search here", " second search "), "q"), (plan("Q as ASKED before", "another one"), " q as asked before "), (plan("short", "another one"), "q"), (plan("a" * 161, "another one"), "q"), (plan("two lines\\n here", "another one"), "q"), (plan("x" * 8, "y" * 160), "q"), ("[]", "q"), ("{}", "q"), (plan("one only here"), "q")]
    assert told(N.search_plan, *rows) == [["one search here", "second search"], None, None, None, None, ["x" * 8, "y" * 160], None, None, None]


def test_plans_stand_alone(told):
    """Text before or behind a plan, or a second value, makes it no plan; white space and other keys do not."""
    plan = '{"queries": ["one search here", "second search"]}'
    rows = [plan + " and more", plan + plan, "x" + plan, plan + "}", plan + ', "seal": "x"}', "```json\n" + plan + "\n```", " \n" + plan + " ", plan[:-1] + ', "why": [1]}']
    assert told(N.search_plan, *((r, "q") for r in rows)) == [None] * 6 + [["one search here", "second search"]] * 2


def test_names_of_any_length(spark):
    from tessera import catalog  # noqa: F401
    from tessera.plans.scoping import held_names

    long = "the very long name of one that has more than six words"
    asked = spark.createDataFrame([(1, f"Who is {long.upper()}?"), (2, "name of one"), (3, None), (4, "")], "item_id int, text string")
    named = spark.createDataFrame([(long,), ("Name",), ("of one",), ("",), ("x " * 500,)], "name string")
    assert {(r.item_id, r.name) for r in held_names(asked, named).collect()} == {(1, long), (1, "Name"), (1, "of one"), (2, "Name"), (2, "of one")}


def test_names_in_questions(told):
    assert told(N.person_asked, ("Who is Dr. Ada Pell?",), ("tell me about Prof. Pell in medicine",), ("Who was the author of Pell?",), ("who is one two three four five",), ("What is Pell?",), ("who's “Pell”?",)) == ["Ada Pell", "Pell", "", "", "", "Pell"]
    assert told(N.related_names, ("How is Ann Pell related to Dr. Bo Kerr?",), ("Are Pell and pell related?",), ("are A B C D E and F related",), ("what was the relationship between X and Y",), ("why",)) == [("Ann Pell", "Bo Kerr"), None, None, ("X", "Y"), None]
    assert told(N.author_is, ("Pell, Ada (1801)", "Ada Pell"), ("Pell, A.", "Ada Pell"), ("Ada Fox", "Ada Fox"), ("x", "")) == [True, False, False, False]
    assert told(N.author_shown, ("Pell, A. B. (Ada Bea)", "p"), ("Ada Pell", "p"), ("Pell, Kerr", "p")) == ["Ada Bea Pell", "Ada Pell", "p"]
    assert told(N.authors_on_page, ("A. Pell and B. Kerr", "by Kerr & Pell."), ("Pell, Kerr", "Pell only"), ("", "x")) == [True, False, False]
    assert told(N.physician_named, ("by Ada Pell, M. D.", "Pell"), ("Dr. Ada Pell", "Pell"), ("Pell of Rome", "Pell"), ("Dr. (x) Pell+", "Pell+")) == [True, True, False, False]


def test_short_forms(told):
    rows = [("the FIT tool ( a faecal   test, )", "FIT"), ("a Faecal Immune Test (FIT) was", "FIT"), ("FIT (one)", "FIT"), ("A+B (plus two things)", "A+B"), ("none", "FIT")]
    assert told(N.expanded_term, *rows)[:3] == ["a faecal test", "a Faecal Immune Test", ""]


def test_sources_by_title_words_and_surname(told):
    rows = [("what is in the green hills?", "The Green Hills", "A"), ("who wrote about ancient mountain villages", "Ancient villages in mountain country", "A"), ("what did the book by Pell say", "T", "Ada Pell"), ("what did Pell say", "T", "Ada Pell"), ("the work of Ash", "T", "Bo Ash")]
    assert told(N.source_meant, *rows) == [True, True, True, False, False]


def test_named_sections(spark):
    rows = [(1, 1, "A. Pell", "Organs: Heart"), (1, 2, "A. Pell", "Organs: Liver"), (1, 3, "Kerr", "Organs: Liver"), (2, 1, "A. Pell", "Organs: Liver"), (2, 2, "Kerr", "x")]
    frame = spark.createDataFrame([(*r[:2], "see Pell's heart section", *r[2:]) for r in rows], "item_id int, doc_id int, question string, author string, title string")
    assert sorted((r.item_id, r.doc_id) for r in N.in_named_sections(frame).collect()) == [(1, 1), (1, 3), (2, 1), (2, 2)]
    several = {r.item_id: r.several for r in N.several_authors(frame.withColumn("question", F.lit("pell or kerr"))).collect()}
    assert several == {1: True, 2: True}


def test_pages_and_texts(told):
    assert told(R.printed_label, ("xiv\na\nb",), ("a\nb\n 12 ",), ("a\n7",), ("Title\nb\n12345",), ("Mills\nb\nq",)) == ["xiv", "12", None, None, None]
    assert told(R.contributor, ("Pell, Ada, 1801-1870.",), ("Pell, Ada 1801-",), ("  Ada   Pell. ",), ("x" * 301,)) == ["Ada, Pell", "Ada Pell", "Ada Pell", ""]
    assert told(lambda x: F.octet_length(R.short_text(x)), ("é" * 300,), ("aé" * 200,), ("  a  b ",)) == [400, 400, 3]
    assert told(lambda x: R.first_bytes(x, 4), ("ab€",), ("abcd",), ("€€",), ("",)) == ["ab", "abcd", "€", ""]
    assert told(lambda x: R.editor_offset(x, F.lit(5)), ("ab\r\ncd\r\nef",), ("abcdefg",), ("a\r\n\r\n\r\n\r\n",)) == [6, 5, 9]
    assert told(R.embedding_input, ("search_document: a",), ("search_document: search_query: a",), ("a search_query: b",)) == ["a", "a", "a search_query: b"]
    assert told(lambda a, b: R.scheme_shown(a, F.array(b, F.lit("three grades"))), ("three", "x"), (" ", "x"), ("four", "x four")) == [True, False, True]


def test_addresses(told):
    scope = lambda u: R.url_allowed(u, ("Books.org",), ("/vol/", "/one"), volumes=True)
    rows = {"http://books.org/vol/a.htm": True, "https://BOOKS.org:80/vol2/a": True, "http://books.org/volx/a": False, "http://books.org/one": True, "http://books.org/oneself": False, "http://u@books.org/one": False, "http://books.org/one#x": False, "http://books.org/one/../two": False, "http://books.org/one/%2e%2e/x": False, "ftp://books.org/one": False, "http://other.org/one": False, "http://books.org/one//x": False, "http://books.org/one?a=b": True}
    assert told(scope, *((u,) for u in rows)) == list(rows.values())
    assert told(R.linked_volume, ("/a/book/", "/a/book2/p"), ("/a/book1", "/a/book/p"), ("/a/book", "/a/book2"), ("/a/book", "/a/bookish/p"), ("/", "/x/y")) == [True, True, False, False, False]
    assert told(R.likely_document, ("/a/b",), ("/a.b/c",), ("/a.PDF",), ("/a.HTM",)) == [True, True, False, True]


def test_licences_and_notices(told, spark):
    assert [r and r.format for r in told(R.open_location, ("CC-BY ", "publishedVersion", "landing", "u"), ("cc-by-nc", "publishedVersion", "pdf", "u"), ("cc0", "submittedVersion", "pdf", "u"), ("cc0", "acceptedVersion", "xml", "u"))] == ["html", None, None, None]
    assert told(R.notice_priority, ("removal",), ("expression_of_concern",), ("erratum",), ("update",)) == [4, 3, 2, 1]
    dates = [([[2020]], True), ([], True), (None, True), ([[2031, 1, 1]], False), ([[2030, 6]], True), ([[2030, 13]], False), ([[2030, 6, 16]], False), ([[2030, 5, 32]], False), ([[2030, 5, 31]], True)]
    frame = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(dates)], "i int, d array<array<int>>")
    assert [r.x for r in frame.select("i", R.licence_started(F.col("d"), F.lit(datetime.date(2030, 6, 15))).alias("x")).orderBy("i").collect()] == [x for _, x in dates]
    ids = [r.x for r in frame.select(R.natural_id(F.col("i"), F.lit(None).cast("string")).alias("x")).collect()]
    assert len(set(ids)) == len(dates) and all(len(x) == 64 for x in ids)
