"""Claims, verdicts and sections, on cases of our own."""

import json

import pytest

from tessera.functions import passages as P
from tessera.operators import claims as C

TEXTS = {"E1": "BURNING PAINS\nThe pain burns at night and wakes the sleeper.\nCold air helps it soon.", "E2": "Like the others it is worse from cold air in the morning.", "E3": "Rest and warm drinks bring some relief by evening."}


@pytest.fixture(scope="module")
def evidence(spark):
    return spark.createDataFrame([(d, k, t, "Notes", a) for d in range(9) for (k, t), a in zip(TEXTS.items(), ("Ann Alder, ed.", "Bo Birch", "Ann Alder, ed."))], "draft_id int, label string, text string, title string, author string")


def test_excerpts():
    text = TEXTS["E1"]
    assert P.excerpt(text, "pain burns, at night and", "the burning kind") == (0, text.index(" wakes"), text[: text.index(" wakes")])
    assert P.excerpt(text, "pain burns at night and", "it hurts")[0] == text.index("pain")
    assert P.excerpt(text, "cold air helps it now and then", "x")[2] == "Cold air helps it" and P.excerpt(text, "cold air helped nobody at all", "x") is None
    assert P.recover_quote("a b c d e f", "x b c d e y") == "b c d e" and P.recover_quote("a b c d", "b c d") is None


def test_quotes_held(spark):
    from pyspark.sql import functions as F

    rows = [("One two-\n three four five", "two three four five", False), ("One two-\n three four five", "twothree, FOUR five. one", False), ("One two-\n three four five.", "one twothree: four five", True), ("a b c d", "a b c", False)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, q string, want boolean")
    assert all(r.x == r.want for r in frame.select(P.holds_quote(F.col("p"), F.col("q")).alias("x"), "want").collect())


def test_entries_are_not_crossed(spark):
    text = "word " * 400
    spans = P.entry_spans(text, [100, 900, 900, 5000], 300)
    assert all(not a < c < b for a, b in spans for c in (100, 900)) and all(text[a:b].strip() == text[a:b] for a, b in spans)
    docs = spark.createDataFrame([(1, text), (2, "short text")], "doc_id long, text string")
    entries = spark.createDataFrame([(1, 100, 900), (1, -5, 7), (3, 0, 1)], "doc_id long, start int, end int")
    got = P.entry_passages(docs, entries, 300).collect()
    assert [(r.start, r.end) for r in got if r.doc_id == 1] == P.entry_spans(text, [100, 900], 300) and sum(r.doc_id == 2 for r in got) == 1


def test_accepted_claims(spark, evidence):
    claim = lambda text, *supports: {"text": text, "supports": [{"id": i, "quote": q} for i, q in supports]}
    good, other = ("E1", "burns at night and wakes"), ("[E3]", "warm drinks bring some relief")
    raw = [
        {"claims": [claim("It burns at night.", good), claim("Drinks help", other, other), claim("Nobody said so.", ("E1", "four words not there")), claim("Two. Sentences.", good), claim("Cited [E1].", good), claim("None.")]},
        {"claims": []}, {"claims": [claim("A!", good, other), claim("B", good), claim("C", good)]}, None, {"claims": [claim("Many", good, good, good), claim("x" * 501, good)]},
    ]
    frame = spark.createDataFrame([(i, json.dumps(r) if r else "no json", 2 if i == 2 else 9) for i, r in enumerate(raw)], "draft_id int, raw string, most int")
    got = {r.draft_id: (r.answer, r.labels, r.omitted) for r in C.accepted_claims(frame, evidence).collect()}
    assert got == {0: ("It burns at night [E1]. Drinks help [E3].", ["E1", "E3"], 4), 1: ("", [], 0), 2: ("A [E1] [E3]! B [E1].", ["E1", "E3"], 0), 3: (None, [], 0), 4: ("", [], 2)}


def test_decisions(spark, evidence):
    drafts = spark.createDataFrame([(0, "It burns at night [E1]. Worse from cold [E2]. Nothing cited. Both help [E1] [E3]. Warm drinks help [E3]. Rest helps [E3].", ["E1"])], "draft_id int, answer string, declared array<string>")
    quotes = [(0, 0, 0, "E1", "not in it at all"), (0, 0, 1, "[E1]", "burns at night and"), (0, 1, 0, "E2", "worse from cold air in"), (0, 3, 0, "E1", "cold air helps it"), (0, 4, 0, "E3", "warm drinks bring some"), (0, 5, 0, "E3", "rest and warm drinks")]
    verdicts = [(0, 0, True, True), (0, 1, True, True), (0, 3, True, True), (0, 4, False, True), (0, 5, True, False)]
    rows = C.decided_claims(drafts, evidence, spark.createDataFrame(quotes, "draft_id int, number int, place int, label string, quote string"), spark.createDataFrame(verdicts, "draft_id int, number int, supported boolean, relevant boolean")).orderBy("number").collect()
    assert [r.decision for r in rows] == ["supported", "missing_excerpt", "missing_excerpt", "missing_excerpt", "unsupported", "irrelevant"]
    assert [(s.label, s.text) for s in rows[0].supports] == [("E1", "burns at night and")] and [len(r.supports) for r in rows] == [1, 0, 0, 1, 1, 1]


def test_sections(spark, evidence):
    sentences = spark.createDataFrame([(d, n, s) for d in range(4) for n, s in ((1, "One [E1]."), (2, "Two [E2]."), (3, "Three [E3]." if d < 3 else "Three."))], "draft_id int, number int, sentence string")
    groups = [(0, 0, "First & last", [3, 1]), (0, 1, "Middle", [2]), (1, 0, "Once", [1, 2]), (1, 1, "Twice", [2, 3]), (2, 0, "Bad: title", [1, 2]), (2, 1, "Other", [3])]
    got = sorted((r.draft_id, r.place, r.title, r.body) for r in C.sections(sentences, spark.createDataFrame(groups, "draft_id int, place int, title string, numbers array<int>"), evidence).collect())
    by_author = lambda d: [(d, 1, "Findings from Alder", "One [E1]. Three [E3]."), (d, 2, "Findings from Birch", "Two [E2].")]
    assert got == [(0, 0, "First & last", "Three [E3]. One [E1]."), (0, 1, "Middle", "Two [E2]."), *by_author(1), *by_author(2), (3, 1, "Findings in the books", "One [E1]. Two [E2]. Three.")]
