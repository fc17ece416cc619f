"""Text functions on small tables of cases."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import passages as P
from tessera.functions import text as T
from tessera.operators import classify as C
from tessera.operators import graph, identity, jobs, retrieve


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


TEXTS = ["ACONITE\nMind.— restless\nHead: pain\nBELLADONNA\nMind: hot.", "One sentence, é.\r\n" * 150, "界" * 200, "a b\tc", "", "A. B. C.\n\nD; e! f? g"]


@pytest.mark.parametrize("limit", [1, 7, 70, 1800])
@pytest.mark.parametrize("text", TEXTS)
def test_passages_cover_every_visible_character(text, limit):
    spans = P.split_passages(text, limit)
    assert all(a < b <= a + limit for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    inside = {i for a, b in spans for i in range(a, b)}
    assert all(i in inside or c.isspace() for i, c in enumerate(text))


def test_entries_are_not_joined():
    assert [TEXTS[0][a:b].split("\n")[0] for a, b in P.split_passages(TEXTS[0], 1800)] == ["ACONITE", "BELLADONNA"]
    assert P.split_passages("x", 0) == []


def test_section_labels(spark):
    lines = ["Mind.— restless", "Head: pain", "MODALITIES", " urinary organs --", "Headache after motion", "Skin is dry", "", None]
    assert column(spark, lines, T.section_label) == ["mind", "head", "modalities", "urinary organs", "", "", "", None]


def test_headings(spark):
    assert column(spark, ["ACONITUM NAPELLUS", "Mind:", "AB", "A LINE WITH FAR TOO MANY WORDS IN", "Aconite", "ÜBER (X-Y)"], T.is_heading) == [True, True, False, False, False, True]


def test_quotes():
    p = "The patient com-\n plained of Burning,  sharp pain; worse at night."
    assert p[slice(*P.locate_quote(p, "complained of burning sharp pain"))] == "com-\n plained of Burning,  sharp pain"
    assert P.locate_quote(p, "burning sharp pain") is None and P.locate_quote(p, "not in the passage") is None
    assert P.recover_quote(p, "of burning sharp pain XX at") == "of Burning,  sharp pain"
    assert P.recover_quote(p, "patient complained of burning") == "patient complained of burning"
    assert P.recover_quote(p, "one two three four five") is None


def test_rubric_rows(spark):
    text = "\u2003Roots, old: Moss., Fern.;  Pine. \r\nbad: Moss.,, Fern.\nsame: Moss., Moss.\nhttp://x: y\nprose here: and more\na.b: Moss.\nno colon\nLast é: Ash-t."
    rows = P.rubric_rows(spark.createDataFrame([(1, text), (2, "a: B.\n" * 60), (3, None), (4, "")], "doc_id int, text string")).orderBy("doc_id", "line").collect()
    own = [r for r in rows if r.doc_id == 1]
    assert [(r.heading, r.notations) for r in own] == [("Roots, old", ["Moss.", "Fern.", "Pine."]), ("Last é", ["Ash-t."])]
    assert all(text[r.start : r.end] == r.exact for r in own) and sum(r.doc_id == 2 for r in rows) == 50 and len(rows) == 52


def test_query_terms_and_questions(spark):
    assert column(spark, ["What does the Fear of fear mean, with rain?", "", None], T.query_terms) == [["fear", "mean", "rain"], [], None]
    assert column(spark, ["flu", "Nux", "", "g", "GI", "???", "é" * 501], T.valid_question) == [True, True, False, False, False, False, False]


def test_identifiers(spark):
    assert column(spark, ["https://doi.org/10.1000/ABC", "doi: 10.1/x", "10.12345/a b", None], T.doi) == ["10.1000/abc", None, None, None]
    assert column(spark, ["https://creativecommons.org/licenses/by-sa/4.0/", "https://creativecommons.org/licenses/by-nc/4.0/", None], T.open_licence) == [True, False, False]


def test_literature(spark):
    rubric = "Mind - fear\n" + "anxiety : Acon., Bell., Phos.\nsadness : Aur., Ign., Nat-m.\nanger : Cham., Nux-v., Staph.\n"
    kinds = column(spark, ["A randomized trial with placebo-controlled arms", "nothing here", rubric, "The repertory and its rubrics; materia medica with modalities."], lambda x: C.literature(x)["categories"])
    assert kinds == [["research"], ["unclassified"], ["repertory"], ["materia_medica", "repertory"]]


def test_evidence_type(spark):
    texts = ["Study protocol for a randomized controlled trial with outcomes", "randomized controlled trial: results", "case report of a patient", ""]
    assert column(spark, texts, C.evidence_type) == ["study_protocol", "trial_study", "published_case", "unknown"]


def test_text_check(spark):
    from tessera.operators import page_text as P

    page = " ".join(f"word{i}" for i in range(60))
    cases = [(page, page, False), (" ".join(page.split()[20:]), page, True), (page.replace("word5 ", "wo[r]d "), page, True), (" ".join(reversed(page.split())), page, False), (None, page, True), (page, "few words", True)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").withColumn("m", P.measured(F.col("a"), F.col("b")))
    assert [bool(r.s) for r in rows.select("i", P.text_check(F.col("a"), F.col("m"))["suspect"].alias("s")).orderBy("i").collect()] == [c for *_, c in cases]
    assert P.measures("a b c ddd".split(), "a xxx q yyy b zzz zz zzzz".split())[2:] == (2, 2, 2, 2, 2)


def test_evidence_opening_is_cut_by_bytes(spark):
    """Cues beyond the first 8,000 bytes do not count, however few characters that are."""
    cue = " case report of a patient"
    assert column(spark, ["é" * 4000 + cue, "e" * 7900 + cue, "é" * 3980 + cue, "€" * 2700 + cue], C.evidence_type) == ["unknown", "published_case", "published_case", "unknown"]


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], [1.0, 1.0]), (1, [0.0, 0.0], [1.0, 1.0])], "i int, a array<float>, b array<float>")
    got = [r.c for r in rows.select("i", T.cosine(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1] is None


def test_quota_balances_sources(spark):
    rows = spark.createDataFrame([(i, "a" if i < 8 else "b", 1.0 - i / 100) for i in range(12)], "doc_id long, source string, score double")
    got = retrieve.evidence_quota(rows, 8).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"a": 4, "b": 4}
    one = retrieve.evidence_quota(rows.where("source = 'a'"), 8)
    assert one.count() == 8 and {r.label for r in one.collect()} == {f"E{i}" for i in range(1, 9)}


def test_breadth_first_levels(spark):
    edges = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 4, 0), (3, 4, 0), (4, 1, 0), (5, 6, 0)], "`from` long, to long, number int")
    got = {r.node: (r.depth, r.parent) for r in graph.levels(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: (0, None), 2: (1, 1), 3: (1, 1), 4: (2, 2)}


def test_link_states(spark):
    links = spark.createDataFrame([(1, "u1"), (1, "f2"), (1, "zz")], "`from` long, target string")
    items = spark.createDataFrame([(10, "u1", "f1", 1, "done"), (11, "u2", "f2", 2, "failed"), (12, "u1", None, 3, "skipped")], "item_id long, requested_url string, final_url string, ordinal int, state string")
    assert {r.target: (r.item_id, r.link_state) for r in graph.states(links, items).collect()} == {"u1": (12, "skipped"), "f2": (11, "failed"), "zz": (None, "unresolved")}


def test_identity_in_order(spark):
    rows = spark.createDataFrame([("s", 1, "d1", None), ("s", 2, "d1", "p2"), ("s", 3, "d3", "p3"), ("s", 4, "d4", "p3"), ("s", 5, None, None)], "search string, n int, doi string, pmid string")
    got = {r.n: (r.kept, r.identity_conflict) for r in identity.merge_in_order(rows, "search", "n", ["doi", "pmid"]).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, True), 4: (True, True), 5: (True, False)}


def test_identity_of_many_searches(spark):
    """A task merges its searches one after the other, also those that lie across batches; each as if it were alone."""
    cases = [("d1", None), ("d1", "p2"), ("d3", "p3"), ("d4", "p3"), (None, None)]
    keys = [None, *(1 << 60 | k for k in range(3000))]
    rows = spark.createDataFrame([(k, n, *x) for k in keys for n, x in enumerate(cases)], "search long, n int, doi string, pmid string").repartition(3, "n")
    merged = identity.merge_in_order(rows, "search", "n", ["doi", "pmid"])
    assert "FlatMapGroups" not in merged._jdf.queryExecution().optimizedPlan().toString()
    told = [(True, False), (False, False), (True, True), (True, True), (True, False)]
    assert {(r.search, r.n): (r.kept, r.identity_conflict) for r in merged.collect()} == {(k, n): x for k in keys for n, x in enumerate(told)}


def test_leases(spark):
    rows = spark.createDataFrame([(1, "running", 1, 0), (2, "running", 5, 0), (3, "failed", 2, 0), (4, "waiting", 0, 1), (5, "running", 1, 9)], "id int, status string, attempts int, minute int")
    rows = rows.withColumn("at", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.col("minute"), F.lit(0))).withColumn("priority", -F.col("id"))
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    assert {r.id: r.state for r in jobs.settle(rows, now).collect()} == {1: "waiting", 2: "failed", 3: "waiting", 4: "waiting", 5: "running"}
    assert [r.id for r in jobs.claimable(rows, now).collect()] == [4]


def test_streamed_windows(spark, tmp_path):
    from tessera.streaming import activity

    path = "/root/testdata/sf0.001/events.parquet"
    events = activity.events_stream(spark, "/root/testdata/sf0.001", "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    q = activity.windowed_counts(events).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM windows").first().n == pd.read_parquet(path).shape[0]
