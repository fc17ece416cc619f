import pytest

from tessera.functions import citations as C

EVIDENCE = [("E1", "Burning pain at night, said Alder.", "Clinical notes", "Alder"), ("E2", "Worse from cold air in the morning.", "Lectures", "Birch, Old")]


@pytest.fixture(scope="module")
def asked(spark):
    def of(f, *drafts, **more):
        """f over drafts (answer, declared), each with the same evidence, in order."""
        frame = spark.createDataFrame([(i, a, d) for i, (a, d) in enumerate(drafts)], "draft_id int, answer string, declared array<string>")
        if f is C.settled_drafts:
            return [r.answer for r in f(frame).orderBy("draft_id").collect()]
        evidence = spark.createDataFrame([(i, *e) for i in range(len(drafts)) for e in EVIDENCE], "draft_id int, label string, text string, title string, author string")
        return f(frame, evidence, **more).orderBy("draft_id").collect()

    return of


def test_sound_drafts(asked):
    drafts = [("The pain burns at night [E1]. It is worse from cold [E2].", ["E2", "E1"]), ('He wrote "Burning pain at night" there [E1].', ["E1"]), ("Dr. Alder saw it [E1].", ["E1"]), ("Worse from Cold [E2]", ["E2"])]
    assert [r.valid for r in asked(C.valid_drafts, *drafts)] == [True] * 4


def test_unsound_drafts(asked):
    drafts = [("", []), ("No label.", []), ("One [E1]. Two.", ["E1"]), ("One [E1] two.", ["E1"]), ("One [E3].", ["E3"]), ("One [E1].", ["E1", "E2"]), ("One [E1] [E99].", ["E1"]), ("One [see E9] here [E1].", ["E1"]), ("One [E1, E2].", ["E1"])]
    drafts += [("As Rowan says [E1].", ["E1"]), ('He wrote "never written down" [E1].', ["E1"]), ("x" * 5000 + " [E1].", ["E1"]), ("Fine [E1]. But [E2].", ["E1"])]
    assert [r.valid for r in asked(C.valid_drafts, *drafts)] == [False] * len(drafts)


def test_kept_sentences(asked):
    drafts = [("The pain burns [E1]. As Rowan says it [E1]. Cold is worse [E2].", []), ("No label. She saw it in the morning [E2]", []), ("Nothing holds.", []), ("One [E1] [E7]. Two [see E1] [E1].", [])]
    rows = asked(C.kept_sentences, *drafts, called={"birch": "Birch"})
    assert [(r.answer, r.labels, r.omitted) for r in rows] == [("The pain burns [E1]. Cold is worse [E2].", ["E1", "E2"], 1), ("Birch saw it in the morning [E2].", ["E2"], 1), ("", [], 1), ("", [], 2)]


def test_settling(asked):
    drafts = [("First thing. [E1] Then more. And last [E1].", ["E1"]), ("One. Two.", ["E2"]), ("One [E1]. Two. Three [E2].", ["E1", "E2"]), ("A b [E1]. Middle one.  Last [E1]! Other [E2].\n\nNext one? End", ["E1", "E2"]), ("One.", ["E77"]), ("Bare [E12]. Two.", [])]
    assert asked(C.settled_drafts, *drafts) == [
        "First thing [E1]. Then more [E1]. And last [E1].", "One [E2]. Two [E2].", "One [E1]. Two. Three [E2].", "A b [E1]. Middle one [E1].  Last [E1]! Other [E2].\n\nNext one? End", "One.", "Bare [E12]. Two [E12]."
    ]


def test_sentences(spark):
    from pyspark.sql import functions as F

    texts = ["One. Two! “Three” four? five. Six", "By A. B. Carr vs. Dr. Dorn etc. Then end.", "x.Y  a.\tB", "", "é. Ah. Oh"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.sentences(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [["One.", "Two!", "“Three” four? five.", "Six"], ["By A. B. Carr vs. Dr. Dorn etc. Then end."], ["x.Y  a.\tB"], [""], ["é.", "Ah.", "Oh"]]
