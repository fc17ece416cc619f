"""The maintained index: changes, tombstones, compaction, pruning and early termination against plain counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators.index import Index

WORDS = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]


def texts(keys, seed):
    rng = random.Random(seed)
    return {k: " ".join(rng.choices(WORDS, range(1, 25), k=rng.randint(0, 60))) for k in keys}


def plain(held, asked, most, allowed=None):
    out = {}
    for q, words in asked.items():
        hits = {k: sum(n for w, n in Counter(t.split()).items() if w in words) for k, t in held.items() if allowed is None or k in allowed}
        best = sorted((-n, k) for k, n in hits.items() if n)[:most]
        out |= {(q, k): (-n, i + 1) for i, (n, k) in enumerate(best)}
    return out


def frame(spark, held):
    return spark.createDataFrame(list(held.items()), "doc_id long, text string")


def asked_of(spark, asked):
    return spark.createDataFrame([(q, w) for q, ws in asked.items() for w in ws], "question int, lexeme string")


def rows(found):
    return {(r.question, r.key): (r.hits, r["rank"]) for r in found.collect()}


@pytest.mark.parametrize("kind", ["plain", "simple"])
def test_changes_are_exact(spark, tmp_path, kind):
    held, asked = texts(range(-20, 300), 1), {1: {"ax", "hz"}, 2: {"bx"}, 3: {"cx", "dy", "ez", "hz"}, 4: {"nowhere"}}
    own = Index.create(spark, str(tmp_path / "i"), frame(spark, held), kind, buckets=5, width=8)
    questions = asked_of(spark, asked)
    assert rows(own.best(questions, 7)) == plain(held, asked, 7)
    more = texts([*range(250, 400), 5], 2) | {6: ""}  # new ones, changed ones, and one that has no words now
    own.add(frame(spark, more))
    held |= more
    assert rows(own.best(questions, 7)) == plain(held, asked, 7)
    own.remove(spark.createDataFrame([(k,) for k in (0, 255, 399, 10_000)], "doc_id long"))
    held = {k: t for k, t in held.items() if k not in (0, 255, 399)}
    own.add(frame(spark, back := {255: "hz hz hz bx " * 30}))  # removed, then added again
    held |= back
    again = Index(spark, own.folder)  # another reader
    assert rows(again.best(questions, 7)) == plain(held, asked, 7)
    odd = {k for k in held if k % 2}
    allowed = spark.createDataFrame([(k,) for k in odd], "doc_id long")
    assert rows(again.best(questions, 500, allowed)) == plain(held, asked, 500, odd)
    before = again.postings().count()
    again.compact()
    again.vacuum()
    assert [g >> 24 for g in again.state["live"]] == [4] and not again.state["gone"]
    assert len({p.name for p in (tmp_path / "i/postings").iterdir()}) == 1
    last = Index(spark, own.folder)
    assert rows(last.best(questions, 7)) == plain(held, asked, 7) and last.postings().count() == before


def test_rows_that_share_a_key_add_up(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ax bx"), (1, "ax"), (2, "ax")], "doc_id long, text string")
    own = Index.create(spark, str(tmp_path / "i"), rows, "simple")
    assert sorted((r.lexeme, r.key, r.n) for r in own.postings().collect()) == [("ax", 1, 2), ("ax", 2, 1), ("bx", 1, 1)]
    alone = Index.create(spark, str(tmp_path / "j"), rows.where("text <> 'ax bx'"), "simple")
    assert sorted((r.lexeme, r.key, r.n) for r in alone.postings().collect()) == [("ax", 1, 1), ("ax", 2, 1)]


def test_a_late_writer_fails(spark, tmp_path):
    one = Index.create(spark, str(tmp_path / "i"), frame(spark, {1: "ax"}), "plain")
    other = Index(spark, one.folder)
    one.remove(spark.createDataFrame([(1,)], "doc_id long"))
    with pytest.raises(Exception, match="(?i)exist"):
        other.remove(spark.createDataFrame([(1,)], "doc_id long"))
    with pytest.raises(ValueError, match="holds an index"):
        Index.create(spark, one.folder, frame(spark, {}), "plain")
    assert Index(spark, one.folder).postings().count() == 0


def test_an_unfinished_change_is_not_seen(spark, tmp_path):
    own = Index.create(spark, str(tmp_path / "i"), frame(spark, {1: "ax", 2: "ax bx"}), "simple")
    own._write(frame(spark, {3: "ax"}).select(F.col("text").alias("lexeme"), F.col("doc_id").alias("key"), F.lit(1).cast("long").alias("n"), F.array(F.lit(1)).alias("positions")), 1)
    with pytest.raises(Exception):  # noqa: B017  a writer that was lost while it made the first generation
        Index.create(spark, str(tmp_path / "j"), frame(spark, {1: "ax"}).select("doc_id", F.expr("if(doc_id = 1, raise_error('lost'), text)").alias("text")), "simple")
    assert {r.key for r in Index.create(spark, str(tmp_path / "j"), frame(spark, {1: "ax"}), "simple").postings().collect()} == {1}
    (tmp_path / "i/manifest/00000001").mkdir()  # a writer that was lost before its manifest was complete
    assert {r.key for r in Index(spark, own.folder).postings().collect()} == {1, 2}


def test_only_what_may_matter_is_read(spark, tmp_path):
    """Buckets are pruned and lexemes pushed down; blocks that cannot reach the list are not scored."""
    held = {k: "common " * (50 if k < 64 else 1) + f"word{chr(97 + k % 26)}" for k in range(4000)}
    own = Index.create(spark, str(tmp_path / "i"), frame(spark, held), "plain", width=16)
    asked = asked_of(spark, {1: {"common"}})
    found = own.best(asked, 10, first=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:] if "lexeme" in x.split("ReadSchema")[0]]
    assert len(scans) >= 3 and all("bucket" in x.split("PartitionFilters")[1].split("]")[0] for x in scans)
    assert all("EqualTo(lexeme,common)" in x or "In(lexeme" in x for x in scans)
    assert rows(found) == {(1, k): (50, k + 1) for k in range(10)}
    found.collect()
    bounds = own._read("maxima", own.state["live"]).where("lexeme = 'common'")
    assert bounds.count() == 250 and bounds.where("most >= 50").count() == 4  # the blocks that a list of 10 has to read


def test_a_common_lexeme_lies_in_several_files(spark, tmp_path, monkeypatch):
    from tessera.operators import index

    monkeypatch.setattr(index, "SLICE", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    Index.create(spark, str(tmp_path / "i"), frame(spark, {k: "common" for k in range(2000)}), "plain", buckets=2, width=32)
    assert sum(p.suffix == ".parquet" for p in (tmp_path / "i/postings").rglob("*")) >= 4
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_an_index_of_files_is_found_again(spark, tmp_path):
    frame(spark, {1: "ax bx", 2: None, 3: "x1"}).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    own = Index.of(docs, "simple")
    assert Index.of(docs, "simple").folder == own.folder != Index.of(docs, "plain").folder
    frame(spark, {4: "ax"}).write.mode("append").parquet(str(tmp_path / "d"))
    new = Index.of(spark.read.parquet(str(tmp_path / "d")), "simple")
    assert new.folder != own.folder and {(r.lexeme, r.key) for r in new.postings().collect()} == {("ax", 1), ("bx", 1), ("x1", 3), ("ax", 4)}
    none = Index.create(spark, str(tmp_path / "none"), docs.limit(0), "simple")
    assert none.best(asked_of(spark, {1: {"ax"}})).count() == 0 and none.postings().count() == 0
