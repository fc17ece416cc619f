"""Deletions over references, versioned tables and table functions of SQL."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.functions.passages import split_passages
from tessera.operators.deletion import Reference, delete
from tessera.operators.schema import Versioned
from tessera.sources import html

REFERENCES = [Reference("page", "source", "source", "cascade"), Reference("chunk", "page", "page", "cascade"), Reference("chunk", "part_of", "chunk", "cascade"), Reference("citation", "chunk", "chunk", "block"), Reference("source", "newer", "source", "block"), Reference("item", "source", "source", "clear"), Reference("source", "edition", "edition", "own"), Reference("page", "file", "file", "own")]
COLUMNS = {"source": ["edition", "newer"], "page": ["source", "file"], "chunk": ["page", "part_of"], "citation": ["chunk"], "item": ["source"], "edition": [], "file": []}


def plain(data, roots):
    """One root after the other: what it would take along, what keeps it; then owned rows and cleared references."""
    gone, blocked = {t: set() for t in data}, set()
    for root in sorted(roots & set(data["source"])):
        own = {("source", root)}
        while True:
            more = {(r.table, k) for r in REFERENCES if r.rule == "cascade" for k, row in data[r.table].items() if (r.to, row[r.column]) in own} - own
            if not more:
                break
            own |= more
        by = {r.table for r in REFERENCES if r.rule == "block" for k, row in data[r.table].items() if (r.to, row[r.column]) in own and (r.table, k) not in own}
        blocked |= {(root, b) for b in by}
        if not by:
            for t, k in own:
                gone[t].add(k)
    for r in REFERENCES:
        if r.rule == "own":
            of = lambda keep: {row[r.column] for k, row in data[r.table].items() if (k in gone[r.table]) != keep}  # noqa: E731, B023
            gone[r.to] |= (of(False) - of(True)) - {None}
    left = {t: {k: dict(row) for k, row in rows.items() if k not in gone[t]} for t, rows in data.items()}
    for row in left["item"].values():
        row["source"] = None if row["source"] in gone["source"] else row["source"]
    return left, blocked


def test_deletions_by_brute_force(spark):
    rng = random.Random(4)
    size = {"source": 12, "page": 30, "chunk": 60, "citation": 6, "item": 8, "edition": 5, "file": 20}
    pick = lambda t, p=1.0: rng.randrange(size[t]) if rng.random() < p else None
    data = {
        "source": {k: {"edition": pick("edition"), "newer": pick("source", 0.2)} for k in range(12)}, "page": {k: {"source": pick("source"), "file": pick("file", 0.9)} for k in range(30)},
        "chunk": {k: {"page": pick("page"), "part_of": pick("chunk", 0.3)} for k in range(60)}, "citation": {k: {"chunk": pick("chunk")} for k in range(6)}, "item": {k: {"source": pick("source", 0.9)} for k in range(8)},
        "edition": {k: {} for k in range(5)}, "file": {k: {} for k in range(20)},
    }
    frames = {t: spark.createDataFrame([(k, *(row[c] for c in COLUMNS[t])) for k, row in rows.items()], ", ".join(f"{c} long" for c in ["id", *COLUMNS[t]])) for t, rows in data.items()}
    roots = {0, 2, 3, 5, 8, 9, 11, 77}
    got = delete(frames, dict.fromkeys(data, "id"), REFERENCES, "source", spark.createDataFrame([(k,) for k in roots], "id long"))
    left, blocked = plain(data, roots)
    assert {(r.root, r.by) for r in got.blocked.collect()} == blocked
    for t, rows in left.items():
        assert {r.id: {c: r[c] for c in COLUMNS[t]} for r in got.tables[t].collect()} == rows, t
    went = set(data["source"]) - set(left["source"])
    assert went and blocked and went < roots
    for r in REFERENCES:  # nothing dangles
        assert got.tables[r.table].where(F.col(r.column).isNotNull()).join(got.tables[r.to].select(F.col("id").alias("__k")), F.col(r.column) == F.col("__k"), "left_anti").count() == 0
    with pytest.raises(ValueError, match="rules"):
        delete(frames, dict.fromkeys(data, "id"), [Reference("page", "source", "source", "drop")], "source", frames["source"].select("id"))


def test_upgrades_are_made_once(spark, tmp_path):
    table = Versioned(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no table"):
        table.read()
    table.create(spark.createDataFrame([(1, "a b"), (2, None)], "id long, name string"))
    steps = [("words", lambda df: df.withColumn("words", F.size(F.split("name", " ")))), ("longer ids", lambda df: df.withColumn("id", F.col("id") + 100))]
    assert table.upgrade(steps) == ["words", "longer ids"] and table.upgrade(steps) == []
    rows = {(r.id, r.name, r.words) for r in table.read().collect()}
    assert rows == {(101, "a b", 2), (102, None, None)} or rows == {(101, "a b", 2), (102, None, -1)}
    assert [n for n, _ in table.applied()] == ["create", "words", "longer ids"]
    with pytest.raises(ValueError, match="begins"):
        table.upgrade(steps[::-1])
    with pytest.raises(ValueError, match="begins"):
        table.upgrade(steps[:1])
    bad = [*steps, ("no ids", lambda df: df.withColumn("id", F.lit(None).cast("long")))]
    with pytest.raises(ValueError, match="check"):
        table.upgrade(bad, check=lambda df: df.where("id is null"))
    (tmp_path / "t/ledger/000002").mkdir()  # a run that was lost
    assert {r.id for r in Versioned(spark, str(tmp_path / "t")).read().collect()} == {101, 102} and len(table.applied()) == 3


def test_table_functions(spark):
    tables.register(spark)
    tables.register(spark)
    sf = "/root/testdata/sf0.001"
    docs, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages"))
    docs.createOrReplaceTempView("lateral_docs")
    pages.createOrReplaceTempView("lateral_pages")
    got = spark.sql("SELECT d.doc_id, p.number, p.start, p.end, p.passage FROM lateral_docs d, LATERAL passages(d.text, 400) p").collect()
    want = {(r.doc_id, n, a, b, r.text[a:b]) for r in docs.collect() for n, (a, b) in enumerate(split_passages(r.text, 400))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    blocks = spark.sql("SELECT d.page_id, b.* FROM lateral_pages d, LATERAL html_blocks(d.html) b")
    assert sorted(map(str, blocks.collect())) == sorted(map(str, html.blocks(pages).select(blocks.columns).collect()))
    links = spark.sql("SELECT d.page_id, l.* FROM lateral_pages d, LATERAL html_links(d.url, d.html) l")
    assert sorted(map(str, links.collect())) == sorted(map(str, html.links(pages).select(links.columns).collect()))
    assert spark.sql("SELECT * FROM passages(CAST(NULL AS STRING), 100)").count() == 0


def test_every_check_of_the_gate(spark):
    """A passage passes; each change of one table alone keeps it out; so does each choice that it does not meet."""
    from dataclasses import replace

    from tessera.operators.evidence import Library, eligible

    make = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    sources = "source string, source_key string, author string, title string, status string, rights string, superseded string"
    lib = Library(
        make("id int, source string", (1, "s")), make("id int, page_kind string, scan int", (1, "text", 3), (1, "index", 4)), make(sources, ("s", "moss-1", "A. Moss", "Walls", "published", "allowed", None)),
        make("publication int, source string", (7, "s")), make("run int, publication int, config int, status string", (5, 7, 1, "ready"), (6, 7, 1, "building")), make("publication int, run int", (7, 5)),
        make("id int, config int", (1, 1)), make("id int, categories array<string>", (1, ["x"])), make("source string, snapshot int", ("s", 2), ("t", 3)), make("snapshot int, collection int", (2, 9), (3, 9), (4, 8)), make("collection int, snapshot int", (9, 2), (8, 4)),
    )
    ids = lambda x, *a, **k: [(r.id, r.author, r.scan) for r in eligible(x, *(a or (1,)), **k).collect()]
    assert ids(lib) == [(1, "A. Moss", 3)]
    row = ("s", "moss-1", "A. Moss", "Walls", "published", "allowed", None)
    for at, value in ((4, "review"), (4, None), (5, "denied"), (6, "2024")):
        assert ids(replace(lib, sources=make(sources, (*row[:at], value, *row[at + 1 :])))) == []
    for change in ({"active": make("publication int, run int", (7, 6))}, {"active": make("publication int, run int", (8, 5))}, {"live": make("collection int, snapshot int", (9, 3))}, {"locations": make("id int, page_kind string, scan int", (1, "index", 3))}):
        assert ids(replace(lib, **change)) == []
    for name in ("locations", "sources", "publications", "runs", "active", "vectors", "categories"):
        assert ids(replace(lib, **{name: getattr(lib, name).limit(0)})) == []
    assert ids(replace(lib, items=lib.items.limit(0))) == ids(replace(lib, live=lib.live.limit(0))) == [(1, "A. Moss", 3)]
    assert ids(lib, 2) == [] and ids(lib, scope="moss") == ids(lib, scope="WALL") == ids(lib, selected=["s"], asked=["y", "x"]) == [(1, "A. Moss", 3)]
    assert ids(lib, scope="fern") == ids(lib, selected=["t"]) == ids(lib, asked=["y"]) == []
