"""Every registered query against DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", catalog.ORACLE)
def test_oracle(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    other = db.execute(catalog.ORACLE[name])
    names = [d[0] for d in other.description]
    assert sorted(df.columns) == sorted(names)
    assert ordered(df.select(*names).collect()) == ordered(other.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    sf = "/root/testdata/sf0.01" if name == "fts_english_all" else SF  # no text of the smaller tables holds all of an item's terms
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLE) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_tightening_the_gate_never_adds_rows(spark):
    from tessera.operators.retrieve import eligible

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    every = {r.doc_id for r in eligible(docs, labels).collect()}
    fewer = {r.doc_id for r in eligible(docs.where("lang = 'en'"), labels).collect()}
    assert fewer < every
    assert eligible(docs, labels.limit(0)).count() == 0


def test_export_is_whole(spark, tmp_path):
    """Every conversation, all of each text, and a repeated heading once."""
    rows = [(3, 2, "user", "c" * 50), (3, 1, "user", "b" * 90), (3, 3, "assistant", None), (75, 1, None, "d"), (75, 2, "user", "e")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.exported for r in catalog.QUERIES["plain_text_export"](spark, str(tmp_path)).collect()}
    assert got == {3: "user\n" + "b" * 90 + "\n" + "c" * 50 + "\nassistant\n", 75: "\nd\nuser\ne"}


def test_first_texts_are_whole(spark, tmp_path):
    rows = [(k, f"{k} " + "x" * 500, "s") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    (got,) = catalog.QUERIES["first_n_string_agg"](spark, str(tmp_path)).collect()
    assert got.texts == "|".join(t for _, t, _ in rows[:30])


def test_worksheet_of_every_item(spark, tmp_path):
    """More items than one, and the first eligible documents for an item without hits."""
    docs = [(k, f"alpha text{k} " + "beta " * k, f"s{k % 3}") for k in range(1, 30)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(3, 30)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "alpha"), (1, "beta beta"), (2, "zeta"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for r in catalog.QUERIES["worksheet_candidates"](spark, str(tmp_path)).collect():
        got.setdefault(r.item_id, set()).add((r.doc_id, r.hits, r.fallback))
    first = range(3, 13)
    assert got == {0: {(k, 1, False) for k in first}, 1: {(k, k, False) for k in range(20, 30)}, 2: {(k, 0, True) for k in first}, 3: {(k, 0, True) for k in first}}


def test_overlaps_in_every_language(spark, tmp_path):
    rows = [(1, "x" * 1500, "de"), (2, "x" * 1500, "fr"), (3, "x" * 800, None), (4, "x" * 600, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r["first"], r.second) for r in catalog.QUERIES["span_overlap"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, 700), (1, 700, 1400), (2, 0, 700), (2, 700, 1400), (3, 0, 700)}


def test_snapshot_reads_every_document(spark, tmp_path):
    """Ids 1 and 5 modulo 6 too, and a changed row under one id."""
    spark.createDataFrame([(k, "s", "en") for k in range(1, 13)], "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.change for r in catalog.QUERIES["v_snapshot_difference"](spark, str(tmp_path)).collect()}
    assert got == {1: "changed", 11: "changed", 10: "gone", 2: "gone", 12: "gone", -2: "new", -12: "new"}


def _pages_differ(spark, tmp_path, name, rows):
    """The query's rows on pages of our own, beside the rows of its SQL."""
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    other = own.execute(catalog.ORACLE[name])
    columns = [d[0] for d in other.description]
    return ordered(catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), ordered(other.fetchall())


def test_titles_cut_off_in_a_reference(spark, tmp_path):
    pages = ["<title>moss &amp;&amp</title>", "<title>a &lt;b&gt; &quot;c&#39; &am</title>", "<title>&amp;lt; &ampx &lt</title>", f"<title>{'x' * 2001}</title>", "<p>none</p>", "<title> a\n b </title>", None]
    got, told = _pages_differ(spark, tmp_path, "page_titles", [(i, "", h) for i, h in enumerate(pages)])
    assert got == told and (0, "moss &&amp") in got


def test_scopes_leave_fragments_out(spark, tmp_path):
    urls = ["http://a.org/x#top", "https://A.org/fr2/y.htm#a/b?c", "http://a.org", "http://a.org?q=1", "http://a.org#z", "http://b.org/x#top", "http://a.org/x.pdf?q#t", "http://a.org/x?q=/#t"]
    got, told = _pages_differ(spark, tmp_path, "url_scopes", [(i, u, "") for i, u in enumerate(urls)])
    assert got == told


def test_coverage_of_odd_rows(spark, tmp_path):
    """One row a document and side is shuffled; rows of one document add up, also those before it, and empty ones are left out."""
    rows = [(1, "a b"), (1, "b É"), (2, "b B b é"), (3, " .,"), (4, "x"), (5, None), (6, "y y"), (7, "y")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    own = catalog.QUERIES["multiset_coverage"](spark, str(tmp_path))
    assert "Generate" not in own._jdf.queryExecution().optimizedPlan().toString()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    other = db.execute(catalog.ORACLE["multiset_coverage"])
    assert ordered(own.select(*[d[0] for d in other.description]).collect()) == ordered(other.fetchall())
