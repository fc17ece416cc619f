"""More integrity rules as queries of violations. The driver's tables hold no entries, locations or acquisitions, so these are
made of their keys by expressions that both engines read alike, some of them against the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import text as T
from tessera.plans.scoping import valid_set
from tessera.sources.tables import sql, table

REVIEWED = ("accepted", "corrected")
_LOC = "SELECT doc_id, text, CAST(doc_id % 5 AS INT) AS a, CAST(doc_id % 5 + 8 AS INT) AS b, CASE doc_id % 10 WHEN 1 THEN 'pending' WHEN 3 THEN 'corrected' ELSE 'accepted' END AS status, CASE WHEN doc_id % 8 = 5 THEN 'elsewhere' ELSE substring(text, CAST(doc_id % 5 + 1 AS INT), 8) END AS exact FROM {documents}"
_MEMBER = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'categorical' WHEN 1 THEN 'numeric' WHEN 2 THEN 'typographic' ELSE 'none' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS scheme, CAST(o_custkey * 60 - 100 AS INT) AS grade, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'as printed' END AS note, o_orderpriority AS exact, substring(o_orderpriority, 3, 3) AS notation FROM {orders}"
_duck = lambda x: x.replace("{documents}", "documents").replace("{orders}", "orders")


@query(f"SELECT doc_id, exact IS DISTINCT FROM substring(text, a + 1, b - a) AS differs, status NOT IN ('accepted', 'corrected') AS unreviewed FROM ({_duck(_LOC)}) WHERE exact <> substring(text, a + 1, b - a) OR status NOT IN ('accepted', 'corrected')")
def v_locations(spark, sf_dir):
    """Locations of entries whose words differ from their span, or whose page is not reviewed."""
    rows = sql(spark, sf_dir, _LOC, "documents")
    differs, unreviewed = ~T.span_text(F.col("text"), F.col("a"), F.col("b")).eqNullSafe(F.col("exact")), ~F.col("status").isin(*REVIEWED)
    return rows.select("doc_id", differs.alias("differs"), unreviewed.alias("unreviewed")).where("differs or unreviewed")


@query(f"""SELECT id, CASE WHEN kind IN ('categorical', 'numeric') AND (trim(scheme) = '' OR NOT contains(exact, scheme)) THEN 'scheme' WHEN kind = 'numeric' AND grade NOT BETWEEN 1 AND 32767 THEN 'grade' WHEN kind = 'typographic' AND trim(note) = '' THEN 'note' WHEN NOT contains(lower(exact), lower(notation)) THEN 'notation' END AS problem FROM ({_duck(_MEMBER)})
WHERE (kind IN ('categorical', 'numeric') AND (trim(scheme) = '' OR NOT contains(exact, scheme))) OR (kind = 'numeric' AND grade NOT BETWEEN 1 AND 32767) OR (kind = 'typographic' AND trim(note) = '') OR NOT contains(lower(exact), lower(notation))""")
def v_grades(spark, sf_dir):
    """Grades without their scheme in the evidence, numbers out of range, typography without a note, notations that the
    evidence does not hold."""
    rows = sql(spark, sf_dir, _MEMBER, "orders")
    kind, shown = F.col("kind"), (F.trim("scheme") != "") & F.contains("exact", "scheme")
    problem = (
        F.when(kind.isin("categorical", "numeric") & ~shown, "scheme").when((kind == "numeric") & ~F.col("grade").between(1, 32767), "grade")
        .when((kind == "typographic") & (F.trim("note") == ""), "note").when(~F.contains(F.lower("exact"), F.lower("notation")), "notation")
    )
    return rows.select("id", problem.alias("problem")).where("problem is not null")


@query("SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1 AND d.doc_id % 4 <> 0")
def v_withdrawn_published(spark, sf_dir):
    """Published sources that have been withdrawn; documents are published unless their id is divisible by four."""
    withdrawn = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select("doc_id").join(withdrawn, "doc_id", "left_semi")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 AND (c_mktsegment = 'BUILDING' OR c_nationkey > 20)")
def v_removed_enabled(spark, sf_dir):
    """Removed sources that are enabled or published again; a balance below zero stands for removal."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("removed"), (F.col("c_mktsegment") == "BUILDING").alias("enabled"), (F.col("c_nationkey") > 20).alias("published"))
    return rows.where("removed and (enabled or published)").select("id")


@query("SELECT doc_id FROM documents WHERE doc_id % 6 IN (0, 1) OR (doc_id % 6 = 2 AND lang = 'en') OR lang NOT IN ('en', 'de', 'fr')")
def v_categories(spark, sf_dir):
    """Category lists that are empty, hold one twice or hold an unknown one."""
    lists = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 6 == 1, F.array("lang", "lang")).when(F.col("doc_id") % 6 == 2, F.array("lang", F.lit("en"))).otherwise(F.array("lang"))
    rows = table(spark, sf_dir, "documents").select("doc_id", lists.alias("c"))
    return rows.where(~valid_set(F.col("c"), ("en", "de", "fr"))).select("doc_id")


@query(f"""WITH l AS ({_duck(_LOC)}) SELECT doc_id, CASE WHEN doc_id % 7 = 2 AND status IN ('accepted', 'corrected') THEN 'rejected' ELSE status END AS status, CASE WHEN doc_id % 7 = 2 AND status IN ('accepted', 'corrected') THEN 'text changed' END AS reason FROM l""")
def mapping_invalidation(spark, sf_dir):
    """Locations after some pages' texts changed: reviewed mappings of those pages are rejected, the others stay as they are."""
    rows = sql(spark, sf_dir, _LOC, "documents")
    now = rows.select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 2, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("now"))
    changed = rows.select("doc_id", F.sha2("text", 256).alias("was")).join(now, "doc_id").where("was <> now").select("doc_id").withColumn("changed", F.lit(True))
    hit = F.coalesce("changed", F.lit(False)) & F.col("status").isin(*REVIEWED)
    return rows.join(changed, "doc_id", "left").select("doc_id", F.when(hit, "rejected").otherwise(F.col("status")).alias("status"), F.when(hit, "text changed").alias("reason"))


@query("SELECT d.doc_id, d.source AS asset, sha256(d.source || ':' || CAST(d.n_chars AS VARCHAR)) AS revision, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id % 2 = 0 OR l.doc_id IS NOT NULL")
def provenance_rows(spark, sf_dir):
    """The provenance that follows from a new row: its asset, a revision named by its key, and its review if there is one.
    Rows with an even id are new, and so are reviewed ones."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("reviewed"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left").where("doc_id % 2 = 0 or reviewed")
    return rows.select("doc_id", F.col("source").alias("asset"), F.sha2(F.concat("source", F.lit(":"), F.col("n_chars").cast("string")), 256).alias("revision"), "quality")


_PATHS = """SELECT d.doc_id AS id, CASE WHEN d.doc_id % 10 > 0 THEN d.doc_id - d.doc_id % 10 END AS parent, d.lang AS heading, CASE WHEN d.doc_id % 40 = 30 THEN array('none', d.lang) WHEN d.doc_id % 10 = 0 THEN array(d.lang)
WHEN d.doc_id % 10 = 3 THEN array(d.lang) WHEN d.doc_id % 10 = 7 THEN array('lost', d.lang) WHEN d.doc_id % 10 = 8 THEN array(p.lang, 'other') WHEN p.doc_id % 40 = 30 THEN array('none', p.lang, d.lang) ELSE array(p.lang, d.lang) END AS path FROM {documents} d LEFT JOIN {documents} p ON p.doc_id = d.doc_id - d.doc_id % 10"""


@query(f"""WITH t AS ({_PATHS.replace('{documents}', 'documents').replace('array(', 'list_value(')}) SELECT t.id FROM t LEFT JOIN t p ON p.id = t.parent
WHERE (t.parent IS NULL AND t.path <> [t.heading]) OR (p.id IS NOT NULL AND t.path <> list_append(p.path, t.heading))""")
def v_paths(spark, sf_dir):
    """Nodes of a tree whose path is not their parent's path and their own heading, or that have no parent and another path than
    their heading; some roots and some nodes below are made so."""
    rows = sql(spark, sf_dir, _PATHS, "documents")
    above = rows.select(F.col("id").alias("parent"), F.col("path").alias("above"))
    roots = rows.where("parent is null and (size(path) <> 1 or path[0] <> heading)").select("id")
    below = rows.join(above, "parent").where(F.col("path") != F.concat("above", F.array("heading"))).select("id")
    return roots.unionByName(below)


@query("SELECT source AS revision, lang AS path, count(*) AS n FROM documents WHERE doc_id % 3 > 0 GROUP BY 1, 2 HAVING count(*) > 1")
def v_duplicate_paths(spark, sf_dir):
    """Paths that several live nodes of a revision have; nodes with an id divisible by three have been removed."""
    live = table(spark, sf_dir, "documents").where("doc_id % 3 > 0")
    return live.groupBy(F.col("source").alias("revision"), F.col("lang").alias("path")).agg(F.count("*").alias("n")).where("n > 1")


_ARTICLE = "SELECT o_orderkey AS id, concat('10.1234/', o_orderkey) AS doi, concat('PMC', o_custkey) AS pmcid, CASE WHEN o_orderkey % 6 = 0 THEN concat('10.1234/', o_orderkey + 1) ELSE concat('10.1234/', o_orderkey) END AS found_doi, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat('PMC', o_custkey) END AS found_pmcid, CASE o_orderkey % 5 WHEN 0 THEN 'https://creativecommons.org/licenses/by-nc/4.0/' WHEN 1 THEN 'http://creativecommons.org/publicdomain/zero/1.0/' ELSE 'https://creativecommons.org/licenses/by/4.0/' END AS licence FROM {orders}"


@query(f"SELECT id, doi IS DISTINCT FROM found_doi OR pmcid IS DISTINCT FROM found_pmcid AS other, contains(licence, 'by-nc') AS closed FROM ({_duck(_ARTICLE)}) WHERE doi IS DISTINCT FROM found_doi OR pmcid IS DISTINCT FROM found_pmcid OR contains(licence, 'by-nc')")
def v_articles(spark, sf_dir):
    """Acquired articles that are not the saved reference's, by any identifier, or that no open licence covers."""
    rows = sql(spark, sf_dir, _ARTICLE, "orders")
    other = ~F.col("doi").eqNullSafe(F.col("found_doi")) | ~F.col("pmcid").eqNullSafe(F.col("found_pmcid"))
    return rows.select("id", other.alias("other"), (~F.lower("licence").rlike(r"^https?://creativecommons\.org/(licenses/by/4\.0|publicdomain/zero/)")).alias("closed")).where("other or closed")


@query("""SELECT item_id, CASE WHEN item_id % 4 = 1 THEN 'category' WHEN item_id % 7 = 3 THEN 'gold' WHEN item_id % 10 = 9 THEN 'repeated' END AS problem FROM benchmark WHERE item_id % 4 = 1 OR item_id % 7 = 3 OR item_id % 10 = 9""")
def v_dataset(spark, sf_dir):
    """Cases of an evaluation set that break its contract: an unknown category, no wanted passages where there must be some, or
    an id that another case has."""
    i = F.col("item_id")
    cases = table(spark, sf_dir, "benchmark").select(
        "item_id", F.when(i % 10 == 9, F.lit("same")).otherwise(i.cast("string")).alias("name"), F.when(i % 4 == 1, "other").when(i % 2 == 0, "single_source").otherwise("comparison").alias("category"), F.when(i % 7 == 3, F.array().cast("array<string>")).otherwise(F.array(i.cast("string"))).alias("gold")
    )
    repeated = cases.groupBy("name").agg(F.count("*").alias("n"))
    known = F.col("category").isin("single_source", "comparison", "author_edition", "unsupported")
    problem = F.when(~known, "category").when((F.col("category") != "unsupported") & (F.size("gold") == 0), "gold").when(F.col("n") > 1, "repeated")
    return cases.join(repeated, "name").select("item_id", problem.alias("problem")).where("problem is not null")
