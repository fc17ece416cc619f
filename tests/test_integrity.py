"""Rules that the driver's tables keep, against tables that break them; identity in order."""

from tessera import catalog
from tessera.operators import identity


def test_planted_violations(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "abc", 3), (2, "abc", 4), (3, None, 0)], "doc_id long, text string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    ones = [1.0] * 64
    spark.createDataFrame([(1, ones), (2, [0.0] * 64), (3, ones[1:]), (4, [float("nan"), *ones[1:]]), (5, None), (6, [None, *ones[1:]])], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 1, 0), (2, 2, 0), (3, 0, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    ids = lambda name: sorted(r[0] for r in catalog.QUERIES[name](spark, folder).collect())
    assert ids("v_text_length") == [2] and ids("v_vectors") == [2, 3, 4, 5, 6] and ids("v_labels") == [2, 3, 9]


def plain_merge(rows):
    """The rule, one record after another."""
    kept, seen = [], {}
    for ref, *values in rows:
        keys = [(k, v) for k, v in enumerate(values) if v] or [("ref", ref)]
        first = next((seen[k] for k in keys if k in seen), None)
        if first is None:
            seen.update(dict.fromkeys(keys, len(kept)))
            kept.append([ref, values, False])
        elif any(a and b and a != b for a, b in zip(values, kept[first][1])):
            kept[first][2] = True
            kept.append([ref, values, True])
    return {ref: flag for ref, _, flag in kept}


def test_merge_in_order(spark):
    rows = [(i, f"d{i % 7}" if i % 3 else None, f"p{i % 5}" if i % 4 else None, f"c{i % 3}" if i % 6 == 0 else None) for i in range(60)]
    rows += [(60, None, None, None), (61, None, None, None)]
    frame = spark.createDataFrame([(0, *r) for r in rows], "search int, ref int, doi string, pmid string, pmcid string")
    got = {r.ref: r.identity_conflict for r in identity.merge_in_order(frame, "search", "ref", ["doi", "pmid", "pmcid"], native="ref").collect() if r.kept}
    assert got == plain_merge(rows) and any(got.values())


def test_upsert(spark):
    known = spark.createDataFrame([(1, "d1", None), (2, "d2", "p2"), (3, None, "p3")], "id int, doi string, pmid string")
    new = spark.createDataFrame([(10, "d1", "p1"), (11, "d9", "p2"), (12, "d8", "p8"), (13, "d2", "p3"), (14, None, None)], "ref int, doi string, pmid string")
    got = {r.ref: (r.id, r.state, r.doi, r.pmid) for r in identity.upsert(known, new, ["doi", "pmid"]).collect()}
    assert got == {10: (1, "updated", "d1", "p1"), 11: (2, "conflict", "d2", "p2"), 12: (None, "inserted", "d8", "p8"), 13: (2, "conflict", "d2", "p2"), 14: (None, "inserted", None, None)}
