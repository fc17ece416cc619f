"""Stems, postings and cover density."""

import itertools
import random

from pyspark.sql import functions as F

from tessera import catalog  # noqa: F401
from tessera.functions.stem import stem
from tessera.operators import postings as P
from tessera.operators.index import Index
from tessera.plans import search

STEMS = "consigned consign, consistency consist, consolatory consolatori, knives knive, knightly knight, generally general, communism communism, happy happi, enjoy enjoy, dying die, skies sky, proceeding proceed, ties tie, cries cri, gas gas, kiwis kiwi, hopping hop, hoping hope, agreed agre, relational relat, rational ration, electricity electr, hopefulness hope, replacement replac, geology geolog, studies studi, analysis analysi, bed bed, controlling control, say say, cry cri, by by"


def test_stems():
    assert all(stem(w) == s for w, s in (x.split() for x in STEMS.split(", ")))


def test_positions_of_stop_words_count():
    assert P.positions("The cats and the CAT, studying.", True) == {"cat": [2, 5], "studi": [6]}
    assert P.positions("The cats, 2 the", False) == {"the": [1, 4], "cats": [2], "2": [3]}
    long = P.positions("a " * 300 + "b " * 17_000, False)
    assert long["a"] == list(range(1, 257)) and len(long["b"]) == 256
    assert P.positions("x " * 10 + "y" + " z" * 16_400 + " w v w", False)["w"] == [16_383]


def test_cover_density_by_brute_force():
    random.seed(4)
    for _ in range(300):
        n = random.randint(1, 3)
        places = [sorted(random.sample(range(1, 30), random.randint(1, 4))) for _ in range(n)]
        taken, own = set(), []
        for p in places:
            own.append([x for x in p if x not in taken])
            taken |= set(p)
        if not all(own):
            continue
        every = sorted((x, k) for k, p in enumerate(own) for x in p)
        want = 0.0
        for a, b in itertools.combinations_with_replacement(range(len(every)), 2):
            holds = lambda i, j: len({k for _, k in every[i : j + 1]}) == n
            if holds(a, b) and (a == b or not holds(a + 1, b) and not holds(a, b - 1)):
                want += 0.1 / (1 + every[b][0] - every[a][0] - (b - a))
        assert abs(P.covers(own) - want) < 1e-12


def test_texts_are_inverted_in_bounded_parts(spark):
    """Postings equal those of each text alone, and leave a task in parts that do not grow with its rows."""
    random.seed(5)
    words = ["the", "Running", "run", "a1", "É", "b_c", "studies", "study", "x"]
    texts = ["", "The İß", "a " * 300 + "b " * 17_000, "x " * 10 + "y" + " z" * 16_400 + " w v w"] + [" ".join(random.choices(words, k=random.randint(0, 400))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "x"), (-1, None)], "doc_id long, text string").coalesce(1)
    for kind in ("simple", "english"):
        found = P.lexed(docs, kind, most=1000)
        own = {(r.lexeme, r.key): (r.n, r.positions) for r in found.collect()}
        assert own == {(w, k): (len(at), at) for k, t in enumerate(texts) for w, at in P.positions(t, kind == "english").items()}
        assert found.count() == len(own)
    plain = {(r.lexeme, r.key): (r.n, len(r.positions)) for r in P.lexed(docs, "plain").where("lexeme in ('z', 'running')").collect()}
    assert plain["z", 3] == (16_400, 256) and plain["running", 7][0] == texts[7].count("Running")


def shuffled(spark):
    """Rows written to shuffles by all stages so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    none = spark._sc._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_parts_hold_the_postings(spark):
    """Gathered and scattered again, postings are those of lexed(), and each block tells its greatest n once in a part."""
    random.seed(6)
    words = ["the", "Running", "run", "a1", "É", "studies", "study", "x"]
    texts = ["", "The İß", "a " * 300 + "b " * 17_000, "x " * 10 + "y" + " z" * 16_400 + " w v w"] + [" ".join(random.choices(words, k=random.randint(0, 300))) for _ in range(200)]
    keys = random.sample(range(-500, 500), 200) + [-(1 << 62), 1 << 62, 1 << 40, 7_000]
    docs = spark.createDataFrame([*zip(keys, texts), (None, "x"), (-1_000, None)], "doc_id long, text string").coalesce(1)
    for kind in ("plain", "simple", "english"):
        made = P.parts(docs, kind, 64).withColumn("bucket", F.lit(3))
        found = P.from_parts(made, 8, most=500).collect()
        want = {(r.lexeme, r.key): (r.n, r.positions) for r in P.lexed(docs, kind).collect()}
        assert {(r.lexeme, r.key): (r.n, r.positions) for r in found} == want and len(found) == len(want)
        assert all(r.block == r.key // 8 and r.bucket == 3 for r in found)
        best = {}
        for (w, k), (n, _) in want.items():
            best[w, k // 8] = max(best.get((w, k // 8), 0), n)
        told = [((r.lexeme, r.block), r.most) for r in found if r.most is not None]
        assert dict(told) == best and len(told) == len(best)


def test_an_index_shuffles_a_lexeme_once_for_many_texts(spark, tmp_path):
    random.seed(7)
    docs = spark.createDataFrame([(k, " ".join(random.choices([f"w{i}" for i in range(300)], k=200))) for k in range(2000)], "doc_id long, text string").coalesce(2)
    before = shuffled(spark)
    own = Index.create(spark, str(tmp_path / "i"), docs, "simple")
    rows = shuffled(spark) - before
    assert rows < 10_000 and own.postings().count() > 250_000


def test_texts_with_all_terms_are_told_without_positions(spark):
    """A posting is shuffled once, not once for each item that asks for it, and positions only of texts that hold all terms."""
    sf = "/root/testdata/sf0.01"
    own = search.asked(spark, sf, search.EVERY, True)
    rows = search.found(spark, sf, own, True)  # the index is made
    met = rows.join(own, "lexeme").count()
    before = shuffled(spark)
    found = search.ranked_all(spark, sf, True).collect()
    assert shuffled(spark) - before < 0.8 * met and len(found) == 5
    plan = search.matched(spark, sf, rows, own)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan and "positions" not in plan.split("Relation", 1)[0]


def test_texts_with_all_lexemes(spark):
    docs = spark.createDataFrame([(k, f"word{k} common text {k % 3}") for k in range(500)], "doc_id long, text string")
    own = P.postings(docs, english=False).where("lexeme in ('word7', 'common')").withColumn("q", F.lit(1))
    assert [(r.doc_id, round(r.score, 9)) for r in P.rank_all(own, ["q", "doc_id"], F.lit(2)).collect()] == [(7, 0.1)]


def test_the_flagship_reads_its_lexemes(spark):
    """No text is read for the lexical list, and of the index only the buckets of the question's lexemes."""
    from tessera import catalog  # noqa: F401
    from tessera.plans.retrieval import lexical_list

    plan = lexical_list(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    physical = lexical_list(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in physical.split("FileScan")[1:] if "lexeme" in x.split("ReadSchema")[0]]
    assert len(scans) >= 3 and all("bucket" in x.split("PartitionFilters")[1].split("]")[0] for x in scans)
    assert "regexp_extract_all" not in plan.split("Relation", 1)[1]
