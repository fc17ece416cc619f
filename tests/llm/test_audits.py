"""Alignment, decontamination and the filter audit: brute-force versions, edge rows, general outputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from tessera.llm import align, audit, decontaminate, queries

from .test_queries import SF, small  # noqa: F401


def tokens(texts):
    """(A's and B's ids and bytes) of each text by plain use of the libraries over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(align.BYTES), sentencepiece.SentencePieceProcessor(model_file=align.PIECES)
    a.encode_special_tokens = True
    level = {c: bytes([x]) for x in range(256) for c in [next(iter(byte_char(x)))]}
    assert decoders.ByteLevel().decode([c for c in level if level[c] < b"\x80"]) == "".join(map(chr, (level[c][0] for c in level if level[c] < b"\x80")))
    for t in texts:
        ia = a.encode(" " + t, add_special_tokens=False).ids
        ib = b.encode(t)
        ba = [b"".join(level[c] for c in a.id_to_token(i)) for i in ia]
        bb = []
        for i in ib:
            p = b.id_to_piece(i)
            bb.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        yield ia, ba, ib, bb


def byte_char(x):
    from tokenizers import pre_tokenizers

    if x < 0x80:
        return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(x))[0][0]
    whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    for c in range(0x80, 0x110000):  # the first character whose UTF-8 ends with or begins with the byte
        if not 0xD800 <= c < 0xE000 and x in (u := chr(c).encode()):
            return whole.pre_tokenize_str(chr(c))[0][0][u.index(x)]
        if c > 0x3000 and not c % 64 and x > 0xE0:
            continue
    return "\0"  # no byte of UTF-8


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def aligned(texts):
    """The rows that the contract asks for, pair by pair."""
    each, held = [], Counter()
    for t, (ia, ba, ib, bb) in zip(texts, tokens([t or "" for t in texts])):
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            each.append(None)
            continue
        sa, sb = spans(ba), spans(bb)
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        link = [(x, y) for x, (s, e) in zip(ia, sa) for y, (u, v) in zip(ib, sb) if s < v and u < e]
        groups, last = [], 0
        for end in ends:
            groups.append(",".join(str(x) for x, (s, e) in zip(ia, sa) if last <= s and e <= end) + "|" + ",".join(str(x) for x, (s, e) in zip(ib, sb) if last <= s and e <= end))
            last = end
        each.append((len(ia), len(ib), len(ends), link, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        held.update(set(link))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(held[p] == top[p[0]] for p in r[3]), sum(held[p] for p in r[3]), r[4]) for r in each]


def strange(n, seed=5):
    rng = random.Random(seed)
    parts = ["the", "The", " ", "  ", "\n", "\n\n", "\t", "é", "é", "日本語", "　", " ", "▁", "<s>", "<|endoftext|>", "</s>", "don't", "'s", "12345", "3.14", "...", "!?", "🙂", "👩‍👩‍👧", "\x00", "\x1c", "\x85", "aaaaaaaaaaaaa", "<0x41>", "ﬁ", "x" * 40, "a b", "​", "\r\n", "Ünïcödé"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 25))) for _ in range(n)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_by_brute_force(spark, small, monkeypatch):  # noqa: F811
    full, _, docs, _, _ = small
    got = Counter(tuple(r) for r in queries.op11_alignment(spark, full).select(*COLUMNS).collect())
    assert got == Counter(aligned(docs.text.tolist()))


@pytest.mark.parametrize(("units", "block"), [(1 << 19, 1 << 22), (40, 300)])
def test_alignment_of_strange_texts(spark, monkeypatch, units, block):
    """Special tokens' strings, every kind of white space, bytes; units and pair counts also in small blocks."""
    texts = [*strange(300), None, "", " ", "   ", "\n", "a", *["same text here"] * 3]
    monkeypatch.setattr(align, "UNITS", units)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.report(docs, block=block).collect()}
    want = aligned(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[0] == 0 for w in want) >= 2 and sum(w[0] > 0 for w in want) > 150


def test_alignment_in_small_batches():
    """The partial counts of batches add up to those of all texts."""
    own, texts = align.Aligner(align.BYTES, align.PIECES), strange(80)
    _, pairs, n = own.rows(texts)
    parts = Counter()
    for i in range(0, 80, 7):
        parts.update(dict(zip(*(x.tolist() for x in own.rows(texts[i : i + 7])[1:]))))
    assert parts == Counter(dict(zip(pairs.tolist(), n.tolist())))


def test_links_have_shares(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "two")], "doc_id long, text string")
    rows = align.links(docs).collect()
    assert rows and max(r.docs for r in rows) == 3
    assert all(abs(sum(r.share for r in rows if r.a == a) - 1) < 1e-9 for a in {r.a for r in rows})


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def leaks(texts, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(len(w) - n, 0) + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for k in range(len(w)):
            for m in range(1, n + 1):
                if k + m <= len(w) and (x := windows.get(tuple(w[k : k + m]))):
                    hit |= set(range(k, k + m))
                    found |= x
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


LEAK = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def leak_case(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(8)] + ["Été", "x1", "日本"]
    items = [(i if i else None, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 9, 10, 11, 14, 30])))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "?!"), (7, items[3][1]), (103, items[5][1])]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [None, "", "!!", *(f"go {t} On. {t}" for _, t in items[:30]), *(t.upper().replace(" ", " -- ") for _, t in items[20:30])]
    return items, texts


@pytest.mark.parametrize("size", [48 << 20, 6000])
def test_leaks_by_brute_force(spark, size):
    """Short and long items, items that share windows, several words of a text in several items; also in several blocks."""
    items, texts = leak_case()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.scan(docs, bench, block_bytes=size).collect()
    got = {r.doc_id: (r["__words"], sum(x.end - x.start for x in r["__runs"]), r["__items"]) for r in rows}
    want = leaks(texts, items)
    assert [(w, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), bool(h)) for w, h, i in (got[k] for k in range(len(texts)))] == want
    assert sum(w[4] for w in want) > 40


def test_leaks_are_cut_or_dropped(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = ["Before this, ONE two -- three four five six seven eight nine ten ELEVEN! After it.", item, "nothing here", None, "é one two three four five six seven eight nine ten"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, size int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.size) for r in decontaminate.cut_spans(docs, bench).collect()}
    assert got == {0: ("Before this, After it.", 7), 1: ("", 7), 2: ("nothing here", 7), 3: (None, 7), 4: ("é ", 7)}
    assert {r.doc_id for r in decontaminate.drop_documents(docs, bench).collect()} == {2, 3}
    assert decontaminate.drop_documents(docs, bench).columns == docs.columns
    assert {r.doc_id for r in decontaminate.drop_documents(docs, bench, least=11).collect()} == {2, 3, 4}
    with pytest.raises(ValueError, match="__words"):
        decontaminate.scan(docs.withColumnRenamed("size", "__words"), bench)


def test_equal_hashes_are_told_apart_by_words(monkeypatch):
    """With hashes that all agree, no factor tells windows apart; with few different ones, words decide."""
    import numpy as np

    plain = decontaminate._hash
    monkeypatch.setattr(decontaminate, "_hash", lambda ids, size, factors: plain(ids, size, factors) >> np.uint64(57))
    own = decontaminate.WindowSet([("1", "a b"), ("2", "c d"), ("2", "e")])
    assert [x[1:] for x in decontaminate._scan([b"a b c d x e", *(b"%c %c" % (x, y) for x in b"abcde" for y in b"abcde")], own)][:1] == [([(0, 4), (5, 6)], ["1", "2"])]
    found = [x for x in decontaminate._scan([b"%c %c" % (x, y) for x in b"abcd" for y in b"abcd"], own) if x[1]]
    assert len(found) == 2
    monkeypatch.setattr(decontaminate, "_hash", lambda ids, size, factors: plain(ids, size, factors) & np.uint64(0))
    with pytest.raises(ValueError, match="factor"):
        decontaminate.WindowSet([("1", "a b"), ("2", "c d")])


def audited(docs, labels):
    """Each order filter by filter, document by document."""
    rows = []
    for d in docs.itertuples():
        t = d.text or ""
        w = t.encode().split()
        smaller = any((o.text or "") == t and not isna(o.doc_id) and not isna(d.doc_id) and o.doc_id < d.doc_id for o in docs.itertuples())
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller}
        own = labels[[not isna(i) and not isna(d.doc_id) and i == d.doc_id for i in labels.doc_id]]
        rows.append((d.source or "", {f for f in fails if fails[f]}, (own.quality == 1).fillna(False).any(), (own.toxic == 1).fillna(False).any()))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def isna(x):
    return x is None or str(x) in ("<NA>", "nan")


def test_audit_by_brute_force(spark, small):  # noqa: F811
    full, _, docs, _, _ = small
    labels = spark.read.parquet(f"{full}/labels.parquet").toPandas()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in queries.op13_filter_audit(spark, full).collect()}
    assert got == audited(docs.assign(source=[s if isinstance(s, str) else None for s in docs.source], text=[t if isinstance(t, str) else None for t in docs.text]), labels)


def test_walk_makes_each_set_once(spark):
    """Four filters: 16 of 65 nodes, depth first, each after a node with one filter less; all persisted ones are given up."""
    rows = spark.createDataFrame([(bool(i & 1), bool(i & 2), bool(i & 4), bool(i & 8)) for i in range(16)], "p boolean, q boolean, r boolean, s boolean")
    met = []
    for left in audit.walk(rows, "pqrs", lambda left, done: met.append(done) or left):
        assert left.count() == 2 ** (4 - len(met[-1]))
    assert len(met) == len(set(met)) == 16 and met[4] == frozenset("pqrs")
    assert all(any(len(d - e) == 1 and e < d for e in met[:i]) for i, d in enumerate(met) if d)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_audit_of_named_filters(spark):
    """Any filters of one letter; a part that loses all its rows early; other columns are ignored."""
    rows = spark.createDataFrame([("x", True, False, True, False), ("x", True, True, False, False), ("y", False, False, False, True)], "part string, P boolean, Q boolean, good boolean, toxic boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audit(rows.withColumn("left", rows.P), "PQ").collect()}
    assert got == {("x", "PQ", 1): (0, 2, 0, 1, 1, 0, 4 - 1), ("x", "PQ", 2): (0, 0, 1, 0, 0, 0, 1), ("x", "QP", 1): (1, 1, 0, 0, 0, 0, 1), ("x", "QP", 2): (0, 1, 1, 1, 1, 0, 3)} | {("y", o, k): (1, 0, 0, 0, 0, 0, 0) for o in ("PQ", "QP") for k in (1, 2)}


@pytest.mark.parametrize("name", ["op12_decontamination", "op13_filter_audit"])
def test_sql_on_edge_rows(spark, small, name):  # noqa: F811
    full = small[0]
    db = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{full}/{t}.parquet'")
    df = queries.QUERIES[name](spark, full)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(df.collect()) == text(db.execute(queries.ORACLE_SQL[name]).fetchdf()[df.columns].astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None))
