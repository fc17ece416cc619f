"""Trees and crawls against plain searches, one item at a time."""

import random
from collections import deque

from tessera.operators import graph


def crawled(items, links, root, most_depth=0, most_documents=0, most_bytes=0, most_seconds=0, most_links=0):
    """A crawl by a plain queue, one document after another."""
    by = {i[0]: i[1:] for i in items}
    queue, seen, finals, documents, told, spent, clock = deque([(root, 0)]), {root}, set(), [], [], 0, 0
    while queue:
        if (most_documents and len(documents) >= most_documents) or (most_bytes and spent >= most_bytes) or (most_seconds and clock >= most_seconds):
            break
        url, depth = queue.popleft()
        final, state, anchors, size, seconds = by.get(url, (None, "failed", None, 0, 0))
        spent, clock = spent + (size or 0), clock + (seconds or 0)
        if state == "fetched" and final in finals:
            state = "duplicate_redirect"
        documents.append((url, final, state, anchors))
        if state != "fetched":
            continue
        finals.add(final)
        seen.add(final)
        for u, number, target, fragment, allowed in (x for x in links if x[0] == url):
            if most_links and len(told) >= most_links:
                break
            if not allowed:
                state = "excluded_scope"
            elif target in seen:
                state = "duplicate_or_cycle"
            elif 0 < most_depth <= depth:
                state = "excluded_depth"
            elif most_documents and len(seen) >= most_documents:
                state = "excluded_document_limit"
            else:
                state = "queued"
                seen.add(target)
                queue.append((target, depth + 1))
            told.append([u, number, target, fragment, state])
    last = {}
    for url, final, state, anchors in documents:
        last[url] = (state, anchors)
        if final:
            last[final] = (state, anchors)
    for x in told:
        if x[4] not in ("queued", "duplicate_or_cycle"):
            continue
        state, anchors = last.get(x[2], (None, None))
        if state is None:
            x[4] = "unfetched"
        elif state != "fetched":
            x[4] = f"target_{state}"
        elif x[3] and x[3] not in anchors:
            x[4] = "missing_anchor"
        elif x[4] == "queued" or x[3]:
            x[4] = "resolved"
    return documents, told


def same_crawl(spark, items, links, **limits):
    frames = spark.createDataFrame(items, "url string, final_url string, state string, anchors array<string>, bytes long, seconds long"), spark.createDataFrame(links, "url string, number int, target string, fragment string, allowed boolean")
    documents, told = graph.crawl(*frames, "n0", **limits)
    want_documents, want = crawled(items, links, "n0", **limits)
    assert [(r.url, r.state) for r in documents.orderBy("depth", "ordinal").collect()] == [(u, s) for u, _, s, _ in want_documents], limits
    assert sorted(tuple(r) for r in told.collect()) == sorted(map(tuple, want)), limits
    return want_documents, want


def test_crawl(spark):
    name = "n{}".format
    items = [(name(i), name(i - 1 if i % 9 == 8 else i), "failed" if i % 11 == 7 else "fetched", ["a"], i % 5, None) for i in range(60)]
    links = [(name(i), k, name(t), "a" if i % 4 == 0 else "b" if i % 4 == 1 else "", t % 10 != 9) for i in range(60) for k, t in enumerate((i // 2, 2 * i + 1, 2 * i + 2, i + 1))]
    for limits in ({}, {"most_depth": 3}, {"most_documents": 25}):
        same_crawl(spark, items, links, **limits)


def test_crawl_limits_on_random_graphs(spark):
    """Every limit, alone and with others, cuts within a level where a plain queue does."""
    rng, name, cut = random.Random(8), "n{}".format, set()
    for case in range(7):
        n = rng.randint(28, 45)
        items = [(name(i), name(rng.choice([i, i, i, rng.randrange(n + 5)]) if i else 0), rng.choice(["fetched"] * 6 + ["failed"]) if i else "fetched", rng.sample(["a", "b"], rng.randint(0, 2)), rng.randint(0, 9), rng.randint(0, 4)) for i in range(n) if i == 0 or rng.random() < 0.95]
        links = [(name(i), k, name(rng.randrange(n + 3)), rng.choice(["", "", "a", "b"]), rng.random() < 0.9) for i in range(n) for k in range(rng.randint(0, 6) if i else 6)]
        every = {"most_depth": 1 + case % 2, "most_documents": rng.randint(4, n // 2), "most_bytes": rng.randint(5, 3 * n), "most_seconds": rng.randint(3, n), "most_links": rng.randint(3, 2 * n)}
        limits = every if case == 6 else dict([list(every.items())[case]]) if case < 5 else dict(rng.sample(list(every.items()), 3))
        _, told = same_crawl(spark, items, links, **limits)
        cut |= {x[4] for x in told}
    assert {"excluded_depth", "excluded_document_limit", "unfetched", "excluded_scope", "missing_anchor"} <= cut


def test_sums_over_rows_before(spark):
    rows = [(f"{i * 7919 % 1000:04d}", i % 13) for i in range(1000)]
    got = {r.o: r.b for r in graph.before(spark.createDataFrame(rows, "o string, v long"), "o", "v", "b").collect()}
    total = 0
    for o, v in sorted(rows):
        assert got[o] == total
        total += v


def test_ancestors_end_in_cycles_and_at_unknown_parents(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None), (5, 4), (6, 99)], "id long, parent long")
    got = sorted((r.id, r.depth, r.node) for r in graph.ancestors(tree, tree.where("id in (1, 5, 6)")).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (5, 0, 5), (5, 1, 4), (6, 0, 6), (6, 1, 99)]
    assert sorted(r.id for r in graph.descendants(tree, tree.where("id = 1")).collect()) == [1, 2, 3]


def test_ancestors_and_depths_by_brute_force(spark):
    """Random forests with cycles and unknown parents; a chain much longer than two; a limit within it."""
    rng = random.Random(6)
    tree = {i: (None if rng.random() < 0.1 else rng.randrange(120)) for i in range(100)} | {1000 + i: 999 + i for i in range(1, 70)} | {1000: None}
    frame = spark.createDataFrame(list(tree.items()), "id long, parent long")

    def above(i, most):
        out, at = {}, i
        while at is not None and at not in out and len(out) <= most:
            out[at] = len(out)
            at = tree.get(at)
        return out

    for most in (100, 5):
        got = {(r.id, r.node): r.depth for r in graph.ancestors(frame, frame.where("id % 3 = 0"), most).collect()}
        assert got == {(i, n): d for i in tree if i % 3 == 0 for n, d in above(i, most).items()}
    deep = {}
    for i in tree:
        path = list(above(i, 1000))
        if path[-1] in tree and tree[path[-1]] is None:
            deep[i] = len(path) - 1
    assert {r.id: r.depth for r in graph.depths(frame).collect()} == deep
