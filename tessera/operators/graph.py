"""Trees and link graphs, level by level; each level is a table of its own, so no plan repeats the levels before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.store import saved


def levels(edges: DataFrame, roots: DataFrame, most_depth: int = 5) -> DataFrame:
    """(node, depth, parent, ordinal) of what is reached from roots (node) over edges (from, to, number).

    A node belongs to the first edge that reaches it, in the order of (parent's ordinal, number); ordinals give the
    order of discovery within a level. Each level is one join; only whether a level is empty comes to the driver.
    """
    level = saved(roots.select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit("").alias("ordinal")).distinct(), "levels")
    found = level
    for depth in range(1, most_depth + 1):
        reached = level.select(F.col("node").alias("from"), F.col("ordinal").alias("above")).join(edges, "from").where("`to` is not null")
        order = F.concat("above", F.lit("."), F.lpad(F.col("number").cast("string"), 8, "0"))
        first = reached.groupBy(F.col("to").alias("node")).agg(F.min(F.struct(order.alias("ordinal"), "from")).alias("f"))
        rows = first.join(found.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), F.col("f.from").alias("parent"), F.col("f.ordinal").alias("ordinal"))
        level = saved(rows, "levels")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def depths(tree: DataFrame) -> DataFrame:
    """(id, depth) of what lies below a root of tree (id, parent; a root has none), by pointer doubling: each step doubles how far
    up a node looks, so there are as many joins as the deepest level has binary digits. Cycles and what hangs below an
    unknown parent have no depth."""
    rows = saved(tree.select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("met")).withColumn("met", F.col("up").isNull()).withColumn("depth", F.when(F.col("met"), 0).otherwise(1)), "depths")
    while True:
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"), F.col("met").alias("done"))
        own = rows.where("not met").join(above, "up").select("id", F.col("higher").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("done").alias("met"))
        new = saved(rows.where("met").unionByName(own.select("id", "up", "depth", "met")), "depths")
        open_ = new.where("not met").count()
        if not open_ or open_ == rows.where("not met").count() and new.where("met").count() == rows.where("met").count():
            return new.where("met").select("id", "depth")
        rows = new


def ancestors(tree: DataFrame, start: DataFrame, most: int = 100) -> DataFrame:
    """(id, node, depth): each start's (id) own node and those above it, over tree (id, parent), at most `most` levels; a node
    that a path has met ends it, so cycles do no harm. There is no limit to the number of rows.

    By pointer doubling: after a step the paths known are twice as long, so there are as many joins as the longest path has
    binary digits; ids of tree are distinct.
    """
    up = saved(tree.where("parent is not null").select(F.col("id").alias("node"), F.col("parent").alias("above")), "ancestors")
    jump, length = up, 1  # from a node to the one `length` levels above it
    found = saved(start.select("id", F.col("id").alias("node"), F.lit(0).alias("depth")), "ancestors")
    while length <= most:
        far = found.join(jump, "node").select("id", F.col("above").alias("node"), (F.col("depth") + length).alias("depth")).where(F.col("depth") <= most)
        more = saved(found.unionByName(far).groupBy("id", "node").agg(F.min("depth").alias("depth")), "ancestors")  # a cycle leads back to what is known
        if more.count() == found.count():
            break
        found, length = more, 2 * length
        jump = saved(jump.select("node", F.col("above").alias("mid")).join(jump.select(F.col("node").alias("mid"), "above"), "mid").select("node", "above"), "ancestors")
    return found


def descendants(tree: DataFrame, start: DataFrame) -> DataFrame:
    """(id): start (id) and all below it over tree (id, parent), until a level brings nothing new."""
    level = saved(start.select("id").distinct(), "descendants")
    found = level
    while not level.isEmpty():
        below = tree.join(level.select(F.col("id").alias("parent")), "parent").select("id").distinct()
        level = saved(below.join(found, "id", "left_anti"), "descendants")
        found = found.unionByName(level)
    return found


def states(links: DataFrame, items: DataFrame) -> DataFrame:
    """links (from, target) with the item each resolves to, by requested or final URL, and its state; the last item with a URL counts."""
    urls = items.select(F.explode(F.array_distinct(F.array("requested_url", "final_url"))).alias("target"), "item_id", "ordinal", "state")
    last = urls.where("target is not null").groupBy("target").agg(F.max_by(F.struct("item_id", "state"), "ordinal").alias("i"))
    return links.join(last, "target", "left").select(*links.columns, F.col("i.item_id").alias("item_id"), F.coalesce("i.state", F.lit("unresolved")).alias("link_state"))


def before(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with a column more: the sum of value over the rows that come before in the order, whose values differ. Ranges of
    the order are summed on their own and then added up, so no task orders more than a range."""
    own = saved(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = own.groupBy("__part").agg(F.sum(value).alias("__sum"))  # a row for each range
    above = sums.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__above"))
    within = F.sum(value).over(Window.partitionBy("__part").orderBy(order)) - F.col(value)
    return own.withColumn("__within", within).join(F.broadcast(above), "__part").withColumn(name, F.col("__within") + F.col("__above")).drop("__part", "__within", "__above")


def crawl(items: DataFrame, links: DataFrame, root: str, most_depth: int = 0, most_documents: int = 0, most_bytes: int = 0, most_seconds: int = 0, most_links: int = 0) -> tuple[DataFrame, DataFrame]:
    """What a crawl from root fetches, breadth first: (url, depth, ordinal, final_url, anchors, state) of documents and links
    with a state, as a queue that takes one document after another would have it.

    items: (url, final_url, state: fetched or failed, anchors, and, if these are limited, bytes and seconds); links: (url,
    number, target, fragment, allowed). Before each document the limits on documents, bytes and seconds are looked at: the one
    that passes a limit is still fetched, those behind it are not. Of documents that redirect to one address the first
    counts, the others are duplicate_redirect and are not followed. Links beyond most_links are left out. A link is queued if it
    is allowed, new, not too deep, and fewer addresses than most_documents are known then: queued ones and final addresses of the
    documents up to then. Limits of 0 are none. Queued and repeated links are then resolved by what became of their targets.
    """
    level = saved(items.sparkSession.createDataFrame([(root, "")], "url string, ordinal string"), "crawl")
    seen, entries, told, depth = level.select("url"), [], [], 0
    fetched, spent, linked = 0, {"bytes": 0, "seconds": 0}, 0
    while not level.isEmpty():
        own = level.join(items, "url", "left").withColumn("state", F.coalesce("state", F.lit("failed")))
        if most_documents:
            own = own.orderBy("ordinal").limit(max(most_documents - fetched, 0))
        for name, most in (("bytes", most_bytes), ("seconds", most_seconds)):
            if most:
                own = before(own.withColumn(name, F.coalesce(name, F.lit(0))), "ordinal", name, f"__{name}").where(F.col(f"__{name}") + spent[name] < most)
        own = saved(own, "crawl")
        landed = own.where("state = 'fetched'").groupBy("final_url").agg(F.min("ordinal").alias("first"))
        for x in entries:
            landed = landed.join(x.where("state = 'fetched'").select("final_url"), "final_url", "left_anti")
        state = F.when((F.col("state") == "fetched") & ~F.col("ordinal").eqNullSafe(F.col("first")), "duplicate_redirect").otherwise(F.col("state"))
        sums = own.agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x, most in (("bytes", most_bytes), ("seconds", most_seconds)) if most)).first()
        cut = sums.n < level.count()  # a limit was met: this level is the last
        fetched, spent = fetched + sums.n, {k: v + ((sums[k] or 0) if k in sums else 0) for k, v in spent.items()}
        own = saved(own.join(landed, "final_url", "left").select("url", F.lit(depth).alias("depth"), "ordinal", "final_url", "anchors", state.alias("state")), "crawl")
        entries.append(own)
        good = own.where("state = 'fetched'")
        place = F.concat("ordinal", F.lit("."), F.lpad(F.col("number").cast("string"), 8, "0"))
        out = good.select("url", "ordinal").join(links, "url").select("url", "number", "target", "fragment", "allowed", place.alias("place"))
        if most_links:
            out = saved(out.orderBy("place").limit(max(most_links - linked, 0)), "crawl")
            linked += out.count()
        out = saved(out, "crawl")
        # addresses become known in order: a document's own before its links
        finals = good.select(F.col("final_url").alias("target"), F.concat("ordinal", F.lit(".")).alias("place"), F.lit(True).alias("final"))
        deep = 0 < most_depth <= depth
        asked = out.where("allowed").select("target", "place", F.lit(False).alias("final"))
        known = seen.select(F.col("url").alias("target"))
        new = saved((finals if deep else finals.unionByName(asked)).groupBy("target").agg(F.min(F.struct("place", "final")).alias("f")).select("target", "f.place", "f.final").join(known, "target", "left_anti"), "crawl")
        if most_documents:  # the first links beyond the limit, and all behind them, are not queued
            free = max(most_documents - seen.count(), 0)
            last = new.orderBy("place").limit(free).agg(F.max("place")).first()[0]
            within = new.where(F.col("place") <= last) if last is not None else new.limit(0)
        else:
            within = new
        queued = saved(within.where("not final").select("target", F.col("place").alias("queued")), "crawl")
        met = within.select("target", F.col("place").alias("met")).unionByName(finals.select("target", F.col("place").alias("met"))).groupBy("target").agg(F.min("met").alias("met"))
        there = known.distinct().withColumn("seen", F.lit(True))
        rows = out.join(there, "target", "left").join(met, "target", "left").join(queued, "target", "left")
        kind = (
            F.when(~F.col("allowed"), "excluded_scope").when(F.col("seen").isNotNull() | (F.col("met") < F.col("place")), "duplicate_or_cycle")
            .when(F.lit(deep), "excluded_depth").when(F.col("queued") == F.col("place"), "queued").otherwise("excluded_document_limit")
        )
        told.append(rows.select("url", "number", "target", "fragment", kind.alias("state")))
        seen = saved(seen.union(finals.select("target")).union(queued.select("target")).distinct(), "crawl")
        level, depth = saved(queued.select(F.col("target").alias("url"), F.col("queued").alias("ordinal")).where(F.lit(not cut)), "crawl"), depth + 1
    documents, every = entries[0], told[0]
    for x in entries[1:]:
        documents = documents.unionByName(x)
    for x in told[1:]:
        every = every.unionByName(x)
    return documents, resolve(saved(every, "crawl-links"), documents)


def resolve(links: DataFrame, documents: DataFrame) -> DataFrame:
    """links with their states settled by what became of their targets, found by requested or final address; of several
    documents with an address the last counts."""
    urls = documents.select(F.explode(F.array_distinct(F.array("url", "final_url"))).alias("target"), "ordinal", "depth", F.col("state").alias("became"), "anchors")
    last = urls.where("target is not null").groupBy("target").agg(F.max_by(F.struct("became", "anchors"), F.struct("depth", "ordinal")).alias("t"))
    open_ = F.col("state").isin("queued", "duplicate_or_cycle")
    missing = (F.col("fragment") != "") & ~F.coalesce(F.array_contains("t.anchors", F.col("fragment")), F.lit(False))
    settled = (
        F.when(F.col("t").isNull(), "unfetched").when(F.col("t.became") != "fetched", F.concat(F.lit("target_"), "t.became")).when(missing, "missing_anchor")
        .when((F.col("state") == "duplicate_or_cycle") & (F.col("fragment") == ""), F.col("state")).otherwise("resolved")
    )
    return links.join(last, "target", "left").select(*links.columns[:-1], F.when(open_, settled).otherwise(F.col("state")).alias("state"))
