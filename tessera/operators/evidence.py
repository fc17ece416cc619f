"""The retrieval gate over all that decides whether a passage may be shown: its source's status, rights, supersession and
collection, its publication's active index, its vector, its page's kind, and what a question selects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Library:
    """The tables of the gate. Every check is a join on keys; only `sources` carries columns on.

    passages: id, source; locations: id, page_kind, scan; sources: source, source_key, author, title, status, rights,
    superseded; publications: publication, source; runs: run, publication, config, status; active: publication, run; vectors:
    id, config; categories: id, categories; items: source, snapshot; snapshots: snapshot, collection; live: collection, snapshot.
    """

    passages: DataFrame
    locations: DataFrame
    sources: DataFrame
    publications: DataFrame
    runs: DataFrame
    active: DataFrame
    vectors: DataFrame
    categories: DataFrame
    items: DataFrame
    snapshots: DataFrame
    live: DataFrame


def open_sources(lib: Library) -> DataFrame:
    """Sources that are published, allowed, not superseded, and in no collection whose live snapshot is another than theirs."""
    own = lib.sources.where("status = 'published' and rights = 'allowed' and superseded is null")
    live = lib.live.select("collection", F.col("snapshot").alias("now"))
    other = lib.items.join(lib.snapshots, "snapshot").join(live, "collection").where("now <> snapshot").select("source")
    return own.join(other, "source", "left_anti").select("source", "source_key", "author", "title")


def in_scope(scope: str):
    """Whether a source belongs to an author's or title's scope; every source does for an empty one."""
    low = F.lit(scope.lower())
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), low)
    return F.lit(True) if not scope else F.startswith("source_key", F.lit(scope + "-")) | has("author") | has("title")


def eligible(lib: Library, config: int, scope: str = "", selected: list[str] | None = None, asked: list[str] | None = None) -> DataFrame:
    """(id, source, author, title, scan) of the passages that a question may be answered with.

    A passage needs a text page, an open source within the scope and the selection, a publication whose active run over
    the configuration is ready, a vector of that configuration, and one of the categories asked for, if any are. What a
    table lacks is not allowed; a passage with several text pages has a row for each; tightening never adds rows.
    """
    sources = open_sources(lib).where(in_scope(scope))
    if selected:
        sources = sources.where(F.col("source").isin(selected))
    ready = lib.runs.where((F.col("config") == config) & (F.col("status") == "ready")).select("run", "publication")
    indexed = lib.publications.join(ready, "publication").join(lib.active.select("publication", "run"), ["publication", "run"], "left_semi").select("source").distinct()
    sources = sources.join(indexed, "source", "left_semi")
    rows = lib.passages.select("id", "source").join(sources, "source").join(lib.locations.where("page_kind = 'text'").select("id", "scan"), "id")
    rows = rows.join(lib.vectors.where(F.col("config") == config).select("id"), "id", "left_semi")
    categories = lib.categories.where(F.arrays_overlap("categories", F.array(*map(F.lit, asked)))) if asked else lib.categories
    return rows.join(categories.select("id"), "id", "left_semi").select("id", "source", "author", "title", "scan")
