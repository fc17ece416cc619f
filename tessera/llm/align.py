"""Alignment of two tokenizers over the bytes of the same texts, by DuckDB within each Arrow partition.

Both tokenizers cut every text before a single space, and before a single line feed, between two characters that are no
white space, so the distinct units between such places are encoded once as long as a worker remembers them, and their
tokens laid out on one axis of bytes as two interval tables. In DuckDB an ASOF join finds, for each token of the first tokenizer, the token of the second in which
it begins; a range join finds those of the second that begin inside it; together they are the pairs that overlap. Sums
over windows number the groups between offsets where both end. Each batch also yields how many of its texts hold each
pair; Spark adds these partial counts up, and a second pass weighs every text's links with them. The counts are
broadcast in blocks of bounded size, one pass a block.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import save, small_batches

BYTES, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Where both tokenizers cut: the first splits there before it merges, and no piece of the second holds a space behind
#: another character, or a line feed.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
SHIFT = 1 << 24
#: Characters of texts that are aligned together, and of units that DuckDB takes together; units that a worker remembers,
#: some 250 bytes each.
BATCH, UNITS, KEPT = 4 << 20, 1 << 17, 400_000

_LINKS = """
WITH link AS (
    SELECT a.unit, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.s >= b.s
    UNION ALL SELECT a.unit, a.id, b.id FROM a JOIN b ON b.s > a.s AND b.s < a.e)
SELECT unit, a * {shift} + b AS pair, count(*) AS times FROM link GROUP BY ALL ORDER BY unit, pair"""
_GROUPS = """
WITH ends AS (SELECT a.e FROM a SEMI JOIN b ON a.e = b.e)
SELECT {side}.n, count(x.e) OVER (ORDER BY {side}.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM {side} LEFT JOIN ends x ON x.e = {side}.e ORDER BY {side}.n"""


class Aligner:
    """The two tokenizers and a DuckDB connection of one worker."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        byte_of = _byte_level()
        size = self.a.get_vocab_size()
        self.a_bytes = [b"".join(byte_of.get(c, c.encode()) for c in self.a.id_to_token(i) or "") for i in range(size)]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in names):
            raise ValueError("a piece of the model holds a space behind another character, or a line feed; texts cannot be cut there")
        self.db = duckdb.connect(config={"threads": 1})
        self.clear()
        self.names = np.array([f"{i}{end}" for i in range(max(size, len(names))) for end in ("", ";", "|", ",")], object)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))

    def clear(self) -> None:
        """Forget the units; texts name theirs by number."""
        self.place: dict[str, int] = {}
        self.sound: list[bool] = []
        self.told: list[str] = []
        self.counts, self.pairs, self.times, self.first = np.zeros((3, 0), np.int64), *(np.zeros(n, np.int64) for n in (0, 0, 1))

    def units(self, texts: list[str]) -> tuple[list[bool], list[list[int]]]:
        """For each text, none of them empty, whether both tokenizers give its bytes back, and its units by number. Units that
        were not met before are aligned: of each its groups as text (told), its tokens of a, of b and its groups (counts),
        and its links, as pairs, how often each (times), and where those of a unit begin (first)."""
        if len(self.place) > KEPT:
            self.clear()
        old, place = len(self.place), self.place
        of = [[place.setdefault(u, len(place)) for u in CUT.split(" " + t)] for t in texts]
        found: list[list[np.ndarray]] = [[self.counts], [self.pairs], [self.times], [self.first]]
        for some in _slices(list(islice(place, old, None)), UNITS):
            ok, told, counts, pairs, times, sizes = self._align(some)
            self.sound += ok
            self.told += told
            for x, new in zip(found, (counts, pairs, times, found[3][-1][-1] + np.cumsum(sizes))):
                x.append(new)
        self.counts, self.pairs, self.times, self.first = (np.concatenate(x, axis=-1) for x in found)
        return [all(map(self.sound.__getitem__, u)) for u in of], of

    def _align(self, units: list[str]):
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        # the second adds a space: that of the unit, or before a line feed a token of its own
        b = [x if u[0] == " " else x[1:] for u, x in zip(units, self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1))]
        get_a, get_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        sound = [b"".join(map(get_a, x)) == u.encode() == b"".join(map(get_b, y)) for u, x, y in zip(units, a, b)]
        some = [i for i, s in enumerate(sound) if s]
        a_table, b_table = self._table(some, a, self.a_size), self._table(some, b, self.b_size)
        self.db.register("a_frame", a_table)
        self.db.register("b_frame", b_table)
        self.db.execute("CREATE OR REPLACE TEMP TABLE a AS SELECT * FROM a_frame; CREATE OR REPLACE TEMP TABLE b AS SELECT * FROM b_frame")
        links = self.db.execute(_LINKS.format(shift=SHIFT)).fetchnumpy()
        of_a, of_b = (np.asarray(self.db.execute(_GROUPS.format(side=x)).fetchnumpy()["g"], np.int64) for x in "ab")
        told, counts = self._told(a_table, of_a, b_table, of_b, len(units))
        own = np.bincount(np.asarray(links["unit"], np.int64), minlength=len(units))
        return sound, told, counts, np.asarray(links["pair"], np.int64), np.asarray(links["times"], np.int64), own

    def _told(self, a: pd.DataFrame, of_a: np.ndarray, b: pd.DataFrame, of_b: np.ndarray, units: int) -> tuple[list[str], np.ndarray]:
        """Of each unit its groups as text (a1,a2|b1;a3|b2), and (tokens of a, of b, groups), from the tokens' groups."""
        side = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        order = np.argsort(np.concatenate([of_a, of_b]) * 2 + side, kind="stable")
        group, side = np.concatenate([of_a, of_b])[order], side[order]
        unit, ids = np.concatenate([a["unit"], b["unit"]])[order], np.concatenate([a["id"], b["id"]])[order]
        new_unit, new_group, new_side = (np.append(np.diff(x) != 0, True) for x in (unit, group, side))
        kind = np.where(new_unit, 0, np.where(new_group, 1, np.where(new_side, 2, 3)))
        parts = self.names[ids * 4 + kind].tolist()
        at = np.searchsorted(unit, np.arange(units + 1)).tolist()
        told = ["".join(parts[x:y]) for x, y in zip(at, at[1:])]
        return told, np.array([np.bincount(x, minlength=units) for x in (a["unit"], b["unit"], unit[new_group])])

    @staticmethod
    def _table(some: list[int], ids: list[list[int]], size: np.ndarray) -> pd.DataFrame:
        """The interval table of one tokenizer: n in order, unit, id, s and e; units follow each other on one axis."""
        unit = np.repeat(np.array(some, np.int64), [len(ids[i]) for i in some])
        every = np.fromiter(chain.from_iterable(ids[i] for i in some), np.int64, len(unit))
        end = np.cumsum(size[every])
        return pd.DataFrame({"n": np.arange(len(every)), "unit": unit, "id": every, "s": end - size[every], "e": end})

    def rows(self, texts: list[str | None]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        """The columns of each text, and the pairs of all texts with the number of texts that hold them linked."""
        some = [i for i, t in enumerate(texts) if t]
        good, of = self.units([texts[i] for i in some])
        some, of = [i for i, ok in zip(some, good) if ok], [u for u, ok in zip(of, good) if ok]
        size = np.array(list(map(len, of)), np.int64)
        unit = np.fromiter(chain.from_iterable(of), np.int64, size.sum())
        # the distinct units of a text, how often each, and their links
        number, often = np.unique(np.repeat(np.array(some, np.int64), size) << 40 | unit, return_counts=True)
        text, number = number >> 40, number & (1 << 40) - 1
        links = self.first[number + 1] - self.first[number]
        every = np.repeat(self.first[number] - np.cumsum(links) + links, links) + np.arange(links.sum())
        own, back = np.unique(np.repeat(text, links) << 40 | self.pairs[every], return_inverse=True)  # a pair is less than 2**40
        times = np.bincount(back, np.repeat(often, links) * self.times[every], len(own)).astype(np.int32)
        pairs, ends = own & (1 << 40) - 1, np.searchsorted(own >> 40, np.arange(len(texts) + 1)).astype(np.int32)
        columns = np.zeros((4, len(texts)), np.int64)
        if some:
            columns[:3, some] = np.add.reduceat(self.counts[:, unit], np.cumsum(size) - size, axis=1)
            columns[3] = np.diff(np.concatenate([[0], np.cumsum(times, dtype=np.int64)])[ends])
        digest = [""] * len(texts)
        for i, u in zip(some, of):
            digest[i] = hashlib.sha256(";".join(map(self.told.__getitem__, u)).encode()).hexdigest()
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pairs, times)]
        whole, docs = np.unique(pairs, return_counts=True)
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(digest), *lists], ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]), whole, docs.astype(np.int64)


@lru_cache(1)
def aligner(first: str, second: str) -> Aligner:
    """A worker's own, also for its later tasks."""
    return Aligner(first, second)


def _slices(texts: list[str], most: int) -> Iterator[list[str]]:
    """texts in slices of at most `most` characters, or one text."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield texts[first:]


def _byte_level() -> dict[str, bytes]:
    """The characters that byte-level vocabularies write bytes with: printable ones of Latin-1 stand for themselves, the
    other bytes follow each other from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): bytes([b]) for b in plain} | {chr(256 + i): bytes([b]) for i, b in enumerate(other)}


_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>, docs array<long>"


def aligned(docs: DataFrame, first: str = BYTES, second: str = PIECES) -> tuple[DataFrame, DataFrame]:
    """The saved tables of a first pass: one row per row of docs with doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and
    its distinct linked pairs (first id * 2**24 + second id) with their times; and (pair, docs): how many rows hold it.

    A null or empty text, and one that a tokenizer does not give back byte for byte, has no tokens: zeros and empty lists.
    Repeated rows count each; rows without an id are as others; no rows give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = to_arrow_schema(T._parse_datatype_string(_SCHEMA))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(first, second)
        gc.disable()  # the lists of tokens hold no cycles; what else does is collected with each batch

        def rows(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
            found, pairs, docs = own.rows(texts)
            gc.collect()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *found.columns, pa.nulls(len(ids), pa.list_(pa.int64()))], kind.names)
            whole = {"pairs": [pairs], "docs": [docs]}  # a row more, of the batch itself
            yield pa.RecordBatch.from_arrays([pa.array(whole.get(f.name, [None]), f.type) for f in kind], kind.names)

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "") + 50
                if size > BATCH:
                    yield from rows(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from rows(ids, texts)

    both = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, _SCHEMA), "align-texts")
    part = both.where("docs is not null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("x.pairs", "x.docs")
    return both.where("docs is null").drop("docs"), save(part.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("docs")), "align-pairs")


def report(docs: DataFrame, first: str = BYTES, second: str = PIECES, block: int = 1 << 22) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as many rows of docs
    as any pair of its first id), count_sum (that number, over all links), groups_sha256. See aligned() for edges.

    Pair counts are broadcast in blocks of about `block` pairs, 16 bytes each.
    """
    spark = docs.sparkSession
    rows, pairs = aligned(docs, first, second)
    own = Window.partitionBy(F.floor(F.col("pair") / SHIFT))  # as many rows as the second vocabulary has, at most
    pairs = pairs.withColumn("best", F.col("docs") == F.max("docs").over(own))
    blocks = max(1, -(-pairs.count() // block))
    rows = rows.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    for k in range(blocks):
        some = pairs.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k).toPandas().sort_values("pair")
        shared = spark.sparkContext.broadcast(tuple(some[c].to_numpy() for c in ("pair", "docs", "best")))

        def weigh(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, docs_of, best = shared.value
            for batch in batches:
                lists, times = batch["pairs"], batch["times"]
                p, n, ends = lists.flatten().to_numpy(), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                at = np.minimum(np.searchsorted(known, p), max(len(known) - 1, 0))
                n = np.where(known[at] == p, n, 0) if len(known) else n[:0]
                for name, own in (("n_best", n * best[at]), ("count_sum", n * docs_of[at])):
                    sums = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], ends])] if len(own) else np.zeros(len(lists) + 1, np.int64)
                    k = batch.schema.get_field_index(name)
                    batch = batch.set_column(k, batch.schema.field(k), pa.array(batch[name].to_numpy() + np.diff(sums)))
                yield batch

        rows = rows.mapInArrow(weigh, rows.schema)
        if k < blocks - 1:
            rows = save(rows, "align-weighed")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def links(docs: DataFrame, first: str = BYTES, second: str = PIECES) -> DataFrame:
    """The alignment of the vocabularies: one row per linked pair of ids, a and b, with docs, the rows of docs that hold it
    linked, and share, its part of all of those of a. See aligned() for edges."""
    _, pairs = aligned(docs, first, second)
    a = F.floor(F.col("pair") / SHIFT)
    own = pairs.select(a.alias("a"), (F.col("pair") - a * SHIFT).alias("b"), "docs")
    return own.withColumn("share", F.col("docs") / F.sum("docs").over(Window.partitionBy("a")))
