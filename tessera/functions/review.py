"""Edited review texts mapped back to the blocks that they were made of.

An editor sees a document's blocks as paragraphs; blocks may be taken out whole or lose their beginning and end. Each block
takes, in order, the longest run of whole paragraphs at the head of what is left of the edit that it holds word for word.
What no block takes is an error: nothing is dropped, moved or assigned to another block.
"""

from __future__ import annotations

import re
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "keep the paragraphs in their order and wording; take out whole paragraphs or trim their ends"
_LINE = re.compile("\r\n?")


def plain_lines(text: str) -> tuple[str, list[int]]:
    """text with every line end as a line feed, and where each of its characters, and its end, lies in text."""
    at, out, place = 0, [], [0]
    for m in _LINE.finditer(text):
        out += [text[at : m.start()], "\n"]
        place += [*range(at + 1, m.start() + 1), m.end()]
        at = m.end()
    return "".join([*out, text[at:]]), [*place, *range(at + 1, len(text) + 1)]


def rendered(reviewed: list[str | None]) -> str:
    """What the editor shows of blocks; None stands for one that is excluded."""
    return "".join(plain_lines(t)[0].strip() + "\n\n" for t in reviewed if t is not None)


def mapped(edited: str, originals: list[str]) -> list[tuple[int, int] | None]:
    """For each block the characters of its original that the edit keeps, or None; ValueError for text that no block holds."""
    text = plain_lines(edited)[0].strip()
    gaps = [m.start() for m in re.finditer(r"(?=\n\n)", text)] + [len(text)]  # where a block's part may end
    spans: list[tuple[int, int] | None] = [None] * len(originals)
    at = gap = 0
    for i, original in enumerate(originals):
        if at == len(text):
            break
        own, place = plain_lines(original)
        last = gap
        while last + 1 < len(gaps) and gaps[last + 1] - at <= len(own):
            last += 1
        for k in range(last, gap - 1, -1):
            part = text[at : gaps[k]].strip()
            if len(part) <= len(own) and part and (found := own.find(part)) >= 0:
                spans[i] = place[found], place[found + len(part)]
                at = gaps[k]
                while at < len(text) and text[at].isspace():
                    at += 1
                while gap < len(gaps) - 1 and gaps[gap] <= at:
                    gap += 1
                break
    if at < len(text):
        raise ValueError(UNMATCHED)
    return spans


def _frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["key", "number", "start", "end", "excerpt", "problem"]).astype({"number": "Int32", "start": "Int32", "end": "Int32"})


def reviewed(frames: Iterator[pd.DataFrame], most: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """The rows of review() for rows of key, edited, numbers and originals; those of many documents leave together, as a frame of
    its own costs more than a document. `most` bounds the characters that they are of, or they are one document's."""
    out, size = [], 0
    for frame in frames:
        for key, edited, numbers, originals in zip(frame["key"], frame["edited"], frame["numbers"], frame["originals"]):
            numbers, originals = ([] if x is None else list(x) for x in (numbers, originals))
            try:
                spans = mapped(edited, originals)
                out += [(key, n, *(s or (None, None)), o[s[0] : s[1]] if s else None, None) for n, o, s in zip(numbers, originals, spans)]
            except ValueError as e:
                out.append((key, None, None, None, None, str(e)))
            size += len(edited) + 100 * len(numbers)
            if size > most:
                if out:
                    yield _frame(out)
                out, size = [], 0
    if out:
        yield _frame(out)


def review(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, number, start, end, excerpt, problem) of documents with an edit: blocks (key, number, original), edits (key, edited).

    Rows of a sound edit have a span, or none where the block is left out; of another edit there is one row without a number,
    with the problem. A document's blocks are one row, so memory follows the longest document. Documents without
    blocks have a problem unless their edit is empty; null edits and originals count as empty.
    """
    own = blocks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("number", F.coalesce("original", F.lit("")).alias("original")))).alias("blocks"))
    rows = edits.select("key", F.coalesce("edited", F.lit("")).alias("edited")).join(own, "key", "left").select("key", "edited", F.col("blocks.number").alias("numbers"), F.col("blocks.original").alias("originals"))

    kind = dict(edits.dtypes)["key"]
    return rows.mapInPandas(reviewed, f"key {kind}, number int, start int, end int, excerpt string, problem string")
