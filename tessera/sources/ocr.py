"""Scans: lines of ALTO files, and measures of grey images."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alto_text(raw: bytes) -> str:
    """The text of an ALTO file: strings of a line joined by a space, a line each."""
    if b"<!ENTITY" in raw:
        raise ValueError("entity declarations are not read")
    lines = (e for e in ET.fromstring(raw).iter() if e.tag.rpartition("}")[2] == "TextLine")
    return "".join(" ".join(s.get("CONTENT", "") for s in line if s.tag.rpartition("}")[2] == "String") + "\n" for line in lines)


def grey_measures(raw: bytes, dark: int = 100, step: int = 25, most: int = 8 << 20) -> tuple[float, float]:
    """Share of dark pixels, and of pixels that differ from the one to the left or above by more than step, of a binary PGM;
    pixels of the first row and column count as no edges. The image must hold exactly the pixels that its head names."""
    fields, at = [], 0
    while len(fields) < 4:
        token = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)").match(raw, at)
        if not token:
            raise ValueError("not a PGM")
        fields.append(token[1])
        at = token.end()
    if fields[0] != b"P5" or fields[3] != b"255" or raw[at : at + 1] not in (b"\n", b" ", b"\r"):
        raise ValueError("not an 8-bit PGM")
    w, h = int(fields[1]), int(fields[2])
    if w < 1 or h < 1 or w * h > most or len(raw) - at - 1 != w * h:
        raise ValueError("the head names other pixels than there are")
    x = np.frombuffer(raw, np.uint8, w * h, at + 1).reshape(h, w).astype(np.int16)
    edge = (np.abs(np.diff(x, axis=1))[1:] > step) | (np.abs(np.diff(x, axis=0))[:, 1:] > step)
    return float((x < dark).mean()), float(edge.sum() / (w * h))


def scan_measures(scans: DataFrame) -> DataFrame:
    """(path, dark, edges) of binary images (path, content); both null for one that is no sound PGM."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"]):
                try:
                    rows.append((path, *grey_measures(bytes(raw))))
                except ValueError:
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["path", "dark", "edges"])

    return scans.select("path", "content").mapInPandas(task, "path string, dark double, edges double")


def scan_texts(files: DataFrame) -> DataFrame:
    """(path, text) of ALTO files (path, content); null for one that is not read."""

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        def of(raw):
            try:
                return alto_text(bytes(raw))
            except (ValueError, ET.ParseError):
                return None

        return column.map(of)

    return files.select("path", text("content").alias("text"))
