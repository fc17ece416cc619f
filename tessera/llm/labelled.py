"""Training on a bounded sample of labelled rows: drawn by hash, featurised on executors, fitted in one task."""

from __future__ import annotations

import pickle
from typing import Any, Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, held_out, small_batches, text_or_empty


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold: int, rows: int, seed: int = 7) -> DataFrame:
    """(doc_id, y, text) of at most `rows` labelled documents outside the held-out fold, by the hash of their ids.

    Labels of null or other than 0 and 1 count as none; an id labelled twice takes its smallest label. The sampled ids,
    at most `rows` pairs, are the only thing broadcast.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(target).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.min(target).cast("int").alias("y"))
    chosen = first_by_hash(known, ["doc_id"], rows, seed)
    own = docs.select("doc_id", text_or_empty("text").alias("text"))
    return own.join(F.broadcast(chosen), "doc_id")


def fit_in_task(sample: DataFrame, features: Callable[[str], list[np.ndarray]], fit: Callable[[np.ndarray, list[list[np.ndarray]]], Any]) -> Any:
    """fit(labels, features of each row) in one task over the bounded sample; what it returns comes to the driver.

    features gives integer arrays of one text. Rows are put in order of their ids, so reruns agree.
    """

    def featurise(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "f": [pickle.dumps([np.asarray(x, np.int32) for x in features(t)]) for t in frame["text"]]})

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "f"])
        return pd.DataFrame({"model": [pickle.dumps(fit(frame["y"].to_numpy(), [pickle.loads(x) for x in frame["f"]]))]})

    rows = sample.mapInPandas(featurise, "doc_id long, y int, f binary")
    got = rows.groupBy(F.lit(1).alias("all")).applyInPandas(train, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit(np.empty(0, np.int64), [])
