"""Rules over recognised words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def low_confidence(words: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """(key, low): pages whose words (key, confidence) are too uncertain, from counts in one aggregate; count names a column for their number."""
    c, n = F.col("confidence"), F.count("confidence")
    weak, poor = F.count_if(c < 60), F.count_if(c < 35)
    low: Column = (n == 0) | ((n >= 8) & (((weak >= 5) & (weak > 0.15 * n)) | ((poor >= 3) & (poor > 0.05 * n))))
    return words.groupBy(key).agg(low.alias("low"), *([n.alias(count)] if count else []))
