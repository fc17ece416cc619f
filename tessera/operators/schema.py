"""Versioned tables: named steps that bring a stored table from one shape to the next, each once, with a ledger.

A table's folder holds its data by version and a ledger of manifests; the last complete manifest names the steps applied
and the data that came of them. A run applies the steps that the ledger lacks, in order, and writes one manifest at its end,
so a reader finds the table before all of them or after, and a run that is lost leaves only files that nothing names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

Step = tuple[str, Callable[[DataFrame], DataFrame]]


class Versioned:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _last(self) -> tuple[int, dict]:
        store, path = self._path("ledger")
        numbers = sorted((int(s.getPath().getName()) for s in store.listStatus(path) if s.getPath().getName().isdigit()), reverse=True) if store.exists(path) else []
        for n in numbers:
            if store.exists(self._path(f"ledger/{n:06d}/_SUCCESS")[1]):
                return n, json.loads(self.spark.read.text(f"{self.folder}/ledger/{n:06d}").first()[0])
        return -1, {"steps": [], "data": None}

    def applied(self) -> list[tuple[str, str]]:
        """The steps that the table has been through, with their times."""
        return [tuple(s) for s in self._last()[1]["steps"]]

    def read(self) -> DataFrame:
        data = self._last()[1]["data"]
        if data is None:
            raise ValueError(f"{self.folder} holds no table")
        return self.spark.read.parquet(f"{self.folder}/{data}")

    def _commit(self, number: int, state: dict) -> None:
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("error").text(f"{self.folder}/ledger/{number:06d}")

    def create(self, rows: DataFrame, name: str = "create") -> None:
        number, state = self._last()
        if state["data"]:
            raise ValueError(f"{self.folder} holds a table")
        self._write(rows, number + 1, [[name, _now()]])

    def _write(self, rows: DataFrame, number: int, steps: list) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/data-{number:06d}")  # left by a run that was lost, if by any
        self._commit(number, {"steps": steps, "data": f"data-{number:06d}"})

    def upgrade(self, steps: Sequence[Step], check: Callable[[DataFrame], DataFrame] | None = None) -> list[str]:
        """Apply the steps that the ledger lacks and return their names. The ledger must begin as steps do, first the name that
        created the table: another order, or a step that is not known, is an error, and nothing is written. check returns
        rows that the new table must not have; if there are any, the table stays as it was.
        """
        names = [n for n, _ in steps]
        if len(set(names)) < len(names):
            raise ValueError("a step's name is given twice")
        number, state = self._last()
        done = [n for n, _ in state["steps"]][1:]
        if done != names[: len(done)]:
            raise ValueError(f"the table has been through {done}, which is not how {names} begins")
        rest = list(steps)[len(done) :]
        if not rest:
            return []
        rows = self.read()
        for _, step in rest:
            rows = step(rows)
        if check is not None and not check(rows).isEmpty():
            raise ValueError("the upgraded table does not pass its check")
        self._write(rows, number + 1, [*state["steps"], *([n, _now()] for n, _ in rest)])
        return [n for n, _ in rest]


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")
