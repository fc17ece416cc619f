"""A maintained full-text index: generations of postings, tombstones, block maxima, and the best texts of questions.

An index is a folder. Each call that adds or removes documents writes a generation beside the others and then a manifest
that names the live ones; readers take the last complete manifest, so they see the index before or after a change, never
between. A document that is added again, or removed, leaves a tombstone that hides its postings of earlier generations;
compact() writes one generation without what is hidden.

Postings (lexeme, key, n, positions) lie by bucket of the lexeme and are sorted by lexeme and block, a run of `width` keys.
They are dealt to files by bucket and by a slice of the blocks, so a lexeme that most documents hold is no single task's;
on their way there they are gathered by lexeme, and only then become rows. The first posting of a block carries the maximum
of n there (`most`): best() scores the most promising blocks of a question first and then reads only the blocks whose maxima
can reach what it has found.
"""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import postings as P
from tessera.operators.store import new_folder, shared_folder

KINDS = ("plain", "simple", "english")
#: Blocks of a slice; blocks that a question scores first; rows of a question that are told to the driver.
SLICE, FIRST, FEW = 1 << 13, 16, 1000
#: The form of the stored tables; an index of another form is not read. Keys in order are stored as their steps.
FORM, STORED = 2, {"parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}


def lexed(docs: DataFrame, kind: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(lexeme, key, n, positions) of each text; see postings. Keys are integers; rows that share a key are rows of their own."""
    return P.lexed(docs.withColumn(key, F.col(key).cast("long")), kind, key, text)


class Index:
    """The index in a folder; see the module. Keys are integers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.version, self.state = self._last()
        if self.state and self.state.get("form") != FORM:
            raise ValueError(f"{folder} holds an index of another form: make it again")

    @classmethod
    def create(cls, spark: SparkSession, folder: str, docs: DataFrame, kind: str = "simple", buckets: int = 64, width: int = 128, key: str = "doc_id", text: str = "text") -> Index:
        """A new index of docs. An index that is already in the folder is an error."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        own = cls(spark, folder)
        if own.state:
            raise ValueError(f"{folder} holds an index")
        own.state = {"kind": kind, "buckets": buckets, "width": width, "next": 0, "live": [], "gone": [], "form": FORM}
        own.add(docs, key, text)
        return own

    @classmethod
    def of(cls, docs: DataFrame, kind: str, key: str = "doc_id", text: str = "text") -> Index:
        """The index of a table in files, in the shared folder: made once for a state of its files and then found again."""
        spark, files = docs.sparkSession, sorted(docs.inputFiles())
        if not files:
            return cls.create(spark, new_folder(spark, f"index-{kind}"), docs, kind, key=key, text=text)
        told = []
        for f in files:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            told.append(f"{f} {status.getLen()} {status.getModificationTime()}")
        folder = f"{shared_folder(spark)}/tessera/index-{kind}-{hashlib.sha256(' '.join([*told, key, text, str(FORM)]).encode()).hexdigest()[:32]}"
        own = cls(spark, folder)
        if own.state:
            return own
        try:
            return cls.create(spark, folder, docs, kind, key=key, text=text)
        except Exception:
            if not (own := cls(spark, folder)).state:  # another writer was first
                raise
            return own

    def _store(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> tuple[int, dict]:
        """The number and state of the last complete manifest; -1 and nothing where there is none."""
        path = self._path(f"{self.folder}/manifest")
        store = self._store(path)
        if not store.exists(path):
            return -1, {}
        numbers = sorted((int(s.getPath().getName()) for s in store.listStatus(path) if s.getPath().getName().isdigit()), reverse=True)
        for n in numbers:
            if store.exists(self._path(f"{self.folder}/manifest/{n:08d}/_SUCCESS")):
                return n, json.loads(self.spark.read.text(f"{self.folder}/manifest/{n:08d}").first()[0])
        return -1, {}

    def _commit(self, state: dict) -> None:
        """A further manifest. Two writers at once take the same number, and the second fails."""
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("error").text(f"{self.folder}/manifest/{self.version + 1:08d}")
        self.version, self.state = self.version + 1, state

    def _bucket(self, lexeme: Column) -> Column:
        return F.pmod(F.xxhash64(lexeme), F.lit(self.state["buckets"])).cast("int")

    def _write(self, rows: DataFrame, generation: int) -> None:
        """The postings (lexeme, key, n, positions) of a generation; rows that share lexeme and key add up."""
        block = F.floor(F.col("key") / self.state["width"])
        own = rows.withColumns({"block": block, "bucket": self._bucket(F.col("lexeme")), "slice": F.floor(block / SLICE)}).repartition("bucket", "slice")
        own = own.groupBy("bucket", "slice", "lexeme", "block", "key").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("positions")).alias("positions"))  # where they lie
        top = Window.partitionBy("bucket", "slice", "lexeme", "block").orderBy("key")
        every = top.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        own = own.withColumn("most", F.when(F.row_number().over(top) == 1, F.max("n").over(every)))
        self._store_rows(own.drop("slice").sortWithinPartitions("bucket", "lexeme", "block", "key"), generation)

    def _write_parts(self, parts: DataFrame, generation: int) -> None:
        """The postings of a generation from postings.PARTS, whose keys are of one row each."""
        bucket, width = self._bucket(F.col("lexeme")), self.state["width"]
        own = parts.repartition(bucket, F.floor(F.col("first") / (width * SLICE))).withColumn("bucket", bucket)  # a shuffled row holds no more than it must
        self._store_rows(P.from_parts(own.sortWithinPartitions("bucket", "lexeme", "first"), width), generation)

    def _store_rows(self, rows: DataFrame, generation: int) -> None:
        """Write postings that are in order. They arrive bucket by bucket: with a file open for each, Spark need not sort them again."""
        name = "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(self.state["buckets"]))
        try:
            rows.write.partitionBy("bucket").options(**STORED).parquet(f"{self.folder}/postings/gen={generation}")
        finally:
            self.spark.conf.set(name, before)

    def _read(self, name: str, generations: list[int]) -> DataFrame | None:
        kinds = {"postings": "lexeme string, key long, n long, positions array<int>, most long, block long, gen long, bucket int", "gone": "key long, gen long"}
        if name == "maxima":  # of the lexemes in a block
            rows = self._read("postings", generations)
            return rows and rows.where("most is not null").groupBy("bucket", "lexeme", "block").agg(F.max("most").alias("most"))
        paths = [f"{self.folder}/{name}/gen={g}" for g in generations]
        try:
            return self.spark.read.schema(kinds[name]).option("basePath", f"{self.folder}/{name}").parquet(*paths) if paths else None
        except AnalysisException:  # a generation without postings
            return None

    def _number(self) -> int:
        """The number of a new generation: greater than those before, and no other writer's, nor one that a lost writer left."""
        return self.state["next"] << 24 | random.getrandbits(24)

    def _next(self, **changes) -> dict:
        return self.state | {"next": self.state["next"] + 1} | changes

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Add documents; those that the index holds already are replaced, by nothing where they have no words now."""
        g, live = self._number(), self.state["live"]
        shared = not docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long")).count().where("count > 1").isEmpty()
        if shared:
            self._write(lexed(docs, self.state["kind"], key, text), g)
        else:
            self._write_parts(P.parts(docs, self.state["kind"], self.state["width"] * SLICE, key, text), g)
        if live:
            docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key")).distinct().write.parquet(f"{self.folder}/gone/gen={g}")
        self._commit(self._next(live=[*live, g], gone=[*self.state["gone"], g] if live else []))

    def remove(self, keys: DataFrame, key: str = "doc_id") -> None:
        """Remove documents by key; keys that the index does not hold change nothing."""
        g = self._number()
        keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key")).distinct().write.parquet(f"{self.folder}/gone/gen={g}")
        self._commit(self._next(gone=[*self.state["gone"], g]))

    def compact(self) -> None:
        """One generation without what is hidden; the old ones stay until vacuum()."""
        g, own = self._number(), self.postings()
        self._write(own.select("lexeme", "key", "n", "positions"), g)
        self._commit(self._next(live=[g], gone=[]))

    def vacuum(self) -> None:
        """Delete generations that the last manifest does not name. Readers of an earlier one must have ended."""
        for name, kept in (("postings", "live"), ("gone", "gone")):
            path = self._path(f"{self.folder}/{name}")
            store = self._store(path)
            for s in store.listStatus(path) if store.exists(path) else []:
                if int(s.getPath().getName().removeprefix("gen=")) not in self.state[kept]:
                    store.delete(s.getPath(), True)

    def _choice(self, lexemes: DataFrame | None, few: int = FEW):
        """A function that leaves of stored rows those of the lexemes: by bucket, and by up to `few` lexemes themselves, so
        what lies elsewhere is not read; more are joined."""
        if lexemes is None:
            return lambda rows: rows
        own = lexemes.select("lexeme", self._bucket(F.col("lexeme")).alias("b")).distinct()
        told = own.limit(few + 1).collect()
        if len(told) <= few:
            buckets, words = sorted({r.b for r in told}), sorted(r.lexeme for r in told)
            return lambda rows: rows.where(F.col("bucket").isin(buckets) & F.col("lexeme").isin(words))
        buckets = [r.b for r in own.select("b").distinct().collect()]  # no more than there are buckets
        return lambda rows: rows.where(F.col("bucket").isin(buckets)).join(own.select("lexeme"), "lexeme", "left_semi")

    def postings(self, lexemes: DataFrame | None = None) -> DataFrame:
        """(lexeme, key, n, positions, block, gen) of the documents that are there, of all or some lexemes."""
        return self._postings(self._choice(lexemes))

    def _postings(self, choice) -> DataFrame:
        rows = self._read("postings", self.state["live"])
        if rows is None:
            return self.spark.createDataFrame([], "lexeme string, key long, n long, positions array<int>, block long, gen long")
        rows = choice(rows).drop("bucket", "most")
        gone = self._read("gone", self.state["gone"])
        if gone is None:
            return rows
        last = gone.groupBy("key").agg(F.max("gen").alias("last"))
        return rows.join(last, "key", "left").where(F.col("last").isNull() | (F.col("gen") >= F.col("last"))).drop("last").select(rows.columns)

    def best(self, asked: DataFrame, most: int = 40, allowed: DataFrame | None = None, first: int = FIRST) -> DataFrame:
        """(question, key, hits, rank): of each question the `most` documents with the most occurrences of its lexemes, ties by
        key. asked: distinct (question, lexeme); allowed: the keys that may be returned, all by default.

        A first pass scores the `first` blocks of a question with the greatest sums of maxima; blocks whose sum is less than
        the score of its last document then are not read again. The rows are those of scoring every block.
        """
        maxima = self._read("maxima", self.state["live"])
        if maxima is None:
            return self.spark.createDataFrame([], asked.select("question").schema.add("key", "long").add("hits", "long").add("rank", "long"))
        told = asked.select("question", "lexeme").limit(FEW + 1).collect()
        if len(told) <= FEW:  # they are used several times: what they are made of is read once
            asked = self.spark.createDataFrame(told, asked.select("question", "lexeme").schema)
        choice = self._choice(asked)
        bounds = choice(maxima).join(asked, "lexeme").groupBy("question", "block").agg(F.sum("most").alias("bound"))
        own = self._postings(choice)
        if allowed is not None:
            own = own.join(allowed.select(F.col(allowed.columns[0]).cast("long").alias("key")).distinct(), "key", "left_semi")

        def scored(blocks: DataFrame) -> DataFrame:
            met = own.join(asked, "lexeme").join(blocks.select("question", "block"), ["question", "block"], "left_semi")
            return met.groupBy("question", "key").agg(F.sum("n").alias("hits"))

        def top(rows: DataFrame) -> DataFrame:
            place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("hits"), "key")).cast("long")
            return rows.withColumn("rank", place).where(F.col("rank") <= most)

        at = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("bound"), "block"))
        early = bounds.withColumn("at", at).where(F.col("at") <= first)
        least = top(scored(early)).where(F.col("rank") == most).select("question", F.col("hits").alias("least"))
        left = bounds.join(least, "question", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0)))
        return top(scored(left))
