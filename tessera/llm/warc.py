"""WARC archives and their index.

Pages are written as gzipped WARC records, task by task; each task leaves its archives and one capture run, a CDX file
sorted by URL key and timestamp. The runs are then merged externally: the key space is cut at splitters, a run's part
of a range is a byte slice of its file, and one task per range merges the slices of all runs with a loser tree. The
merged capture history is globally ordered and tells where each record lies; records are read back by it.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import first_by_hash, fresh_path, maybe_in, partitions, save
from .simhash import whole_groups

LEAST, ROLL, CHUNK = 1000, 64 << 20, 1 << 16
#: Runs that a task merges at once.
WIDTH = 256
#: The first capture time, that of page 0 and of pages without an id; a page's id adds as many seconds, going round after some 63 years.
FIRST, SECONDS, ROUND = "20000101000000", 946684800, 2_000_000_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def url_key(url: Column) -> Column:
    """A sortable key: host labels in reverse, then the rest of the URL, in lower case and without white space."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")
    host = F.array_join(F.reverse(F.split(F.regexp_extract(clean, HOST, 1), r"\.")), ",")
    return F.lower(F.concat(host, F.lit(")"), F.regexp_replace(clean, HOST, "")))


def qualified(spark: SparkSession, folder: str) -> str:
    """folder with the scheme and host that Spark itself gives it, under a name that pyarrow knows; another store is refused
    here, on the driver, before anything is written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, _, rest = whole.partition(":")
    name = {"s3a": "s3", "s3n": "s3", "gs": "gs", "s3": "s3", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file", "abfss": "abfss", "abfs": "abfs"}.get(scheme)
    if name is None:
        raise ValueError(f"archives cannot be written to {scheme}: set spark.checkpoint.dir to a folder of another store")
    return f"{name}:{rest}"


def _files(path: str):
    """pyarrow's file system of a qualified folder, and the path within it."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(path)


def _date(ts: str) -> str:
    return f"{ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:]}Z"


def info(name: str) -> bytes:
    """The record that an archive begins with."""
    body = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {_date(FIRST)}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record(page_id, url: str, date: str, payload: bytes, refers_to=None, refers_url: str = "", refers_date: str = "") -> bytes:
    """One WARC record; a revisit keeps the HTTP head, with the payload's length, but not the payload, and names the
    response's id, URL and date."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_date(date)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        lines += [f"WARC-Refers-To-Target-URI: {refers_url}", f"WARC-Refers-To-Date: {_date(refers_date)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record says; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what was written")
    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To"))}


def _packed(raw: bytes, level: int) -> bytes:
    """One gzip member."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _order(page: int | None) -> tuple[int, int]:
    """Where an id stands among captures of one key and time: none first."""
    return (0, 0) if page is None else (1, page)


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, so each step replays one path from leaf to root."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _after(self, a: int, b: int) -> bool:
        """Whether run a's head comes after run b's."""
        x, y = self.heads[a], self.heads[b]
        return x is None or (y is not None and (x, a) > (y, b))

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = winner
                return
            if self._after(winner, other):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def _slice(path: str, start: int, length: int) -> Iterator[tuple]:
    """Captures of a byte slice of a run, read in chunks."""
    filesystem, own = _files(path)
    rest = b""
    with filesystem.open_input_file(own) as f:
        while length:
            got = f.read_at(min(CHUNK, length), start)
            start, length = start + len(got), length - len(got)
            lines = (rest + got).split(b"\n")
            rest = lines.pop()
            for line in lines:
                key, when, page, archive, offset, size = line.split(b" ")
                yield key, when, _order(None if page == b"-" else int(page)), archive, int(offset), int(size)


def _line(key: bytes, when: bytes, page: int | None, archive: bytes, offset: int, size: int) -> bytes:
    """A capture as a line of a run."""
    return b" ".join([key, when, b"-" if page is None else b"%d" % page, archive, b"%d" % offset, b"%d" % size]) + b"\n"


def capture_time(page_id: Column) -> Column:
    """yyyyMMddHHmmss, from the page's id: the table has no time of capture."""
    return F.date_format(F.timestamp_seconds(F.lit(SECONDS) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(ROUND))), "yyyyMMddHHmmss")


def clean_url(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, refers_to, refers_url): of equal payloads of at least `least` bytes, that of the largest page_id
    is the response and the rest refer to it and its URL. Payloads are compared by SHA-256 and length; copies are counted
    before they meet, and only rows whose digest may have a copy are shuffled with their payloads."""
    own = pages.select("page_id", clean_url(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    size = F.octet_length("html")
    keys = own.where(size >= least).select("page_id", "url", F.sha2("html", 256).alias("sha"))
    groups = keys.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("keep"), F.count("*").alias("n")).where("n > 1 and keep.page_id is not null")
    groups = save(groups.select("sha", F.col("keep.page_id").alias("keep"), F.col("keep.url").alias("refers_url")), "warc-groups")
    back = keys.join(groups, "sha").where(~F.col("page_id").eqNullSafe(F.col("keep")))
    back = save(back.select(F.col("page_id").alias("__page"), F.col("sha").alias("__sha"), F.col("keep").alias("refers_to"), "refers_url").distinct(), "warc-revisits")
    own = maybe_in(own.withColumn("__own", F.when(size >= least, F.sha2("html", 256))), back.select(F.col("__sha").alias("__own")), "__own", "__may")
    met = own.where("__may").join(back, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("__own") == F.col("__sha")), "left").select("page_id", "url", "html", "refers_to", "refers_url")
    none = F.lit(None)
    rest = own.where("not __may").select("page_id", "url", "html", none.cast(back.schema["refers_to"].dataType).alias("refers_to"), none.cast("string").alias("refers_url"))
    return met.unionByName(rest)


def write(pages: DataFrame, folder: str, ranges: int, level: int = 5) -> DataFrame:
    """Write archives and capture runs below folder; (range, run, start, length): the slices of the runs, by key range.

    A run is sorted by key, time and id (none first), which is the order of the merged history.
    """
    place = [url_key(F.col("url")).alias("key"), capture_time(F.col("page_id")).alias("ts")]
    own = with_revisits(pages).select("*", *place, capture_time(F.col("refers_to")).alias("refers_ts"))
    drawn = first_by_hash(pages.select("page_id", *place), ["page_id", "key", "ts"], 4096, 1).collect()
    # a bounded draw: it sets the ranges' sizes, not their content
    drawn = sorted((r["key"].encode(), r["ts"].encode(), _order(r["page_id"])) for r in drawn)
    cuts = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = _files(folder)
        filesystem.create_dir(base, recursive=True)
        name, number, out, at = uuid.uuid4().hex, 0, None, 0  # another attempt writes other files; only returned names count
        run, place, slices = None, 0, {}
        try:
            for frame in frames:
                for page, url, html, refers, refers_url, refers_ts, key, ts in zip(*(frame[c] for c in ("page_id", "url", "html", "refers_to", "refers_url", "refers_ts", "key", "ts"))):
                    page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.close()
                        number, at = number + 1, 0
                        archive = f"{name}-{number}.warc.gz"
                        out = filesystem.open_output_stream(f"{base}/{archive}", compression=None)
                        out.write(head := _packed(info(archive), level))
                        at = len(head)
                    if run is None:
                        run = filesystem.open_output_stream(f"{base}/{name}.cdx", compression=None)
                    raw = _packed(record(page, url, ts, html.encode("utf-8", "surrogatepass"), refers, refers_url, refers_ts), level)
                    out.write(raw)
                    line = _line(key.encode(), ts.encode(), page, archive.encode(), at, len(raw))
                    run.write(line)
                    part = slices.setdefault(bisect.bisect_right(cuts, (key.encode(), ts.encode(), _order(page))), [place, 0])
                    part[1] += len(line)
                    at, place = at + len(raw), place + len(line)
        finally:
            for f in (out, run):
                if f is not None:
                    f.close()
        if slices:
            yield pd.DataFrame([(r, f"{folder}/{name}.cdx", a, n) for r, (a, n) in slices.items()], columns=["range", "run", "start", "length"])

    return own.sortWithinPartitions("key", "ts", F.asc_nulls_first("page_id")).mapInPandas(task, "range int, run string, start long, length long")


def narrow(slices: DataFrame, folder: str, width: int = WIDTH) -> DataFrame:
    """slices of at most `width` runs a range: passes that merge `width` runs at a time to one, below folder. So no task holds
    more open files, and a range's merge is spread over tasks while it has many runs."""
    while (slices.groupBy("range").count().agg(F.max("count")).first()[0] or 0) > width:
        place = F.row_number().over(Window.partitionBy("range").orderBy("run", "start")) - 1
        groups = slices.withColumn("part", F.floor(place / width).cast("int"))

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            filesystem, base = _files(folder)
            for frame in whole_groups(frames, ["range", "part"]):
                for (number, _), own in frame.groupby(["range", "part"]):
                    name, length = f"{uuid.uuid4().hex}.cdx", 0
                    with filesystem.open_output_stream(f"{base}/{name}", compression=None) as out:
                        for key, ts, (there, page), *rest in LoserTree([_slice(*x) for x in zip(own["run"], own["start"].tolist(), own["length"].tolist())]):
                            line = _line(key, ts, page if there else None, *rest)
                            out.write(line)
                            length += len(line)
                    yield pd.DataFrame([(number, f"{folder}/{name}", 0, length)], columns=["range", "run", "start", "length"])

        n = partitions(slices.sparkSession)
        slices = save(groups.repartition(n, "range", "part").sortWithinPartitions("range", "part", "run").mapInPandas(task, "range int, run string, start long, length long"), "warc-slices")
    return slices


def merge(slices: DataFrame) -> DataFrame:
    """The capture history: (range, position, key, ts, page_id, archive, offset, length), ordered over all ranges. Slices of
    more than WIDTH runs a range are brought down by narrow() first."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["range", "position", "key", "ts", "page_id", "archive", "offset", "length"]
        for frame in whole_groups(frames, ["range"]):
            for number, own in frame.groupby("range"):
                rows, position = [], 0
                for key, ts, (there, page), archive, offset, size in LoserTree([_slice(*x) for x in zip(own["run"], own["start"].tolist(), own["length"].tolist())]):
                    rows.append((number, position, key.decode(), ts.decode(), page if there else None, archive.decode(), offset, size))
                    position += 1
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    n = partitions(slices.sparkSession)
    return slices.repartition(n, "range").sortWithinPartitions("range", "run").mapInPandas(task, "range int, position long, key string, ts string, page_id long, archive string, offset long, length long")


def read(history: DataFrame, folder: str) -> DataFrame:
    """The records that the history names, each archive read in the order of its bytes."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = _files(folder)
        for frame in frames:
            rows = []
            for archive, own in frame.groupby("archive", sort=False):
                with filesystem.open_input_file(f"{base}/{archive}") as f:
                    for offset, size in zip(own["offset"].tolist(), own["length"].tolist()):
                        rows.append(parse(zlib.decompress(f.read_at(size, offset), 31)))
            if rows:
                yield pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})

    n = partitions(history.sparkSession)
    return history.repartition(n, "archive").sortWithinPartitions("archive", "offset").mapInPandas(task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def roundtrip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages as WARC, merge the runs, read the archives back: one row per row of pages.

    Null html is an empty payload; null URLs have an empty key. Rows without a page_id are never a response that others
    refer to; repeated rows of the largest page_id are all responses. No pages give no rows and no files.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or fresh_path(spark, "warc"))
    slices = save(write(pages, folder, ranges=partitions(spark)), "warc-slices")
    return read(save(merge(narrow(slices, folder)), "warc-history"), folder)
