"""Saved answers of catalogues as tables: JSON files, one answer each, read by Spark and brought to one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions import text as T

ITEM = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,100}$"
LARGEST, MOST = 250 << 20, 12
_TEXTS = "struct<identifier:variant,title:variant,creator:variant,year:variant,date:variant,rights:variant,licenseurl:variant,`access-restricted-item`:variant>"


def answers(spark: SparkSession, glob: str) -> DataFrame:
    """(path, raw) of saved answers."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def flat(x: Column) -> Column:
    """A JSON value as text: a string as it is, a list of strings joined, a number in digits, anything else empty."""
    listed = F.try_variant_get(x, "$", "array<string>")
    return F.coalesce(F.when(F.schema_of_variant(x).startswith("ARRAY"), F.array_join(listed, ", ")), F.when(F.schema_of_variant(x).startswith("OBJECT"), F.lit("")), F.trim(F.try_variant_get(x, "$", "string")), F.lit(""))


def archive_works(saved: DataFrame) -> DataFrame:
    """(path, total, identifier, title, creator, year, record_url) of an archive's search answers; odd identifiers are left out."""
    shape = f"struct<response:struct<numFound:int,docs:array<{_TEXTS}>>>"
    rows = saved.select("path", F.from_json("raw", shape)["response"].alias("r")).select("path", F.col("r.numFound").alias("total"), F.explode("r.docs").alias("d"))
    own = rows.select("path", "total", *(flat(F.col(f"d.{c}")).alias(c) for c in ("identifier", "title", "creator", "year")))
    return own.where(F.col("identifier").rlike(ITEM)).withColumn("record_url", F.concat(F.lit("https://archive.org/details/"), "identifier"))


def archive_items(saved: DataFrame) -> DataFrame:
    """(path, title, creator, year, rights, license_url, pdfs) of an archive's item answers; pdfs: name, bytes and source of the
    first twelve open PDF files of a sound size, none for restricted items."""
    shape = f"struct<metadata:{_TEXTS},files:array<struct<name:string,source:string,size:string,private:variant,is_dark:variant>>>"
    rows = saved.select("path", F.from_json("raw", shape).alias("x")).where("x.metadata is not null")
    m = {c: flat(F.col(f"x.metadata.`{c}`")) for c in ("title", "creator", "year", "date", "rights", "licenseurl", "access-restricted-item")}
    set_ = lambda v: F.coalesce(F.lower(flat(v)).isin("true", "1"), F.lit(False))
    sound = lambda f: (
        F.coalesce(F.try_to_number(f["size"], F.lit("9999999999")).between(1, LARGEST), F.lit(False)) & ~set_(f["private"]) & ~set_(f["is_dark"])
        & F.lower(f["name"]).endswith(".pdf") & ~f["name"].contains("..") & ~f["name"].startswith("/") & ~f["name"].contains("\\")
    )
    files = F.transform(F.slice(F.filter("x.files", sound), 1, MOST), lambda f: F.struct(f["name"].alias("name"), f["size"].cast("long").alias("bytes"), f["source"].alias("source")))
    open_ = F.when(m["access-restricted-item"] == "true", F.array().cast("array<struct<name:string,bytes:bigint,source:string>>")).otherwise(files)
    return rows.select("path", m["title"].alias("title"), m["creator"].alias("creator"), F.when(m["year"] == "", m["date"]).otherwise(m["year"]).alias("year"), m["rights"].alias("rights"), m["licenseurl"].alias("license_url"), open_.alias("pdfs"))


def paper_works(saved: DataFrame) -> DataFrame:
    """(path, provider, native_id, doi, pmid, pmcid, title, authors, year, position) of Europe PMC's and Crossref's search answers."""
    one = "struct<id:string,doi:string,pmid:string,pmcid:string,title:string,authorString:string,pubYear:string>"
    two = "struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>>"
    rows = saved.select("path", F.from_json("raw", f"struct<resultList:struct<result:array<{one}>>,message:struct<items:array<{two}>>>").alias("x"))
    e = rows.select("path", F.posexplode("x.resultList.result").alias("position", "w")).select(
        "path", "position", F.lit("europepmc").alias("provider"), F.col("w.id").alias("native_id"), F.col("w.doi").alias("doi"), F.col("w.pmid").alias("pmid"), F.col("w.pmcid").alias("pmcid"), F.col("w.title").alias("title"), F.col("w.authorString").alias("authors"), F.col("w.pubYear").cast("int").alias("year")
    )
    people = F.array_join(F.transform("w.author", lambda a: F.concat_ws(" ", a["given"], a["family"])), ", ")
    c = rows.select("path", F.posexplode("x.message.items").alias("position", "w")).select(
        "path", "position", F.lit("crossref").alias("provider"), F.col("w.DOI").alias("native_id"), F.col("w.DOI").alias("doi"), F.lit(None).cast("string").alias("pmid"), F.lit(None).cast("string").alias("pmcid"), F.get("w.title", F.lit(0)).alias("title"), people.alias("authors"), F.get(F.get("w.issued.date-parts", F.lit(0)), F.lit(0)).alias("year")
    )
    every = e.unionByName(c)
    return every.withColumns({"doi": T.doi(F.col("doi")), "pmcid": F.nullif(R.pmcid(F.col("pmcid")), F.lit("")), "title": R.squeezed(F.col("title"))})
