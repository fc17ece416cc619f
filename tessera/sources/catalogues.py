"""More saved catalogue answers, brought to the form of replay.paper_works: PubMed's XML, Semantic Scholar, DataCite, open locations.

Answers are rows (path, raw) of replay.answers; XML and JSON are read by Spark's own parsers. Pages of one search follow each other
by tokens, which unbroken() checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions import text as T
from tessera.operators import graph

COLUMNS = ("path", "position", "provider", "native_id", "doi", "pmid", "pmcid", "title", "authors", "year", "kind", "abstract")
#: The most names that a record of DataCite is given, and what stands for none.
MOST_NAMES, NOBODY = 20, "Unknown author"


def _form(rows: DataFrame, provider: str, **columns: Column) -> DataFrame:
    """rows (path, position) with the columns of a work; what an answer lacks is null."""
    told = {c: columns.get(c, F.lit(None).cast("string")) for c in COLUMNS[3:]} | {"year": columns["year"].try_cast("int")}
    empty = lambda c: F.nullif(c, F.lit(""))
    told |= {"doi": empty(T.doi(told["doi"])), "pmcid": empty(R.pmcid(told["pmcid"])), "title": R.squeezed(told["title"]), "authors": R.squeezed(told["authors"])}
    return rows.select("path", "position", F.lit(provider).alias("provider"), *(told[c].alias(c) for c in COLUMNS[3:]))


def pubmed_works(saved: DataFrame) -> DataFrame:
    """Works of PubMed's EFetch answers; markup within titles and abstracts goes, their parts are joined by spaces."""
    name = "struct<LastName:string,ForeName:string>"
    article = f"struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,AuthorList:struct<Author:array<{name}>>,Journal:struct<JournalIssue:struct<PubDate:struct<Year:string>>>,PublicationTypeList:struct<PublicationType:array<string>>>"
    ids = "struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
    one = f"struct<MedlineCitation:struct<PMID:string,Article:{article}>,PubmedData:{ids}>"
    own = F.from_xml("raw", f"PubmedArticle array<{one}>", {"mode": "PERMISSIVE"})["PubmedArticle"]
    rows = saved.where(F.contains("raw", F.lit("<PubmedArticle"))).select("path", F.posexplode(own).alias("position", "w"))
    a, found = F.col("w.MedlineCitation.Article"), F.col("w.PubmedData.ArticleIdList.ArticleId")
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"\s+", " "))
    of = lambda kind: F.get(F.filter(found, lambda i: i["_IdType"] == kind), F.lit(0))["_VALUE"]
    people = F.array_join(F.transform(a["AuthorList"]["Author"], lambda n: F.trim(F.concat_ws(" ", n["ForeName"], n["LastName"]))), ", ")
    pmid = plain(F.col("w.MedlineCitation.PMID"))
    parts = F.array_join(F.transform(a["Abstract"]["AbstractText"], plain), " ")
    types = F.array_join(F.transform(a["PublicationTypeList"]["PublicationType"], plain), ", ")
    return _form(rows, "pubmed", native_id=pmid, pmid=pmid, doi=of("doi"), pmcid=of("pmc"), title=plain(a["ArticleTitle"]), authors=people, year=a["Journal"]["JournalIssue"]["PubDate"]["Year"], kind=types, abstract=parts)


def semantic_works(saved: DataFrame) -> DataFrame:
    """Works of Semantic Scholar's search answers."""
    one = "struct<paperId:string,title:string,year:int,authors:array<struct<name:string>>,publicationTypes:array<string>,externalIds:struct<DOI:string,PubMed:string,PubMedCentral:string>,abstract:string>"
    rows = saved.select("path", F.posexplode(F.from_json("raw", f"struct<data:array<{one}>>")["data"]).alias("position", "w"))
    central = F.col("w.externalIds.PubMedCentral")
    return _form(rows, "semantic_scholar", native_id=F.col("w.paperId"), doi=F.col("w.externalIds.DOI"), pmid=F.col("w.externalIds.PubMed"), pmcid=central, title=F.col("w.title"), authors=F.array_join(F.transform("w.authors", lambda n: n["name"]), ", "), year=F.col("w.year").cast("string"), kind=F.array_join("w.publicationTypes", ", "), abstract=F.col("w.abstract"))


def datacite_works(saved: DataFrame) -> DataFrame:
    """The record of each of DataCite's answers that has a title and a sound DOI: up to twenty names, or a word for nobody."""
    person = "struct<name:string,givenName:string,familyName:string>"
    shape = f"struct<data:struct<attributes:struct<doi:string,titles:array<struct<title:string>>,creators:array<{person}>,publisher:string,publicationYear:int,types:struct<resourceTypeGeneral:string>>>>"
    rows = saved.select("path", F.lit(0).alias("position"), F.from_json("raw", shape)["data"]["attributes"].alias("w"))
    full = lambda n: F.coalesce(F.nullif(F.trim(n["name"]), F.lit("")), F.trim(F.concat_ws(" ", n["givenName"], n["familyName"])))
    names = F.slice(F.filter(F.transform("w.creators", full), lambda n: n != ""), 1, MOST_NAMES)
    authors = F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, F.array_join(names, ", ")).otherwise(NOBODY)
    own = _form(rows, "datacite", native_id=F.col("w.doi"), doi=F.col("w.doi"), title=F.get("w.titles", F.lit(0))["title"], authors=authors, year=F.col("w.publicationYear").cast("string"), kind=F.col("w.types.resourceTypeGeneral"))
    return own.where("title <> '' and doi is not null")


def open_locations(saved: DataFrame) -> DataFrame:
    """(path, doi, open, place, format, url, version, license, host) of Unpaywall's answers: secure addresses in order, each once,
    the best location before the others and a PDF before the page that it is on. An answer without one has one row."""
    place = "struct<url_for_pdf:string,url_for_landing_page:string,version:string,license:string,host_type:string>"
    rows = saved.select("path", F.from_json("raw", f"struct<doi:string,is_oa:boolean,best_oa_location:{place},oa_locations:array<{place}>>").alias("x")).where("x.doi is not null")
    every = F.concat(F.array_compact(F.array("x.best_oa_location")), F.coalesce("x.oa_locations", F.array().cast(f"array<{place}>")))
    both = F.flatten(F.transform(every, lambda p: F.array(*(F.struct(F.lit(f).alias("format"), p[c].alias("url"), p["version"].alias("version"), p["license"].alias("license"), p["host_type"].alias("host")) for f, c in (("pdf", "url_for_pdf"), ("landing", "url_for_landing_page"))))))
    sound = F.filter(both, lambda p: p["url"].rlike(r"(?i)^https://[^/?#@\s]+([/?#]\S*)?$"))
    first = F.filter(sound, lambda p, i: F.array_position(F.transform(sound, lambda q: q["url"]), p["url"]) == i + 1)
    own = rows.select("path", T.doi(F.col("x.doi")).alias("doi"), F.coalesce("x.is_oa", F.lit(False)).alias("open"), F.posexplode_outer(first).alias("place", "p"))
    return own.select("path", "doi", "open", "place", "p.format", "p.url", "p.version", "p.license", "p.host")


def unbroken(pages: DataFrame) -> DataFrame:
    """pages (search, token, next) that a search reaches from its page without a token over the tokens that its pages name, and
    (number) its place; what lies behind a missing page, or leads back to a page, is left out. Followed by pointer
    doubling: as many joins as the number of pages has binary digits."""
    key = lambda c: F.concat_ws("\u0001", "search", F.coalesce(c, F.lit("")))
    tree = pages.select(key("next").alias("id"), key("token").alias("parent")).where("next is not null and next <> ''")
    tree = tree.unionByName(pages.where("coalesce(token, '') = ''").select(key("token").alias("id"), F.lit(None).cast("string").alias("parent"))).dropDuplicates(["id"])
    return pages.withColumn("id", key("token")).join(graph.depths(tree), "id").select("search", "token", "next", F.col("depth").alias("number"))
