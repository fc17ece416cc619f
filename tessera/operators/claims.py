"""Claims with their supports as relations: proposals that quote their evidence, verdicts on drafted sentences, sections.

evidence: (draft_id, label, text, title, author), as in `functions.citations`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import citations as C
from tessera.functions import passages as P
from tessera.functions import text as T

PROPOSAL = "struct<claims:array<struct<text:string,supports:array<struct<id:string,quote:string>>>>>"
LONGEST, SUPPORTS = 500, 2
_bare = lambda x: F.regexp_replace(F.trim(x), r"^\[|\]$", "")
_number = lambda x: F.substring(x, 2, 4).cast("int")


def accepted_claims(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft_id, answer, labels, omitted) of proposals (draft_id, raw: JSON, most: how many claims count). A claim is one
    uncited sentence of at most 500 characters with one or two supports; it is cited by those whose quotation the passage holds
    in whole or for the most part, and left out if there is none. A proposal that is no JSON has no claims and a null answer."""
    told = proposals.select("draft_id", "most", F.from_json(F.trim("raw"), PROPOSAL)["claims"].alias("claims"))
    rows = told.select("draft_id", F.posexplode(F.slice("claims", F.lit(1), F.col("most"))).alias("number", "claim")).select("draft_id", "number", F.trim("claim.text").alias("body"), F.col("claim.supports").alias("supports"))
    formed = (F.col("body") != "") & (F.length("body") <= LONGEST) & (F.size(C.sentences(F.col("body"))) == 1) & ~F.col("body").rlike(C.LABEL) & F.size("supports").between(1, SUPPORTS)
    rows = rows.withColumn("formed", F.coalesce(formed, F.lit(False)))
    asked = rows.where("formed").select("draft_id", "number", F.posexplode("supports").alias("place", "s")).select("draft_id", "number", "place", _bare(F.col("s.id")).alias("label"), F.col("s.quote").alias("quote"))
    held = asked.join(evidence.select("draft_id", "label", "text"), ["draft_id", "label"]).withColumn("own", P.recovered(F.col("text"), F.col("quote"))).where("own is not null")
    cited = held.groupBy("draft_id", "number", "label").agg(F.min("place").alias("place")).groupBy("draft_id", "number").agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("l"))
    rows = rows.join(cited, ["draft_id", "number"], "left").withColumn("labels", F.coalesce("l.label", F.array().cast("array<string>")))
    mark = F.when(F.col("body").rlike("[.!?]$"), F.right("body", F.lit(1))).otherwise(".")
    bare = F.when(F.col("body").rlike("[.!?]$"), F.trim(F.substring("body", F.lit(1), F.length("body") - 1))).otherwise(F.col("body"))
    line = F.concat(bare, F.array_join(F.transform("labels", lambda x: F.concat(F.lit(" ["), x, F.lit("]"))), ""), mark)
    kept = F.size("labels") > 0
    lines = F.sort_array(F.collect_list(F.when(kept, F.struct("number", line.alias("s")))))
    whole = rows.groupBy("draft_id").agg(lines.alias("x"), F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"), F.count_if(~kept).alias("omitted"))
    out = told.select("draft_id", F.col("claims").isNotNull().alias("read")).join(whole, "draft_id", "left")
    labels = F.transform(F.array_sort(F.transform(F.coalesce("labels", F.array().cast("array<string>")), _number)), lambda n: F.concat(F.lit("E"), n.cast("string")))
    return out.select("draft_id", F.when(F.col("read"), F.coalesce(F.array_join("x.s", " "), F.lit(""))).alias("answer"), labels.alias("labels"), F.coalesce("omitted", F.lit(0)).alias("omitted"))


def decided_claims(drafts: DataFrame, evidence: DataFrame, quotes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(draft_id, number, sentence, decision, supports) of each sentence of the drafts, by recorded quotes (draft_id, number,
    place, label, quote) and verdicts (draft_id, number, supported, relevant).

    missing_excerpt: the sentence cites nothing, or a cited passage has no excerpt of its quotations; unsupported or irrelevant:
    as the verdict says; supported otherwise. A passage that opens with a comparison has lost its subject and gives no excerpt.
    Supports are the first excerpt of each cited passage, with the heading that names the subject.
    """
    rows = C.sentence_rows(drafts).withColumn("sentence", F.trim("sentence")).where("sentence <> ''")
    marks = F.array_distinct(F.transform(F.regexp_extract_all("sentence", F.lit(C.LABEL), F.lit(0)), lambda x: F.substring(x, 2, F.length(x) - 2)))
    cited = rows.select("draft_id", "number", "sentence", F.explode(marks).alias("label")).join(evidence.select("draft_id", "label", "text"), ["draft_id", "label"])
    asked = cited.join(quotes.select("draft_id", "number", "place", _bare(F.col("label")).alias("label"), "quote"), ["draft_id", "number", "label"], "left")
    own = F.when(~T.opening_comparison(F.col("text")), P.excerpted(F.col("text"), F.col("quote"), F.col("sentence")))
    found = asked.withColumn("e", own).groupBy("draft_id", "number", "label").agg(F.min_by("e", F.when(F.col("e").isNotNull(), F.col("place"))).alias("e"))
    held = found.groupBy("draft_id", "number").agg(F.bool_and(F.col("e").isNotNull()).alias("whole"), F.array_sort(F.collect_list(F.when(F.col("e").isNotNull(), F.struct(_number(F.col("label")).alias("n"), "label", "e.*")))).alias("supports"))
    told = rows.join(held, ["draft_id", "number"], "left").join(verdicts, ["draft_id", "number"], "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    decision = F.when(no("whole"), "missing_excerpt").when(no("relevant"), "irrelevant").when(no("supported"), "unsupported").otherwise("supported")
    return told.select("draft_id", "number", "sentence", decision.alias("decision"), F.transform(F.coalesce("supports", F.array().cast(told.schema["supports"].dataType)), lambda s: s.dropFields("n")).alias("supports"))


def sections(sentences: DataFrame, groups: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft_id, place, title, body) of sentences (draft_id, number from 1, sentence) by proposed groups (draft_id, place, title,
    numbers). Two to four groups with plain titles that hold every sentence once are taken; else sentences go by the author of
    the first passage they cite, in the order of first mention, or together if one cites nothing known."""
    plain = F.trim("title").rlike(r"^[\p{L}\p{N}\s\-/&,']{1,80}$")
    counted = groups.groupBy("draft_id").agg(F.count("*").alias("groups"), F.bool_and(plain & (F.size("numbers") > 0)).alias("named"), F.array_sort(F.flatten(F.collect_list("numbers"))).alias("all"))
    every = sentences.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.col("number").cast("int"))).alias("numbers"))
    sound = every.join(counted, "draft_id").where(F.col("groups").between(2, 4) & F.col("named") & (F.col("all") == F.col("numbers"))).select("draft_id")
    pairs = groups.join(sound, "draft_id", "left_semi").select("draft_id", "place", F.trim("title").alias("title"), F.posexplode("numbers").alias("at", "number"))
    grouped = pairs.join(sentences, ["draft_id", "number"])
    first = F.regexp_extract("sentence", r"\[(E(?:[1-9]|10))\]", 1)
    rest = sentences.join(sound, "draft_id", "left_anti").withColumn("label", first).join(evidence.select("draft_id", "label", "author"), ["draft_id", "label"], "left")
    per = Window.partitionBy("draft_id")
    rest = rest.withColumn("known", F.min(F.col("author").isNotNull().cast("int")).over(per) == 1)
    name = F.regexp_extract(F.trim(F.substring_index("author", ",", 1)), r"(\S*)$", 1)
    title = F.when(F.col("known"), F.concat(F.lit("Findings from "), name)).otherwise("Findings in the books")
    key = F.when(F.col("known"), F.col("author")).otherwise("")
    rest = rest.select("draft_id", key.alias("key"), title.alias("title"), "number", "sentence").withColumn("place", F.min("number").over(Window.partitionBy("draft_id", "key")))
    rows = grouped.select("draft_id", "place", "title", "at", "sentence").unionByName(rest.select("draft_id", "place", "title", F.col("number").alias("at"), "sentence"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.trim("sentence").alias("s")))), lambda x: x["s"]), " ")
    return rows.groupBy("draft_id", "place", "title").agg(body.alias("body"))
