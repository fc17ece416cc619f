"""Citations in drafted answers as relations: a draft's sentences are rows, and verdicts on them are aggregated.

drafts: (draft_id, answer, declared: the labels it says it uses). evidence: (draft_id, label, text, title, author).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The forms of labels, quotations and names, and words before a full stop that end no sentence.
LABEL, NUMBERED, LIKE = r"\[E(?:[1-9]|10)\]", r"\[E[0-9]+\]", r"\[[^\]]*E[0-9]+[^\]]*\]"
ENDS = r"(?:\s*\[E(?:[1-9]|10)\])+\s*[.!?]?\s*$"
QUOTED = r"[“\"]([^”\"]{8,})[”\"]"
NAME = r"(?<![0-9A-Za-z_])[A-Z][a-z]{3,}(?![0-9A-Za-z_])"
TITLES = ("dr", "mr", "mrs", "prof", "etc", "vs")
LONGEST = 5000
_END = rf"(?<!(?:^|[ \t\n])(?:[\x00-\x7f&&[^ \t\n]]|(?i:{'|'.join(TITLES)})))([.!?])([ \t]+)(?=[\p{{Lu}}“\"'])"
_CUT = "\x01"


def _all(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def sentences(answer: Column) -> Column:
    """The sentences of an answer; initials, titles and abbreviated names do not end one."""
    return F.split(F.regexp_replace(answer, _END, "$1" + _CUT), _CUT, -1)


def sentence_rows(drafts: DataFrame, *keep: str) -> DataFrame:
    return drafts.select("draft_id", *keep, F.posexplode(sentences(F.col("answer"))).alias("number", "sentence"))


def supported(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """rows (draft_id, number, sentence) with labels (those it uses), known (how many of them have evidence) and holds: the
    sentence ends with its citations, and what they cite has its quotations and, unless they open it, its names."""
    used = F.array_distinct(_all(F.col("sentence"), LABEL))
    own = rows.withColumn("labels", used)
    cited = own.select("draft_id", "number", F.explode("labels").alias("mark")).join(evidence.select("draft_id", F.concat(F.lit("["), "label", F.lit("]")).alias("mark"), F.concat_ws(" ", "text", "title", "author").alias("body")), ["draft_id", "mark"])
    bodies = cited.groupBy("draft_id", "number").agg(F.collect_list("body").alias("bodies"))
    names = _all(F.regexp_replace("sentence", rf"^\s*{NAME}", ""), rf"(?<!\[\s{{0,9}}){NAME}")
    told = own.join(bodies, ["draft_id", "number"], "left").withColumn("bodies", F.coalesce("bodies", F.array().cast("array<string>")))
    quoted = F.forall(_all(F.col("sentence"), QUOTED, 1), lambda q: F.exists("bodies", lambda b: F.contains(b, q)))
    named = F.forall(names, lambda n: F.exists("bodies", lambda b: F.contains(F.lower(b), F.lower(n))))
    return told.select(*rows.columns, "labels", F.size("bodies").alias("known"), (F.col("sentence").rlike(ENDS) & quoted & named).alias("holds"))


def valid_drafts(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft_id, valid): a draft of at most 5000 bytes whose labels all have the right form, are those it declares, have
    evidence, and support every sentence."""
    answer = F.col("answer")
    whole = drafts.select(
        "draft_id", F.array_distinct("declared").alias("declared"), F.transform(F.array_distinct(_all(answer, LABEL)), lambda x: F.substring(x, 2, F.length(x) - 2)).alias("used"),
        ((F.trim(answer) != "") & (F.octet_length(answer) <= LONGEST) & answer.rlike(LABEL) & (F.size(_all(answer, LABEL)) == F.size(_all(answer, LIKE)))).alias("formed"),
    )
    same = (F.size(F.array_except("used", "declared")) == 0) & (F.size(F.array_except("declared", "used")) == 0)
    verdicts = supported(sentence_rows(drafts), evidence).groupBy("draft_id").agg(F.bool_and(F.col("holds") & (F.col("known") == F.size("labels"))).alias("held"))
    return whole.join(verdicts, "draft_id", "left").select("draft_id", (F.col("formed") & same & F.coalesce("held", F.lit(False))).alias("valid"))


def kept_sentences(drafts: DataFrame, evidence: DataFrame, called: dict[str, str] | None = None) -> DataFrame:
    """(draft_id, answer, labels, omitted): what remains of a draft when only sentences that hold by themselves stay, each
    ended by a mark. A pronoun that opens what remains gives way to the first cited author, by the short name that `called`
    has for a part of the full one."""
    rows = sentence_rows(drafts).withColumn("sentence", F.trim("sentence")).where("sentence <> ''")
    text = F.col("sentence")
    sound = (F.size("labels") > 0) & (F.col("known") == F.size("labels")) & F.col("holds") & (F.octet_length(text) <= LONGEST) & (F.size(_all(text, LABEL)) == F.size(_all(text, LIKE)))
    told = supported(rows, evidence).withColumn("sound", sound)
    told = told.withColumn("first", F.col("sound") & (F.sum(F.col("sound").cast("int")).over(Window.partitionBy("draft_id").orderBy("number")) == 1))
    author = F.col("author")
    for part, short in (called or {}).items():
        author = F.when(F.lower("author").contains(part.lower()), short).otherwise(author)
    names = evidence.select("draft_id", F.concat(F.lit("["), "label", F.lit("]")).alias("mark"), author.alias("name"))
    told = told.withColumn("mark", F.when(F.col("first") & text.rlike("^(?:He|She) "), F.get("labels", F.lit(0)))).join(names, ["draft_id", "mark"], "left")
    plain = F.when(F.col("name").isNotNull(), F.concat("name", F.substr(text, F.instr(text, " ")))).otherwise(text)
    ended = F.when(plain.rlike("[.!?]$"), plain).otherwise(F.concat(plain, F.lit(".")))
    number = lambda x: F.substring(x, 3, F.length(x) - 3).cast("int")
    parts = F.sort_array(F.collect_list(F.when(F.col("sound"), F.struct("number", ended.alias("s")))))
    labels = F.flatten(F.collect_list(F.when(F.col("sound"), F.col("labels"))))
    out = told.groupBy("draft_id").agg(parts.alias("p"), labels.alias("l"), F.count_if(~F.col("sound")).alias("omitted"))
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct("l"), number)), lambda n: F.concat(F.lit("E"), n.cast("string")))
    return out.select("draft_id", F.array_join("p.s", " ").alias("answer"), ordered.alias("labels"), "omitted")


def settled_drafts(drafts: DataFrame) -> DataFrame:
    """(draft_id, answer): labels stand before the mark that ends a sentence, and a sentence without one gets the label that
    alone can be meant: the paragraph's only one, the only one declared if the paragraph has none, or the one that the nearest
    cited sentences before and after share."""
    moved = F.regexp_replace("answer", rf"([.!?])\s*({LABEL})", " $2$1")
    lines = drafts.select("draft_id", "declared", F.posexplode(F.split(moved, "\n", -1)).alias("line", "body"))
    marked = F.split(F.regexp_replace("body", _END, "$1" + _CUT + "$2"), _CUT, -1)
    rows = lines.select("draft_id", "declared", "line", F.posexplode(marked).alias("number", "part"))
    every = Window.partitionBy("draft_id", "line")
    order = every.orderBy("number")
    rows = rows.withColumn("own", _all(F.col("part"), NUMBERED)).withColumn("some", F.when(F.size("own") > 0, F.col("own")))
    near = {"before": F.last("some", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "after": F.first("some", True).over(order.rowsBetween(1, Window.unboundedFollowing))}
    rows = rows.withColumns({**near, "all": F.array_distinct(F.flatten(F.collect_list("own").over(every)))})
    declared = F.concat(F.lit("["), F.get("declared", F.lit(0)), F.lit("]"))
    only = F.when(F.size("all") == 1, F.get("all", F.lit(0))).when((F.size("all") == 0) & (F.size("declared") == 1) & declared.rlike(f"^{LABEL}$"), declared)
    shared = F.when((F.size("before") == 1) & (F.size("after") == 1) & (F.get("before", F.lit(0)) == F.get("after", F.lit(0))), F.get("before", F.lit(0)))
    label = F.when((F.size("own") == 0) & (F.trim(F.col("part")) != ""), F.coalesce(only, shared))
    bare = F.regexp_replace("part", r"[ \t]+$", "")
    filled = F.when(bare.rlike("[.!?]$"), F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit(" "), label, F.right(bare, F.lit(1)))).otherwise(F.concat(bare, F.lit(" "), label))
    rows = rows.withColumn("part", F.coalesce(filled, "part"))
    texts = rows.groupBy("draft_id", "line").agg(F.array_join(F.sort_array(F.collect_list(F.struct("number", "part")))["part"], "").alias("body"))
    return texts.groupBy("draft_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("line", "body")))["body"], "\n").alias("answer"))
