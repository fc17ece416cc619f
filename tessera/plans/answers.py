"""Drafted answers as queries. Drafts are made from the assistants' turns, their evidence from the other turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import citations as C
from tessera.operators import claims
from tessera.sources.tables import sql, table

_TURN = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn) AS n FROM {conversations}"
_DRAFT = f"""SELECT conv_id AS draft_id, CASE conv_id % 4 WHEN 0 THEN concat(replace(text, '. ', ' [E1]. '), ' [E1].') WHEN 1 THEN concat(replace(text, '. ', '. [E2] '), ' Thus says Alder [E1]') WHEN 2 THEN concat(text, ' [E1]. More of it! [see E2]') ELSE text END AS answer,
CASE WHEN conv_id % 5 = 0 THEN array('E1', 'E2') ELSE array('E1') END AS declared FROM ({_TURN}) t WHERE role = 'assistant' AND n = 1"""
_PROOF = f"SELECT conv_id AS draft_id, concat('E', n) AS label, text, role AS title, 'Alder' AS author FROM ({_TURN}) t WHERE role <> 'assistant' AND n <= 10"


def drafts(spark, sf_dir):
    return sql(spark, sf_dir, _DRAFT, "conversations")


def evidence(spark, sf_dir):
    return sql(spark, sf_dir, _PROOF, "conversations")


_duck = lambda text: text.replace("{conversations}", "conversations").replace("array('E1', 'E2')", "['E1', 'E2']").replace("array('E1')", "['E1']")
_D = f"d AS ({_duck(_DRAFT)}), e AS ({_duck(_PROOF)})"
_TITLES = ", ".join(f"'{t}'" for t in C.TITLES)
_WORD = r"[^ \t\n]+[ \t\n]*|^[ \t\n]+"


def sentence_sql(source: str, key: str, text: str) -> str:
    """CTE `s` of (key, number, sentence): words with what follows them, added up between the words that end a sentence."""
    return rf"""w0 AS (SELECT {key}, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT {key}, CASE WHEN {text} = '' THEN [''] ELSE regexp_extract_all({text}, '{_WORD}') END AS x FROM {source})),
w1 AS (SELECT *, regexp_matches(w, '[.!?][ \t]+$') AND coalesce(regexp_matches(lead(w) OVER (PARTITION BY {key} ORDER BY i), '^[\p{{Lu}}“"'']'), false) AND octet_length(encode(regexp_replace(w, '[.!?][ \t]+$', ''))) <> 1 AND lower(regexp_replace(w, '[.!?][ \t]+$', '')) NOT IN ({_TITLES}) AS stop FROM w0),
w2 AS (SELECT {key}, i, CASE WHEN stop THEN rtrim(w, ' ' || chr(9)) ELSE w END AS w, count(*) FILTER (WHERE stop) OVER (PARTITION BY {key} ORDER BY i) - CASE WHEN stop THEN 1 ELSE 0 END AS number FROM w1),
s AS (SELECT {key}, number, string_agg(w, '' ORDER BY i) AS sentence FROM w2 GROUP BY {key}, number)"""


@query(f"""WITH c AS (SELECT conv_id * 1000 + turn AS k, * FROM conversations WHERE role = 'assistant'), {sentence_sql('c', 'k', 'text')} SELECT conv_id, turn, CAST(number AS INTEGER) AS number, sentence FROM s JOIN c USING (k)""")
def answer_sentences(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(C.sentences(F.col("text"))).alias("number", "sentence"))


_LABEL, _LIKE, _ENDS = r"\[E(?:[1-9]|10)\]", C.LIKE, C.ENDS
_CHECKED = rf"""{_D}, {sentence_sql('d', 'draft_id', 'answer')},
l AS (SELECT draft_id, number, trim(sentence) AS sentence, list_distinct(regexp_extract_all(sentence, '{_LABEL}')) AS labels FROM s),
b AS (SELECT l.draft_id, number, list(concat_ws(' ', text, title, author)) AS bodies FROM (SELECT draft_id, number, unnest(labels) AS mark FROM l) l JOIN e ON e.draft_id = l.draft_id AND mark = '[' || label || ']' GROUP BY ALL),
v AS (SELECT l.draft_id, number, sentence, labels, coalesce(len(bodies), 0) AS known, regexp_matches(sentence, '{_ENDS}')
AND len(list_filter(regexp_extract_all(sentence, '{C.QUOTED}', 1), lambda q: len(list_filter(coalesce(bodies, []), lambda x: contains(x, q))) = 0)) = 0
AND len(list_filter(regexp_extract_all(regexp_replace(sentence, '^\s*[A-Z][a-z]{{3,}}([^0-9A-Za-z_]|$)', '\1'), '(?:^|[^0-9A-Za-z_])([A-Z][a-z]{{3,}})(?:[^0-9A-Za-z_]|$)', 1), lambda n: len(list_filter(coalesce(bodies, []), lambda x: contains(lower(x), lower(n)))) = 0)) = 0 AS holds FROM l LEFT JOIN b USING (draft_id, number))"""


@query(rf"""WITH {_CHECKED}, h AS (SELECT draft_id, bool_and(holds AND known = len(labels)) AS held FROM v GROUP BY draft_id)
SELECT draft_id, trim(answer) <> '' AND octet_length(encode(answer)) <= 5000 AND len(regexp_extract_all(answer, '{_LABEL}')) > 0 AND len(regexp_extract_all(answer, '{_LABEL}')) = len(regexp_extract_all(answer, '{_LIKE}'))
AND list_sort(list_distinct(regexp_extract_all(answer, '{_LABEL}'))) = list_sort(list_transform(declared, lambda x: '[' || x || ']')) AND held AS valid FROM d JOIN h USING (draft_id)""")
def draft_citations(spark, sf_dir):
    return C.valid_drafts(drafts(spark, sf_dir), evidence(spark, sf_dir))


@query(rf"""WITH {_CHECKED}, k AS (SELECT *, len(labels) > 0 AND known = len(labels) AND holds AND octet_length(encode(sentence)) <= 5000 AND len(regexp_extract_all(sentence, '{_LABEL}')) = len(regexp_extract_all(sentence, '{_LIKE}')) AS sound FROM v WHERE sentence <> ''),
j AS (SELECT draft_id, number, sound, CASE WHEN sound AND regexp_matches(sentence, '^(He|She) ') AND count(*) FILTER (WHERE sound) OVER (PARTITION BY draft_id ORDER BY number) = 1 THEN 'Alder' || substr(sentence, instr(sentence, ' ')) ELSE sentence END AS sentence FROM k)
SELECT draft_id, coalesce(string_agg(CASE WHEN regexp_matches(sentence, '[.!?]$') THEN sentence ELSE sentence || '.' END, ' ' ORDER BY number) FILTER (WHERE sound), '') AS answer, count(*) FILTER (WHERE NOT sound) AS omitted FROM j GROUP BY draft_id""")
def supported_sentences(spark, sf_dir):
    return C.kept_sentences(drafts(spark, sf_dir), evidence(spark, sf_dir)).select("draft_id", "answer", "omitted")


@query(rf"""WITH d AS (SELECT * FROM ({_duck(_DRAFT)}) WHERE regexp_matches(answer, '[^\s]')), m AS (SELECT draft_id, declared, regexp_replace(answer, '([.!?])\s*({_LABEL})', ' \2\1', 'g') AS a FROM d),
p AS (SELECT draft_id * 100000 + unnest(range(len(x))) AS k, draft_id, declared, unnest(x) AS body FROM (SELECT *, string_split(a, chr(10)) AS x FROM m)), {sentence_sql('p', 'k', 'body')},
o AS (SELECT k, number, sentence, regexp_extract_all(sentence, '{C.NUMBERED}') AS own, CASE WHEN len(regexp_extract_all(sentence, '{C.NUMBERED}')) > 0 THEN regexp_extract_all(sentence, '{C.NUMBERED}') END AS any_own FROM s),
n AS (SELECT *, list_distinct(flatten(list(own) OVER (PARTITION BY k))) AS every, last_value(any_own IGNORE NULLS) OVER (PARTITION BY k ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(any_own IGNORE NULLS) OVER (PARTITION BY k ORDER BY number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM o),
f AS (SELECT n.*, draft_id, CASE WHEN len(own) > 0 OR trim(sentence) = '' THEN NULL WHEN len(every) = 1 THEN every[1] WHEN len(every) = 0 AND len(declared) = 1 THEN '[' || declared[1] || ']' WHEN len(before) = 1 AND len(after) = 1 AND before[1] = after[1] THEN before[1] END AS label FROM n JOIN p USING (k))
SELECT draft_id, count(*) FILTER (WHERE label IS NOT NULL) AS filled, count(*) AS sentences, CAST(sum(length(sentence) + coalesce(1 + length(label), 0)) AS BIGINT) AS size FROM f GROUP BY draft_id""")
def settled_drafts(spark, sf_dir):
    """How many sentences each draft has, how many of them gained a label, and how long they are then."""
    own = drafts(spark, sf_dir)
    rows = C.sentence_rows(C.settled_drafts(own).select("draft_id", F.explode(F.split("answer", "\n", -1)).alias("answer")))
    before = own.select("draft_id", F.explode(F.split(F.regexp_replace("answer", rf"([.!?])\s*({C.LABEL})", " $2$1"), "\n", -1)).alias("answer"))
    size = lambda x: x.groupBy("draft_id").agg(F.count("*").alias("sentences"), F.sum(F.regexp_count("sentence", F.lit(C.NUMBERED))).alias("labels"), F.sum(F.length("sentence")).alias("size"))
    both = size(rows).join(size(C.sentence_rows(before)).select("draft_id", F.col("labels").alias("had")), "draft_id")
    return both.select("draft_id", (F.col("labels") - F.col("had")).alias("filled"), "sentences", "size")


@query("""SELECT o_orderkey AS claim, '[' || coalesce(string_agg('{"label":"E' || l_linenumber || '","part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey), '') || ']' AS supports FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'N' GROUP BY o_orderkey""")
def claim_supports(spark, sf_dir):
    """Each claim with its supports as a nested list, empty where it has none."""
    item = F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.struct(F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("label"), F.col("l_partkey").alias("part")).alias("s"))
    own = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(own, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").alias("claim"), F.coalesce(F.to_json("x.s"), F.lit("[]")).alias("supports"))


@query()
def answer_sections(spark, sf_dir):
    """The drafts' sentences by proposed groups or, where these leave one out, by the authors they cite."""
    rows = C.sentence_rows(drafts(spark, sf_dir)).withColumn("number", F.col("number") + 1)
    numbers = rows.groupBy("draft_id").agg(F.array_sort(F.collect_list("number")).alias("n"))
    halves = F.array(F.struct(F.lit(0).alias("place"), F.lit("First").alias("title"), F.filter("n", lambda x: x % 2 == 1).alias("numbers")), F.struct(F.lit(1).alias("place"), F.lit("Second").alias("title"), F.filter("n", lambda x: (x % 2 == 0) & ((F.col("draft_id") % 3 > 0) | (x > 2))).alias("numbers")))
    groups = numbers.select("draft_id", F.explode(halves).alias("g")).select("draft_id", "g.*")
    return claims.sections(rows, groups, evidence(spark, sf_dir)).select("draft_id", "place", "title", "body")


@query()
def claim_decisions(spark, sf_dir):
    """The drafts' sentences by recorded quotations and verdicts: the first words of each cited passage are quoted."""
    own, proof = drafts(spark, sf_dir), evidence(spark, sf_dir)
    numbers = C.sentence_rows(own).select("draft_id", "number")
    quoted = F.regexp_extract("text", r"^((?:\S+\s+){6})", 1)
    quotes = numbers.join(proof.select("draft_id", "label", quoted.alias("quote")), "draft_id").where("draft_id % 5 > 0 or number % 2 = 0").withColumn("place", F.lit(0))
    verdicts = numbers.withColumns({"supported": F.col("number") % 3 > 0, "relevant": F.col("number") % 4 < 3})
    return claims.decided_claims(own, proof, quotes, verdicts).select("draft_id", "number", "decision", F.size("supports").alias("supports"))
