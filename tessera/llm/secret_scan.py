"""Secret scans through a trigram inverted index, with DataFrame operations only.

From each rule's pattern a Boolean query over trigrams is derived that every matching text satisfies. Postings of the
trigrams that the queries name are built by segments of documents; queries are answered by intersecting and uniting
postings within a segment, and only candidates are verified with the pattern. Rules without mandatory trigrams scan
every text. The index holds lower-cased trigrams, so it never misses a match of either case.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, save, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # means the same to java.util.regex, RE2 and Python
    group: int = 0  # its characters must number `least`
    least: int = 0


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
WIDEST = 64  # strings that a part of a pattern is spelt out as


# -- Boolean trigram queries: a trigram, ("and", ...), ("or", ...), or None where nothing is mandatory


def _all(parts):
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts):
    parts = list(dict.fromkeys(parts))
    if not parts or None in parts:
        return None
    flat = {p: trigrams(p) for p in parts if isinstance(p, str) or p[0] == "and" and all(isinstance(x, str) for x in p[1:])}
    parts = [p for p in parts if p not in flat or not any(flat[q] < flat[p] for q in flat)]  # a weaker one stands for it
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _spelt(strings):
    """The query of texts that hold one of the strings."""
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def _spell(node) -> set[str] | None:
    """All strings that a part of a pattern matches, in lower case, if there are few; None otherwise."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _spell_all(arg[3])
    if op is C.BRANCH:
        found = [_spell_all(p) for p in arg[1]]
        return None if None in found or sum(map(len, found)) > WIDEST else set().union(*found)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        one = _spell_all(inner)
        if one is None or high is C.MAXREPEAT or high > 8:
            return None
        out, now = set(), {""}
        for n in range(high + 1):
            if n >= low:
                out |= now
            now = {a + b for a in now for b in one}
            if len(out) + len(now) > WIDEST:
                return None
        return out
    return None


def _spell_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _spell(node)
        if one is None or len(out) * len(one) > WIDEST:
            return None
        out = {a + b for a in out for b in one}
    return out


def _query(nodes):
    parts, now = [], {""}
    for node in nodes:
        one = _spell(node)
        if one is not None and len(now) * len(one) <= WIDEST:
            now = {a + b for a in now for b in one}
            continue
        parts.append(_spelt(now))
        now = {""} if one is None else one
        op, arg = node
        if one is not None:
            continue
        if op is C.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif op is C.BRANCH:
            parts.append(_any(_query(p) for p in arg[1]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            own = _spell_all(arg[2])
            parts.append(_query(arg[2]) if own is None else _spelt({s * min(arg[0], 3) if len(own) == 1 else s for s in own}))
    return _all([*parts, _spelt(now)])


def trigram_query(pattern: str):
    return _query(list(parser.parse(pattern)))


def trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


# -- the index


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, segment: int = 4096) -> DataFrame:
    """(segment, trigram, postings): ascending ids of the segment's documents that hold the trigram, for every trigram
    that a rule's query names. About `segment` documents make a segment, dealt by the hash of the id."""
    wanted = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    segments = docs.count() // segment + 1
    low = docs.select("doc_id", F.lower(text_or_empty("text")).alias("low")).where("doc_id is not null")
    held = F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in wanted)))
    rows = low.select("doc_id", F.explode(held).alias("trigram"))
    rows = rows.withColumn("segment", F.pmod(F.xxhash64("doc_id"), F.lit(segments)))
    return rows.groupBy("segment", "trigram").agg(F.array_sort(F.collect_set("doc_id")).alias("postings"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): for each document that satisfies a rule's trigram query, the bits of those rules."""
    none = F.array().cast("array<bigint>")
    own = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("m"))

    def answer(query) -> Column:
        if isinstance(query, str):
            return F.coalesce(F.try_element_at("m", F.lit(query)), none)
        out = answer(query[1])
        for part in query[2:]:
            out = F.array_intersect(out, answer(part)) if query[0] == "and" else F.array_union(out, answer(part))
        return out

    asked = [(i, q) for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None]
    hits = own.select(F.explode(F.array(*(F.struct(F.lit(1 << i).cast("long").alias("bit"), answer(q).alias("ids")) for i, q in asked))).alias("h"))
    return hits.select("h.bit", F.explode("h.ids").alias("doc_id")).groupBy("doc_id").agg(F.bit_or("bit").alias("rules"))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, kind, end>> of a rule's matches, leftmost and non-overlapping, in code points: the pieces
    between matches and the matches' own lengths give the places. Matches whose group is too short are dropped."""
    pattern = F.lit(rule.pattern)
    whole, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    steps = F.arrays_zip(F.transform(F.slice(pieces, F.lit(1), F.size(whole)), F.length).alias("gap"), F.transform(whole, F.length).alias("own"), F.transform(kept, F.length).alias("group"))
    return let(steps, lambda x: F.flatten(let(_chunks(x), lambda chunks: F.transform(F.arrays_zip(chunks.alias("steps"), _offsets(chunks).alias("at")), lambda c: _placed(c, rule, number)))))


CHUNK = 64  # matches whose places are added up together


def let(value: Column, then) -> Column:
    """then(value) with value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _chunks(steps: Column) -> Column:
    """steps cut in pieces of CHUNK: an array grows by one element a step only within a piece, so the work grows with the
    number of matches and not with its square."""
    last = F.greatest(F.ceil(F.size(steps) / CHUNK).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(steps, i * CHUNK + 1, F.lit(CHUNK)))


def _offsets(chunks: Column) -> Column:
    """Where each piece begins in the text."""
    long = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + x["own"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(long, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])


def _placed(chunk: Column, rule: Rule, number: int) -> Column:
    """The spans of a piece's matches that are long enough."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x["own"]).alias("end")))
        return F.struct((start + x["own"]).alias("at"), F.when(x["group"] >= rule.least, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    return F.aggregate(chunk["steps"], F.struct(chunk["at"].alias("at"), empty.alias("found")), step, lambda s: s["found"])


def _scanned(rule: Rule) -> Rule:
    """A rule on a plain run of characters matches whole runs, so its least length can stand in the pattern, which
    spares the scan of every short run. No other rule may be changed so: a match dropped for its length still covers
    its text."""
    return Rule(rule.kind, rule.pattern[:-1] + "{%d,}" % rule.least, 0, 0) if rule.pattern == "[0-9a-f]+" else rule


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: doc_id and found, an array<struct<start, kind (number of the rule), end>> in order.

    Null texts count as empty. Rows without an id stand in no postings and are verified against every rule; rows that
    share an id are each verified. No rows give no rows; other columns are ignored.
    """
    own = docs.select("doc_id", text_or_empty("text").alias("text"))
    cand = save(candidates(build_index(own, rules), rules), "secret-candidates")
    own = maybe_in(own, cand, "doc_id", "may")  # only texts that may be candidates are shuffled
    met = own.where("may").join(cand, "doc_id", "left").select("doc_id", "text", F.coalesce("rules", F.lit(0)).alias("rules"))
    rest = own.where("not may").select("doc_id", "text", F.when(F.col("doc_id").isNull(), -1).otherwise(0).cast(cand.schema["rules"].dataType).alias("rules"))
    rows = met.unionByName(rest)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for i, r in enumerate(map(_scanned, rules)):
        full = trigram_query(r.pattern) is None
        may = F.col("text").rlike(r.pattern)
        may = may if full else (F.col("rules").bitwiseAND(F.lit(1 << i)) != 0) & may
        found.append(F.when(may, spans(F.col("text"), r, i)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the numbers of base spans by kind, the digest of the base spans, and all spans.

    As scan(): null texts count as empty, repeated rows and rows without an id are each scanned, no rows give no rows.
    """
    names = F.array(*(F.lit(r.kind) for r in RULES))

    def told(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    rows = scan(docs).withColumn("base", F.filter("found", lambda x: x["kind"] < len(BASE)))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
