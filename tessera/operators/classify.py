"""Rule classifiers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.rules import first_bytes

# The cues of each kind of literature.
CUES = {
    "materia_medica": ("materia medica", "modalities", "aggravation", "amelioration", "mental symptoms", "remedy picture", "leading symptoms"),
    "repertory": ("repertory", "rubric", "rubrics", "remedies under", "grade of remedies", "mind; fear", "generalities;"),
    "organon_philosophy": ("aphorism", "organon", "vital force", "similia similibus", "philosophy of homoeopathy"),
    "therapeutics": ("therapeutics", "indications for", "treatment of", "clinical indications", "differential diagnosis"),
    "provings": ("proving", "prover", "pathogenetic", "healthy volunteers", "drug proving"),
    "clinical_cases": ("case report", "case history", "patient presented", "follow-up visit", "clinical case"),
    "research": ("randomized", "randomised", "placebo-controlled", "systematic review", "meta-analysis", "confidence interval", "trial registration"),
}
NARRATIVE = ("patient", "called to", "prescribed", "recovery", "aged", "suffering")
STRONG = ("materia medica", "remedy picture", "leading symptoms")
# What divides a row's heading from its items, lengths in bytes of both, and how cases are numbered.
DIVIDER, HEADING, ITEM, NUMBERED_CASE = r"\s*(?:--|—|:)\s*", (3, 120), (1, 28), r"(?i)\bcase\s+[0-9]+\b"
PROFILE = ("modalities", "aggravation", "amelioration", "relationship", "relationships")

# For each kind of evidence, alternatives of (any of these, and any of these, and none of these).
RANDOMISED, SHOWN = ("participants were randomized", "participants were randomised"), ("results showed",)
EVIDENCE = (
    ("study_protocol", ("not initiated or registered", "trial has not been initiated"), (), ()),
    ("study_protocol", ("study protocol", "trial protocol", "protocol for a", "protocol of a"), (), (*RANDOMISED, *SHOWN)),
    ("systematic_review", ("systematic review", "meta-analysis", "meta analysis"), ("search strategy", "database search", "databases were searched", "pooled estimate", "prisma"), ()),
    ("trial_registration", ("trial registration", "clinicaltrials.gov", "ctri/"), (), (*RANDOMISED, *SHOWN, "primary outcome was")),
    ("published_case", ("case report", "case series"), ("patient", "patients", "case presentation"), ()),
    ("observational_study", ("observational study", "cohort study", "case-control study", "cross-sectional study"), ("participants", "patients", "methods", "results"), ()),
    ("trial_study", ("randomized controlled trial", "randomised controlled trial", "randomized clinical trial", "randomised clinical trial"), ("results", "outcomes", *RANDOMISED), ()),
    ("guideline_safety", ("clinical practice guideline", "practice guideline", "safety guideline"), ("recommendation", "recommendations"), ()),
)


def any_of(low: Column, cues: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (low.contains(c) for c in cues), F.lit(False))


def cue_score(low: Column, cues: tuple[str, ...]) -> Column:
    """How many of the cues a lower-cased text holds."""
    return reduce(lambda a, b: a + b, (low.contains(c).cast("int") for c in cues))


def let(value: Column, then) -> Column:
    """then(value) with value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def rubric_shaped(line: Column) -> Column:
    """A row of a heading and three or more short abbreviations."""
    parts = F.split(F.regexp_replace(line, rf"^{T.SPACE}+|{T.SPACE}+$", ""), DIVIDER, 2)
    short = F.filter(F.split(F.get(parts, F.lit(1)), ","), lambda x: F.octet_length(F.trim(x)).between(*ITEM) & x.contains(".") & (F.size(F.split(F.trim(x), r"\s+")) <= 4))
    return F.coalesce((F.size(parts) == 2) & F.octet_length(F.get(parts, F.lit(0))).between(*HEADING) & (F.size(short) >= 3), F.lit(False))


def literature(content: Column, threshold: int = 2) -> Column:
    """struct<categories, state>: the kinds of literature with enough cues, sorted; unclassified where there are none."""
    lines = F.split(content, "\n")
    found = F.struct(
        F.lower(content).alias("low"),
        F.size(F.filter(lines, rubric_shaped)).alias("rows"),
        F.array_distinct(F.filter(F.transform(lines, T.section_label), lambda x: x != "")).alias("labels"),
        (F.size(F.regexp_extract_all(content, F.lit(NUMBERED_CASE), F.lit(0))) >= 2).alias("cases"),
    )

    def chosen(x: Column) -> Column:
        low, rows, labels = x["low"], x["rows"], x["labels"]
        profile = (rows < 3) & (F.size(labels) >= 4) & F.arrays_overlap(labels, F.array(*map(F.lit, PROFILE)))
        score = {c: cue_score(low, cues) for c, cues in CUES.items()}
        score["materia_medica"] = F.when((rows >= 3) & ~any_of(low, STRONG), 0).otherwise(score["materia_medica"] + F.when(profile, 2).otherwise(0))
        score["repertory"] = score["repertory"] + F.when(rows >= 3, 2).otherwise(0)
        score["clinical_cases"] = score["clinical_cases"] + F.when(x["cases"], 1 + (cue_score(low, NARRATIVE) >= 2).cast("int")).otherwise(0)
        return F.array_compact(F.array(*(F.when(score[c] >= threshold, F.lit(c)) for c in sorted(score))))

    def told(kinds: Column) -> Column:
        none = F.size(kinds) == 0
        return F.struct(F.when(none, F.array(F.lit("unclassified"))).otherwise(kinds).alias("categories"), F.when(none, "uncertain").otherwise("suggested").alias("state"))

    return let(let(found, chosen), told)


def evidence_type(content: Column, opening: int = 8000) -> Column:
    """The kind of evidence that the opening bytes of a text describe; the first rule that holds decides."""

    def kind_of(low: Column) -> Column:
        out = F.lit("unknown")
        for kind, one, also, never in reversed(EVIDENCE):
            holds = any_of(low, one) & ~any_of(low, never)
            out = F.when(holds & any_of(low, also) if also else holds, kind).otherwise(out)
        return out

    return let(F.lower(first_bytes(content, opening)), kind_of)
