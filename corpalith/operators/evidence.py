"""From passages to answers: document types, extracted sentences, competing claims, and checks of expectations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpalith.functions import text as T

#: What a title names, with the type it gives; then markers of a body, of which three count.
TITLES = (
    ("policy", r"(?i)\b(policy|policies|standard|code of conduct)\b"), ("procedure", r"(?i)\b(runbook|playbook|how to|guide|procedure|sop)\b"), ("decision", r"(?i)\b(adr|decision record|rfc)\b"),
    ("specification", r"(?i)\b(spec|specification|requirements|prd)\b"), ("faq", r"(?i)\b(faq|frequently asked)\b"), ("notes", r"(?i)\b(notes|minutes|retro|standup|sync)\b"), ("report", r"(?i)\b(report|review|q[1-4]\s*20\d\d|annual)\b"),
)
BODIES = (
    ("decision", r"(?im)^\s*(status|context|decision|consequences)\s*:"), ("policy", r"(?i)\b(effective date|approved by|review date|policy owner)\b"), ("specification", r"(?i)\b(must|must not|should|shall)\b"),
)


def classify(mapped: Column, title: Column, body: Column) -> Column:
    """(doc_type, confidence): a mapped type, else what the title names, else body markers, else a page."""
    out = F.struct(F.lit("page").alias("doc_type"), F.lit(0.3).alias("confidence"))
    made = lambda kind, sure: F.struct(F.lit(kind).alias("doc_type"), F.lit(sure).alias("confidence"))
    for kind, pattern in reversed(BODIES):
        out = F.when(F.regexp_count(body, F.lit(pattern)) >= 3, made(kind, 0.65)).otherwise(out)
    for kind, pattern in reversed(TITLES):
        out = F.when(title.rlike(pattern), made(kind, 0.85)).otherwise(out)
    return F.when(mapped.isNotNull(), F.struct(mapped.alias("doc_type"), F.lit(1.0).alias("confidence"))).otherwise(out)


def extract_sentences(passages: DataFrame, most: int = 3) -> DataFrame:
    """(question_id, nth, marker, sentence, score): the sentences of ``passages(question_id, question, marker, passage)``
    with the most question terms for their length, without repeats."""
    rows = passages.withColumn("__asked", T.content_terms(F.col("question")))
    rows = rows.select("question_id", "marker", "__asked", F.posexplode(F.split("passage", r"[.!?\n]+")).alias("place", "sentence")).withColumn("sentence", F.trim("sentence")).where("sentence <> ''")
    rows = rows.withColumn("__terms", T.content_terms(F.col("sentence")))
    overlap = F.size(F.array_intersect("__asked", "__terms"))
    rows = rows.where(overlap > 0).withColumn("score", F.round(overlap / F.sqrt(F.size("__terms")), 6))
    best = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "marker", "place")
    once = Window.partitionBy("question_id", F.lower(F.substring("sentence", 1, 60))).orderBy(F.col("score").desc(), "marker", "place")
    rows = rows.withColumn("copy", F.row_number().over(once)).where("copy = 1").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most)
    return rows.select("question_id", "nth", "marker", "sentence", "score")


#: Words that are no unit, units of dates, words that say nothing about what is measured.
NO_UNIT = "the a an of to and or in on for with by from at as is are was were be per and following within least most more than about over under".split()
DATES = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday am pm".split()
NO_MEASURE = (
    "the a an of to and or in on for with by from at as is are was were be will may can your you our their this that these those it its per each "
    "assessed charged applied added billed costs cost amount amounts apply applies when where which that than more less up"
).split()
_QUANTITY = re.compile(r"(?P<money>[$£€]\s?)?(?P<value>\d[\d,]*(?:\.\d+)?)(?:\s+(?P<unit>[a-z]+))?", re.I)
_AGE = re.compile(r"\b(?:last\s+(?:updated|modified|edited|reviewed)|updated|posted|published)\b[^.\n]{0,40}?\b\d+\s+(?:second|minute|hour|day|week|month|year)s?\s+ago", re.I)


def claims_of(text: str) -> list[tuple[str, str, str, list[str]]]:
    """(unit, measure, value, words around) of the quantities that a text states.

    An amount of money is named by the words before it, a unit by those after it. Dates, years and
    relative ages state nothing.
    """
    text, out = _AGE.sub(" ", text), []
    for m in _QUANTITY.finditer(text):
        value, unit = m["value"].replace(",", ""), (m["unit"] or "").lower()
        around = sorted(set(w for w in re.findall("[a-z]{4,}", text[max(0, m.start() - 120) : m.end() + 120].lower()) if w not in NO_UNIT))
        if m["money"]:
            words = [w for w in re.findall("[a-z]+", text[max(0, m.start() - 80) : m.start()].lower()) if w not in NO_MEASURE]
            out.append(("currency", " ".join(["currency", *words[-2:]]), value, around))
        elif unit and unit not in NO_UNIT and unit not in DATES and not re.fullmatch(r"20\d\d", value):
            words = [w for w in re.findall("[a-z]+", text[m.end() :].lower())[:5] if w not in NO_MEASURE]
            out.append((unit, " ".join([unit, *words[:2]]), value, around))
    return out


def claims(passages: DataFrame) -> DataFrame:
    """(question_id, doc_id, scope, unit, measure, value, around) of ``passages(question_id, doc_id, scope, passage)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["question_id", "doc_id", "scope", "unit", "measure", "value", "around"]
        for frame in frames:
            yield pd.DataFrame([(r.question_id, r.doc_id, r.scope, *c) for r in frame.itertuples() for c in claims_of(r.passage or "")], columns=names)

    return passages.select("question_id", "doc_id", "scope", "passage").mapInPandas(run, "question_id long, doc_id long, scope string, unit string, measure string, value string, around array<string>")


def conflicts(found: DataFrame) -> DataFrame:
    """Pairs of claims of one question that state different values of the same measure in different documents.

    ``found`` holds the claims of selected passages, a bounded few for each question. Documents that
    declare different scopes may differ; the words around must overlap (3 or more, a quarter of the fewer).
    """
    a, b = found.alias("a"), found.alias("b")
    same = (F.col("a.question_id") == F.col("b.question_id")) & (F.col("a.unit") == F.col("b.unit")) & (F.col("a.measure") == F.col("b.measure")) & (F.col("a.measure") != "")
    differ = (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.value") != F.col("b.value")) & ~F.coalesce(F.col("a.scope") != F.col("b.scope"), F.lit(False))
    shared = F.size(F.array_intersect("a.around", "b.around"))
    near = (shared >= 3) & (shared >= F.least(F.size("a.around"), F.size("b.around")) * 0.25)
    return a.join(b, same & differ).where(near).select("a.question_id", "a.measure", F.col("a.doc_id").alias("doc_a"), F.col("a.value").alias("value_a"), F.col("b.doc_id").alias("doc_b"), F.col("b.value").alias("value_b")).distinct()


def check(cases: DataFrame) -> DataFrame:
    """``cases(case_id, kind, value, answer, grounded, cited)`` with ``failure``: why an expectation isn't met, or null.

    Texts are compared in lower case with white space folded; punctuation counts.
    """
    loose = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    value, kind = loose(F.col("value")), F.col("kind")
    in_cited = F.exists("cited", lambda c: loose(c).contains(value))
    said = loose(F.col("answer")).contains(value)
    failure = (
        F.when((kind == "answers") & ~F.col("grounded"), "refused").when((kind == "refuses") & F.col("grounded"), "answered").when((kind == "cites") & ~in_cited, "not cited")
        .when((kind == "cites_first") & ~F.coalesce(loose(F.get("cited", F.lit(0))).contains(value), F.lit(False)), "not first").when((kind == "cites_something") & (F.size("cited") == 0), "cited nothing")
        .when((kind == "says") & ~said, "not said").when((kind == "does_not_say") & said, "said").when(~kind.isin("answers", "refuses", "cites", "cites_first", "cites_something", "says", "does_not_say"), "unknown expectation")
    )
    return cases.withColumn("failure", failure)
