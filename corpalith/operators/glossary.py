"""Glossary: terms found in a corpus, and questions expanded with the terms' other forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Acronyms that are common words, and technical noise that counts only with an expansion.
NOT_TERMS = (
    "THE AND FOR ARE BUT NOT YOU ALL ANY CAN HAD HER WAS ONE OUR OUT DAY GET HAS HIM HIS HOW MAN NEW NOW OLD SEE TWO WAY WHO BOY DID ITS LET PUT SAY SHE TOO USE NOTE ONLY THIS THAT WITH FROM WILL EACH WHEN THEY "
    "THEM THAN THEN BEEN MUST"
).split()
NOISE = "POST PUT GET DELETE PATCH HEAD JSON HTML XML CSV UTF ASCII".split()
#: A name before its acronym in brackets, an acronym before its name, and an acronym alone.
BEFORE = r"(?U)\b((?:[A-Z][A-Za-z'-]+\s+){1,6}[A-Z][A-Za-z'-]+)\s*\(([A-Z]{3,6})s?\)"
AFTER = r"(?U)\b([A-Z]{3,6})s?\s*\(((?:[A-Za-z'-]+\s+){1,6}[A-Za-z'-]+)\)"
ACRONYM = r"(?U)\b([A-Z]{3,6})s?\b"
#: Documents that must hold an acronym with an expansion, and one without.
MIN_DOCUMENTS, MIN_FREQUENT = 1, 3
SURE = {"expansion": 0.9, "frequency": 0.4}


def discover(docs: DataFrame) -> DataFrame:
    """(term, expansion, method, documents, occurrences, confidence) of the acronyms in ``docs(doc_id, text)``.

    The expansion is the one of the least document id. Without one a term needs three documents.
    Counts are made in each document first, so a frequent term makes one row a document.
    """
    pick = lambda pattern, i: F.regexp_extract_all("text", F.lit(pattern), F.lit(i))
    pairs = lambda pattern, term, name: F.arrays_zip(pick(pattern, term).alias("t"), pick(pattern, name).alias("n"))
    both = docs.select("doc_id", F.explode(F.concat(pairs(BEFORE, 2, 1), pairs(AFTER, 1, 2))).alias("p")).select("doc_id", F.col("p.t").alias("term"), F.regexp_replace("p.n", r"\s+", " ").alias("name"))
    named = both.groupBy("term").agg(F.min(F.struct("doc_id", "name")).alias("first")).select(F.col("term").alias("nt"), F.col("first.name").alias("expansion"))
    held = docs.select("doc_id", F.explode(pick(ACRONYM, 1)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    use = held.groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences")).where(~F.col("term").isin(*NOT_TERMS))
    out = use.join(named, F.col("term") == F.col("nt"), "left").where(F.col("expansion").isNotNull() | ((F.col("documents") >= MIN_FREQUENT) & ~F.col("term").isin(*NOISE)))
    method = F.when(F.col("expansion").isNotNull(), "expansion").otherwise("frequency")
    sure = F.when(method == "expansion", SURE["expansion"]).otherwise(SURE["frequency"]) + F.least(F.lit(0.1), F.col("documents") * 0.02)
    return out.select("term", "expansion", method.alias("method"), "documents", "occurrences", F.round(sure, 4).alias("confidence"))


def refreshed(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(term, expansion, status, documents): measured fields are renewed, judged ones stay; new terms are ``proposed``."""
    measured = found.select(F.col("term").alias("t"), F.col("expansion").alias("e"), F.col("documents").alias("d"))
    both = stored.join(measured, F.col("term") == F.col("t"), "full")
    judged = F.col("term").isNotNull() & (F.col("status") != "proposed")
    return both.select(F.coalesce("term", "t").alias("term"), F.when(judged, F.col("expansion")).otherwise(F.coalesce("e", "expansion")).alias("expansion"), F.coalesce("status", F.lit("proposed")).alias("status"), F.coalesce("d", F.lit(0).cast("long")).alias("documents"))


def expanded(question: Column, terms: dict[str, list[str]], most: int = 4) -> Column:
    """The forms to add to a question: of each term it names, as a whole word, those it does not hold, ``most`` in all.

    Forms under four letters are matched with their case. ``terms`` is the reviewed glossary, a bounded list.
    """

    def names(form: str) -> Column:
        pattern = (r"\b" if len(form) < 4 else r"(?i)\b") + r"\Q" + form + r"\E\b"
        return F.coalesce(question, F.lit("")).rlike(pattern)

    added = []
    for term in sorted(terms, key=lambda t: (-max(map(len, [t, *terms[t]])), t)):
        forms = [term, *terms[term]]
        hit = F.exists(F.array(*map(names, forms)), lambda x: x)
        added += [F.when(hit & ~names(f), F.lit(f)) for f in forms] if len(forms) > 1 else []
    if not added:
        return F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.filter(F.array(*added), lambda x: x.isNotNull())), 1, most)
