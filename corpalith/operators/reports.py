"""Reports on the corpus: vocabulary in use, probes, coverage of collections, refresh queues, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpalith.functions import text as T


def term_use(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, documents, occurrences) of ``terms(term)``, lower-case words, in ``docs(doc_id, text)``; unused terms have zeros.

    Documents are split into words and joined by equality, so no term is searched in every text.
    Words are counted in their document first, so a frequent word makes one row a document.
    """
    words = docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    used = words.groupBy("word").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))
    found = terms.select("term").distinct().join(used, F.col("term") == F.col("word"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("term", zero("documents"), zero("occurrences"))


#: What may stand between a title and the name of its site.
SEPARATORS = (" | ", " - ", " – ", " :: ")


def common_suffix(titles: DataFrame) -> DataFrame:
    """(suffix, n, share) of the separator and tail that most titles end with; no row unless 3 titles and 70 % of all do."""
    total = titles.agg(F.count("title").alias("total"))
    tails = F.array(*(F.when(F.contains("title", F.lit(s)), F.concat(F.lit(s), F.substring_index("title", s, -1))) for s in SEPARATORS))
    counts = titles.select(F.explode(F.filter(tails, lambda x: x.isNotNull())).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.col("n").desc(), "suffix").limit(1)
    return best.join(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(3.0), F.col("total") * 0.7)).select("suffix", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def probe(hits: DataFrame, readable: Column, found: Column) -> DataFrame:
    """(check_no, name, passed, detail) of the checks of a connector, over its index entries.

    A failed first or second check leaves the later ones unmade (passed is null).
    """
    n = lambda c: F.count(F.when(c, 1))
    seen = hits.agg(F.count("*").alias("n"), n(found).alias("found"), n(found & readable).alias("readable"), n(F.col("age_days").isNotNull()).alias("dated"))
    rate = F.coalesce(F.round(F.try_divide("found", "n"), 4), F.lit(0.0))
    made = [
        ("index answers", F.col("n") > 0, F.col("n").cast("double")), ("documents resolve", F.col("found") > 0, F.col("found").cast("double")), ("resolution rate", rate >= 0.8, rate),
        ("principal can read", F.col("readable") > 0, F.col("readable").cast("double")), ("documents are dated", F.col("dated") > 0, F.col("dated").cast("double")),
    ]
    early = made[0][1] & made[1][1]
    cells = [F.struct(F.lit(i).alias("check_no"), F.lit(name).alias("name"), (ok if i <= 2 else F.when(early, ok)).alias("passed"), value.alias("detail")) for i, (name, ok, value) in enumerate(made, 1)]
    return seen.select(F.inline(F.array(*cells)))


def spread(docs: DataFrame, limit: int = 6) -> DataFrame:
    """(kb, doc_id, section, place) of starter documents of ``docs(kb, section, doc_id, weight)``: the heaviest of each section first, then the next ones.

    A window over one section would sort a hot section in one task; the ``limit`` heaviest of a
    section are enough, and are kept by an aggregation that combines before the shuffle.
    """
    order = F.struct((-F.col("weight")).alias("w"), F.col("doc_id").alias("d"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    nth = F.row_number().over(Window.partitionBy("kb", "section", part).orderBy(order))
    few = docs.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")
    inside = F.row_number().over(Window.partitionBy("kb", "section").orderBy(order))
    ranked = few.withColumn("inside", inside).where(F.col("inside") <= limit)
    place = F.row_number().over(Window.partitionBy("kb").orderBy(F.col("inside") > 1, order))
    return ranked.withColumn("place", place).where(F.col("place") <= limit).select("kb", "doc_id", "section", "place")


def overlap(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(collections, documents): how many documents are in no collection, in one, in several."""
    held = members.groupBy(F.col("doc_id").alias("m")).agg(F.count_distinct("collection").alias("n"))
    joined = docs.join(held, F.col("doc_id") == F.col("m"), "left")
    return joined.groupBy(F.coalesce("n", F.lit(0).cast("long")).alias("collections")).agg(F.count("*").alias("documents"))


def metrics(ranked: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(question_id, wanted, found, recall, reciprocal_rank) at ``k`` of ``ranked(question_id, doc_id, rank)`` against ``wanted(question_id, doc_id)``."""
    top = ranked.where(F.col("rank") <= k).select(F.col("question_id").alias("q"), F.col("doc_id").alias("d"), "rank")
    joined = wanted.distinct().join(top, (F.col("question_id") == F.col("q")) & (F.col("doc_id") == F.col("d")), "left")
    out = joined.groupBy("question_id").agg(F.count("*").alias("wanted"), F.count("rank").alias("found"), F.min("rank").alias("first"))
    return out.select("question_id", "wanted", "found", F.round(F.col("found") / F.col("wanted"), 4).alias("recall"), F.coalesce(F.round(1 / F.col("first"), 4), F.lit(0.0)).alias("reciprocal_rank"))
