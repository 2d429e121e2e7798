"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame operations only.

A test item with q distinct shingles is contained in a document if the document has at least
``ceil(threshold * q)`` of them. Items are partitioned by size (powers of two), and each keeps
as sketch its ``q - ceil(threshold * q) + 1`` shingles of least hash: a document that contains
the item misses fewer shingles than that, so it shares at least one of the sketch, and the
search has full recall. A size partition takes part in a document's search only if the document
has enough shingles for the partition's smallest item; the document's sketch is every shingle
whose hash is at or under the largest one in the sketches of those partitions. Long documents are
searched whole, without fixed-length signatures that would drown short items. A candidate also
needs as many shingles as its item asks for, and is verified on the shingles themselves.

The item table is broadcast only if its counted size allows; else the sketches are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.llm.common import BROADCAST_BYTES, durable, hot_join, like, small

SHINGLE = 5
THRESHOLD = 0.8


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; case, punctuation and white space don't count."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, k: int) -> Column:
    """Hash of each run of k words; of the whole sequence if it is shorter; none for no words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(*(F.element_at(words, i + d) for d in range(k))))
    return F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(words: Column, k: int) -> Column:
    """The distinct shingles as texts."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.concat_ws(" ", *(F.element_at(words, i + d) for d in range(k))))
    return F.array_distinct(F.when(n >= k, runs).when(n > 0, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>")))


def item_sketches(items: DataFrame, item_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """(item_id, part, need, hash): the sketch of every item; part is the size partition, need the shingles a document must share."""
    picked = like(items, item_col, text_col).toDF("item_id", "text").where("item_id is not null").distinct()
    split = picked.select("item_id", tokens(F.coalesce("text", F.lit(""))).alias("words"))
    sets = split.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.col("words"), k))).alias("hs")).withColumn("q", F.size("hs")).where("q > 0")
    need = F.ceil(F.col("q") * F.lit(threshold) - 1e-9).cast("int")
    return sets.select("item_id", F.floor(F.log2("q")).cast("int").alias("part"), need.alias("need"), F.explode(F.slice("hs", F.lit(1), F.col("q") - need + 1)).alias("hash"))


def _limit(n: Column, parts: list[tuple[int, int, int]]) -> Column:
    """The largest hash that a document of ``n`` shingles has to probe, by (part, least need, largest hash) of each size partition."""
    out, top = F.lit(None).cast("bigint"), None
    for _, need, largest in sorted(parts):
        top = largest if top is None else max(top, largest)
        out = F.when(n >= need, F.lit(top)).otherwise(out)
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every item contained in a document.

    Containment is over distinct shingles of ``k`` words. An item of fewer than ``k`` words is
    one shingle and is found only in documents that are just those words; one without words
    matches nothing. Null ids and null or empty texts match nothing; repeated rows are one.
    """
    sketch = durable(item_sketches(items, item_col, item_text, k, threshold))
    # One row for each power of two that an item's size can be.
    sized = sketch.groupBy("part").agg(F.min("need"), F.max("hash"), F.count("*")).collect()
    held, top = sum(r[3] for r in sized), max((r[2] for r in sized), default=-(1 << 63))
    picked = like(docs, id_col, text_col).toDF("doc_id", "text").where("doc_id is not null and text is not null")
    words = picked.select("doc_id", tokens(F.col("text")).alias("words"))
    hashes = F.filter(shingle_hashes(F.col("words"), k), lambda h: h <= F.lit(top))
    # n is made before the generator: made beside it, it would be made anew from the words, which every row would carry.
    counted = words.select("doc_id", "words", F.greatest(F.size("words") - k + 1, F.lit(1)).alias("n"))
    probes = counted.select("doc_id", "n", F.explode(hashes).alias("hash")).where(F.col("hash") <= _limit(F.col("n"), [tuple(r)[:3] for r in sized]))
    met = probes.join(small(sketch.select("item_id", "need", "hash"), held), "hash").where("n >= need")
    pairs = durable(met.select("doc_id", "item_id").distinct())

    # The words are a column of their own: inside the shingles' lambda they would be split again for every shingle.
    texts = like(items, item_col, item_text).toDF("item_id", "item_text").where("item_id is not null").distinct()
    texts = texts.select("item_id", F.xxhash64("item_text").alias("item_th"), tokens(F.coalesce("item_text", F.lit(""))).alias("words"))
    wanted = texts.select("item_id", "item_th", shingle_texts(F.col("words"), k).alias("wanted")).select("item_id", "item_th", F.size("wanted").alias("q"), F.explode("wanted").alias("want"))
    wide = wanted.agg(F.coalesce(F.sum(F.octet_length("want") + 48), F.lit(0))).first()[0]
    found = pairs.select("doc_id").distinct()
    picked = picked.join(small(found.withColumnRenamed("doc_id", "hit_id"), found.count()), F.col("doc_id") == F.col("hit_id"), "left_semi")
    have = picked.distinct().select("doc_id", F.xxhash64("text").alias("th"), tokens(F.col("text")).alias("words")).select("doc_id", "th", F.explode(shingle_texts(F.col("words"), k)).alias("have"))
    # A shingle of a document meets the items that have it: rows grow with what is shared, and no document is copied for an item.
    shared = have.join(small(wanted, 1, wide), F.col("have") == F.col("want")) if wide <= BROADCAST_BYTES else hot_join(have, wanted, [("have", "want")])
    counted = shared.groupBy("doc_id", "th", "item_id", "item_th").agg(F.first("q").alias("q"), F.count("*").alias("n_shared")).where(F.col("n_shared") >= F.ceil(F.col("q") * F.lit(threshold) - 1e-9))
    counted = counted.join(pairs.toDF("p_doc", "p_item"), (F.col("doc_id") == F.col("p_doc")) & (F.col("item_id") == F.col("p_item")), "left_semi")
    checked = counted.select("doc_id", "item_id", F.col("q").cast("long").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"))
    return checked.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"), F.max("containment").alias("containment"))
