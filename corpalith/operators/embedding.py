"""A hashing embedder in DataFrame functions: words, their trigrams and neighbours in signed buckets of a unit vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.functions import text as T

DIMENSIONS = 384
WORD, TRIGRAM, NEIGHBOURS = 1.0, 0.35, 0.6


def _features(words: Column) -> Column:
    """Array of (feature, weight): each word, each letter trigram of ``^word$``, each pair of neighbours."""
    made = lambda f, w: F.struct(f.alias("feature"), F.lit(w).alias("weight"))
    marked = lambda x: F.concat(F.lit("^"), x, F.lit("$"))
    grams = F.flatten(F.transform(words, lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: made(F.concat(F.lit("#"), F.substring(marked(x), i, F.lit(3))), TRIGRAM))))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: made(F.concat(a, F.lit("_"), b), NEIGHBOURS)))
    none = F.array().cast("array<struct<feature:string,weight:double>>")
    return F.concat(F.transform(words, lambda x: made(x, WORD)), grams, F.coalesce(pairs, none))


def embed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, bucket, weight): the cells other than zero of each text's unit vector; a text without words has none.

    The bucket is the first 32 bits of the feature's md5 modulo ``dimensions``; the next digit gives the sign.
    Features are counted in their document before they are hashed, and cells are summed before the shuffle.
    """
    words = docs.select(F.col(id_col).alias("id"), T.tokens(F.coalesce(text_col, F.lit(""))).alias("words"))
    rows = words.select("id", F.inline(_features(F.col("words"))))
    digest = F.md5("feature")
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    cells = rows.select("id", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimensions).cast("int").alias("bucket"), (sign * F.col("weight")).alias("w"))
    sums = cells.groupBy("id", "bucket").agg(F.round(F.sum("w"), 6).alias("w")).where("w <> 0")
    norms = sums.groupBy(F.col("id").alias("nid")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(norms, F.col("id") == F.col("nid")).select("id", "bucket", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))
