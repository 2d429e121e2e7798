"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Targets: weights share ``share`` of all tokens; a target stops at ``most`` times its source's
size, and what is over is shared again by weight. As the result is ``min(most * size, level *
weight)``, the level follows from running sums over sources ordered by size / weight.

Seats are blocks of ``block`` tokens. The N highest quotients target / (2 s + 1) win; a source
has floor((target / q + 1) / 2) quotients of at least q, so all but at most two seats a source
follow from two such bounds, and only the quotients between them are ranked. The same rule then
deals a source's seats to its shards by their sizes, in steps of ``FAN`` at most: to groups of
shards, then inside each group, so no task ranks all shards of a source. A shard takes its
documents in seeded order: whole passes first, then evenly spaced blocks from a seeded offset,
found by arithmetic. Large sources get many shards, by words and by rows, so no task holds a
source. Equal rows are one row with a number until their words are counted out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpalith.llm.common import durable, like, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 16
#: Words and distinct rows of a shard, about, and shards or groups of them that are ranked together at most.
SHARD, ROWS, FAN = 100_000, 10_000, 1024
SEED = 7


def text_hash(text: Column, seed: int = SEED) -> Column:
    """Tells rows with the same id and other texts apart."""
    return F.xxhash64(text, F.lit(seed))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes(source, weight, source_size)`` with its ``target``. Sources number far fewer than documents."""
    every = Window.orderBy(F.col("cap") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    rows = sizes.withColumn("cap", F.col("source_size") * F.lit(most))
    rows = rows.withColumn("all", F.sum("source_size").over(whole) * F.lit(share)).withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(every), F.lit(0)))
    rows = rows.withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(every), F.lit(0.0))).withColumn("level", F.col("left") / F.col("left_weight"))
    rows = rows.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    rows = rows.withColumn("level", F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "source"))).over(whole))
    return rows.select(*sizes.columns, F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def sainte_lague(claims: DataFrame, group: list[str], key: list[str], votes: str, seats: Column) -> DataFrame:
    """``claims`` with ``quota``: seats of each group dealt by the highest quotients votes / (2 s + 1).

    ``seats`` is a group's number of seats. Equal quotients go to the lesser key. Claims without
    votes get none.
    """
    over = Window.partitionBy(*(group or [F.lit(0)]))
    rows = claims.withColumn("__n", seats.cast("double")).withColumn("__v", F.sum(votes).over(over)).withColumn("__k", F.count(F.when(F.col(votes) > 0, 1)).over(over))

    def at_least(bound: Column) -> Column:
        return F.when((F.col(votes) > 0) & (F.col("__n") > 0), F.greatest(F.lit(0), F.floor((F.col(votes) / F.col("__v") * bound + 1) / 2))).otherwise(F.lit(0)).cast("long")

    rows = rows.withColumn("__low", F.when(2 * F.col("__n") > F.col("__k"), at_least(2 * F.col("__n") - F.col("__k"))).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("__high", at_least(2 * F.col("__n") + F.col("__k")) + F.when((F.col(votes) > 0) & (F.col("__n") > 0), 1).otherwise(0))
    rows = rows.withColumn("__open", F.col("__n") - F.sum("__low").over(over))
    names = [*group, *key]
    tries = rows.where("__high > __low").select(*names, "__open", votes, F.explode(F.sequence(F.col("__low"), F.col("__high") - 1)).alias("__s"))
    rank = F.row_number().over(over.orderBy((F.col(votes) / (2 * F.col("__s") + 1)).desc(), *key, "__s"))
    won = tries.withColumn("__r", rank).where("__r <= __open").groupBy(*names).agg(F.count("*").alias("__won"))
    on = won.select(*(F.col(c).alias(f"__{c}") for c in names), "__won")
    same = None
    for c in names:
        same = rows[c].eqNullSafe(on[f"__{c}"]) if same is None else same & rows[c].eqNullSafe(on[f"__{c}"])
    return rows.join(on, same, "left").select(*claims.columns, (F.col("__low") + F.coalesce("__won", F.lit(0))).alias("quota"))


def shard_quotas(held: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """``held(nth, shard_no, seats, held)`` with each shard's ``quota`` of its source's ``seats``; ``most`` is the largest number of shards."""
    width = 1
    while width * fan < most:
        width *= fan
    group: list[str] = []
    rows = held.withColumn("quota", F.col("seats"))
    while width:
        name = f"g{width}"
        rows = rows.withColumn(name, F.floor(F.col("shard_no") / width))
        sums = rows.withColumnRenamed("quota", "given").groupBy("nth", *group, name, "given").agg(F.sum("held").alias("votes"))
        dealt = sainte_lague(sums, ["nth", *group], [name], "votes", F.col("given")).withColumnRenamed("quota", "dealt")
        on = dealt.select(F.col("nth").alias("n2"), F.col(name).alias("d2"), "dealt")
        rows = rows.join(on, (F.col("nth") == F.col("n2")) & (F.col(name) == F.col("d2"))).drop("quota", "n2", "d2").withColumnRenamed("dealt", "quota")
        group, width = [name], width // fan
    return rows.select("nth", "shard_no", "held", "quota")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, text_hash, shard_no, size, source_size, target, quota, times, copy, taken) for each document, and its columns ``keep``.

    ``size`` is the number of words (null text: 0) and ``taken`` how many words the mix takes of
    the document, repeats counted: at most ``most`` times its size. Weights repeat over sources in
    code point order, a null source last; sources number far fewer than documents. ``quota`` is
    the shard's number of blocks. The order in a shard depends on the seed, the id and the text
    only, so reruns agree. Rows equal in id, source, text and ``keep`` come out one by one, with
    their number ``times`` and a ``copy`` from 0. Null ids take part. An empty table, or one
    without words, takes nothing.
    """
    picked = like(docs, id_col, text_col, source_col, *keep).toDF("doc_id", "text", "source", *keep)
    rows = picked.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"), text_hash(F.col("text"), seed).alias("th"))
    rows = durable(rows.groupBy("doc_id", "source", *keep, "size", "th").agg(F.count("*").alias("times")))
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("rows"))
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    weighed = sums.withColumn("nth", order - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("nth") % len(weights) + 1).cast("int")))
    aimed = targets(weighed, share, most)
    whole = F.sum("target").over(Window.partitionBy(F.lit(0)))
    seated = sainte_lague(aimed, [], ["nth"], "target", F.round(whole / block))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard), F.ceil(F.col("rows") / ROWS))
    seated = durable(seated.withColumn("shards", shards.cast("long")).drop("rows").withColumnRenamed("quota", "seats"))

    placed = rows.join(seated.withColumnRenamed("source", "s"), rows.source.eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("at", F.xxhash64("doc_id", "th", F.lit(seed))).withColumn("shard_no", F.pmod(F.xxhash64("at"), F.col("shards")))
    placed = placed.withColumn("words", F.col("size") * F.col("times"))
    held = placed.groupBy("nth", "shard_no", "seats").agg(F.sum("words").alias("held"))
    dealt = shard_quotas(held, seated.agg(F.max("shards")).first()[0] or 1)

    line = Window.partitionBy("nth", "shard_no").orderBy("at", "doc_id", "size", "th", *keep)
    lined = placed.withColumn("stop", F.sum("words").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("first", F.col("stop") - F.col("words"))
    lined = lined.join(dealt.withColumnsRenamed({"nth": "n2", "shard_no": "s2"}), (F.col("nth") == F.col("n2")) & (F.col("shard_no") == F.col("s2")))
    tokens = F.least(F.col("quota") * block, F.floor(F.col("held") * F.lit(most)))
    lined = lined.withColumn("passes", F.when(F.col("held") > 0, F.floor(tokens / F.col("held"))).otherwise(0)).withColumn("over", tokens - F.col("passes") * F.col("held"))
    blocks = F.ceil(F.col("held") / block)
    lined = lined.withColumn("blocks", blocks).withColumn("chosen", F.least(blocks, F.round(F.col("over") / block))).withColumn("turn", F.pmod(F.xxhash64("nth", "shard_no", F.lit(seed)), F.greatest(blocks, F.lit(1))))
    lined = lined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    lined = lined.withColumn("start", F.col("first") + F.col("copy") * F.col("size")).withColumn("stop", F.col("start") + F.col("size"))

    def before(position: Column) -> Column:
        """Words of chosen blocks ahead of a position in the shard's line."""
        nth = F.floor(position / block)
        count = lambda i: F.floor((i + F.col("turn")) * F.col("chosen") / F.col("blocks"))
        return (count(nth) - count(F.lit(0))) * block + (count(nth + 1) - count(nth)) * (position % block)

    taken = F.col("passes") * F.col("size") + F.when(F.col("blocks") > 0, before(F.col("stop")) - before(F.col("start"))).otherwise(0)
    return lined.select("doc_id", "source", F.col("th").alias("text_hash"), "shard_no", "size", "source_size", "target", "quota", "times", "copy", F.least(taken, F.floor(F.col("size") * F.lit(most))).cast("long").alias("taken"), *keep)
