"""A Merkle manifest of a dataset: digests of rows, of groups and of the whole, with a proof for each row.

Rows of a group are leaves in the order of their ids. Every ``FAN`` consecutive nodes become one, level
by level, until one remains; the groups' roots are the leaves of one more tree. The lowest levels of a
group are cut into aligned blocks. A block's proofs come from a fractal traversal: for each level it
holds the run of siblings around the current leaf (existing) and builds the next one leaf by leaf
(desired), so successive proofs need a few runs of digests and no tree. Blocks' roots are joined upwards
by Spark, a shuffle for each level, and their proofs are appended to those of the leaves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.llm.common import durable, like, stored
from corpalith.llm.ranks import one_by_one, ranked

FAN = 16
#: Levels of a block: it has FAN ** LEVELS leaves.
LEVELS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

PROVEN = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(values: Sequence[Column]) -> Column:
    """Hex sha256 of values one after another, each as its UTF-8 byte count, ``:`` and itself, or ``-`` if null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined(nodes: Column) -> Column:
    """The node above an array of nodes."""
    return F.sha2(F.array_join(nodes, "").cast("binary"), 256)


def _one_level_up(nodes: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(FAN))
    return F.transform(starts, lambda i: _joined(F.slice(nodes, i, FAN)))


def block_roots(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(key, pos, node, n) of the blocks of ``leaves(key, pos, total, leaf)``: n is the number of the key's blocks."""
    size = FAN**levels
    placed = leaves.groupBy("key", F.expr(f"pos div {size}").alias("block"), "total").agg(F.array_sort(F.collect_list(F.struct("pos", "leaf"))).alias("run"))
    nodes = placed.select("key", "block", "total", F.transform("run", lambda x: F.lower(F.hex(x["leaf"]))).alias("nodes"))
    for level in range(levels):
        nodes = nodes.withColumn("nodes", F.when(F.col("total") > FAN**level, _one_level_up(F.col("nodes"))).otherwise(F.col("nodes")))
    return nodes.select("key", F.col("block").alias("pos"), F.element_at("nodes", 1).alias("node"), F.ceil(F.col("total") / size).alias("n"))


def climb(nodes: DataFrame) -> DataFrame:
    """(key, pos, top, steps) for each of ``nodes(key, pos, node, n)``, where n is the number of the key's nodes.

    ``top`` is the key's root; ``steps`` are (left, right): the siblings on both sides, level by level.
    Each level has a sixteenth of the rows of the one below, so there are few levels at any size.
    """
    now, sides = durable(nodes), []
    finished = []
    while True:
        finished.append(now.where("n = 1").select("key", F.col("pos").alias("p"), F.col("node").alias("top")))
        rest = now.where("n > 1")
        if rest.isEmpty():
            break
        runs = rest.groupBy("key", F.expr(f"pos div {FAN}").alias("up"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("run"))
        runs = durable(runs.select("key", "up", "n", F.transform("run", lambda x: x["node"]).alias("run")))
        side = runs.select("key", "up", F.posexplode("run").alias("i", "node"), "run")
        left, right = F.array_join(F.slice("run", F.lit(1), F.col("i")), ""), F.array_join(F.slice("run", F.col("i") + 2, F.lit(FAN)), "")
        sides.append(side.select("key", "up", (F.col("up") * FAN + F.col("i")).alias("pos"), F.struct(left.alias("left"), right.alias("right")).alias("step")))
        now = durable(runs.select("key", F.col("up").alias("pos"), _joined(F.col("run")).alias("node"), F.ceil(F.col("n") / FAN).alias("n")))
    none = F.array().cast("array<struct<left string, right string>>").alias("steps")
    above = finished[-1].select("key", "p", "top", none)
    for level in reversed(range(len(sides))):
        over = above.select(F.col("key").alias("k"), F.col("p").alias("u"), "top", "steps")
        climbed = sides[level].join(over, (F.col("key") == F.col("k")) & (F.col("up") == F.col("u")))
        climbed = climbed.select("key", F.col("pos").alias("p"), "top", F.concat(F.array("step"), "steps").alias("steps"))
        above = durable(climbed.union(finished[level].select("key", "p", "top", none)))
    return above.select("key", F.col("p").alias("pos"), "top", "steps")


class _Run:
    """Siblings of one level, built from the leaves below them, one leaf at a time."""

    def __init__(self, level: int):
        self.partial: list[list[str]] = [[] for _ in range(level + 1)]

    def push(self, leaf: str) -> None:
        self.partial[0].append(leaf)
        for low, high in zip(self.partial, self.partial[1:], strict=False):
            if len(low) < FAN:
                break
            high.append(_node(low))
            low.clear()

    def siblings(self) -> list[str]:
        """The run; a last node with fewer leaves is closed."""
        for low, high in zip(self.partial, self.partial[1:], strict=False):
            if low:
                high.append(_node(low))
                low.clear()
        return self.partial[-1]


def _node(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def traverse(leaves: Sequence[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """Of each leaf in turn the (left, right) siblings of ``height`` levels, from the lowest up.

    Beside the leaves only an existing and a desired run of ``FAN`` digests are held for each level.
    At every step each desired run takes one leaf, so it is complete when its turn comes.
    """
    spans = [FAN ** (level + 1) for level in range(height)]
    existing = []
    for level, span in enumerate(spans):
        run = _Run(level)
        for leaf in leaves[:span]:
            run.push(leaf)
        existing.append(run.siblings())
    desired, ahead = [_Run(level) for level in range(height)], list(spans)
    for i in range(len(leaves)):
        path = []
        for level, span in enumerate(spans):
            if i and i % span == 0:
                existing[level], desired[level] = desired[level].siblings(), _Run(level)
            if ahead[level] < len(leaves):
                desired[level].push(leaves[ahead[level]])
                ahead[level] += 1
            at = i * FAN // span % FAN
            run = existing[level]
            path.append(("".join(run[:at]), "".join(run[at + 1 :])))
        yield path


def fold(node: str, steps: Sequence[tuple[str, str]]) -> str:
    """The root that a node and its siblings lead to."""
    for left, right in steps:
        node = sha256(f"{left}{node}{right}".encode()).hexdigest()
    return node


def height_of(total: int, most: int) -> int:
    """Levels of a tree of ``total`` leaves, ``most`` at most."""
    height = 0
    while height < most and FAN**height < total:
        height += 1
    return height


def proven(leaves: DataFrame, uppers: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Each of ``leaves(key, pos, total, id, leaf, shown)`` with its proof, hashed, and what its ``shown`` leaf (or else its own) folds to.

    ``uppers(k, b, subroot, root, steps)`` has a row for each block of ``FAN ** levels`` leaves, which is
    what a task holds at a time.
    """
    kind = leaves.schema["id"].dataType.simpleString()

    def run(block: pa.Table, upper: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block["pos"]))
        above = upper.to_pylist()[0]
        steps = [(s["left"], s["right"]) for s in above["steps"]]
        tail = "".join(left + right for left, right in steps)
        own = [x.hex() for x in block["leaf"].to_pylist()]
        shown = [x.hex() if x is not None else y for x, y in zip(block["shown"].to_pylist(), own, strict=True)]
        folded: dict[str, str] = {}
        out: list[list] = [[], [], []]
        for at, path in enumerate(traverse(own, height_of(block["total"][0].as_py(), levels))):
            node = fold(shown[at], path)
            if node not in folded:
                folded = {**(folded if len(folded) < 1024 else {}), node: fold(node, steps)}
            text = "".join(left + right for left, right in path) + tail
            for column, value in zip(out, (sha256(text.encode()).hexdigest(), folded[node], folded[node] == above["root"]), strict=True):
                column.append(value)
        same = [pa.array([above[c]] * len(own), pa.string()) for c in ("subroot", "root")]
        return pa.Table.from_arrays([block["id"], pa.array(own), *same, pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.bool_())], names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    blocks = leaves.withColumn("block", F.expr(f"pos div {FAN**levels}"))
    return blocks.groupBy("key", "block").cogroup(uppers.groupBy("k", "b")).applyInArrow(run, f"id {kind}, {PROVEN}")


def manifest(docs: DataFrame, shown: dict[str, Column] | None = None, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", levels: int = LEVELS) -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    A leaf digests ``columns``; leaves of a group ascend by ``id_col``, a null id first and equal ids by
    their digests, so reruns agree. Groups ascend by their UTF-8 bytes, a null one first. Repeated rows
    are leaves of their own. ``shown`` says, by column, what is shown for verification instead of the
    row: ``folded_root`` is what the shown row and the original siblings lead to, and ``verified`` whether
    that is the root. Columns that aren't named in ``columns`` play no part; an empty table gives no rows.
    """
    rows = like(docs, *dict.fromkeys((*columns, id_col, group_col)))
    # The group without nulls, in the same order.
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{group_col}`").cast("string")), F.lit("n")).alias("key")
    own = leaf_digest([F.col(f"`{c}`") for c in columns])
    other = leaf_digest([(shown or {}).get(c, F.col(f"`{c}`")) for c in columns]) if shown else F.lit(None).cast("string")
    digests = rows.select(F.col(f"`{id_col}`").alias("id"), key, own.alias("leaf"), other.alias("shown"))
    digests = digests.select("id", "key", F.unhex("leaf").alias("leaf"), F.unhex(F.when(F.col("shown") != F.col("leaf"), F.col("shown"))).alias("shown"))
    digests = stored(digests.groupBy("key", "id", "leaf", "shown").agg(F.count("*").alias("times")))
    if (digests.agg(F.max("times")).first()[0] or 1) > 1:
        digests = stored(one_by_one(digests, "times"))
    else:
        digests = digests.withColumn("copy", F.lit(0).cast("long"))
    leaves = stored(ranked(digests.drop("times"), "key", ["id", "leaf", "copy"]).drop("copy"))

    subtrees = climb(block_roots(leaves, levels))
    tops = stored(subtrees.where("pos = 0").select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("top").alias("node")))
    tops = ranked(tops, "key", ["group"]).withColumnRenamed("total", "n")
    tops = durable(tops)
    over = climb(tops.drop("group")).select(F.col("pos").alias("g"), F.col("top").alias("root"), F.col("steps").alias("rest"))
    over = tops.join(over, F.col("pos") == F.col("g")).select("group", "root", "rest")
    uppers = subtrees.join(over, F.col("key") == F.col("group"))
    uppers = durable(uppers.select(F.col("key").alias("k"), F.col("pos").alias("b"), F.col("top").alias("subroot"), "root", F.concat("steps", "rest").alias("steps")))
    return proven(leaves, uppers, levels).withColumnRenamed("id", id_col)
