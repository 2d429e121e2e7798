import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from corpalith.llm import merkle
from corpalith.llm.ranks import one_by_one, ranked

ROW = "doc_id long, source string, lang string, n_chars long, text string"


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """All levels of nodes, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([hashed(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    steps = []
    for nodes in levels[:-1]:
        run = at // 16 * 16
        steps.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])))
        at //= 16
    return steps


def by_hand(rows, shown):
    """Whole trees in memory; ``shown(row)`` is the row that is shown."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    names = sorted(groups, key=lambda s: b"" if s is None else b"s" + s.encode())
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = path(trees[s], at) + path(top, i)
            node = leaf_of(*shown(row))
            for left, right in steps:
                node = hashed(left, node, right)
            out.append((row[0], leaf, trees[s][-1][0], top[-1][0], hashed(*(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


def lowered(row):
    return (*row[:4], row[4].lower() if row[4] and row[0] is not None and row[0] % 3 == 0 else row[4])


def result(spark, rows, **how):
    df = spark.createDataFrame(rows, ROW)
    text = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    got = merkle.manifest(df, {"text": text}, **how)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def made(n_by_source):
    rng = random.Random(4)
    ids = rng.sample(range(100_000), sum(n_by_source.values()))
    return [(ids.pop(), s, rng.choice(["en", None]), rng.randrange(99), f"Text {rng.random()} É") for s, n in n_by_source.items() for _ in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_as_by_hand(spark, levels):
    """Sources of one leaf, of whole and of partial runs, with a last run of one, and a hot one of several blocks."""
    rows = made({None: 3, "": 1, "a": 16, "b": 17, "é": 256, "z": 257, "hot": 1100, "Z": 33, **{f"s{i}": 1 + i for i in range(14)}})
    assert result(spark, rows, levels=levels) == by_hand(rows, lowered)


def test_odd_rows(spark):
    rows = made({"a": 40, None: 5}) + [(None, "a", None, None, None), (None, None, None, None, None), (3, "a", "en", 1, ""), (3, "a", "en", 2, "SAME ID")]
    rows += [(9, "a", "en", 1, "Repeated")] * 30 + [(6, "a", "x", 0, "W" * 200_000)]
    assert result(spark, rows) == by_hand(rows, lowered)
    assert result(spark, rows[:1]) == by_hand(rows[:1], lowered)
    assert merkle.manifest(spark.createDataFrame([], ROW)).count() == 0


def test_other_columns_and_names(spark):
    df = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", 6)], "n long, pos string, key string, leaf long")
    got = merkle.manifest(df, columns=("n", "key"), id_col="n", group_col="pos").collect()
    first, second = leaf_of(1, "x"), leaf_of(2, "y")
    assert {r.n: r.leaf for r in got} == {1: first, 2: second} and {r.root for r in got} == {hashed(first, second)}
    assert all(r.verified and r.subroot == r.root for r in got)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4096])
def test_traversal_is_the_tree(n):
    leaves = [hashed(str(i)) for i in range(n)]
    levels = tree(leaves)
    got = list(merkle.traverse(leaves, merkle.height_of(n, 3)))
    assert got == [path(levels, i) for i in range(n)]
    assert all(merkle.fold(leaf, steps) == levels[-1][0] for leaf, steps in zip(leaves, got, strict=True))


def test_positions(spark):
    rows = [("g%d" % (i % 3 if i % 4 else 0), i * 37 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o long, i long").checkpoint() if spark.sparkContext.getCheckpointDir() else spark.createDataFrame(rows, "g string, o long, i long")
    want = {}
    for g in ("g0", "g1", "g2"):
        mine = sorted((o, i) for h, o, i in rows if h == g)
        want |= {i: (at, len(mine)) for at, (_, i) in enumerate(mine)}
    assert {r.i: (r.pos, r.total) for r in ranked(df, "g", ["o", "i"]).collect()} == want
    out = one_by_one(spark.createDataFrame([("a", 5), ("b", 1)], "k string, n long"), "n", step=2).select("k", "copy").collect()
    assert sorted(map(tuple, out)) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 0)]
