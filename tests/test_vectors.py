import numpy as np
import pyarrow as pa
import pytest

from corpalith.operators import vectors as V

ROW = "vec_id long, embedding array<float>, label int"


def clustered(n, width=16, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return [(i, (centres[i % groups] + 0.2 * rng.normal(size=width)).astype(np.float32).tolist(), i % groups) for i in range(n)]


def by_hand(rows, queries, k):
    held = [(i, np.array(x, np.float32).astype(float)) for i, x, *_ in rows]
    out = []
    for q, x, *_ in queries:
        x = np.array(x, np.float32).astype(float)
        scores = []
        for i, y in held:
            size = np.sqrt(x @ x) * np.sqrt(y @ y)
            scores.append((-(round(float(x @ y) / size, 6) if size else 0.0), i))
        best = sorted(s for s in scores if s[1] != q)[:k]
        out += [(q, i, -s + 0.0, rank) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in df.collect())


def test_exact_is_brute_force(spark):
    rows = clustered(600)
    df = spark.createDataFrame(rows, ROW)
    index = V.build(df, lists=15)
    assert rows_of(V.exact(index, df.where("vec_id % 20 = 0"), 20, probes=1)) == by_hand(rows, rows[::20], 20)
    assert index.sizes.sum() == 600 and sorted({r.list for r in index.vectors.collect()}) == np.flatnonzero(index.sizes).tolist()


def test_recall_of_probed_lists(spark):
    """On the given table, whose vectors lie nearly at random, and with exact scores for all that is found."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = df.where("vec_id % 20 = 0")
    index = V.build(df)
    truth = {(q, i): s for q, i, s, _ in rows_of(V.exact(index, queries, 20))}
    got = {(q, i): s for q, i, s, _ in rows_of(V.search(index, queries, 20))}
    assert len(truth.keys() & got.keys()) >= 0.9 * len(truth)
    assert all(got[x] == truth[x] for x in truth.keys() & got.keys())
    few = rows_of(V.search(index, queries, 20, probes=1))
    assert 0 < len({(q, i) for q, i, *_ in few} & truth.keys()) < len(truth)


def test_clusters_need_few_lists(spark):
    df = spark.createDataFrame(clustered(600), ROW)
    index = V.build(df, lists=12)
    assert V.tuned_probes(index, df, 10) <= 4


@pytest.mark.parametrize("part, block", [(V.PART, V.BLOCK), (16, 4)])
def test_a_hot_list_is_cut(spark, monkeypatch, part, block):
    """A third of all vectors is one vector; long lists and many queries are dealt out, and ties go by id."""
    monkeypatch.setattr(V, "PART", part)
    monkeypatch.setattr(V, "BLOCK", block)
    rows = clustered(200)
    rows += [(1000 + i, rows[7][1], 0) for i in range(100)]
    df = spark.createDataFrame(rows, ROW)
    index = V.build(df, lists=10)
    assert index.sizes.max() >= 100 and (part > 16 or index.parts().max() >= 7)
    assert rows_of(V.exact(index, df, 5, probes=2)) == by_hand(rows, rows, 5)


def test_odd_rows(spark):
    """Zero vectors score 0; rows without an id, of another width or with numbers that aren't finite are left out."""
    rows = clustered(40, width=4) + [(100, [0.0] * 4, 1), (101, [0.0] * 4, 1)]
    bad = [(102, [1.0] * 3, 1), (103, None, 1), (104, [float("nan")] * 4, 1), (105, [float("inf")] * 4, 1), (106, [], 1), (107, [1.0, None, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows + bad, ROW)
    index = V.build(df, lists=5)
    assert index.sizes.sum() == 42
    assert rows_of(V.exact(index, df.where("vec_id % 20 = 0"), 6)) == by_hand(rows, [r for r in rows if r[0] % 20 == 0], 6)
    assert rows_of(V.search(index, df, 3, probes=len(index.centroids))) == by_hand(rows, rows, 3)
    assert V.build(df.limit(0)) is None and V.build(df.where("embedding is null")) is None
    only = V.build(df.where("vec_id in (100, 101)"))
    assert rows_of(V.exact(only, df.where("vec_id in (100, 101)"), 2)) == [(100, 101, 0.0, 1), (101, 100, 0.0, 1)]


def test_knn_meets_block_by_block(spark, monkeypatch):
    from corpalith.operators import ranking

    monkeypatch.setattr(ranking, "PART", 100)
    monkeypatch.setattr(ranking, "BLOCK", 7)
    rows = clustered(600)
    rows += [(i, rows[5][1], 0) for i in range(600, 680)] + [(680, [0.0] * 16, 0)]  # copies, more than the rank, and a zero vector
    df = spark.createDataFrame([*rows, (None, rows[0][1], 0)], ROW)
    near = ranking.knn(df, df.where("vec_id % 20 = 0"), 20)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows_of(near) == by_hand(rows, rows[::20], 20)
    odd = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0], 0), (2, None, 0), (3, [None, 1.0], 0), (4, [2.0, 0.0], 0), (4, [-2.0, 0.0], 0)], ROW)
    assert rows_of(ranking.knn(odd, odd.where("vec_id = 0"), 9)) == [(0, 1, 0.0, 2), (0, 2, 0.0, 3), (0, 3, 0.0, 4), (0, 4, -1.0, 5), (0, 4, 1.0, 1)]
    assert rows_of(ranking.knn(odd, odd.where("vec_id = 9"), 9)) == []


def test_every_vector_is_asked_for_its_duplicates(spark, tmp_path):
    """Also those whose ids 20 doesn't divide; the SQL asks for the same."""
    import duckdb

    from corpalith import catalogue

    rows = clustered(130)
    rows += [(i, rows[7][1], 0) for i in range(130, 139)]
    spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r.vec_id, r.score, r.duplicate) for r in catalogue.QUERIES["t10_duplicate_candidates"](spark, str(tmp_path)).collect())
    assert got == sorted((q, i, s, s > 0.72) for q, i, s, _ in by_hand(rows, rows, 3))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(catalogue.ORACLE_SQL["t10_duplicate_candidates"]).fetchall())


@pytest.mark.parametrize("rows_at_once, columns, hits", [(256, 1024, 4096), (7, 16, 1)])
def test_near_vectors_are_scored_exactly(spark, monkeypatch, rows_at_once, columns, hits):
    """Scores that differ by less than single precision can tell, many copies, ids that occur twice, and vectors with no number."""
    from corpalith.operators import ranking

    for name, value in (("ROWS", rows_at_once), ("COLUMNS", columns), ("HITS", hits), ("PAIR_BYTES", 1000)):
        monkeypatch.setattr(ranking, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.002 * rng.normal(size=16)).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(i, rows[3][1], 0) for i in range(300, 400)] + [(400, [0.0] * 16, 0)] + [(i, [-x for x in rows[9][1]], 0) for i in range(401, 420)]
    df = spark.createDataFrame(rows, ROW)
    assert rows_of(ranking.knn(df, df, 4)) == by_hand(rows, rows, 4)
    odd = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [float("nan"), 0.0], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [float("inf"), 1.0], 0)], ROW)
    got = [(r.query_id, r.vec_id, str(r.score), r["rank"]) for r in ranking.knn(odd, odd.where("vec_id in (0, 2)"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, "nan", 1), (0, 4, "nan", 2), (0, 1, "1.0", 3), (2, 1, "nan", 1), (2, 4, "nan", 2), (2, 0, "1.0", 3)]
    # Equal vectors of many ids: k + 1 of them are met, and k rows of each id.
    ids = np.array([0, 0, 0, 1, 2, 3, 4])
    same = pa.chunked_array([[[1.0, 2.0]] * 7])
    assert ranking._least_copies(same, ids, 2).tolist() == [0, 1, 3, 4]
