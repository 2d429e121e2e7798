import random
from collections import Counter
from itertools import combinations

import pyarrow as pa

import corpus_pipeline
from corpalith.llm import near_copies

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return out


def texts():
    rng = random.Random(5)
    out = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 400))]
        out += [" ".join(w) for w in (words, *(edited(rng, words, rng.randint(1, max(1, len(words) // 25))) for _ in range(3)))]
    return out


def test_one_of_near_copies_stays(spark, tmp_path):
    """Copies with edits all over, against all pairs by brute force."""
    every = texts()
    root = list(range(len(every)))
    for i, j in combinations(range(len(every)), 2):
        if similarity(every[i], every[j]) >= 0.8:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    assert 40 <= len(set(root)) < 120
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(every)], ROW)
    got = corpus_pipeline.simhash_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(root))


def test_large_groups_are_dealt(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(edited(rng, words, 2))) for i in range(60)], "key long, text string")
    monkeypatch.setattr(near_copies, "TILE", 8)
    assert {r.root for r in near_copies.near_copies(docs).collect()} == {0}


def by_hand(every):
    root = list(range(len(every)))
    for i, j in combinations(range(len(every)), 2):
        if similarity(every[i], every[j]) >= 0.8:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_texts_far_from_the_leader_keep_their_links(spark, monkeypatch):
    """A chain of texts, each near the next: only the first ones are near the leader, and tiles are tiny."""
    rng = random.Random(8)
    chain = [[f"w{i}" for i in range(200)]]
    for _ in range(30):
        chain.append(edited(rng, chain[-1], 3))
    every = [" ".join(w) for w in chain] + [" ".join(edited(rng, chain[0], 2)) for _ in range(20)]
    root = by_hand(every)
    assert len(set(root)) < 5
    docs = spark.createDataFrame(list(enumerate(every)), "key long, text string")
    monkeypatch.setattr(near_copies, "TILE", 6)
    assert {r.key: r.root for r in near_copies.near_copies(docs).collect()} == dict(enumerate(root))


def test_recall_on_the_given_table(spark):
    """All pairs of differing texts with a similarity of 0.8 or more, found through shared rare shingles, are linked."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = sorted({r.text for r in rows if r.text})
    sets = [frozenset(zip(*(w[i:] for i in range(5)), strict=False)) or frozenset([tuple(w)]) for w in (t.lower().split() for t in texts)]
    often = Counter(s for x in sets for s in x)
    # Texts that near share one of the rarest fifth of each one's shingles.
    held, pairs = {}, set()
    for i, x in enumerate(sets):
        for s in sorted(x, key=lambda s: (often[s], s))[: len(x) - int(0.8 * len(x) - 1e-9)]:
            for j in held.get(s, ()):
                pairs.add((j, i))
            held.setdefault(s, []).append(i)
    near = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    root = {r.key: r.root for r in near_copies.near_copies(docs).collect()}
    assert near and all(root[i] == root[j] for i, j in near)


def test_fingerprints_alone_bring_near_texts_together(spark, monkeypatch):
    """Near texts meet by the tiles of their fingerprints where no key of minima is shared; a link is still verified."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(edited(rng, words, 1))), (2, " ".join(words[:2000]))], "key long, text string")
    made = near_copies._signatures

    def without_bands(batches):
        for batch in made(batches):
            empty = pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], empty], names=batch.schema.names)

    monkeypatch.setattr(near_copies, "_signatures", without_bands)
    assert sorted((r.key, r.root) for r in near_copies.near_copies(docs).collect()) == [(0, 0), (1, 0), (2, 2)]
