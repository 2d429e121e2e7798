import random

from corpalith.llm import decontaminate


def shingles(text, k=5):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def test_matches_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 60)))) for i in range(40)]
    docs = []
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 400))]
        if d % 2:
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice((0, 0, 1, 2))):
                part[rng.randrange(len(part))] = "other"
            text[len(text) // 2 : len(text) // 2] = part
        docs.append((d, " ".join(text).upper() if d % 3 else ", ".join(text)))
    want = {}
    for d, text in docs:
        have = shingles(text)
        for i, item in items:
            wanted = shingles(item)
            if len(wanted & have) >= 0.8 * len(wanted):
                want[d, i] = (len(wanted), len(wanted & have))
    assert len(want) > 20
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in got.collect()} == want


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "the QUICK brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "one"), (4, "one"), (1, "the QUICK brown fox jumps over the lazy dog")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, items).collect()}
    assert got == {(1, 1), (2, 1), (8, 4)}
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
