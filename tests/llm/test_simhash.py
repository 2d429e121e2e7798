import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpalith.llm import components, simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBé\u2003 \n\t.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == brute_fingerprint(text)


@pytest.mark.parametrize("bands", [5, 6, 7])
def test_bands_lose_no_link(bands):
    rng = np.random.default_rng(3)
    for _ in range(200):
        flips = rng.choice(64, 4, replace=False)
        changed = sum(1 << int(b) for b in flips)
        assert any(m % (1 << 64) & changed == 0 for m in simhash.masks(bands))


def brute_components(fps, ids, radius=4):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_match_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    for base in list(fps)[:12]:  # chains of near ones
        for _ in range(5):
            base ^= sum(1 << int(b) for b in rng.choice(63, 3, replace=False))
            fps.add(base)
    fps = sorted(fps)
    ids = [int(i) for i in rng.permutation(len(fps))]
    want = brute_components(fps, ids)
    reps = spark.createDataFrame(list(zip(fps, ids, strict=True)), "fp long, rep long")
    got = {r.node: r.root for r in components.components(simhash.links(reps, len(fps), tile=tile)).collect()}
    assert {i: got.get(i, i) for i in ids} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r.root for r in components.components(edges).collect()} == {0}


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    by = {i: (f, c) for i, f, c in got if i is not None}
    assert by[3] == by[4] == by[5] == ("0" * 16, 3)
    assert [g for g in got if g[0] is None and g[1] == "0" * 16] == [(None, "0" * 16, 3)]
    assert simhash.near_duplicates(none).count() == 0
