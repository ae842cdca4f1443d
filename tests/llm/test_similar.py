"""Near-duplicates by shingle sets: repeated lines, links that only seem sure, several pairs between groups."""

import random

import numpy as np

from cartograph.llm import simhash


def words(rnd, n, tag=""):
    return [f"{tag}{rnd.randrange(10**9)}" for _ in range(n)]


def components(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar(df, 0.8, 5).collect()}


def bits_between(a, b):
    x, y = (np.frombuffer(simhash.wide_fingerprint(t, 5, 8), np.uint64) for t in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def test_near_copies_with_repeated_lines(spark):
    rnd = random.Random(3)
    rows = []
    for i, times in enumerate((10, 20, 40)):
        own, line = words(rnd, 400), words(rnd, 8)
        a, b = " ".join(own), " ".join(own + line * times)
        assert bits_between(a, b) <= 40, times
        rows += [(2 * i, a), (2 * i + 1, b)]
    assert components(spark, rows) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_no_link_without_likeness(spark, monkeypatch):
    # all pairs are candidates, as if the bits said that they were alike
    monkeypatch.setattr(simhash, "wide_of", lambda hashes, n: bytes(8 * n))
    rnd = random.Random(4)
    own = [" ".join(words(rnd, 100)) for _ in range(3)]
    rows = [(0, own[0]), (1, own[1] + " x"), (2, own[2] + " yy"), (3, own[0] + " zzz")]
    assert components(spark, rows) == {0: 0, 1: 1, 2: 2, 3: 0}


def test_the_nearest_pair_by_bits_is_not_the_only_try(spark, monkeypatch):
    rnd = random.Random(5)
    base = words(rnd, 100)

    def changed(*at):
        return " ".join("x" + w if i in at else w for i, w in enumerate(base))

    # only 1 and 3 join {0, 1} and {2, 3}, and by bits they are the farthest pair
    texts = [changed(), changed(10), changed(10, 30, 50, 70), changed(10, 30, 50)]
    flips = [range(0), range(60, 65), range(20), [*range(20), *range(70, 75)]]
    sets = [np.unique(simhash.shingle_hashes(t, 5).astype(np.uint64)).tobytes() for t in texts]

    def bits(hashes, n):
        x = np.zeros(64 * n, np.uint8)
        x[list(flips[sets.index(hashes.tobytes())])] = 1
        return np.packbits(x).tobytes()

    monkeypatch.setattr(simhash, "wide_of", bits)
    assert components(spark, list(enumerate(texts))) == {0: 0, 1: 0, 2: 0, 3: 0}


def test_unrelated_texts_meet_under_no_key():
    """Keys of bits alone are shared by chance, in numbers that grow with the square of the corpus."""
    rnd = random.Random(6)
    hashes = [np.array(sorted(rnd.getrandbits(64) for _ in range(20)), np.uint64) for _ in range(10_000)]
    found = np.concatenate([simhash.block_keys(h, simhash.wide_of(h, simhash.WORDS)) for h in hashes])
    assert len(np.unique(found)) == len(found)


def test_alike_texts_meet_under_a_key_as_often_as_said():
    rng = np.random.default_rng(7)
    keys = lambda h: simhash.block_keys(h, simhash.wide_of(h, simhash.WORDS))
    met = []
    for _ in range(1000):  # 160 common hashes of 200
        h = rng.integers(0, 2**64, 200, np.uint64)
        met.append(int((keys(h[:180]) == keys(h[20:])).sum()))
    each = 1 - (1 - simhash.recall(0.8)) ** (1 / simhash.WORDS)
    assert abs(np.mean(met) - simhash.WORDS * each) < 0.05 * simhash.WORDS * each and np.mean([m > 0 for m in met]) >= 0.99


def test_pairs_of_cut_keys_are_decided_in_one_of_them(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 4)
    rnd = random.Random(8)
    base = words(rnd, 200)
    rows = [(i, " ".join(f"x{i}" if k == 4 * i else w for k, w in enumerate(base))) for i in range(40)]
    rows += [(100 + i, " ".join(words(rnd, 200))) for i in range(10)]
    assert components(spark, rows) == {**dict.fromkeys(range(40), 0), **{100 + i: 100 + i for i in range(10)}}
