"""Syncmer fingerprints and their likeness against plain Python; neighbours for ids of any kind."""

import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from cartograph.llm import syncmers

M64 = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(*longs):
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest((x & M64).to_bytes(8, "little"), seed)
    return signed(seed)


def brute_anchors(text):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in text.split()]
    pack = lambda x, i: ((x >> 25) << 25) + (i & 0xFFFFFF)
    if len(h) < 6:
        found = [pack(x, i) for i, x in enumerate(h)]
    else:
        s = [chain(a, b) for a, b in zip(h, h[1:])]
        found = [pack(chain(s[i], s[i + 2], s[i + 4]), i) for i in range(len(s) - 4) if min(s[i + 1 : i + 4]) >= min(s[i], s[i + 4])]
        if not found:
            seed = 42
            for x in h:
                seed = chain(seed, x)
            found = [pack(seed, 0)]
    first = {}
    for x in sorted(found):
        first.setdefault(x >> 25, x)
    return sorted(first.values())


def brute_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    x, y = ({v >> 25: v & 0xFFFFFF for v in z} for z in (a, b))
    at = sorted((x[h], y[h]) for h in x if h in y)
    segments = []
    for p, q in at:
        if segments and abs((q - p) - segments[-1][-1]) <= 8:
            segments[-1] = [segments[-1][0] + 1, segments[-1][1], q, q - p]
        else:
            segments.append([1, q, q, q - p])
    best = []
    for n, lo, hi, _ in segments:
        if n > 1 or len(at) == 1:
            best.append((hi, n + max((m for last, m in best if last < lo), default=0)))
    ok, d = max((n for _, n in best), default=0), at
    return 1.0 if a == b else ok / (len(x) + len(y) - len(d))


def test_anchors_and_likeness(spark):
    rnd = random.Random(2)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(900)]
    texts = ["", "one", "a b c d e", "x " * 50, " ".join(base), " ".join(base[:400] + ["new"] * 20 + base[400:]), " ".join(base[500:] + base[:500])]
    texts += [" ".join(rnd.choices(base, k=rnd.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(base[:450] + [w if rnd.random() > 0.1 else "z" for w in base[450:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", syncmers.anchors(F.col("t")).alias("a"))
    got = {r.i: r.a for r in df.collect()}
    assert got == {i: brute_anchors(t) for i, t in enumerate(texts)}
    both = df.crossJoin(df.select(F.col("i").alias("j"), F.col("a").alias("b"))).where("i < 8 or j > 60")
    rows = both.select("i", "j", syncmers.likeness(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(r.s - brute_likeness(got[r.i], got[r.j])) < 1e-12 for r in rows)
    by = {(r.i, r.j): r.s for r in rows}
    # what follows an inserted paragraph moves as a whole; a long text keeps all its anchors
    assert by[4, 5] > 0.9 and len(got[4]) > 200 and 0.5 < by[4, 67] < 1


@pytest.mark.parametrize(
    "ids",
    [
        [-(2**63) + 1, -5, 0, 7, 2**63 - 1],
        [*range(3000), 2**62],
        [None] * 700,
        [5] * 900 + list(range(-40, 40)) + [None] * 3,
        [i * 0x9E3779B97F4A7C15 % 2**64 - 2**63 for i in range(500)],
        [3],
    ],
)
def test_neighbours_of_any_ids(spark, ids):
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = syncmers.with_next(df, F.length, 50).collect()
    assert Counter(r.text for r in rows) == Counter(r.next_text for r in rows) == Counter(f"t{k}" for k in range(len(ids)))
    of = {f"t{k}": -(2**63) if i is None else i for k, i in enumerate(ids)}
    following = {r.text: r.next_text for r in rows}
    assert sum(of[a] < of[b] for a, b in following.items()) == (len(set(of.values())) > 1)
    seen, at = set(), "t0"
    while at not in seen:
        seen.add(at)
        at = following[at]
    assert len(seen) == len(ids)
    sizes = Counter(r.bucket for r in syncmers._bucketed(df, 50).collect())
    assert max(sizes.values()) <= 400
