"""Places of many matches, spans apart from others, announced values, and expectation-maximisation by brute force."""

import itertools
import random
import re
import time

from pyspark.sql import functions as F

from cartograph.llm import pii
from cartograph.llm.common import running


def test_running_results(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.randint(-9, 9) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 127, 128, 129, 256, 1000))]
    df = spark.createDataFrame(rows, "i int, a array<int>")
    got = df.select("i", running(F.col("a"), lambda x, y: x + y).alias("s"), running(F.col("a"), lambda x, y: F.greatest(x, y)).alias("m")).collect()
    assert {r.i: (r.s, r.m) for r in got} == {i: (list(itertools.accumulate(a)), list(itertools.accumulate(a, max))) for i, a in rows}


def test_many_matches_and_overlaps(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("ab1é😀 ", k=rnd.randint(0, 3000))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pii.located(F.col("t"), "[a1]+").alias("x"), pii.located(F.col("t"), "b[ab]+").alias("y"))
    for r in df.select("i", "x", "y", pii.apart(F.col("x"), pii.sides(F.col("y"))).alias("z")).collect():
        t = texts[r.i]
        x, y = ([(m.start(), m.end(), m[0]) for m in re.finditer(p, t)] for p in ("[a1]+", "b[ab]+"))
        assert [tuple(s) for s in r.x] == x and [tuple(s) for s in r.y] == y
        assert [tuple(s) for s in r.z] == [s for s in x if not any(a < s[1] and s[0] < b for a, b, _ in y)]


def test_a_text_of_many_spans_takes_no_quadratic_time(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdef0123456789", k=14))
    took = []
    for n in (4_000, 4_000, 32_000):
        df = spark.createDataFrame([(1, " ".join(f"{word()} a{i}@b.cd" for i in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        r = pii.find(df).select(pii.count_kind(F.col("base"), 0).alias("n")).first()
        took.append(time.perf_counter() - began)
        assert r.n == n
    print(took)
    assert took[2] < 24 * max(took[1], 0.5)


def test_announced_values(spark):
    rows = [(i, f"My ssn: {100 + i}-45-67{i:02d} and password is hunter{i}24x, passport no. X{1000000 + i}. iban: DE{10 + i} 3704 0044 0532 0130 00 end") for i in range(40)]
    rows += [(100 + i, f"The key idea, point {i}, is that token 7 of an account costs 12345 and no more; licence to go on") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(df, keep=("text",)).collect()
    for r in found:
        spans = [r.text[s.start : s.stop] for s in r.spans]
        if r.doc_id < 100:
            i = r.doc_id
            assert f"{100 + i}-45-67{i:02d}" in spans and f"hunter{i}24x" in spans and f"DE{10 + i} 3704 0044 0532 0130 00" in spans, spans
        else:
            assert not spans, spans


def test_reliabilities_by_single_votes():
    """EM over counts of patterns equals EM over the candidates one by one."""
    rnd = random.Random(4)
    votes = []
    for _ in range(400):
        private = rnd.random() < 0.4
        votes.append([int(rnd.random() < (p if private else q)) for p, q in ((0.9, 0.1), (0.8, 0.3), (0.7, 0.05), (0.6, 0.2), (0.5, 0.1))])
    share, rel = 0.5, [(0.7, 0.2)] * 5
    for _ in range(200):
        post = []
        for v in votes:
            a, b = share, 1 - share
            for x, (p, q) in zip(v, rel):
                a, b = a * (p if x else 1 - p), b * (q if x else 1 - q)
            post.append(a / (a + b))
        yes, no = sum(post), len(votes) - sum(post)
        share = (yes + 1) / (yes + no + 2)
        rel = [((sum(p for p, v in zip(post, votes) if v[k]) + 7) / (yes + 10), (sum(1 - p for p, v in zip(post, votes) if v[k]) + 2) / (no + 10)) for k in range(5)]
    counts = {}
    for v in votes:
        counts[sum(x << k for k, x in enumerate(v))] = counts.get(sum(x << k for k, x in enumerate(v)), 0) + 1
    got_share, got = pii.reliabilities(counts)
    assert abs(got_share - share) < 1e-9 and all(abs(a - b) < 1e-9 for x, y in zip(got, rel) for a, b in zip(x, y))
    soft = {i: pii.posterior(sum(x << k for k, x in enumerate(v)), share, rel) for i, v in enumerate(votes)}
    assert all(abs(soft[i] - p) < 0.02 for i, p in enumerate(post))
