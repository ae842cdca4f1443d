"""Concentration steps and distances against NumPy, group by group."""

import math
import random

import numpy as np

from cartograph.llm import quality


def brute(v, u):
    floor2 = np.array(quality.FLOOR) ** 2
    at = lambda x, p: np.sort(x)[max(0, math.ceil(p * len(x) - 1e-9) - 1)]
    grid = np.floor(v * quality.GRID)
    mu = np.array([(at(grid[:, k], 0.5) + 0.5) / quality.GRID for k in range(5)])
    spread = [max((at(grid[:, k], 0.75) - at(grid[:, k], 0.25)) / (1.349 * quality.GRID), quality.FLOOR[k]) for k in range(5)]
    cov = np.diag(np.square(spread))

    def distances():
        out = []
        for x, noise in zip(v, u):
            c = cov.copy()
            c[3, 3] += noise[0]
            c[4, 4] += noise[1]
            out.append((x - mu) @ np.linalg.solve(c, x - mu))
        return np.array(out)

    change = math.inf
    while True:
        level = np.floor(np.log2(np.maximum(distances(), 2.0**-20)) * quality.GRID)
        kept = v[level <= at(level, quality.SUPPORT)]
        before_det = np.linalg.slogdet(cov)[1] / 2
        mu = kept.mean(axis=0)
        cov = np.cov(kept.T, bias=True) * quality.FACTOR + np.diag(floor2)
        before, change = change, abs(np.linalg.slogdet(cov)[1] / 2 - before_det)
        if change <= quality.SETTLED or change >= before:
            return distances()


def test_distances_of_each_group(spark):
    rnd = random.Random(9)

    def text(n, junk):
        lines = [" ".join("".join(rnd.choices("abcdef#$", k=rnd.randint(2, 9))) for _ in range(rnd.randint(5, 15))) for _ in range(n)]
        return "\n".join(lines + [lines[0]] * rnd.choice([0, 0, junk]))

    rows = [(i, text(rnd.randint(8, 40), i % 7), "en", "ab"[i % 2]) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = quality.statistics(docs).withColumn("base_failed", quality.base_failed())
    names = (*quality.STATS, *quality.NOISE)
    vectors = stats.select("doc_id", "source", "base_failed", *(c.alias(n) for n, c in zip(names, quality.vector() + quality.noise()))).collect()
    got = {r.doc_id: r.distance for r in quality.judge(docs).collect()}
    for source in "ab":
        own = [r for r in vectors if r.source == source and not r.base_failed]
        want = brute(np.array([[r[n] for n in quality.STATS] for r in own]), np.array([[r[n] for n in quality.NOISE] for r in own]))
        have = np.array([got[r.doc_id] for r in own])
        assert len(own) > 100 and np.allclose(have, want, rtol=1e-4, atol=1e-5), np.abs(have - want).max()
