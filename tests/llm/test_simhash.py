"""SimHash against a per-shingle computation and all pairs."""

import random
import re

import pytest
import xxhash

from cartograph.llm import simhash
from cartograph.llm.common import connected_components


def brute_fp(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, k, bits):
    fps = [(d, brute_fp(t, k)) for d, t in rows]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        low[find(i)] = min((x for x in (d, low.get(find(i))) if x is not None), default=None)
    return sorted(((d, f, low[find(i)]) for i, (d, f) in enumerate(fps)), key=str)


@pytest.mark.parametrize("which", ["tricky", "docs", "nothing"])
def test_against_all_pairs(which, request):
    df = request.getfixturevalue(which)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df, 4, 4).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()], 4, 4)


@pytest.mark.parametrize("bits,n", [(4, 10), (4, 10**6), (4, 10**9), (3, 10**7)])
def test_any_close_pair_shares_a_key(bits, n):
    rnd = random.Random(n)
    ms = simhash.masks(n, bits)
    for _ in range(2000):
        a, b = rnd.getrandbits(64), 0
        for i in rnd.sample(range(64), bits):
            b |= 1 << i
        assert any(b & m == 0 for m in ms), (a, b)


def test_dense_group_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 16)
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << i for i in rnd.sample(range(12), rnd.randint(0, 4))) for _ in range(300)} | {rnd.getrandbits(64) for _ in range(300)}
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    comp = {r.node: r.component for r in simhash.links(df, 4).collect()}
    fps = [simhash.signed(f) for f in fps]
    want = {}
    for f in fps:
        want[f] = f
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 4 and want[b] < want[a]:
                    want[a] = want[b]
                    changed = True
    assert {f: comp.get(f, f) for f in fps} == want


def test_components_of_a_chain_and_empty(spark):
    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5000, 5000)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[1001] == 1000 and got.get(5000, 5000) == 5000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
