"""SimHash near-duplicates: 64-bit fingerprints of word shingles, found by pigeonhole blocks, verified by Hamming distance.

The 64 bits are cut into k blocks. Fingerprints that differ in at most d bits agree on at least k - d whole blocks, so
they meet under one of the C(k, d) keys made of k - d blocks. k is the smallest number whose keys have so many bits
that a key holds less than one unrelated fingerprint on average; it changes the work, never the result. Only distinct
fingerprints are joined, so exact copies cost nothing. Rows that share a key come to one task in order; NumPy compares
them at all distances within the key, and only a spanning star of what is linked leaves the task, never all pairs.

Keys with more than ``RUN`` fingerprints are split into parts, at random in each key, and compared within their parts
first: that is linear, and mostly joins a large group of copies whole. Then the rows of different groups that are left
in such a key meet over all its parts, the largest group's on one side and all others on the other, so that a group
that is joined already is never compared with itself.

Cases: a null or empty text has fingerprint zero and links like any other; repeated rows and ids are kept row by row;
very long texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free, join_small, materialize, text_or_empty

RUN = 2000
#: Candidates for each row of a run that are all taken; runs with more are compared again once those are settled.
EACH = 4


def fingerprint(text: str, shingle: int, seed: int = 42) -> int:
    """SimHash over XXH64 of the space-joined word shingles of a text, A-Z lower-cased."""
    hashes = shingle_hashes(text, shingle, seed)
    n = len(hashes)
    return int.from_bytes(np.packbits(2 * _bit_sums(hashes.view(np.uint8).reshape(-1, 8)) > n).tobytes(), "big") if n else 0


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle as big-endian u64; all words are one shingle if there are fewer."""
    import xxhash

    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(b" ".join(words), seed)] if words else [], ">u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = len(words) - shingle + 1
    return np.array([h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], ">u8")


def _bit_sums(rows: np.ndarray) -> np.ndarray:
    """Column sums of the bits of rows of bytes; 255 rows at a time fit a byte."""
    total = np.zeros(rows.shape[1] * 8, np.int64)
    for lo in range(0, len(rows), 255):
        total += np.unpackbits(rows[lo : lo + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return total


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(batch.column(1)[k].as_py(), shingle) for k in range(batch.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(n: int, bits: int) -> list[int]:
    """Masks of the keys for n distinct fingerprints: any two within ``bits`` bits agree under one of them."""
    for k in range(bits + 1, 65):
        edges = [64 * i // k for i in range(k + 1)]
        least = sum(sorted(b - a for a, b in zip(edges, edges[1:]))[: k - bits])
        if 2**least >= n or comb(k + 1, bits) > 500:
            break
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, k - bits)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars about the least member of what they join."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _pairs(run: np.ndarray, x: np.ndarray, bits: int, group: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, d): rows of equal ``run`` (sorted) and different ``group`` whose bits ``x`` (rows of u64) differ in d, at most
    ``bits``; bit by bit of the distance between rows."""
    end = np.searchsorted(run, run, side="right")
    at, s = np.arange(len(run)), 1
    while True:
        at = at[at + s < end[at]]
        if not len(at):
            return
        i = at if group is None else at[group[at] != group[at + s]]
        d = np.bitwise_count(x[i] ^ x[i + s]).sum(axis=1, dtype=np.int64)
        near = d <= bits
        if near.any():
            yield i[near], i[near] + s, d[near]
        s += 1


def _linked(run: np.ndarray, ids: np.ndarray, x: np.ndarray, bits: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of equal ``run``, as stars."""
    ua, ub, held = [], [], 0
    for i, j, _ in _pairs(run, x, bits, group):
        ua.append(ids[i])
        ub.append(ids[j])
        held += len(i)
        if held > 1_000_000:
            a, b = _stars(np.concatenate(ua), np.concatenate(ub))
            ua, ub, held = [a], [b], len(a)
    return _stars(np.concatenate(ua), np.concatenate(ub)) if held else (ids[:0], ids[:0])


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Indices of the spanning forest of the edges u - v over ``n`` nodes that prefers earlier edges."""
    label, alive = np.arange(n), np.arange(len(u))
    chosen = np.zeros(len(u), bool)
    while True:
        lu, lv = label[u[alive]], label[v[alive]]
        alive, lu, lv = alive[lu != lv], lu[lu != lv], lv[lu != lv]
        if not len(alive):
            return np.flatnonzero(chosen)
        first = np.full(n, len(u))
        np.minimum.at(first, lu, alive)
        np.minimum.at(first, lv, alive)
        pick = np.unique(first[first < len(u)])
        chosen[pick] = True
        nodes, roots = _stars(label[u[pick]], label[v[pick]])
        to = np.arange(n)
        to[nodes] = roots
        label = to[label]


def _candidates(run: np.ndarray, ids: np.ndarray, x: np.ndarray, bits: int, close: int) -> tuple[np.ndarray, np.ndarray]:
    """((a, b), a < b, first rows of the runs that have more): pairs of rows of a run that differ in ``bits`` bits at most:
    all of them, if a run has ``EACH`` for each of its rows at most, else only the run's spanning forest over pairs
    within ``close`` bits, the nearest first."""
    n = len(run)
    first = np.searchsorted(run, run)  # a run's first row stands for it
    size = np.bincount(first, minlength=n)
    more = np.zeros(n, bool)
    held, count, limit = np.zeros((3, 0), np.int64), 0, 1_000_000
    new: list[np.ndarray] = []

    def reduced(e: np.ndarray) -> np.ndarray:
        found = np.bincount(first[e[0]], minlength=n)
        more[found > EACH * size] = True
        many = more[first[e[0]]]
        few, e = e[:, ~many], e[:, many & (e[2] <= close)]
        e = e[:, np.lexsort((ids[e[1]], ids[e[0]], e[2]))]
        return np.concatenate([few, e[:, _forest(e[0], e[1], n)]], axis=1)

    for i, j, d in _pairs(run, x, bits, None):
        new.append(np.stack([i, j, d]))
        count += len(i)
        if count > limit:
            held = reduced(np.concatenate([held, *new], axis=1))
            new, count = [], held.shape[1]
            limit = max(limit, 2 * count)
    held = reduced(np.concatenate([held, *new], axis=1))
    a, b = ids[held[0]], ids[held[1]]
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1), np.flatnonzero(more)


def alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of hashes have this Jaccard similarity or more."""
    both = len(p) + len(q) - len(np.union1d(p, q))
    return both >= similarity * (len(p) + len(q) - both)


def _decided(run: np.ndarray, ids: np.ndarray, x: np.ndarray, key: np.ndarray, group: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join all rows of a run and of different groups that are alike by their sets; a pair is left to the
    first key that it shares. ``x`` has the fingerprint and then the keys of each row, ``key`` the one it is here for."""
    found = [np.zeros((3, 0), np.int64)]
    for i, j, _ in _pairs(run, x[:, : CHECKED // 64], most_bits(similarity, CHECKED), group):
        for lo in range(0, len(i), 10_000):
            a, b = i[lo : lo + 10_000], j[lo : lo + 10_000]
            d = np.bitwise_count(x[a, :WORDS] ^ x[b, :WORDS]).sum(axis=1, dtype=np.int64)
            ok = np.flatnonzero(d <= most_bits(similarity, 64 * WORDS))
            same = x[a[ok], WORDS:] == x[b[ok], WORDS:]
            ok = ok[x[a[ok], WORDS + same.argmax(axis=1)] == key[a[ok]]]
            found.append(np.stack([a[ok], b[ok], d[ok]]))
    e = np.concatenate(found, axis=1)
    e = e[:, np.lexsort((ids[e[1]], ids[e[0]], e[2]))]
    label = np.unique(np.stack([run, group]), axis=1, return_inverse=True)[1].reshape(-1)
    root = list(range(len(run)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for i, j in e[:2].T.tolist():
        p, q = top(int(label[i])), top(int(label[j]))
        if p != q and alike(sets[i], sets[j], similarity):
            root[q] = p
            out.append((int(ids[i]), int(ids[j])))
    return out


def _shared(keyed: DataFrame) -> DataFrame:
    """(key, n): keys that n > 1 rows have."""
    return materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))


def _own(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, lo, hi, fp): rows that share a key, dealt to one part of it each. A key with many rows is split by Spark's
    own handling of skewed joins, as its count was written before."""
    part = F.pmod(F.xxhash64("fp", "key"), F.ceil(F.col("n") / RUN)).cast("int")
    # tables that follow the corpus are never broadcast, however small they may be
    return keyed.join(shared.hint("merge"), "key").select("key", part.alias("lo"), "fp").withColumn("hi", F.col("lo"))


def _dealt(rows: DataFrame, prints: DataFrame, *more: str) -> DataFrame:
    """(key, lo, hi, fp, bits, and ``more`` of prints) of (key, lo, hi, fp), rows that are compared in one task and in order."""
    keys = ["key", "lo", "hi"]
    rows = rows.join(prints, "fp").select(*keys, "fp", "bits", *more)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp")


def _across(rows: DataFrame, size: int) -> DataFrame:
    """(key, lo, hi, fp) of (key, fp, group): keys with several groups, dealt so that any two rows of different groups meet.

    The largest group of a key is one side, cut into parts lo of about ``size`` rows; all others are the other side, cut into parts hi; every
    lo meets every hi, and the parts of the other side meet each other (as -1 - lo, -1 - hi)."""
    by = rows.groupBy("key", "group").agg(F.count("*").alias("n"))
    by = by.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "group")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    by = materialize(by.select("key", F.col("main.group").alias("main"), F.ceil(F.col("main.n") / size).cast("int").alias("pm"), F.ceil((F.col("n") - F.col("main.n")) / size).cast("int").alias("po")))
    r = join_small(rows, by, ["key"]).withColumn("other", F.col("group") != F.col("main"))
    r = r.withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.when(F.col("other"), F.col("po")).otherwise(F.col("pm"))).cast("int"))
    seq = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    with_main = F.when(F.col("other"), F.transform(seq("pm"), lambda i: pair(i, F.col("own")))).otherwise(F.transform(seq("po"), lambda j: pair(F.col("own"), j)))
    others = F.when(F.col("other") & (F.col("po") > 1), F.transform(seq("po"), lambda j: pair(-1 - F.least("own", j), -1 - F.greatest("own", j)))).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))
    return r.select("key", "fp", F.explode(F.concat(with_main, others)).alias("at")).select("key", "at.lo", "at.hi", "fp")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
    """(number of the run, fp, bits as rows of u64, rows) of dealt rows; a run is never cut."""
    held: list[pa.RecordBatch] = []

    def of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
        cols = np.stack([rows.column(i).to_numpy().astype(np.int64) for i in range(3)])
        new = np.concatenate([[True], (cols[:, 1:] != cols[:, :-1]).any(axis=0)])
        x = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        return np.cumsum(new), rows.column(3).to_numpy().astype(np.int64), x, rows

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        tail = int((cols == cols[:, -1:]).all(axis=0)[::-1].cumprod().sum())
        cut = batch.num_rows - tail
        if held and not cut and all(held[-1].column(i)[-1].as_py() == batch.column(i)[0].as_py() for i in range(3)):
            held.append(batch)
            continue
        ready = pa.Table.from_batches([*held, batch.slice(0, cut)]) if held or cut else None
        if ready is not None and ready.num_rows:
            yield of(ready)
        held = [batch.slice(cut)]
    if held:
        yield of(pa.Table.from_batches(held))


def _compared(dealt: DataFrame, bits: int, grouped: bool) -> DataFrame:
    """(a, b): stars over fp that join what lies within ``bits`` bits in dealt rows, of different groups if there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, ids, x, rows in _runs(batches):
            a, b = _linked(runs, ids, x, bits, rows.column(5).to_numpy().astype(np.int64) if grouped else None)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, bits: int) -> DataFrame:
    """(node, component) over distinct fingerprints (column fp) that are joined by links of ``bits`` bits at most; those
    without a link are absent. ``distinct`` should be materialized."""
    ms = masks(max(2, distinct.count()), bits)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(ms)])
    keyed = distinct.select("fp", F.explode(keys).alias("key"))
    prints = distinct.select("fp", F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("bits"))
    shared = _shared(keyed)
    found = materialize(_compared(_dealt(_own(keyed, shared), prints), bits, False).distinct())
    comp = materialize(connected_components(found))
    large = shared.where(F.col("n") > RUN).select("key")
    if not large.isEmpty():
        groups = materialize(distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("group")))
        rows = _across(join_small(keyed, large, ["key"]).join(groups, "fp"), RUN)
        more = _compared(_dealt(rows, prints.join(groups, "fp"), "group"), bits, True).distinct()
        joined = materialize(connected_components(found.union(more)))
        free(comp, groups)
        comp = joined
    free(found, shared)
    return comp


def near_duplicates(docs: DataFrame, shingle: int = 5, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fp, component_id (the smallest doc_id reachable over links of at most ``bits`` bits)."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col))
    firsts = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = links(firsts.select("fp"), bits)
    whole = firsts.join(comp, firsts["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = materialize(whole.join(least, "root").select("fp", "component_id"))
    free(firsts, comp)
    return join_small(fps, by_fp, ["fp"]).select("doc_id", "fp", "component_id")


# Similarity of 0.8 and less: long fingerprints

#: Words of a long fingerprint, with a key each, and bits of it in a key, the same at every size of the corpus: pairs at a
#: similarity of 0.8 share a key with probability 0.997. Bits alone would make unrelated texts meet, in numbers that grow
#: with the square of the corpus; a key also holds two shingles' hashes, and texts without a common shingle share none.
WORDS, BLOCK_BITS = 32, 8
#: Bits compared within a block, before all of them are.
CHECKED = 128
#: Candidates lie within so many standard errors of the bits that differ at the wanted similarity.
ERRORS = 3.0
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def wide_fingerprint(text: str, shingle: int, words: int) -> bytes:
    """SimHash of ``words`` times 64 bits over the set of shingles of a text."""
    return wide_of(np.unique(shingle_hashes(text, shingle).astype(np.uint64)), words)


def wide_of(h: np.ndarray, words: int) -> bytes:
    """SimHash of distinct hashes: each word has its own hashes, mixed from them. A shingle counts once, so that
    differing bits estimate the likeness of sets that is asked for."""
    if not len(h):
        return bytes(8 * words)
    total = np.zeros(64 * words, np.int64)
    for z in _of_words(h, words):
        total += _bit_sums(z.view(np.uint8))
    return np.packbits(2 * total > len(h)).tobytes()


def _mixed(z: np.ndarray) -> np.ndarray:
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _of_words(h: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The hashes (a row each) that each word (a column) has of them, 10,000 rows at a time."""
    for lo in range(0, len(h), 10_000):
        yield _mixed(h[lo : lo + 10_000, None] + _GOLDEN * np.arange(1, words + 1, dtype=np.uint64))


def block_keys(h: np.ndarray, wide: bytes) -> np.ndarray:
    """The key of each word of a long fingerprint: the word's low bits, the least and the greatest of its hashes."""
    bits = np.frombuffer(wide, np.uint64) & np.uint64((1 << BLOCK_BITS) - 1)
    low, high = np.full(len(bits), 2**64 - 1, np.uint64), np.zeros(len(bits), np.uint64)
    for z in _of_words(h, len(bits)):
        low, high = np.minimum(low, z.min(axis=0)), np.maximum(high, z.max(axis=0))
    return _mixed(_mixed(_mixed(low + _GOLDEN * np.arange(len(bits), dtype=np.uint64)) ^ high) ^ bits)


def differing(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity of sets of one size; of unequal ones fewer differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(similarity: float, bits: int) -> int:
    far = differing(similarity)
    return math.ceil(bits * far + ERRORS * math.sqrt(bits * far * (1 - far)))


def recall(similarity: float) -> float:
    """Probability that two texts of this similarity share a key: the least and the greatest hash are common ones, each with
    the probability of the similarity, and the bits agree."""
    return 1 - (1 - similarity**2 * (1 - differing(similarity)) ** BLOCK_BITS) ** WORDS


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(row, set) of (row, text): sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(batch.column(1)[k].as_py(), shingle).astype(np.uint64)).tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["fp", "set"])

    return texts.mapInArrow(run, "fp long, set binary")


def _joined(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """(a, b, va, vb): pairs with a value (fp, ``name``) of either."""
    both = pairs.join(values.select(F.col("fp").alias("a"), F.col(name).alias("va")), "a").join(values.select(F.col("fp").alias("b"), F.col(name).alias("vb")), "b")
    return both.select("a", "b", "va", "vb")


def similar_classes(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, row_col: str = "_row", text_col: str = "text", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of ``docs``: rows has (row, order, h1, h2), classes (h1, h2, first, component) with one row per distinct set
    of shingles; its first row by ``order`` (a column of docs), and the component, a row number, that it belongs to.

    ``row_col`` numbers the rows and must be the same whenever ``docs`` is read, as for a table in files.
    """
    order = order or row_col
    d = docs.select(F.col(row_col).cast("long").alias("row"), F.col(order).alias("order"), text_or_empty(text_col).alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            w, of, one, two = [], [], [], []
            for k in range(batch.num_rows):
                h = np.unique(shingle_hashes(batch.column(2)[k].as_py(), shingle).astype(np.uint64))
                w.append(wide_of(h, WORDS))
                of.append(block_keys(h, w[-1]).tobytes())
                whole = xxhash.xxh3_128_intdigest(h.tobytes())
                one.append(signed(whole >> 64))
                two.append(signed(whole & ((1 << 64) - 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(w, pa.binary()), pa.array(of, pa.binary())], ["row", "order", "h1", "h2", "wide", "keys"])

    kind = next(f.dataType.simpleString() for f in d.schema if f.name == "order")
    fps = materialize(d.mapInArrow(prints, f"row long, order {kind}, h1 long, h2 long, wide binary, keys binary"))
    firsts = materialize(fps.groupBy("h1", "h2").agg(F.min("row").alias("fp"), F.min(F.struct("order", "row")).alias("first")))
    wide = materialize(fps.select(F.col("row").alias("fp"), "wide", "keys").join(firsts.select("fp"), "fp"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.repeat(batch.column(0).to_numpy(), WORDS))], ["key", "fp"])

    keyed = wide.select("fp", "keys").mapInArrow(keys, "key long, fp long")
    bits = wide.select("fp", F.substring("wide", 1, CHECKED // 8).alias("bits"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, null): candidates of dealt rows; (null, null, key): keys that have more of them."""
        for runs, ids, x, rows in _runs(batches):
            pairs, more = _candidates(runs, ids, x, most_bits(similarity, CHECKED), math.ceil(CHECKED * differing(similarity)))
            open_ = rows.column(0).to_numpy()[more].astype(np.int64)
            none = [None] * len(open_)
            a = pa.array([*pairs[0].tolist(), *none], pa.int64())
            b = pa.array([*pairs[1].tolist(), *none], pa.int64())
            yield pa.RecordBatch.from_arrays([a, b, pa.array([*([None] * pairs.shape[1]), *open_.tolist()], pa.int64())], ["a", "b", "key"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, ids, x, rows in _runs(batches):
            key = rows.column(0).to_numpy().astype(np.int64).view(np.uint64)
            sets = [np.frombuffer(v.as_buffer() or b"", np.uint64) for v in rows.column(6)]
            found = _decided(runs, ids, x, key, rows.column(5).to_numpy().astype(np.int64), sets, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], ["a", "b"])

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose bits, all of them, say that they may be alike."""
        limit = most_bits(similarity, 64 * WORDS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
                    ok = pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= limit)
                    yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

        return materialize(_joined(pairs, wide, "wide").mapInArrow(run, "a long, b long"))

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, ok) of (a, b) by their shingles."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of = lambda v: np.frombuffer(v.as_buffer() or b"", np.uint64)
                ok = [alike(of(p), of(q), similarity) for p, q in zip(batch.column(2), batch.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

        return materialize(_joined(pairs, sets, "set").mapInArrow(run, "a long, b long, ok boolean"))

    def grouped(ok: DataFrame) -> DataFrame:
        """(fp, group) of all rows that a candidate has."""
        comp = connected_components(ok)
        return materialize(nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("group")))

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs of different groups."""
        p = pairs.join(groups.select(F.col("fp").alias("a"), F.col("group").alias("ga")), "a").join(groups.select(F.col("fp").alias("b"), F.col("group").alias("gb")), "b")
        return p.where("ga <> gb").select("a", "b")

    shared = _shared(keyed)
    found = materialize(_dealt(_own(keyed, shared), bits).mapInArrow(search, "a long, b long, key long").distinct())
    pairs = near(found.where("a is not null").select("a", "b"))
    # each row against the centre of its star joins most; the other candidates follow where groups are still apart
    stars = materialize(connected_components(pairs))
    # keys that were cut, or have more candidates than were taken, are compared once more, all of their rows
    open_keys = shared.where(F.col("n") > RUN).select("key").union(found.where("key is not null").select("key")).distinct()
    rows = materialize(join_small(keyed, materialize(open_keys), ["key"]))
    nodes = materialize(stars.select(F.col("node").alias("fp")).union(rows.select("fp")).distinct())
    sets = materialize(_sets(d.join(nodes.select(F.col("fp").alias("row")).hint("merge"), "row", "left_semi").select(F.col("row").alias("fp"), "text"), shingle))
    done = verified(stars.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
    groups = grouped(done.where("ok"))
    done = done.unionByName(verified(apart(pairs).join(done.select("a", "b"), ["a", "b"], "left_anti")))
    free(groups, found, pairs, stars, shared)
    groups = grouped(done.where("ok"))
    if not rows.isEmpty():
        has = wide.select("fp", F.concat("wide", "keys").alias("bits")).join(groups, "fp").join(sets, "fp")
        more = _dealt(_across(rows.join(groups, "fp"), RUN // 4), has, "group", "set").mapInArrow(decide, "a long, b long")
        done = done.where("ok").select("a", "b").union(materialize(more))
        free(groups)
        groups = grouped(done)
    classes = materialize(firsts.join(groups, "fp", "left").select("h1", "h2", "first", F.coalesce("group", "fp").alias("component")))
    free(firsts, wide, sets, nodes, groups, rows)
    return fps.select("row", "order", "h1", "h2"), classes


def similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and component_id, the least doc_id of the texts whose shingles are joined by links of
    ``similarity`` or more.

    At 0.8, a tenth to a sixth of the bits differ, too many for blocks that catch all of them, so the fingerprint is
    long and has a key for each of its ``WORDS`` words, which find a pair with the probability ``recall``. Pairs whose
    bits say that they may be alike are candidates; no two texts are linked but by their shingles.

    Cases: null ids and repeated ids are rows of their own (a component's id is its least one that is not null); a null or
    empty text is like any other; ties and repeated rows share a class; an empty table gives no rows; other columns are
    not read. ``docs`` must give the same rows in the same partitions whenever it is read, as a table in files does.
    """
    numbered = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows, classes = similar_classes(numbered, similarity, shingle, "_row", "_text", "_id")
    members = materialize(join_small(rows, classes.select("h1", "h2", "component"), ["h1", "h2"]).select(F.col("order").alias("doc_id"), "component"))
    least = materialize(members.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return join_small(members, least, ["component"]).select("doc_id", "component_id")


def distinct_rows(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, row_col: str = "_row", text_col: str = "text", order: str | None = None) -> DataFrame:
    """(row): the first row by ``order`` of each group of ``similar`` texts."""
    _, classes = similar_classes(docs, similarity, shingle, row_col, text_col, order)
    return classes.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
