"""Best-fit packing of token pieces by exact complements.

Only lengths matter to a packing, and there are at most ``capacity`` different ones, so the plan is made from the
histogram of lengths on the driver: a few thousand counts at any input size. Gaps are filled exactly first: a length
``a`` looks up a single length, a pair or a triple whose sum is ``capacity - a`` and that the counts still allow, and
the combination is consumed as often as they allow. What is left goes by best fit, longest first. The plan is a bounded
list of patterns (lengths, repeats); pieces find their place by their rank among the pieces of their length.

Cases: a null or empty text is the single end id; ties and repeated rows are ordered by (doc_id, text) and each row is
packed by itself; an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, text_or_empty

PIECES = "doc_id long, copy int, piece int, start long, length int, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full ones after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of ``docs``: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(bpe.vocabulary(tokenizer))
        for batch in batches:
            for part in bpe.slices(batch, 1):
                rows: list[tuple] = []
                ids, ends = enc.ids(part.column(1))
                for doc, a, b in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = np.full(b - a + 1, end_id, "<u4")
                    own[:-1] = ids[a:b]
                    rows += [(doc, 0, k, s, n, zlib.crc32(own[s : s + n])) for k, (s, n) in enumerate(cut(len(own), capacity))]
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, PIECES)


class _Counts:
    """Available lengths and the sums that one, two or three of them make."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.n, self.capacity = counts.copy(), capacity

    def pair(self, total: int) -> tuple[int, ...] | None:
        """Two available lengths of this sum, the largest possible first."""
        n = self.n
        hi = min(total - 1, self.capacity)
        lo = (total + 1) // 2
        if lo > hi:
            return None
        bs = np.arange(hi, lo - 1, -1)
        cs = total - bs
        ok = (n[bs] > 0) & (n[cs] > (bs == cs))
        k = int(ok.argmax())
        return (int(bs[k]), int(cs[k])) if ok[k] else None

    def triple(self, total: int) -> tuple[int, ...] | None:
        n = self.n
        for b in np.flatnonzero(n[: min(total - 2, self.capacity) + 1])[::-1]:
            b = int(b)
            if 3 * b < total:
                break
            n[b] -= 1
            rest = self.pair(total - b)
            n[b] += 1
            if rest:
                return (b, *rest)
        return None


def plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, repeats) that use up ``counts`` (length -> pieces), each of at most ``capacity`` tokens."""
    n = np.zeros(capacity + 1, np.int64)
    for length, c in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length}")
        n[length] = c
    have = _Counts(n, capacity)
    n = have.n
    patterns: list[tuple[tuple[int, ...], int]] = []

    def consume(combination: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for x in combination:
            need[x] = need.get(x, 0) + 1
        times = min(int(n[x]) // k for x, k in need.items())
        for x, k in need.items():
            n[x] -= times * k
        patterns.append((combination, times))

    for a in range(capacity, 0, -1):
        while n[a]:
            gap = capacity - a
            if gap == 0:
                consume((a,))
                continue
            if gap < capacity and n[gap] > (gap == a):
                consume((a, gap))
                continue
            n[a] -= 1
            rest = have.pair(gap) or have.triple(gap)
            n[a] += 1
            if not rest:
                break
            consume((a, *rest))
    return patterns + best_fit(n, capacity)


def best_fit(n: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts: open sequences of the same content move together."""
    by_room: dict[int, list[list]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        left = int(n[length])
        while left:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                group = by_room[room][-1]
                k = min(left, group[1])
                group[1] -= k
                if not group[1]:
                    by_room[room].pop()
                    rooms[room] = bool(by_room[room])
                inside, room = (*group[0], length), room - length
            else:
                each = min(capacity // length, left)
                k, inside, room = left // each, (length,) * each, capacity - each * length
                left -= k * (each - 1)
            left -= k
            by_room.setdefault(room, []).append([inside, k])
            rooms[room] = True
    return [(inside, k) for groups in by_room.values() for inside, k in groups]


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): the r-th piece of a length goes to sequence
    first + r - first rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for inside, times in patterns:
        offset = 0
        for x in inside:
            rows.append((x, used.get(x, 0), times, base, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        base += times
    return rows


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_salt: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of ``token_pieces``).

    The pieces are written to the shared folder first, so that ranks hold when executors are lost. Ranks come from
    windows over (length, salt): a length that holds a third of all rows is dealt over many tasks, and the salts'
    first ranks come from their counts. The plan (one row per pattern and place, bounded by the capacity and not by
    the input) is broadcast.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    salts = max(1, -(-sum(counts.values()) // rows_per_salt), spark.sparkContext.defaultParallelism)
    rows = placements(plan(counts, capacity))
    where = spark.createDataFrame(rows, "length int, lo long, n long, base long, offset long")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    firsts = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("first"))
    )
    ranked = salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(firsts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("k"))
    w = F.broadcast(where.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "base", "offset"))).alias("places")))
    # the place of a rank: places of a length are disjoint ranges, so exactly one holds it
    found = F.filter("places", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["lo"] + p["n"]))[0]
    return ranked.join(w, "length").withColumn("place", found).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("place.base") + F.col("rank") - F.col("place.lo")).alias("sequence_id"), F.col("place.offset").alias("offset"),
    )
