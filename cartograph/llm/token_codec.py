"""Token ids as compressed binary frames: adaptive context mixing drives a range coder.

Model. Before each id, an order-2 and an order-1 table (keyed by the last two ids, the last id) each predict one id with
a confidence of 0 to 3; order 0 is the distribution of ids in the frame. The three are mixed at the level of ids:
``P = q2 [x = p2] + (1 - q2) (q1 [x = p1] + (1 - q1) P0)``, where the weights q2, q1 are adaptive and depend on both
confidences and on whether the predictions agree. The mixture drives a 64-bit carry-less range coder with 32-bit output,
so that a step puts out one word of a lane at most.

Blocks. Each block of ``BLOCK`` ids starts from reset tables, weights and coder, has its own CRC-32 and can be decoded
with nothing but the frame's header. Blocks of a frame are coded in lockstep, one NumPy lane each.

Frame (little-endian), one per row of the written table:
  4 bytes magic ``CGT3``; u32 header length; header (zlib): u64 first start, u32 documents, u32 distinct ids,
  per document i64 doc_id and u64 ids; distinct ids u16 and their frequencies u16 (sum 65536, 0 stands for 65536);
  u32 crc of the header; u32 blocks; then per block u32 ids, u32 crc of the ids (as u32) and the payload, u32 payload words; then the payloads (u32).
A wrong magic, header or block raises ``CorruptFrame``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import shared_dir, text_or_empty

MAGIC = b"CGT3"
NO_ID = -(2**63)  # stands for a null doc_id
BLOCK = 4096
FRAME_IDS = 16_000_000
SLICE = 8_000_000  # bytes of text encoded at once; distinct pieces grow less than that
_SLOTS = 11  # bits of a table's index
_BOT, _U = np.uint64(1 << 32), np.uint64
_S16, _S28, _S32, _M28, _M32, _ONE = _U(16), _U(28), _U(32), _U((1 << 28) - 1), _U((1 << 32) - 1), _U(1)
_W1, _W5, _W12, _W13, _W15, _W16, _W4064, _W4094, _W4096, _ID = (np.uint32(n) for n in (1, 5, 12, 13, 15, 16, 4064, 4094, 4096, 0xFFFF))
_BOTH1, _BOTH11 = np.uint32(0x10001), np.uint32(0x7FF07FF)
_STEP, _KEPT, _MOST = np.uint32(1 << 16), np.uint32(2 << 16), np.uint32(3 << 16)  # of confidence


class CorruptFrame(ValueError):
    pass


class _Model:
    """Tables of all lanes and the coder's ranges: a step is ``predict``, then ``narrow`` once the ids are known.

    Arrays are made once, an operation has one type, and what only few lanes need is done for those.
    """

    def __init__(self, lanes: int, sym: np.ndarray, f: np.ndarray):
        self.t2 = np.full(lanes << _SLOTS, 0xFFFF, np.uint32)  # id, and 16 bits up its confidence
        self.t1 = np.full(lanes << _SLOTS, 0xFFFF, np.uint32)
        self.q = np.full(lanes << 5, 1024 << 16 | 1024, np.uint32)  # the weights q2, and 16 bits up q1
        self.base = np.arange(lanes, dtype=np.int64) << _SLOTS
        self.qbase = np.arange(lanes, dtype=np.uint32) << np.uint32(5)
        self.order0 = np.zeros(65_536, np.uint64)  # share of the ids before it, and 32 bits up its own
        self.order0[sym] = (np.cumsum(f) - f).astype(np.uint64) | (f.astype(np.uint64) << _S32)
        self.low, self.rng = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.h1, self.hb, self.h, self.i1, self.i2, self.iq = (np.zeros(lanes, np.int64) for _ in range(6))
        self.e1, self.e2, self.p1, self.p2, self.w1, self.w2, self.w, self.a, self.b = (np.zeros(lanes, np.uint32) for _ in range(9))
        self.f1, self.f2, self.rest, self.r, self.start, self.wide = (np.zeros(lanes, np.uint64) for _ in range(6))
        self.flag = np.zeros(lanes, bool)

    def predict(self) -> None:
        """Predictions p2, p1, and the shares of order 2, 1 and 0 (f2, f1, rest; 4096 in all)."""
        h, a, b = self.h, self.a, self.b
        np.right_shift(self.h1, 32 - _SLOTS, out=h)
        np.add(h, self.base, out=self.i1)
        np.bitwise_xor(self.h1, self.hb, out=h)
        np.multiply(h, 0x9E3779B1, out=h)
        np.bitwise_and(h, 0xFFFFFFFF, out=h)
        np.right_shift(h, 32 - _SLOTS, out=h)
        np.add(h, self.base, out=self.i2)
        self.t1.take(self.i1, out=self.e1, mode="clip")
        self.t2.take(self.i2, out=self.e2, mode="clip")
        np.bitwise_and(self.e1, _ID, out=self.p1)
        np.bitwise_and(self.e2, _ID, out=self.p2)
        np.equal(self.p1, self.p2, out=self.flag)
        np.copyto(a, self.flag)
        np.right_shift(self.e1 - self.p1, _W15, out=b)
        np.bitwise_or(a, b, out=a)
        np.right_shift(self.e2 - self.p2, _W13, out=b)
        np.bitwise_or(a, b, out=a)
        np.bitwise_or(a, self.qbase, out=a)
        np.copyto(self.iq, a)
        self.q.take(self.iq, out=self.w, mode="clip")
        np.bitwise_and(self.w, _ID, out=self.w2)
        np.right_shift(self.w, _W16, out=self.w1)
        # the weights stay within 32 and 4064 of 4096, so that each of the three shares is 1 at least
        np.subtract(_W4094, self.w2, out=a)
        np.multiply(a, self.w1, out=a)
        np.right_shift(a, _W12, out=a)
        np.add(a, _W1, out=a)
        np.copyto(self.f1, a)
        np.add(a, self.w2, out=a)
        np.subtract(_W4096, a, out=a)
        np.copyto(self.rest, a)
        np.copyto(self.f2, self.w2)

    def narrow(self, x: np.ndarray) -> np.ndarray:
        """Narrows the ranges to those of the ids ``x`` (u32), learns them, and returns the lanes with a word to move.

        A range holds the ids of order 0, then p1, then p2, which is taken where both are right.
        """
        k1 = np.flatnonzero(np.equal(self.p1, x, out=self.flag))
        k2 = np.flatnonzero(np.equal(self.p2, x, out=self.flag))
        np.copyto(self.h, x)
        self.order0.take(self.h, out=self.wide, mode="clip")
        np.bitwise_and(self.wide, _M32, out=self.start)
        np.right_shift(self.wide, _S32, out=self.wide)
        np.multiply(self.start, self.rest, out=self.start)
        np.multiply(self.wide, self.rest, out=self.wide)
        self.start[k1] = self.rest[k1] << _S16
        self.wide[k1] = self.f1[k1] << _S16
        f2 = self.f2[k2]
        self.start[k2] = (_U(4096) - f2) << _S16
        self.wide[k2] = f2 << _S16
        np.right_shift(self.rng, _S28, out=self.r)
        np.multiply(self.start, self.r, out=self.start)
        np.add(self.low, self.start, out=self.low)
        np.multiply(self.wide, self.r, out=self.rng)

        # weights lose a 32nd of what they are above 31, both in one word; right ones gain one of what lacks to 4064.
        # q2 learns from each id, q1 from those that p2 misses
        w, w1 = self.w, self.w1[k1]
        right1, right2 = (w1 + ((_W4064 - w1) >> _W5)) << _W16, w[k2] + ((_W4064 - self.w2[k2]) >> _W5)
        np.subtract(w, _BOTH1, out=self.a)
        np.right_shift(self.a, _W5, out=self.a)
        np.bitwise_and(self.a, _BOTH11, out=self.a)
        np.subtract(w, self.a, out=w)
        w[k1] = w[k1] & _ID | right1
        w[k2] = right2
        self.q[self.iq] = w

        # a table replaces a prediction when confidence is out
        first = np.bitwise_or(x, _STEP, out=self.b)
        for t, i, e, k in ((self.t2, self.i2, self.e2, k2), (self.t1, self.i1, self.e1, k1)):
            right = np.minimum(e[k] + _STEP, x[k] | _MOST)
            np.less(e, _KEPT, out=self.flag)
            np.subtract(e, _STEP, out=e)
            np.copyto(e, first, where=self.flag)
            e[k] = right
            t[i] = e
        np.multiply(self.h1, 0x85EBCA77, out=self.hb)
        np.bitwise_and(self.hb, 0xFFFFFFFF, out=self.hb)
        np.multiply(self.h, 0x9E3779B1, out=self.h1)
        np.bitwise_and(self.h1, 0xFFFFFFFF, out=self.h1)
        return np.flatnonzero(np.less(self.rng, _BOT, out=self.flag))


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and frequencies of at least 1 that sum to 65536."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = np.bincount(ids)
    sym = np.flatnonzero(n)
    share = n[sym] / n.sum() * (65_536 - len(sym))
    f = np.floor(share).astype(np.int64) + 1
    short = 65_536 - int(f.sum())
    f[np.argsort(-(share - np.floor(share)), kind="stable")[:short]] += 1
    return sym, f


def _settled(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Ranges below 2^32, cut where their ends differ in the upper 32 bits; those of ``low`` may go out then."""
    apart = np.flatnonzero((low ^ (low + rng)) >= _BOT)
    if len(apart):
        rng[apart] = (~low[apart] + _ONE) & _M32
    return rng


def encode_blocks(ids: np.ndarray, sym: np.ndarray, f: np.ndarray) -> list[np.ndarray]:
    """The payload (u32 words) of each block of ``ids``."""
    lanes = -(-len(ids) // BLOCK)
    if not lanes:
        return []
    steps = min(BLOCK, len(ids))
    grid = np.full(lanes * BLOCK, ids[-1], np.uint16)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    m = _Model(lanes, sym, f)
    x = np.zeros(lanes, np.uint32)
    words, owners = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    owner = np.arange(lanes, dtype=np.uint16 if lanes <= 65_536 else np.uint32)
    for step in range(steps):
        m.predict()
        np.copyto(x, grid[step])
        go = m.narrow(x)
        if len(go):
            lo = m.low[go]
            words.append((lo >> _S32).astype(np.uint32))
            owners.append(owner[go])
            m.rng[go] = _settled(lo, m.rng[go]) << _S32
            m.low[go] = lo << _S32
    lane = np.concatenate([*owners[1:], owner, owner])
    tail = [(m.low >> _S32).astype(np.uint32), m.low.astype(np.uint32)]
    ordered = np.concatenate([*words[1:], *tail])[np.argsort(lane, kind="stable")]
    return np.split(ordered, np.cumsum(np.bincount(lane, minlength=lanes))[:-1])


def decode_blocks(payloads: list[np.ndarray], sizes: list[int], sym: np.ndarray, f: np.ndarray) -> np.ndarray:
    lanes = len(payloads)
    if not lanes:
        return np.zeros(0, np.uint32)
    steps = max(sizes)
    slot = np.repeat(sym.astype(np.uint32), f)
    words = np.concatenate([*payloads, np.zeros(steps + 2, np.uint32)])
    pos = np.cumsum([0, *(len(p) for p in payloads)][:-1]).astype(np.int64)
    m = _Model(lanes, sym, f)
    code = np.zeros(lanes, np.uint64)
    for _ in range(2):
        code = (code << _S32) | words[pos]
        pos += 1
    grid = np.zeros((steps, lanes), np.uint16)
    last = len(words) - 1
    v, edge = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
    x, rest, index, flag = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32), np.zeros(lanes, np.int64), np.zeros(lanes, bool)
    for step in range(steps):
        m.predict()
        np.right_shift(m.rng, _S28, out=v)
        np.subtract(code, m.low, out=edge)
        np.floor_divide(edge, v, out=v)
        np.minimum(v, _M28, out=v)
        np.copyto(x, v, casting="unsafe")
        np.copyto(rest, m.rest, casting="unsafe")
        np.floor_divide(x, rest, out=x)
        np.copyto(index, x)
        slot.take(index, out=x, mode="clip")  # any, where a prediction was right
        np.left_shift(m.rest, _S16, out=edge)
        k = np.flatnonzero(np.greater_equal(v, edge, out=flag))
        x[k] = np.where(v[k] >> _S16 < _U(4096) - m.f2[k], m.p1[k], m.p2[k])
        np.copyto(grid[step], x, casting="unsafe")
        go = m.narrow(x)
        if len(go):
            at, lo = pos[go], m.low[go]
            code[go] = (code[go] << _S32) | words[np.minimum(at, last)]
            pos[go] = at + 1
            m.rng[go] = _settled(lo, np.maximum(m.rng[go], _ONE)) << _S32
            m.low[go] = lo << _S32
    grid = np.ascontiguousarray(grid.T)
    return np.concatenate([grid[k, :n] for k, n in enumerate(sizes)])


def write_frame(docs: list[tuple[int, np.ndarray]], start: int) -> bytes:
    """A frame of whole documents (doc_id, ids); ``start`` counts the ids before it in its file."""
    ids = np.concatenate([a for _, a in docs]) if docs else np.zeros(0, np.uint16)
    sym, f = _frequencies(ids)
    table = np.array([(NO_ID if d is None else d, len(a)) for d, a in docs], "<i8").reshape(-1, 2)
    head = zlib.compress(struct.pack("<QII", start, len(docs), len(sym)) + table.tobytes() + sym.astype("<u2").tobytes() + (f % 65_536).astype("<u2").tobytes(), 6)
    parts = [MAGIC, struct.pack("<I", len(head)), head, struct.pack("<I", zlib.crc32(head))]
    payloads = encode_blocks(ids, sym, f)
    parts.append(struct.pack("<I", len(payloads)))
    for k, p in enumerate(payloads):
        own = ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4")
        parts.append(struct.pack("<III", len(own), zlib.crc32(p.astype("<u4").tobytes(), zlib.crc32(own.tobytes())), len(p)))
    return b"".join([*parts, *(p.astype("<u4").tobytes() for p in payloads)])


def read_frame(frame: bytes) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """(start, documents) of a frame, each block held against its checksum."""
    try:
        if frame[:4] != MAGIC:
            raise CorruptFrame("magic")
        (n,) = struct.unpack_from("<I", frame, 4)
        head, at = frame[8 : 8 + n], 8 + n
        if struct.unpack_from("<I", frame, at)[0] != zlib.crc32(head):
            raise CorruptFrame("header")
        raw = zlib.decompress(head)
        start, n_docs, n_sym = struct.unpack_from("<QII", raw)
        table = np.frombuffer(raw, "<i8", 2 * n_docs, 16).reshape(-1, 2)
        sym = np.frombuffer(raw, "<u2", n_sym, 16 + 16 * n_docs).astype(np.int64)
        f = np.frombuffer(raw, "<u2", n_sym, 16 + 16 * n_docs + 2 * n_sym).astype(np.int64)
        f = np.where(f == 0, 65_536, f)
        (blocks,) = struct.unpack_from("<I", frame, at + 4)
        index = np.frombuffer(frame, "<u4", 3 * blocks, at + 8).reshape(-1, 3)
        at += 8 + 12 * blocks
        payloads = []
        for _, _, w in index.tolist():
            payloads.append(np.frombuffer(frame, "<u4", w, at))
            at += 4 * w
    except (struct.error, ValueError, zlib.error) as e:
        raise CorruptFrame(str(e)) from e
    sizes = index[:, 0].tolist()
    ids = decode_blocks(payloads, sizes, sym, f)
    at = 0
    for k, (size, crc, _) in enumerate(index.tolist()):
        if zlib.crc32(payloads[k].tobytes(), zlib.crc32(ids[at : at + size].astype("<u4").tobytes())) != crc:
            raise CorruptFrame(f"block {k}")
        at += size
    ends = np.cumsum(table[:, 1])
    return start, [(None if d == NO_ID else d, ids[e - n : e]) for (d, n), e in zip(table.tolist(), ends.tolist(), strict=True)]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME_IDS) -> None:
    """Encode whole texts, append ``end_id`` to each and write frames to ``path`` in ascending id order.

    Rows (file int, frame int, ids long, frame_bytes binary): file ascends with the ids, frame within a file. Documents
    are dealt by range of id, so files hold disjoint ranges; equal ids (repeated rows) stay together, ordered by text.
    A null or empty text is its end id alone; null ids come first. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(bpe.vocabulary(tokenizer))
        held: list[tuple[int, np.ndarray]] = []
        state = {"n": 0, "frame": 0, "before": 0, "file": 0}

        def flush() -> pa.RecordBatch:
            blob = write_frame(held, state["before"])
            row = [[state["file"]], [state["frame"]], [state["n"]], [blob]]
            state["before"] += state["n"]
            state["frame"] += 1
            state["n"] = 0
            held.clear()
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.large_binary() if len(blob) > 2**31 - 1 else pa.binary()), strict=True)], ["file", "frame", "ids", "frame_bytes"])

        for batch in batches:
            if batch.num_rows:
                state["file"] = batch.column(2)[0].as_py()
            for part in bpe.slices(batch, 1, SLICE):
                ids, ends = enc.ids(part.column(1))
                for doc, lo, hi in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    a = np.full(hi - lo + 1, end_id, "<u2")
                    a[:-1] = ids[lo:hi]
                    held.append((doc, a))
                    state["n"] += len(a)
                    if state["n"] >= frame_ids:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    n = max(docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("file", F.spark_partition_id())
    rows.mapInArrow(run, "file int, frame int, ids long, frame_bytes binary").write.mode("overwrite").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """Per document of written frames: doc_id, start (ids before it over all files), n_tokens, ids_crc32."""
    frames = spark.read.parquet(path)
    # one small row per frame, a bounded share of the ids: sums by file first, then the files before it
    sizes = frames.groupBy("file").agg(F.sum("ids").alias("ids"))
    before = sizes.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("file_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start, docs = read_frame(blob.as_py())
                rows = []
                for d, ids in docs:
                    rows.append((file, d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = frames.select("file", "frame_bytes").mapInArrow(run, "file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(before), "file").select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def frames_path(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/frames/{uuid.uuid4().hex}"
