"""Token counts of whole texts from counts of distinct pre-tokens; ids are never built.

A sentencepiece BPE model whose pieces hold the space sign only in front never merges across the border between a
character and a following space. So a text is cut there into pre-tokens (a run of spaces with the word after it), each
distinct pre-token of the corpus is counted once, and a document's count is the sum of its pre-tokens' counts times
their frequencies. Frequencies of all documents choose at most ``HEAD`` short pre-tokens that every worker holds; they
cover most occurrences and all hot keys. The rest meet their counts in a shuffled join on the pre-token.

Cases: a null or empty text has 0 bytes and 0 tokens; very long words are pre-tokens like others; repeated rows and
repeated ids are counted row by row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import materialize, text_or_empty

HEAD = 100_000  # pre-tokens in the broadcast dictionary at most, each of at most HEAD_CHARS characters: under 10 MB
HEAD_CHARS = 32
_FLUSH = 400_000


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first space; the one after the last word, a run of spaces, likewise."""
    if not text:
        return []
    parts = text.replace("▁", " ").split(" ")
    if "" not in parts:
        return parts
    out, lead = [], 0
    for p in parts:
        if p:
            out.append(" " * lead + p)
            lead = 0
        else:
            lead += 1
    if lead:
        out.append(" " * (lead - 1))  # "" is a single space sign
    return out


def _model(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if any("▁" in p.lstrip("▁") for p in map(sp.id_to_piece, range(sp.get_piece_size()))):
        raise ValueError("pieces of this model cross spaces")
    return sp


def count_piece(sp, key: str) -> int:
    return len(sp.encode(key)) if key else 1


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def distinct_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(pre, freq, n): each distinct pre-token of column text, its occurrences in the corpus and its tokens."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        names = ["pre", "freq"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(lo, 64).to_pylist():
                    seen.update(pre_tokens(text))
                if len(seen) > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names)
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _model(vocabulary(tokenizer))
        for batch in batches:
            keys = batch.column(0).to_pylist()
            n = [len(x) if k else 1 for k, x in zip(keys, sp.encode(keys, num_threads=1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["pre", "freq", "n"])

    pairs = docs.select("text").mapInArrow(tally, "pre string, freq long").groupBy("pre").agg(F.sum("freq").alias("freq"))
    return materialize(pairs.mapInArrow(count, "pre string, freq long, n long"))


def frequent(counts: DataFrame, head: int) -> dict[str, int]:
    """Counts of the most frequent short pre-tokens, ``head`` at most: a histogram of rounded log frequencies (a few
    hundred rows) tells from which frequency on they are few enough."""
    short = counts.where(F.length("pre") <= HEAD_CHARS).withColumn("level", F.floor(F.log2("freq") * 16).cast("int"))
    levels = sorted(((r["level"], r["k"]) for r in short.groupBy("level").agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = None, 0
    for level, k in levels:
        total += k
        if total > head:
            break
        least = level
    return {} if least is None else {r["pre"]: r["n"] for r in short.where(F.col("level") >= least).select("pre", "n").collect()}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    counts = distinct_counts(docs, tokenizer)
    known = docs.sparkSession.sparkContext.broadcast(frequent(counts, head))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        row = TaskContext.get().partitionId() << 36
        kinds, names = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), ["row", "doc_id", "n_bytes", "n_head", "pre", "freq"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    pre = pre_tokens(text)
                    n = list(map(get, pre))
                    tail = Counter(p for p, k in zip(pre, n, strict=True) if k is None) if None in n else {}
                    # a document's own row has a key that no pre-token has, so that these rows spread
                    rows.append((row, doc, len(text.encode()), sum(filter(None, n)), f"\x00 {row}", 0))
                    rows += [(row, None, None, 0, p, c) for p, c in tail.items()]
                    row += 1
                yield _batch(rows, kinds, names)

    parts = docs.mapInArrow(split, "row long, doc_id long, n_bytes long, n_head long, pre string, freq long")
    return (
        parts.join(counts.select("pre", "n"), "pre", "left")
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n_head") + F.coalesce("n", F.lit(0)) * F.col("freq")).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
