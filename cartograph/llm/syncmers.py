"""Document fingerprints from closed syncmers. DataFrame functions only.

A k-mer is K consecutive words; its inner substrings are pairs of consecutive words, compared by hash. A k-mer is a
closed syncmer if the least of its inner hashes is the first or the last one. That depends on the k-mer alone, so an
anchor found in one text is found wherever its words recur. The fingerprint holds all anchors of the whole text, each
distinct one with the position of its first word. In a text of fewer than K words each word is an anchor; a text
without words has none.

Two fingerprints are alike in the share of the anchors of either that both hold in line: shared anchors make segments
whose displacement changes by DRIFT words at most from one to the next, and the heaviest chain of segments that follow
each other in both texts counts. Text put in or taken out so moves what follows as a whole.

Cases: a null or empty text has the fingerprint of the text without words, likeness 1 to any other such text and 0 to
texts with words; equal texts have equal fingerprints; null ids come last; ties of doc_id are ordered by a hash of text
and place; a single document is its own next one; an empty table gives no rows; other columns are not read. Positions
count modulo 2^24 words, which displacements don't mind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, words

K = 6
DRIFT = 8
#: Rows of a bucket of neighbouring ids on average, and buckets at most: a bucket is sorted in one task and may spill.
BUCKET, BUCKETS = 2048, 4096
_POS = 24
_HASH = _POS + 1  # one bit between them tells two texts apart in a merge
_LEAST = -(2**63)


def _distinct(a: Column) -> Column:
    """The first of each hash of sorted anchors."""
    return F.filter(a, lambda x, j: (j == 0) | (F.shiftright(x, _HASH) != F.shiftright(F.get(a, j - 1), _HASH)))


def _anchors(s: Column) -> Column:
    """Packed anchors (39 bits of hash, a zero, 24 of position), sorted, of an array of inner hashes; K - 1 of them make a k-mer."""
    inner = K - 1

    def is_syncmer(i: Column) -> Column:
        edge = F.least(s[i], s[i + inner - 1])
        return F.least(*(s[i + j] for j in range(1, inner - 1))) >= edge

    at = F.filter(F.sequence(F.lit(0), F.size(s) - inner), is_syncmer)
    return let(F.array_sort(F.transform(at, lambda i: _packed(F.xxhash64(s[i], s[i + 2], s[i + 4]), i))), _distinct)


def _packed(h: Column, i: Column) -> Column:
    return F.shiftleft(F.shiftright(h, _HASH), _HASH) + i.bitwiseAND(F.lit((1 << _POS) - 1)).cast("long")


def anchors(text: Column) -> Column:
    """The fingerprint of a text as an array of longs."""
    none = F.array().cast("array<bigint>")

    def of_hashes(h: Column) -> Column:
        pairs = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))
        whole = F.array(_packed(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)), F.lit(0)))
        each = let(F.array_sort(F.transform(h, _packed)), _distinct)
        return F.when(F.size(h) == 0, none).when(F.size(h) < K, each).otherwise(let(pairs, lambda s: let(_anchors(s), lambda a: F.when(F.size(a) > 0, a).otherwise(whole))))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of_hashes)


def as_string(a: Column) -> Column:
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints. Anchors of both are merged by sorting, so the time is nearly linear."""
    pos = lambda x: x.bitwiseAND(F.lit((1 << _POS) - 1))

    def of(a: Column, b: Column) -> Column:
        both = F.array_sort(F.concat(a, F.transform(b, lambda x: x + F.lit(1 << _POS))))

        def of_merged(s: Column) -> Column:
            # an anchor of a and the same of b stand side by side
            n = F.size(s)
            first = F.filter(F.sequence(F.lit(0), n - 2), lambda j: F.shiftright(s[j], _HASH) == F.shiftright(s[j + 1], _HASH))
            return let(F.array_sort(F.transform(first, lambda j: F.shiftleft(pos(s[j]), _POS) + pos(s[j + 1]))), lambda p: of_shared(p, n))

        def of_shared(p: Column, n: Column) -> Column:
            return let(F.transform(p, lambda x: F.struct(pos(x).alias("at"), (pos(x) - F.shiftright(x, _POS)).alias("d"))), lambda d: in_line(d, n - F.size(d)))

        def in_line(d: Column, union: Column) -> Column:
            size = F.size(d)
            starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.abs(d[i]["d"] - F.get(d, i - 1)["d"]) > DRIFT))
            ends = lambda t: F.concat(F.slice(t, 2, F.size(t)), F.array(size))
            segment = lambda i, j: F.struct((j - i).alias("n"), d[i]["at"].alias("first"), d[j - 1]["at"].alias("last"))
            segments = let(starts, lambda t: F.zip_with(t, ends(t), segment))
            chain = let(F.filter(segments, lambda x: (x["n"] > 1) | (size == 1)), heaviest)
            return F.when(size == 0, F.lit(0.0)).otherwise(chain / union)

        def heaviest(segments: Column) -> Column:
            """Most anchors of segments that follow each other in b, too; quadratic in the segments, of which there is one
            for each place where more than DRIFT words went in or out."""
            none = F.array().cast("array<struct<last:bigint,n:int>>")

            def add(acc: Column, x: Column) -> Column:
                before = F.array_max(F.transform(F.filter(acc, lambda y: y["last"] < x["first"]), lambda y: y["n"]))
                return F.concat(acc, F.array(F.struct(x["last"].alias("last"), (x["n"] + F.coalesce(before, F.lit(0))).alias("n"))))

            return F.when(F.size(segments) < 2, F.coalesce(F.get(segments, F.lit(0))["n"], F.lit(0))).otherwise(F.aggregate(segments, none, add, lambda acc: F.array_max(F.transform(acc, lambda y: y["n"]))))

        return let(both, of_merged)

    both = F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).when(a == b, F.lit(1.0)).otherwise(let(F.struct(a.alias("a"), b.alias("b")), lambda p: of(p["a"], p["b"])))
    return both.cast("double")


def _bucketed(docs: DataFrame, rows: int) -> DataFrame:
    """Adds key (doc_id, null the least), order and bucket to (doc_id, text): buckets ascend with (key, order). Their bounds
    are quantiles of the ids, whatever range these have; an id that holds several quantiles is split by the order of its rows."""
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(_LEAST))).withColumn("order", F.shiftrightunsigned(F.xxhash64("text", F.monotonically_increasing_id()), 1))
    count = docs.count()
    m = max(1, min(BUCKETS, -(-count // rows)))
    share = [i / m for i in range(1, m)]
    bounds = (docs.agg(F.percentile_approx("key", share, 10 * m).alias("q")).first()["q"] or []) if share else []
    known = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in range(len(bounds).bit_length(), -1, -1)))

    def below(ok) -> Column:  # bounds are sorted: their number by halving
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(ok(F.get(known, at + s - 1)), F.lit(False)), at + s).otherwise(at))

    lo, hi = below(lambda q: q < F.col("key")), below(lambda q: q <= F.col("key"))
    part = F.shiftright("order", 20).cast("double") / float(1 << 43)
    docs = docs.withColumn("lo", lo).withColumn("hi", hi)
    inside = F.least(F.col("lo") + F.floor(part * (F.col("hi") - F.col("lo") + 1)).cast("int"), F.col("hi"))
    return docs.withColumn("bucket", F.when(F.col("hi") - F.col("lo") <= 1, F.col("hi")).otherwise(inside)).drop("lo", "hi")


def with_next(docs: DataFrame, fingerprint=anchors, bucket_rows: int = BUCKET) -> DataFrame:
    """Adds fp, next_text and next_fp, those of the next document by descending doc_id, to (doc_id, text); after the
    last comes the first. Documents are bucketed by neighbouring ids and ordered within buckets, and each bucket gets a
    copy of the first row of the next one: texts are shuffled once, and only one row per bucket, of ``BUCKETS`` at most,
    is ordered over all."""
    docs = _bucketed(docs, bucket_rows)
    tops = docs.groupBy("bucket").agg(F.max(F.struct("key", "order")).alias("top"))
    cyclic = Window.orderBy(F.desc("bucket"))
    to = F.coalesce(F.lag("bucket").over(cyclic), F.last("bucket").over(cyclic.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ring = materialize(tops.select("bucket", F.col("top.key").alias("key"), F.col("top.order").alias("order"), to.alias("to")), partitions=1)
    first = docs.join(F.broadcast(ring), ["bucket", "key", "order"]).groupBy("to").agg(F.max("text").alias("text"))
    copies = first.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("order"), F.col("to").alias("bucket"), F.lit(1).alias("copy"))
    rows = docs.withColumn("copy", F.lit(0)).unionByName(copies).withColumn("fp", fingerprint(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("copy", F.desc("key"), F.desc("order"))
    rows = rows.select("doc_id", "text", "fp", "copy", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp"))
    return rows.where("copy = 0").drop("copy")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    edited text has its last half replaced by as much of the next document's start."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = with_next(d)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("n_chars", F.length("text")).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    d = d.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", anchors(F.col("edited")).alias("edited_fp"), "next_fp")
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
