"""Helpers shared by the corpus operators: durable tables, shipping code, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A word, wherever a contract says so: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="cartograph-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a lost executor costs no recomputation,
    and later reads see the same rows in the same partitions. Unlike checkpoint() the files are compressed columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tables/" in path:
                at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))


def words(c: Column) -> Column:
    """Array of words of a string column; null gives an empty array. White space is squeezed first so that a plain
    split on one character suffices."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def n_words(c: Column) -> Column:
    """Number of words, without building them: white space runs left after trimming, plus one."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``; nodes without an edge are absent.

    Alternates large-star and small-star (Kiveris et al., 2014) until a round changes nothing, after a number of rounds
    that grows as the logarithm of the nodes. A node's neighbours are reduced to a minimum with partial aggregation and
    meet it again by ``join_small``, so that no neighbour list is built and the centre of a large star is no hot key.
    Each round's output is written to the shared folder. Self links only make a node known.
    """
    e = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null").distinct()
    )
    mark = _signature(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # large star: larger neighbours of u point at the least neighbour of u (or u itself)
        large = join_small(both.where("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct())
        # small star: u and its smaller neighbours point at the least of them
        small_low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = join_small(large, small_low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, old = mark, e
        e = materialize(small.union(small_low.select("u", F.col("m").alias("v"))).distinct())
        free(old, low, large, small_low)
        mark = _signature(e)
        if mark == before:
            break
    e = e.where("u <> v")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct()).groupBy("node").agg(F.min("component").alias("component"))


def _signature(edges: DataFrame) -> tuple:
    """Number and sum of 64-bit hashes of the links between different nodes; a round that keeps both changed nothing."""
    return tuple(edges.where("u <> v").agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def clean(spark: SparkSession) -> None:
    """Delete what ``materialize`` and the token frames have left in the shared folder, once results are written."""
    for name in ("tables", "frames"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: join_small() sends the smaller side to all executors only up to this many (short) rows.
SMALL_ROWS = 50_000


def join_small(rows: DataFrame, groups: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Inner equi-join of many ``rows`` with a table of one row per group, counted first. Up to SMALL_ROWS groups it is
    broadcast; beyond, both sides are salted, so that a group with a third of all rows is dealt over many tasks."""
    if groups.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(groups), keys)
    left = rows.withColumn("_salt", F.floor(F.rand(17) * salts).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once; without it a lambda may evaluate it again for each element."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine, chunk: int = 128) -> Column:
    """Inclusive running results of the associative ``combine`` over an array of int. Folds run over chunks and then over
    the chunks' totals, as appending to an array copies it."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(None).cast("int").alias("at"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        return let(F.when(acc["at"].isNull(), x).otherwise(combine(acc["at"], x)), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))

    def scan(a: Column) -> Column:
        return F.aggregate(a, start, add, lambda acc: acc["out"])

    def joined(parts: Column) -> Column:
        before = scan(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda x: combine(F.get(b, k - 1), x))))))

    def of(a: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / chunk).cast("int")), lambda k: scan(F.slice(a, k * chunk + 1, F.lit(chunk))))
        return F.when(F.size(a) <= chunk, scan(a)).otherwise(let(many, joined))

    return let(values, of)


__all__ = ["SMALL_ROWS", "SPACE", "WORD", "clean", "connected_components", "free", "join_small", "let", "materialize", "n_words", "running", "shared_dir", "ship", "table", "text_or_empty", "words"]
