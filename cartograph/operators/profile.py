"""Column statistics in one pass per table, value patterns and semantic roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import display, normalize_identifier, value_pattern
from ..sources.catalog import Catalog, kind_of

METRIC_DISTINCT = 10
VALUES_DISTINCT = 20
DATE_HINTS = ("date", "datetime", "time", "timestamp")
STATS = "table string, ord int, column string, n_rows long, n_null long, n_distinct long, distinct_values array<string>, min double, max double, patterns array<string>"


def profile(df: DataFrame, table: str, threshold: int = VALUES_DISTINCT, approximate: bool = False, values: set[str] | None = None) -> DataFrame:
    """One row per column of ``df`` from a single aggregate, unpivoted by exploding one array.

    NaN counts as null. Nested columns have no distinct counts. Values are listed up to ``threshold`` distinct ones.
    Sets of values are gathered for the columns in ``values``, by default all: that is for samples. Full tables take
    ``profile_full``, which counts distinct values by HyperLogLog (``approximate``) and gathers no large set.
    """
    gather = {f.name for f in df.schema.fields} if values is None else values
    aggs: list[Column] = [F.count("*").alias("n")]
    parts = []
    for i, f in enumerate(df.schema.fields):
        kind, c = kind_of(f.dataType), F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        nested = kind == "nested"
        distinct = F.lit(None).cast("long") if nested else (F.approx_count_distinct(c) if approximate else F.count_distinct(c))
        shown = display(c)
        aggs += [
            F.sum(c.isNull().cast("long")).alias(f"null{i}"),
            F.max(F.lit(None).cast("long")).alias(f"dist{i}") if nested else distinct.alias(f"dist{i}"),
            F.max(F.lit(None).cast("array<string>")).alias(f"vals{i}") if nested or f.name not in gather else F.sort_array(F.collect_set(c)).cast("array<string>").alias(f"vals{i}"),
            (F.min(c.cast("double")) if kind == "numeric" else F.min(F.lit(None).cast("double"))).alias(f"min{i}"),
            (F.max(c.cast("double")) if kind == "numeric" else F.max(F.lit(None).cast("double"))).alias(f"max{i}"),
            (F.array_sort(F.collect_set(value_pattern(shown))) if kind == "text" else F.max(F.lit(None).cast("array<string>"))).alias(f"pat{i}"),
        ]
        parts.append(F.struct(
            F.lit(i).alias("ord"), F.lit(f.name).alias("column"), F.col("n").alias("n_rows"), F.coalesce(f"null{i}", F.lit(0)).alias("n_null"), F.col(f"dist{i}").cast("long").alias("n_distinct"),
            F.when(F.col(f"dist{i}") <= threshold, F.col(f"vals{i}")).alias("distinct_values"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.col(f"pat{i}").alias("patterns"),
        ))
    if not parts:
        return df.sparkSession.createDataFrame([], STATS)
    return df.agg(*aggs).select(F.explode(F.array(*parts)).alias("s")).select(F.lit(table).alias("table"), "s.*")


def profile_full(df: DataFrame, table: str, threshold: int = VALUES_DISTINCT, approximate: bool = True) -> DataFrame:
    """Statistics of whole columns in two passes: approximate counts, then sets for columns of few distinct values, and
    exact counts unless ``approximate``."""
    first = profile(df, table, threshold, approximate=True, values=set()).collect()  # one row per column
    few = {r["column"] for r in first if r["n_distinct"] is not None and r["n_distinct"] <= 2 * threshold}
    return profile(df, table, threshold, approximate=approximate, values=few)


def profile_catalog(catalog: Catalog, rows: int = 50, ordered: bool = False, max_columns: int = 15) -> DataFrame:
    """Statistics of a sample of each readable table."""
    found = [profile(catalog.sample(n, rows=rows, ordered=ordered, max_columns=max_columns), catalog.key(n)) for n in catalog.readable()]
    return reduce(DataFrame.unionByName, found) if found else catalog.spark.createDataFrame([], STATS)


def coverage(profiles: DataFrame) -> DataFrame:
    """One row: rows sampled of all tables (total, mean, most) and the number of tables."""
    n = profiles.groupBy("table").agg(F.coalesce(F.max("n_rows"), F.lit(0)).alias("n"))
    return n.agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.count("*").alias("tables"))


def entity_tags(profiles: DataFrame, gazetteer) -> DataFrame:
    """Profiles with the lower-cased entity labels of the column's name after its own tags."""
    named = gazetteer.tag(profiles, "column")
    return named.withColumn("tags", F.array_union("tags", F.transform("labels", F.lower))).drop("labels")


def role(column: str = "column", kind: str = "kind", n_distinct: str = "n_distinct") -> Column:
    """The role of a column from (column, kind, pk_pos, fk_pos, n_distinct); the first rule that fits."""
    name = normalize_identifier(F.col(column))
    squeezed = F.regexp_replace(F.lower(column), "[^a-z0-9]", "")
    hinted = reduce(lambda a, b: a | b, (F.contains(name, F.lit(h)) for h in DATE_HINTS))
    return (
        F.when((F.col(kind) == "temporal") | (hinted & (F.col(kind) != "numeric")), "date")
        .when(F.col("pk_pos").isNotNull() | F.col("fk_pos").isNotNull() | F.lower(column).endswith("_id") | squeezed.endswith("id"), "key")
        .when(F.col(kind) == "numeric", F.when(F.col(n_distinct) > METRIC_DISTINCT, "metric").otherwise("category"))
        .when(F.col(kind) == "text", "text")
        .otherwise("category")
    )


def column_profiles(columns: DataFrame, stats: DataFrame, promote_text: bool = False) -> DataFrame:
    """Columns with role, null_rate, distinct_ratio, distinct_values, value_range, tags and patterns. A column without
    statistics is an empty one. ``promote_text`` makes text of few distinct values a category."""
    c = columns.join(stats.drop("ord"), ["table", "column"], "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    r = role()
    if promote_text:
        r = F.when((r == "text") & F.col("n_distinct").between(1, VALUES_DISTINCT), "category").otherwise(r)
    n = F.when(F.col("n_rows") > 0, F.col("n_rows"))
    tag = lambda p: F.when(p == "percent", "unit:%").otherwise(p)
    return (
        c.withColumn("role", r)
        .withColumn("null_rate", F.col("n_null") / n)
        .withColumn("distinct_ratio", F.col("n_distinct") / n)
        .withColumn("value_range", F.when((F.col("role") == "metric") & (F.col("n_distinct") <= VALUES_DISTINCT), F.struct("min", "max")))
        .withColumn("tags", F.transform(F.coalesce("patterns", F.array().cast("array<string>")), tag))
        .withColumn("sample_patterns", F.transform(F.coalesce("patterns", F.array().cast("array<string>")), lambda p: F.concat(p, F.lit("-like"))))
    )
