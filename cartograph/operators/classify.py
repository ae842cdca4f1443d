"""Table archetypes, flags, summaries and subject areas over the column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_archive, tokens
from .graph import communities, degrees

# Tokens of generic tables, and of names that don't describe an area.
GENERIC_TOKENS = (
    "people", "person", "user", "users", "transaction", "transactions", "transactiontype", "transactiontypes", "type", "types", "status", "statuses", "method", "methods",
    "parameter", "parameters", "system", "systems", "sys", "log", "logs", "history", "archive", "archived", "temp", "tmp", "code", "codes", "lookup", "lookups", "ref", "reference", "references",
)
AREA_STOP_TOKENS = ("id", "name", "key", "last", "edited", "by", "valid", "from", "to", "pk")


def counts(profiles: DataFrame) -> DataFrame:
    """Per table: columns, columns outside all declared keys, metrics and dates."""
    when = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return profiles.groupBy("table").agg(
        F.count("*").alias("n_columns"), when(F.col("role") == "metric").alias("n_metrics"), when(F.col("role") == "date").alias("n_dates"),
        when(F.col("pk_pos").isNull() & F.col("fk_pos").isNull()).alias("n_non_key"), when(F.col("pk_pos").isNotNull()).alias("n_pk"), when(F.col("pk_pos").isNotNull() & F.col("fk_pos").isNotNull()).alias("n_pk_fk"),
        F.max("n_rows").alias("n_rows_sampled"),
    )


def archetype():
    """The first rule that fits, from counts and degrees."""
    degree = F.col("in_degree") + F.col("out_degree")
    return (
        F.when((F.col("n_pk") >= 2) & (F.col("n_pk") == F.col("n_pk_fk")) & (F.col("n_non_key") <= 1) & (degree >= 2), "bridge")
        .when((F.col("n_metrics") >= 2) & (F.col("n_dates") >= 1) & (degree >= 2), "fact")
        .when((F.col("in_degree") >= 2) & (F.col("n_metrics") <= 1) & (F.col("n_pk") == 1), "dimension")
        .when((F.col("n_columns") <= 4) & (F.col("n_metrics") == 0) & (degree >= 1), "reference")
        .otherwise("operational")
    )


def tables(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per table: counts, degrees, centrality, archetype, is_archive, is_audit_like, area, summary."""
    t = counts(profiles).join(degrees(profiles.select("table").distinct(), edges), "table").withColumn("archetype", archetype())
    p80 = F.percentile("centrality", 0.8).over(Window.partitionBy())
    generic = F.arrays_overlap(tokens(F.element_at(F.split("table", r"\."), -1)), F.array(*map(F.lit, GENERIC_TOKENS)))
    t = t.withColumn("is_archive", is_archive(F.col("table"))).withColumn("is_audit_like", generic | ((F.col("centrality") >= p80) & (F.col("n_metrics") == 0) & (F.col("n_dates") == 0)))
    nodes = sorted(r["table"] for r in profiles.select("table").distinct().collect())  # one row per table
    label = communities(nodes, [(r["src"], r["dst"]) for r in edges.select("src", "dst").collect()])
    areas = profiles.sparkSession.createDataFrame([(n, str(a)) for n, a in label.items()], "table string, area string")
    return t.join(areas, "table").join(summaries(profiles, edges), "table").withColumn("summary", F.concat(F.col("table"), F.lit(" is a "), F.col("archetype"), F.col("summary")))


def summaries(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """What follows the archetype in a table's summary: keys, dates, measures, dimensions and joins."""
    listed = lambda cond, n: F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "column")))), lambda x: x["column"]), 1, n), ", ")
    cols = profiles.groupBy("table").agg(
        listed(F.col("role") == "key", 3).alias("keys"), listed(F.col("role") == "date", 2).alias("dates"),
        listed(F.col("role") == "metric", 5).alias("measures"), listed(F.col("role").isin("category", "text"), 6).alias("dims"),
    )
    joins = edges.groupBy(F.col("src").alias("table")).agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]), 1, 4), ", ").alias("joins"))
    part = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"; {name}: "), F.col(c))).otherwise("")
    return cols.join(joins, "table", "left").na.fill("").select("table", F.concat(part("keys", "keys"), part("dates", "dates"), part("measures", "measures"), part("top dims", "dims"), part("joins", "joins")).alias("summary"))


def areas(t: DataFrame) -> DataFrame:
    """One row per area: name, n_tables, key_tables (top five by centrality), archetypes, summary. The name is made of the
    three most frequent tokens of table names that are neither among the ten most common of all nor generic."""
    words = t.select("area", "table", F.explode(tokens(F.element_at(F.split("table", r"\."), -1))).alias("token"))
    common = words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(10).select("token")
    own = words.join(common, "token", "left_anti").where((F.length("token") > 2) & ~F.col("token").isin(*AREA_STOP_TOKENS)).groupBy("area", "token").agg(F.count("*").alias("n"))
    names = own.groupBy("area").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "token"))), lambda x: x["token"]), 1, 3), " / ").alias("name"))
    kinds = archetype_distribution(t).groupBy("area").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "archetype", F.col("n").cast("string")))), ", ").alias("archetypes"))
    key = t.groupBy("area").agg(F.count("*").alias("n_tables"), F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("centrality")).alias("c"), "table"))), lambda x: x["table"]), 1, 5), ", ").alias("key_tables"))
    out = key.join(kinds, "area").join(names, "area", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("area_"), "area")))
    return out.withColumn("summary", F.concat(F.lit("Key tables: "), "key_tables", F.lit("; archetypes: "), "archetypes"))


def archetype_distribution(t: DataFrame) -> DataFrame:
    return t.groupBy("area", "archetype").agg(F.count("*").alias("n"))


def important(t: DataFrame, k: int = 8) -> DataFrame:
    """Tables by centrality; audit-like and archive tables only fill up."""
    flagged = (F.col("is_audit_like") | F.col("is_archive")).cast("int")
    return t.select("table", "centrality", flagged.alias("flagged")).orderBy("flagged", F.desc("centrality"), "table").limit(k)


def patterns(t: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of flags: star, normalized, time_series, analytics."""
    n = edges.agg(F.count("*").alias("n_edges"))
    return t.agg(
        F.max(F.col("archetype") == "fact").alias("fact"), F.max(F.col("archetype") == "dimension").alias("dim"), F.count("*").alias("n"),
        F.max(F.col("n_dates") > 0).alias("time_series"), F.max(F.col("n_metrics") > 0).alias("analytics"),
    ).join(F.broadcast(n), F.lit(True)).select((F.col("fact") & F.col("dim")).alias("star"), (F.col("n_edges") > F.col("n")).alias("normalized"), "time_series", "analytics")
