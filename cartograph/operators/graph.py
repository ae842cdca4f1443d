"""The foreign-key graph: degrees, communities, neighbours, bridges. ``edges`` has src, dst, src_col, dst_col, ord."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

# Tokens of bookkeeping columns and of identity tables.
ADMIN_TOKENS = ("last", "edited", "edit", "lastedited", "lasteditedby", "created", "create", "createdby", "modified", "modify", "modifiedby", "update", "updated", "updatedby", "change", "changed")
IDENTITY_TOKENS = ("user", "users", "person", "people", "employee", "employees", "staff", "account", "accounts", "login", "logon", "owner", "ownerid")


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, neighbour), each once, without self links."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(e.select("dst", "src")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(table, in_degree, out_degree, centrality): distinct tables on either side; centrality is distinct neighbours by
    the number of other tables."""
    n_in = edges.groupBy(F.col("dst").alias("table")).agg(F.count_distinct("src").alias("in_degree"))
    n_out = edges.groupBy(F.col("src").alias("table")).agg(F.count_distinct("dst").alias("out_degree"))
    near = both_ways(edges).groupBy(F.col("node").alias("table")).agg(F.count("*").alias("near"))
    others = F.greatest(F.count("*").over(Window.partitionBy()) - 1, F.lit(1))
    return (
        nodes.select("table").withColumn("others", others).join(n_in, "table", "left").join(n_out, "table", "left").join(near, "table", "left").na.fill(0)
        .select("table", "in_degree", "out_degree", (F.col("near") / F.col("others")).alias("centrality"))
    )


def communities(nodes: list[str], pairs: list[tuple[str, str]]) -> dict[str, int]:
    """Greedy modularity communities on the driver; the graph has one node per table. Labels go by size, then name; a
    graph without edges is one community."""
    links = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    if not links:
        return dict.fromkeys(nodes, 0)
    groups = {n: {n} for n in nodes}
    degree = {n: sum(n in p for p in links) for n in nodes}
    between: dict[tuple[str, str], int] = dict.fromkeys(links, 1)
    m = len(links)
    while True:
        gain = lambda p: between[p] / m - degree[p[0]] * degree[p[1]] / (2 * m * m)
        best = max(sorted(between), key=gain, default=None)
        if best is None or gain(best) <= 1e-12:
            break
        a, b = best
        groups[a] |= groups.pop(b)
        degree[a] += degree.pop(b)
        merged: dict[tuple[str, str], int] = {}
        for (x, y), k in between.items():
            x, y = sorted((a if x == b else x, a if y == b else y))
            if x != y:
                merged[x, y] = merged.get((x, y), 0) + k
        between = merged
    ordered = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    return {n: i for i, g in enumerate(ordered) for n in g}


def utility() -> Column:
    """Worth of a table in a plan, from its profile columns."""
    return (
        F.when(F.col("archetype") == "fact", 2.0).when(F.col("archetype") == "dimension", 1.0).otherwise(0.5)
        + 0.3 * F.least(F.lit(2), F.col("n_metrics"))
        + F.when(F.col("n_dates") > 0, 0.2).otherwise(0.0)
        + 0.2 * F.col("centrality")
        - F.when(F.col("is_audit_like"), 0.5).otherwise(0.0)
        - F.when(F.col("is_archive"), 0.6).otherwise(0.0)
    )


def expand_simple(seeds: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Seeds (table, pos) and their neighbours, k in all: seeds in order, then neighbours by name."""
    near = both_ways(edges).join(seeds.select(F.col("table").alias("node")), "node", "left_semi").select(F.col("neighbour").alias("table")).distinct().join(seeds, "table", "left_anti")
    return seeds.select("table", "pos").unionByName(near.withColumn("pos", F.lit(1_000_000))).orderBy("pos", "table").limit(k).select("table")


def expand_fk(seeds: DataFrame, edges: DataFrame, tables: DataFrame, k: int) -> DataFrame:
    """The first k seeds, filled up with their neighbours by utility, 0.2 more in the first seed's area."""
    first = seeds.orderBy("pos", "table").limit(k)
    area = tables.join(first.where("pos = 0"), "table").select(F.col("area").alias("first_area"))
    near = both_ways(edges).join(first.select(F.col("table").alias("node")), "node", "left_semi").select(F.col("neighbour").alias("table")).distinct().join(first, "table", "left_anti")
    near = near.join(tables, "table").join(F.broadcast(area), F.lit(True), "left")  # area is one row
    score = utility() + F.when(F.col("area") == F.col("first_area"), 0.2).otherwise(0.0)
    rows = first.select("table", F.lit(0.0).alias("score"), F.lit(0).alias("rank"), "pos").unionByName(near.select("table", score.alias("score"), F.lit(1).alias("rank"), F.lit(0).alias("pos")))
    return rows.orderBy("rank", "pos", F.desc(F.round("score", 9)), "table").limit(k).select("table", "score")


def _leg_penalty() -> Column:
    """Penalty of one foreign key by the tokens of its columns."""
    has = lambda c, words: F.arrays_overlap(c, F.array(*map(F.lit, words)))
    left, right = tokens(F.col("src_col")), tokens(F.col("dst_col"))
    la, ra, li, ri = has(left, ADMIN_TOKENS), has(right, ADMIN_TOKENS), has(left, IDENTITY_TOKENS), has(right, IDENTITY_TOKENS)
    clean = (F.array_contains(left, "id") & ~la) | (F.array_contains(right, "id") & ~ra)
    return F.when(la | ra, -0.5).otherwise(0.0) + F.when((la & ri) | (ra & li), -0.4).otherwise(0.0) + F.when(clean, 0.1).otherwise(0.0)


def bridges(edges: DataFrame, tables: DataFrame, main: str, targets: DataFrame) -> DataFrame:
    """(table, bridge, score): for each target not adjacent to ``main``, the best table adjacent to both."""
    e = edges.where("src <> dst").withColumn("pen", _leg_penalty())
    legs = e.select(F.col("src").alias("x"), F.col("dst").alias("y"), "pen").union(e.select("dst", "src", "pen")).groupBy("x", "y").agg(F.sum("pen").alias("pen"))
    info = tables.select("table", "area", "is_audit_like")
    near = legs.where(F.col("x") == main).select(F.col("y").alias("bridge"), F.col("pen").alias("p1"))
    far = targets.select("table").where(F.col("table") != main).join(near.select(F.col("bridge").alias("table")), "table", "left_anti")
    paths = near.join(legs.select(F.col("x").alias("bridge"), F.col("y").alias("table"), F.col("pen").alias("p2")), "bridge").join(far, "table")
    paths = paths.where(~F.col("bridge").isin(main)).join(info.select(F.col("table").alias("bridge"), F.col("area").alias("xa"), "is_audit_like"), "bridge")
    paths = paths.join(info.select("table", F.col("area").alias("ta")), "table").join(F.broadcast(info.where(F.col("table") == main).select(F.col("area").alias("ma"))), F.lit(True))  # one row
    generic = F.when(F.arrays_overlap(tokens(F.col("bridge")), F.array(*map(F.lit, IDENTITY_TOKENS))), -0.4).otherwise(0.0)  # once for each leg
    score = F.col("p1") + F.col("p2") + generic + F.when(F.col("is_audit_like"), -0.6).otherwise(0.0) + F.when(F.col("xa") == F.col("ma"), 0.2).otherwise(0.0) + F.when(F.col("xa") == F.col("ta"), 0.2).otherwise(0.0)
    best = Window.partitionBy("table").orderBy(F.desc("score"), "bridge")
    return paths.withColumn("score", score).withColumn("rn", F.row_number().over(best)).where("rn = 1").select("table", "bridge", "score")
