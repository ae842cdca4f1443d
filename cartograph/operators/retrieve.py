"""Retrieval of tables, columns or documents by tokens, vectors and both. An index is a DataFrame, so the same operators
serve a schema of a hundred tables and a corpus of documents; a query is a handful of tokens or one vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_archive, number_variant, token_list, tokens
from ..functions.vectors import EPSILON, dot, hint_boost, min_max, norm, synonym_weight

# Words that ask for an aggregate.
AGGREGATE_WORDS = ("top", "rank", "ranked", "sum", "total", "count", "avg", "average", "median", "percent", "percentage")
APPROACHES = ("lexical", "emb_table", "emb_column", "combo")


def schema_index(profiles: DataFrame) -> DataFrame:
    """(item, token, weight) of tables: table name 2, schema 0.5, column names 1, roles 0.5, all a fifth for archives."""
    schema, name = F.split("table", r"\.")[0], F.element_at(F.split("table", r"\."), -1)
    one = profiles.select("table").distinct()
    parts = [
        one.select("table", F.explode(tokens(name)).alias("token"), F.lit(2.0).alias("w")),
        one.select("table", F.explode(tokens(schema)).alias("token"), F.lit(0.5).alias("w")),
        profiles.select("table", F.explode(tokens(F.col("column"))).alias("token"), F.lit(1.0).alias("w")),
        profiles.select("table", F.explode(tokens(F.col("role"))).alias("token"), F.lit(0.5).alias("w")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    factor = F.when(is_archive(F.col("table")), 0.2).otherwise(1.0)
    return rows.groupBy(F.col("table").alias("item"), "token").agg(F.sum("w").alias("w")).withColumn("table", F.col("item")).select("item", "token", (F.col("w") * factor).alias("weight"))


def text_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, token, weight): occurrences of each token in a text column."""
    return docs.select(F.col(id_col).cast("string").alias("item"), F.explode(tokens(F.col(text_col))).alias("token")).groupBy("item", "token").agg(F.count("*").cast("double").alias("weight"))


def query_tokens(spark, query: str) -> DataFrame:
    """(token, n) of a query, repeats counted."""
    found: dict[str, int] = {}
    for t in token_list(query):
        found[t] = found.get(t, 0) + 1
    return spark.createDataFrame(list(found.items()), "token string, n int")


def expand(query: DataFrame, lexicon: DataFrame | None = None, vector: list[float] | None = None, top_n: int = 16, min_df: int = 2) -> DataFrame:
    """(token, q): 1 for each occurrence, 0.3 for the other grammatical number, and neighbours in the lexicon."""
    own = query.select("token", F.col("n").cast("double").alias("q"))
    other = query.select(number_variant(F.col("token")).alias("token"), F.lit(0.3).alias("q")).where("token is not null")
    rows = own.unionByName(other)
    if lexicon is not None and vector is not None:
        near = knn(lexicon.join(query, "token", "left_anti").where(F.col("df") >= min_df), vector, top_n, "token", "vec")
        rows = rows.unionByName(near.select(F.col("item").alias("token"), synonym_weight(F.col("score")).alias("q")))
    return rows.groupBy("token").agg(F.sum("q").alias("q"))


def boosts(index: DataFrame, query: DataFrame, per_token: int = 20) -> DataFrame:
    """(item, boost): small sums for the items that weigh a query token most."""
    best = Window.partitionBy("token").orderBy(F.desc("weight"), "item")
    hit = index.join(F.broadcast(query.select("token").distinct()), "token").withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= per_token)
    return hit.groupBy("item").agg(F.sum(hint_boost(F.col("weight"))).alias("boost"))


def lexical(index: DataFrame, query: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """(item, score): weights of the expanded query's tokens by the item's norm, plus boosts; items without a hit score 0.
    The query is broadcast: its size is that of a sentence."""
    q = expanded if expanded is not None else expand(query)
    scored = index.join(F.broadcast(q), "token", "left").groupBy("item").agg(
        F.sum(F.col("weight") * F.coalesce("q", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
    )
    return scored.join(boosts(index, query), "item", "left").select("item", (F.col("dot") / (F.col("norm") + EPSILON) + F.coalesce("boost", F.lit(0.0))).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "item").limit(k)


def without_archives(scores: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """The k best; archives follow all others, and strictly only appear if there is nothing else."""
    s = scores.withColumn("archive", is_archive(F.col("item"))).orderBy("archive", F.desc("score"), "item").limit(k)
    if strict:  # a window over the k best
        s = s.withColumn("live", ~F.min("archive").over(Window.partitionBy())).where(~F.col("archive") | ~F.col("live"))
    return s.orderBy("archive", F.desc("score"), "item").select("item", "score")


# vectors


def knn(items: DataFrame, vector: list[float], k: int, id_col: str = "item", vec_col: str = "vec") -> DataFrame:
    """(item, score): the k nearest by cosine, exactly; one scan and a bounded top-k per task."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    size = sum(x * x for x in map(float, vector)) ** 0.5 + EPSILON
    v = F.col(vec_col)
    return items.select(F.col(id_col).alias("item"), (dot(v, q) / ((norm(v) + EPSILON) * F.lit(size))).alias("score")).orderBy(F.desc("score"), "item").limit(k)


def knn_lsh(items: DataFrame, vector: list[float], k: int, id_col: str = "item", vec_col: str = "vec", bucket: float = 2.0, tables: int = 8) -> DataFrame:
    """Approximate neighbours by random projection buckets, for indexes that are searched again and again."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    v = Normalizer(inputCol="raw", outputCol="features").transform(items.select(F.col(id_col).alias("item"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("raw")))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(v)
    size = sum(x * x for x in vector) ** 0.5 or 1.0
    near = model.approxNearestNeighbors(v, Vectors.dense([x / size for x in vector]), k)
    return near.select("item", (1 - F.col("distCol") * F.col("distCol") / 2).alias("score"))


class HashedEmbedder:
    """Texts to vectors by hashed TF-IDF of tokens; any object with ``fit`` and ``encode`` may stand in."""

    def __init__(self, features: int = 256):
        self.features, self.model = features, None

    def _tf(self, df: DataFrame, text_col: str) -> DataFrame:
        from pyspark.ml.feature import HashingTF

        return HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=self.features).transform(df.withColumn("_tokens", tokens(F.col(text_col))))

    def fit(self, df: DataFrame, text_col: str) -> HashedEmbedder:
        from pyspark.ml.feature import IDF

        self.model = IDF(inputCol="_tf", outputCol="_idf").fit(self._tf(df, text_col))
        return self

    def encode(self, df: DataFrame, text_col: str) -> DataFrame:
        """Adds vec (array<double>, of length one)."""
        from pyspark.ml.feature import Normalizer
        from pyspark.ml.functions import vector_to_array

        if self.model is None:
            raise ValueError("the embedder has not been fitted")
        out = Normalizer(inputCol="_idf", outputCol="_unit").transform(self.model.transform(self._tf(df, text_col)))
        return out.withColumn("vec", vector_to_array("_unit")).drop("_tokens", "_tf", "_idf", "_unit")

    def vector(self, spark, text: str) -> list[float]:
        return self.encode(spark.createDataFrame([(text,)], "t string"), "t").first()["vec"]


def token_df(items: DataFrame) -> DataFrame:
    """(token, df) over (item, tokens array): items that hold a token; numbers are no tokens here."""
    return items.select("item", F.explode(F.array_distinct("tokens")).alias("token")).where(~F.rlike("token", F.lit("^[0-9]+$"))).groupBy("token").agg(F.count("*").alias("df"))


def lexicon(items: DataFrame) -> DataFrame:
    """(token, df, vec) over (item, tokens, vec): the mean vector of the items that hold a token, averaged by position."""
    rows = items.select("item", "vec", F.explode(F.array_distinct("tokens")).alias("token")).where(~F.rlike("token", F.lit("^[0-9]+$")))
    cells = rows.select("token", F.posexplode("vec").alias("pos", "x")).groupBy("token", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("df"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])  # bounded by the dimension
    return cells.groupBy("token").agg(F.max("df").alias("df"), vec.alias("vec"))


def lexicon_neighbours(lex: DataFrame, vector: list[float], top_n: int = 10, min_df: int = 2, exclude: tuple[str, ...] = ()) -> DataFrame:
    near = knn(lex.select("token", "vec"), vector, 5 * top_n, "token")
    near = near.where(~F.col("item").isin(*exclude)) if exclude else near
    return near.join(lex.select(F.col("token").alias("item"), "df"), "item").where(F.col("df") >= min_df).orderBy(F.desc("score"), "item").limit(top_n)


def by_table(hits: DataFrame, table: Column) -> DataFrame:
    """Scores of column hits summed per table, negative ones as 0."""
    return hits.groupBy(table.alias("item")).agg(F.sum(F.greatest(F.lit(0.0), F.col("score"))).alias("score"))


def combined(embedded: DataFrame, lexed: DataFrame, alpha: float = 0.7, index: DataFrame | None = None, expanded: DataFrame | None = None, tables: DataFrame | None = None, k: int = 8, strict: bool = True) -> DataFrame:
    """(item, score): both sides scaled to 0 to 1 and mixed; a side that lacks an item gives 0. With ``index`` and
    ``expanded`` comes a bonus for overlap, and with ``tables`` one for metrics, dates and facts if the query asks for an
    aggregate."""
    n = max(50, k)
    e = top(embedded, n).select("item", min_max(F.col("score")).alias("e"))
    x = top(lexed, n).select("item", min_max(F.col("score")).alias("l"))
    s = e.join(x, "item", "full_outer").select("item", (F.lit(alpha) * F.coalesce("e", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("l", F.lit(0.0))).alias("score"))
    if index is not None and expanded is not None:
        hit = index.join(F.broadcast(expanded.select("token").withColumn("hit", F.lit(1))), "token", "left").groupBy("item").agg(
            (F.sum(F.when(F.col("hit") == 1, F.col("weight")).otherwise(0.0)) / (F.sqrt(F.sum(F.col("weight") * F.col("weight"))) + EPSILON)).alias("overlap")
        )
        s = s.join(hit, "item", "left").select("item", (F.col("score") + 0.12 * F.coalesce("overlap", F.lit(0.0))).alias("score"))
        if tables is not None:
            asks = expanded.agg(F.max(F.col("token").isin(*AGGREGATE_WORDS)).alias("asks"))
            bonus = F.when(F.col("n_metrics") > 0, 0.08).otherwise(0.0) + F.when(F.col("n_dates") > 0, 0.04).otherwise(0.0) + F.when(F.col("archetype") == "fact", 0.06).otherwise(0.0)
            t = tables.select(F.col("table").alias("item"), bonus.alias("bonus")).join(F.broadcast(asks), F.lit(True))  # one row
            s = s.join(t, "item", "left").select("item", (F.col("score") + F.when(F.col("asks"), F.coalesce("bonus", F.lit(0.0))).otherwise(0.0)).alias("score"))
    return without_archives(s, k, strict)


def find_columns(profiles: DataFrame, keyword: str, limit: int = 25, by: str | None = None, hits: DataFrame | None = None) -> DataFrame:
    """(table, column, role, dtype, score): vector hits first (scores over 10), then 1 for a shared name token and 0.3 for
    a shared role token; each column once."""
    q = F.array(*map(F.lit, token_list(keyword))) if token_list(keyword) else F.array().cast("array<string>")
    rows = profiles.where(F.col("table") == by) if by else profiles
    score = F.when(F.arrays_overlap(tokens(F.col("column")), q), 1.0).otherwise(0.0) + F.when(F.arrays_overlap(tokens(F.col("role")), q), 0.3).otherwise(0.0)
    rows = rows.withColumn("score", score)
    if hits is not None:
        rows = rows.join(hits.select(F.split("item", "::")[0].alias("table"), F.split("item", "::")[1].alias("column"), (F.col("score") + 10).alias("near")), ["table", "column"], "left").withColumn("score", F.coalesce("near", "score"))
    return rows.where("score > 0").orderBy(F.desc("score"), "table", "ord").limit(limit).select("table", "column", "role", "dtype", "score")


def table_texts(profiles: DataFrame, tables: DataFrame) -> DataFrame:
    """(item, text) that embeds a table: its summary and its first 12 columns."""
    col = F.concat(F.col("column"), F.lit("("), F.col("role"), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "ref_table"), F.lit("")))
    cols = profiles.where("ord < 12").groupBy("table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", col.alias("t")))), lambda x: x["t"]), ", ").alias("cols"))
    return tables.join(cols, "table").select(F.col("table").alias("item"), F.concat("table", F.lit(": "), "summary", F.lit(". Columns: "), "cols").alias("text"))


def column_texts(profiles: DataFrame, tables: DataFrame, most: int = 20) -> DataFrame:
    """(item table::column, text) that embeds a column."""
    p = profiles.where(F.col("ord") < most).join(tables.select("table", "summary"), "table")
    text = F.concat("table", F.lit("."), "column", F.lit(": role="), "role", F.lit("; type="), "dtype", F.lit("; tags="), F.array_join("tags", ","), F.coalesce(F.concat(F.lit(" -> "), "ref_table"), F.lit("")), F.lit("; table="), "summary")
    return p.select(F.concat_ws("::", "table", "column").alias("item"), text.alias("text"))
