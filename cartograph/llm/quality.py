"""Quality rules: fixed base rules, then robust multivariate outliers per language and source. DataFrame functions only.

Each document gets a vector of transformed statistics. Per (language, source) the minimum covariance determinant is
sought deterministically: start from medians and median deviations, then repeat concentration steps, each of which
keeps the share ``SUPPORT`` of the documents with the least Mahalanobis distance and takes their mean and covariance. A
step is two aggregates that Spark combines before the shuffle (a histogram of distances and sums), so a group with a
third of all rows is no bottleneck, and steps repeat until the determinants settle. The covariance gets the consistency factor of the chi-square and a floor of noise per
coordinate, which keeps it regular where most documents share a value; repetition gets noise by the length of the
document, as one repeated line says little in a short one. Documents beyond the ``CUTOFF`` distance go.

Groups of fewer than ``LEAST`` documents that pass the base rules are pooled by language, and those that are still too
few together; what remains below it is judged by the base rules alone.

Cases: a null or empty text has no words and fails; null languages and sources are groups of their own; statistics come
from whole texts; repeated rows count as often as they come; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, join_small, let, materialize, words

LEAST = 50
SUPPORT = 0.75
#: Steps of the grids for quantiles: of a statistic, and of the binary logarithm of a squared distance.
GRID = 512
SETTLED = 1e-3
STATS = ("v0", "v1", "v2", "v3", "v4")
#: Standard deviation of noise in each coordinate: log words, log word length, roots of the shares of symbols, repeated
#: lines and repeated words.
FLOOR = (0.25, 0.05, 0.02, 0.05, 0.08)
#: Variance that a document adds in the last two, by its length: one repeated line lies two standard deviations off, in
#: few lines as in many. A line counts as LINE words at most, so that long documents of one line get none for free.
NOISE = ("u3", "u4")
LINE = 12


def _gamma_p(a: float, x: float) -> float:
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_cdf(x: float, k: int) -> float:
    return _gamma_p(k / 2, x / 2)


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return lo


#: Share of a normal distribution's documents that may go. Far out, as the vectors of good documents are not normal: with
#: five statistics the squared distance is about 60.
TAIL = 1.2e-11
CUTOFF = chi2_quantile(1 - TAIL, len(STATS))
FACTOR = SUPPORT / chi2_cdf(chi2_quantile(SUPPORT, len(STATS)), len(STATS) + 2)


def repeat_words(w: Column, window: int = 3) -> Column:
    """Words inside ``window``-word windows that come twice or more, over an array of words. Windows are compared by a
    64-bit hash of their words' 64-bit hashes."""
    n = F.size(w)

    def of_hashes(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(h[i + k] for k in range(window))))
        return let(grams, of_grams)

    def of_grams(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))), of_sorted))

    def of_sorted(s: Column) -> Column:
        last = F.size(s) - 1
        again = F.filter(s, lambda x, j: ((j > 0) & (x["g"] == F.get(s, j - 1)["g"])) | ((j < last) & (x["g"] == F.get(s, j + 1)["g"])))
        return let(F.array_sort(F.transform(again, lambda x: x["i"])), lambda at: F.aggregate(F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window))), F.lit(0), lambda x, y: x + y))

    return F.when(n < window + 1, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines; ``keep`` adds columns."""
    t = F.coalesce(F.col("_text"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("_text"), *keep)
    line = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    d = d.withColumn("_w", words(t))
    return d.select(
        "doc_id", "lang", "source", *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(line, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("_lines"),
        repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
    ).withColumn("n_dup_lines", F.col("_lines.dup")).withColumn("n_lines", F.col("_lines.all")).drop("_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def noise() -> list[Column]:
    line = 1 / F.greatest(F.col("n_lines"), F.lit(1))
    return [line / 4, F.least(line, LINE / F.greatest(F.col("n_words"), F.lit(1))) / 4]


def _groups(d: DataFrame) -> DataFrame:
    """Adds group: by language and source, else by language, else all; null where even that is too few."""
    ok = (~F.col("base_failed")).cast("long")
    lang, source = F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("-")), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    d = d.withColumn("_l", lang).withColumn("_s", source)
    n = d.groupBy("_l", "_s").agg(F.sum(ok).alias("n"))
    pooled = n.withColumn("own", F.col("n") >= LEAST)
    by_lang = pooled.where("not own").groupBy("_l").agg(F.sum("n").alias("n_l"))
    n_all = by_lang.where(f"n_l < {LEAST}").agg(F.coalesce(F.sum("n_l"), F.lit(0)).alias("n")).first()["n"]
    named = pooled.join(by_lang, "_l", "left").select(
        "_l", "_s",
        F.when(F.col("own"), F.concat_ws("/", "_l", "_s")).when(F.col("n_l") >= LEAST, F.col("_l")).when(F.lit(n_all >= LEAST), F.lit("*")).alias("group"),
    )
    return join_small(d, materialize(named, partitions=1), ["_l", "_s"]).drop("_l", "_s")


def _distance(center: str = "mu", factor: str = "il") -> Column:
    """Squared length of L^-1 (v - mu), L^-1 lower triangular and flat, with the document's noise added to the variances
    of the last two coordinates: what the first three leave of them is weighed by a matrix of its own."""
    diff = [F.col(v) - F.col(center)[i] for i, v in enumerate(STATS)]
    at, ys = 0, []
    for i in range(len(STATS)):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(factor)[at] * diff[j]
            at += 1
        ys.append(y)

    def last(x: Column) -> Column:
        l33, l44 = 1 / x["i33"], 1 / x["i44"]
        return let(F.struct(l33.alias("l33"), l44.alias("l44"), (-x["i43"] * l33 * l44).alias("l43"), x["y3"].alias("y3"), x["y4"].alias("y4")), weighed)

    def weighed(x: Column) -> Column:
        a, b, c = x["l33"] * x["l33"] + F.col(NOISE[0]), x["l33"] * x["l43"], x["l43"] * x["l43"] + x["l44"] * x["l44"] + F.col(NOISE[1])
        r, s = x["l33"] * x["y3"], x["l43"] * x["y3"] + x["l44"] * x["y4"]
        return (c * r * r - 2 * b * r * s + a * s * s) / (a * c - b * b)

    i33, i43, i44 = (F.col(factor)[k] for k in (9, 13, 14))
    return sum((y * y for y in ys[:3]), F.lit(0.0)) + let(F.struct(i33.alias("i33"), i43.alias("i43"), i44.alias("i44"), ys[3].alias("y3"), ys[4].alias("y4")), last)


def _inverse_factor(moments: DataFrame) -> DataFrame:
    """(group, mu, il) from sums n, s_i and p_ij: the inverse of the Cholesky factor of the covariance, row by row."""
    p = len(STATS)
    m = moments
    for i in range(p):
        m = m.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(p):
        for j in range(i + 1):
            c = (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * FACTOR
            m = m.withColumn(f"c{i}{j}", c + F.lit(FLOOR[i] ** 2) if i == j else c)
    for i in range(p):
        for j in range(i + 1):
            s = F.col(f"c{i}{j}")
            for k in range(j):
                s = s - F.col(f"L{i}{k}") * F.col(f"L{j}{k}")
            m = m.withColumn(f"L{i}{j}", F.sqrt(F.greatest(s, F.lit(FLOOR[i] ** 2 / 100))) if i == j else s / F.col(f"L{j}{j}"))
    for i in range(p):
        for j in range(i, -1, -1):
            if i == j:
                x = 1.0 / F.col(f"L{i}{i}")
            else:
                x = F.lit(0.0)
                for k in range(j, i):
                    x = x - F.col(f"L{i}{k}") * F.col(f"I{k}{j}")
                x = x / F.col(f"L{i}{i}")
            m = m.withColumn(f"I{i}{j}", x)
    return m.select("group", F.array(*(f"m{i}" for i in range(p))).alias("mu"), F.array(*(f"I{i}{j}" for i in range(p) for j in range(i + 1))).alias("il"))


def _moments(rows: DataFrame) -> DataFrame:
    # sums of decimals don't depend on the order of rows, so reruns agree
    dec = lambda c: F.sum(c.cast("decimal(28,10)")).cast("double")
    p = range(len(STATS))
    return rows.groupBy("group").agg(
        F.count("*").alias("n"), *(dec(F.col(STATS[i])).alias(f"s{i}") for i in p),
        *(dec(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}{j}") for i in p for j in range(i + 1)),
    )


def _quantiles(levels: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(group, stat, q) from (group, stat, level): the least level that a share of the rows does not exceed. Levels are a grid,
    so their counts are a bounded table for each group and don't depend on the order of rows."""
    n = levels.groupBy("group", "stat", "level").agg(F.count("*").alias("n"))
    by = Window.partitionBy("group", "stat")
    n = n.withColumn("below", F.sum("n").over(by.orderBy("level"))).withColumn("all", F.sum("n").over(by))
    return n.groupBy("group", "stat").agg(F.array(*(F.min(F.when(F.col("below") >= F.lit(p) * F.col("all"), F.col("level"))) for p in shares)).alias("q"))


def start(rows: DataFrame) -> DataFrame:
    """(group, mu, il): medians, and spreads from quartiles."""
    p = len(STATS)
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("stat"), F.floor(F.col(v) * GRID).cast("int").alias("level")) for i, v in enumerate(STATS))))
    q = _quantiles(rows.select("group", grid.alias("x")).select("group", "x.stat", "x.level"), (0.25, 0.5, 0.75))
    q = q.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("stat", "q"))).alias("q"))  # five entries
    mid = [(F.col("q")[i][1] + 0.5) / GRID for i in range(p)]
    scale = [F.greatest((F.col("q")[i][2] - F.col("q")[i][0]) / (1.349 * GRID), F.lit(FLOOR[i])) for i in range(p)]
    flat = [1.0 / scale[i] if i == j else F.lit(0.0) for i in range(p) for j in range(i + 1)]
    return q.select("group", F.array(*mid).alias("mu"), F.array(*flat).alias("il"))


def concentrate(rows: DataFrame, est: DataFrame) -> DataFrame:
    """(group, mu, il) of the share SUPPORT of rows with the least distances by ``est``."""
    level = F.floor(F.log2(F.greatest(F.col("d"), F.lit(2.0**-20))) * GRID).cast("int")
    d = join_small(rows, est, ["group"]).select("group", *STATS, *NOISE, _distance().alias("d")).withColumn("level", level)
    cut = _quantiles(d.select("group", F.lit(0).alias("stat"), "level"), (SUPPORT,)).select("group", F.col("q")[0].alias("cut"))
    return _inverse_factor(_moments(join_small(d, materialize(cut, partitions=1), ["group"]).where("level <= cut")))


def estimates(rows: DataFrame) -> DataFrame:
    """(group, mu, il) by concentration steps over (group, v0.., u3, u4), until no group's log determinant changes by more
    than SETTLED, or changes stop getting smaller: rounding to the grid can make a step go back and forth."""
    est = materialize(start(rows), partitions=1)
    log_det = -sum((F.log(F.col("il")[i * (i + 3) // 2]) for i in range(len(STATS))), F.lit(0.0))
    change = math.inf
    while True:
        new = materialize(concentrate(rows, est), partitions=1)
        both = est.select("group", log_det.alias("x")).join(new.select("group", log_det.alias("y")), "group")
        before, change = change, both.agg(F.coalesce(F.max(F.abs(F.col("x") - F.col("y"))), F.lit(0.0))).first()[0]
        free(est)
        est = new
        if change <= SETTLED or change >= before:
            return est


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, the statistics, base_failed, distance (squared, null if not judged by it), kept."""
    d = statistics(docs, id_col, text_col, lang_col, source_col, keep).withColumn("base_failed", base_failed())
    d = d.select("*", *(v.alias(n) for n, v in zip(STATS + NOISE, vector() + noise(), strict=True)))
    raw = materialize(d)
    d = materialize(_groups(raw))
    free(raw)
    judged = d.where("not base_failed and `group` is not null")
    est = estimates(judged.select("group", *STATS, *NOISE))
    far = join_small(judged, est, ["group"]).withColumn("distance", _distance()).drop("mu", "il")
    rest = d.where("base_failed or `group` is null").withColumn("distance", F.lit(None).cast("double"))
    return far.unionByName(rest).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).drop(*STATS, *NOISE)


