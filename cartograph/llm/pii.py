"""Personal data by rules and weak supervision. DataFrame functions only.

Base spans come from fixed expressions (e-mail, IP address, card, phone). Further spans come from candidates, stretches
of 12 or more token characters with a digit, and shorter values or groups with one that a credential word announces, that
no base span touches. Labelers vote on each candidate: the shape by expressions, a gazetteer of
credential words before it, and its context (assignment, quotes, label). Votes have few patterns, so their counts over
all documents are a bounded table: expectation-maximisation estimates each labeler's reliability and the share of
private candidates from it, and a naive Bayes span classifier is trained on the resulting posteriors over votes and
features of the span. Its verdict per pattern is a bounded table again, matched in the plan.

Expressions are anchored at the start of a run and possessive, so that they take linear time and no recursion on texts
of one endless word. Places of matches are running sums over chunks, and spans meet spans by halving.

Cases: a null or empty text has no spans; repeated rows are searched row by row; an empty table gives no rows; other
columns are not read unless kept.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, running

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{12,}+"
KINDS = ("email", "ip", "card", "phone", "secret")
#: Words that announce a credential or an identity number.
CREDENTIALS = ("token", "secret", "password", "passwd", "pwd", "api", "key", "bearer", "auth", "credential", "account", "konto", "iban", "ssn", "passport", "licence", "license", "contraseña", "passwort", "clave", "jeton")
#: A shorter value with a digit, or groups of them, that such a word announces with a colon, an equals sign or the like.
ANNOUNCED = (
    r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(CREDENTIALS) + r")(?:[ _-]?(?:no|nr|num|number|code|key|id))?[.]?[\"']?(?:[ ]?[:=#][ ]?|[ ]is[ ]|[ ](?=[0-9]{3}-[0-9]{2}-|[A-Z]{2}[0-9]{2}))[\"'`]?"
    r"([A-Za-z]{2}[0-9]{2}(?:[ ][0-9A-Za-z]{4}){2,8}+(?:[ ][0-9A-Za-z]{1,3})?(?![0-9A-Za-z])|(?=[^\s\"'`,;<>0-9]*+[0-9])[^\s\"'`,;<>]{4,}+)"
)
VOTERS = 5
CONTEXT = 32
SPAN = "struct<start:int,kind:int,stop:int>"


def located(text: Column, pattern: str, context: int = 0) -> Column:
    """Matches of ``pattern`` as array<struct<start, stop, m>> in code points: lengths of what lies between them add up.
    With ``context`` also before, so many characters before the match (as far as the last match but one)."""

    def of(found: Column, gaps: Column) -> Column:
        ends = running(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m)), lambda x, y: x + y)
        if not context:
            return F.zip_with(ends, found, lambda stop, m: F.struct((stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("m")))
        before = lambda i: F.substring(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i)), -context, context)
        return F.transform(F.zip_with(ends, found, lambda stop, m: F.struct(stop.alias("stop"), m.alias("m"))), lambda x, i: F.struct((x["stop"] - F.length(x["m"])).alias("start"), x["stop"].alias("stop"), x["m"].alias("m"), before(i).alias("before")))

    none = F.array().cast("array<struct<start:int,stop:int,m:string" + (",before:string" if context else "") + ">>")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))
    return let(both, lambda x: F.when(F.size(x["m"]) == 0, none).otherwise(of(x["m"], x["gap"])))


def sides(spans: Column) -> Column:
    """What ``apart`` needs of spans sorted by start: their starts, and the running maximum of their ends."""
    return F.struct(F.transform(spans, lambda b: b["start"]).alias("starts"), running(F.transform(spans, lambda b: b["stop"]), lambda x, y: F.greatest(x, y)).alias("ends"))


def apart(spans: Column, others: Column) -> Column:
    """The ``spans`` that overlap none of the others, of which ``sides`` are given; found by halving."""
    starts, ends = others["starts"], others["ends"]
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))

    def free(s: Column) -> Column:
        # others that start before the span stops
        n = F.aggregate(steps, F.lit(0), lambda at, w: F.when((at + w <= F.size(starts)) & (F.get(starts, at + w - 1) < s["stop"]), at + w).otherwise(at))
        return F.coalesce(F.get(ends, n - 1) <= s["start"], F.lit(True))

    return F.when((F.size(spans) == 0) | (F.size(starts) == 0), spans).otherwise(F.filter(spans, free))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 1, F.when(x.cast("int") * 2 > 9, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).otherwise(x.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _small(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(short) > 3, F.lit(False)).otherwise(F.substring(short, 1, 3).cast("int") <= 255)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, stop>> of the base kinds, ordered by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(kind: int, pattern: str, gate: Column, good=None) -> Column:
        found = located(text, pattern)
        found = F.filter(found, lambda s: good(s["m"])) if good else found
        return F.when(gate, F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))).otherwise(none)

    digits = lambda lo, hi: lambda m: let(F.length(_digits(m)), lambda n: (n >= lo) & (n <= hi))
    return F.array_sort(F.concat(
        of(0, EMAIL, F.contains(text, F.lit("@"))),
        of(1, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]")), lambda m: F.forall(F.split(m, r"\."), _small)),
        of(2, CARD, F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda m: let(_digits(m), lambda d: (F.length(d) >= 12) & (F.length(d) <= 19) & luhn(d))),
        of(3, PHONE, F.contains(text, F.lit("+")), digits(9, 15)),
    ))


def with_candidates(d: DataFrame, text: Column) -> DataFrame:
    """Adds cand to rows with base, array<struct<start, stop, pattern>>: stretches that may be private, with votes (low bits)
    and features. Column by column, as an expression of all would nest too deep for the analyser."""
    gazetteer = "(?i)(?:" + "|".join(CREDENTIALS) + ")"

    def pattern(s: Column) -> Column:
        before, m = s["before"], s["m"]
        letters, n = F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.length(m)
        votes = [
            F.rlike(m, F.lit("^(?:[0-9a-f]{24,}|[0-9A-F]{24,})$")) | (F.rlike(m, F.lit("[a-z]")) & F.rlike(m, F.lit("[A-Z]")) & (n >= 20)),  # shape: hexadecimal or mixed
            F.length(F.regexp_replace(m, "[0-9]", "")) * 10 <= n * 9,  # shape: a tenth of digits or more
            F.rlike(before, F.lit(gazetteer)),  # gazetteer
            F.rlike(before, F.lit("""[=:]\\s*["'`]?$""")),  # context: assigned
            F.rlike(before, F.lit("""["'`]$""")),  # context: quoted
        ]
        features = [n >= 20, n >= 32, letters == 0, F.rlike(m, F.lit("[_-]"))]
        bits = F.lit(0)
        for i, b in enumerate([*votes, *features]):
            bits = bits + F.when(b, F.lit(1 << i)).otherwise(0)
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), bits.alias("pattern"))

    none = F.array().cast("array<struct<start:int,stop:int,m:string,before:string>>")

    def value(s: Column) -> Column:
        said = lambda v: F.substring(F.concat(s["before"], F.substring(s["m"], F.lit(1), F.length(s["m"]) - F.length(v))), -CONTEXT, CONTEXT)
        return let(F.regexp_extract(s["m"], ANNOUNCED, 1), lambda v: F.struct((s["stop"] - F.length(v)).alias("start"), s["stop"].alias("stop"), v.alias("m"), said(v).alias("before")))

    d = d.withColumn("_tokens", F.when(F.rlike(text, F.lit(TOKEN)), located(text, TOKEN, CONTEXT)).otherwise(none))
    d = d.withColumn("_said", F.when(F.rlike(text, F.lit(ANNOUNCED)), F.transform(located(text, ANNOUNCED, CONTEXT), value)).otherwise(none))
    d = d.withColumn("_base", sides(F.col("base")))
    d = d.withColumn("_tokens", apart(F.col("_tokens"), F.col("_base"))).withColumn("_said", apart(F.col("_said"), F.col("_base")))
    d = d.withColumn("_held", sides(F.col("_tokens")))
    d = d.withColumn("_tokens", F.concat("_tokens", apart(F.col("_said"), F.col("_held"))))
    return d.withColumn("cand", F.transform("_tokens", pattern)).drop("_tokens", "_said", "_base", "_held")


def reliabilities(counts: dict[int, int], rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """Share of private candidates and per labeler (votes on private, votes on others), by EM over counts of vote
    patterns. Pseudo-counts say that a labeler is more often right than wrong, which keeps the two classes apart."""
    votes: dict[int, float] = defaultdict(float)
    for p, n in counts.items():
        votes[p & ((1 << VOTERS) - 1)] += n
    share, rel = 0.5, [(0.7, 0.2)] * VOTERS
    for _ in range(rounds):
        post = {v: posterior(v, share, rel) for v in votes}
        yes = sum(post[v] * n for v, n in votes.items())
        no = sum((1 - post[v]) * n for v, n in votes.items())
        share = (yes + 1) / (yes + no + 2)
        rel = [
            ((sum(post[v] * n for v, n in votes.items() if v >> i & 1) + 7) / (yes + 10), (sum((1 - post[v]) * n for v, n in votes.items() if v >> i & 1) + 2) / (no + 10))
            for i in range(VOTERS)
        ]
    return share, rel


def posterior(vote: int, share: float, rel: list[tuple[float, float]]) -> float:
    a = math.log(share) + sum(math.log(p if vote >> i & 1 else 1 - p) for i, (p, _) in enumerate(rel))
    b = math.log(1 - share) + sum(math.log(q if vote >> i & 1 else 1 - q) for i, (_, q) in enumerate(rel))
    return 1 / (1 + math.exp(min(700.0, b - a)))


def train(counts: dict[int, int]) -> dict[int, bool]:
    """The span classifier's verdict per pattern of votes and features."""
    share, rel = reliabilities(counts)
    soft = {p: posterior(p & ((1 << VOTERS) - 1), share, rel) for p in counts}
    yes = sum(soft[p] * n for p, n in counts.items())
    no = sum((1 - soft[p]) * n for p, n in counts.items())
    bits = range(VOTERS + 4)
    w = [((sum(soft[p] * n for p, n in counts.items() if p >> i & 1) + 1) / (yes + 2), (sum((1 - soft[p]) * n for p, n in counts.items() if p >> i & 1) + 1) / (no + 2)) for i in bits]
    prior = (yes + 1) / (yes + no + 2)

    def verdict(p: int) -> bool:
        learned = posterior(p, prior, w)
        # the classifier counts correlated evidence twice, so a span also needs two votes at least
        return learned > 0.5 and (p & ((1 << VOTERS) - 1)).bit_count() >= 2

    return {p: verdict(p) for p in counts}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, base and spans (array<struct<start, kind, stop>>, in order), and the kept columns."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), *keep)
    d = d.withColumn("base", base_spans(text))
    d = with_candidates(d, text).drop("_t")
    d = materialize(d)
    counts = {r["p"]: r["n"] for r in d.select(F.explode("cand.pattern").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}  # <= 2^9 rows
    good = [p for p, yes in train(counts).items() if yes]
    more = F.transform(F.filter("cand", lambda c: c["pattern"].isin(good) if good else F.lit(False)), lambda c: F.struct(c["start"].alias("start"), F.lit(4).alias("kind"), c["stop"].alias("stop")))
    return d.withColumn("spans", F.array_sort(F.concat("base", more))).drop("cand")


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))))


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each stretch of (overlapping) spans replaced by the first one's kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def add(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), names[s["kind"]])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(new, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))))
