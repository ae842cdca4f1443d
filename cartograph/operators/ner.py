"""Entities in identifiers: gazetteers from the JVM's locale data, and patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, fold_column, ngrams
from ..shipping import ship

# Patterns of identifiers by label, and money symbols.
PATTERNS = {
    "PERSON": [
        r"\b(?:first|last|full|given|family)_?names?\b",
        r"\b(?:customer|user|employee|contact|person|client|member|owner)_?names?\b",
        r"\b(?:author|creator|manager|supervisor|admin)_?names?\b",
        r"\b(?:mr|mrs|ms|dr|prof)\.?[_\s]?[a-z]+\b",
        r"\b(?:user|customer|employee|person|contact)_?ids?\b",
    ],
    "ORG": [
        r"\b(?:company|corp|corporation|organization|business)_?names?\b",
        r"\b\w+_?(?:inc|corp|llc|ltd|co|plc)\b",
        r"\b(?:vendor|supplier|client|partner|contractor)_?names?\b",
        r"\b(?:dept|department|division|unit|agency|firm)_?names?\b",
    ],
    "GPE": [r"\b(?:country|state|province|region|territory)_?(?:names?|codes?)?\b", r"\b(?:nationality|citizenship)\b"],
    "LOC": [
        r"\b(?:address|location|place|position|site)\b",
        r"\b(?:street|road|avenue|blvd|lane|drive|way)\b",
        r"\b(?:zip|postal)_?codes?\b",
        r"\b(?:coordinates|latitude|longitude|lat|lng)\b",
        r"\b(?:home|work|shipping|billing|mailing)_?(?:address|location)\b",
    ],
    "CURRENCY": [r"[€£¥₹₩₽₺₫₦]", r"\$"],
}
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW", "₽": "RUB", "₺": "TRY", "₫": "VND", "₦": "NGN"}


@dataclass(frozen=True)
class Entity:
    label: str
    text: str
    start: int
    end: int
    canonical: str | None
    score: float
    source: str


class Gazetteer:
    """Terms of countries, currencies and time zones; ``subdivisions`` (term -> code) have no source in the JVM and may be
    given. ``strict_codes`` leaves out two-letter country codes, which collide with words such as id."""

    def __init__(self, spark: SparkSession, subdivisions: dict[str, str] | None = None, strict_codes: bool = False):
        ship(spark)
        jvm = spark._jvm
        english = jvm.java.util.Locale.ENGLISH
        self.spark = spark
        self.terms: dict[tuple[str, str], str] = {}
        for code in jvm.java.util.Locale.getISOCountries():
            loc = jvm.java.util.Locale("", code)
            names = [loc.getDisplayCountry(english), loc.getISO3Country()] + ([] if strict_codes else [code])
            self.terms |= {("COUNTRY", fold(n)): code for n in names}
        for cur in jvm.java.util.Currency.getAvailableCurrencies().toArray():
            code, name = cur.getCurrencyCode(), cur.getDisplayName(english)
            self.terms |= {("CURRENCY", fold(code)): code, ("CURRENCY", fold(name)): code}
        for zone in jvm.java.time.ZoneId.getAvailableZoneIds().toArray():
            if "/" in zone:
                self.terms["TIMEZONE", fold(zone)] = zone
        self.terms |= {("SUBDIVISION", fold(k)): v for k, v in (subdivisions or {}).items()}
        self.terms.pop(("COUNTRY", ""), None)

    def frame(self) -> DataFrame:
        """(label, term, canonical): some thousand rows, whatever the data."""
        return self.spark.createDataFrame([(a, b, c) for (a, b), c in sorted(self.terms.items())], "label string, term string, canonical string")

    def analyze(self, text: str) -> list[Entity]:
        """Entities of one text: gazetteer n-grams, money symbols, patterns; one of each label and canonical form."""
        parts = [p for p in fold(text).split("_") if p]
        grams = dict.fromkeys([*parts, *("_".join(parts[i : i + n]) for n in (2, 3) for i in range(len(parts) - n + 1)), fold(text)])
        out = [Entity(label, g, -1, -1, self.terms[label, g], 0.9, "gazetteer") for g in grams for label in ("COUNTRY", "SUBDIVISION", "CURRENCY", "TIMEZONE") if (label, g) in self.terms]
        out += [Entity("CURRENCY", s, text.find(s), text.find(s) + 1, c, 0.6, "symbol") for s, c in SYMBOLS.items() if s in text]
        out += [Entity(label, m[0], m.start(), m.end(), None, 0.6, "pattern") for label, ps in PATTERNS.items() for p in ps for m in re.finditer(p, text, re.I)]
        seen: set = set()
        return [e for e in out if not ((k := (e.label, e.canonical or e.text)) in seen or seen.add(k))]

    def labels(self, text: str) -> list[str]:
        return sorted({e.label for e in self.analyze(text)})

    def tag(self, rows: DataFrame, column: str) -> DataFrame:
        """Adds labels (array<string>) of a text column: n-grams join the broadcast gazetteer, patterns match in place."""
        keyed = rows.withColumn("_id", F.monotonically_increasing_id())
        parts = F.filter(F.split("_f", "_"), lambda x: x != "")
        hits = keyed.withColumn("_f", fold_column(F.col(column))).select("_id", F.explode(ngrams(parts)).alias("term")).join(F.broadcast(self.frame()), "term").groupBy("_id").agg(F.collect_set("label").alias("_g"))
        found = [F.when(F.rlike(column, F.lit("(?i)" + p)), F.lit(label)) for label, ps in PATTERNS.items() for p in ps]
        every = F.filter(F.array(*found), lambda x: x.isNotNull())
        return keyed.join(hits, "_id", "left").withColumn("labels", F.array_sort(F.array_distinct(F.concat(every, F.coalesce("_g", F.array().cast("array<string>")))))).drop("_id", "_g")
