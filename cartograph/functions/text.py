"""Text functions over identifiers and values, as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tokens and patterns that mark archives, and patterns of values.
ARCHIVE_TOKENS = ("archive", "archived", "hist", "history", "backup", "bak", "snapshot", "snap", "temp", "tmp", "old")
ARCHIVE_SUFFIX = "(?i)(archive|archived|hist|history|backup|bak|old|tmp|temp)$"
VALUE_PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "phone": r"^\+?\d[\d\-\s]{7,}\d$",
    "url": r"^https?://",
    "percent": r"%$",
}


def normalize_identifier(c: Column) -> Column:
    """Words of an identifier: separators and capitals (except the first letter) start a word; lower case."""
    spaced = F.regexp_replace(F.regexp_replace(c, "[_-]+", " "), "(?<!^)(?=[A-Z])", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_identifier(c), "[^a-z0-9]+"), lambda t: t != "")


def token_list(text: str) -> list[str]:
    """The tokens of one string, on the driver."""
    spaced = re.sub(r"(?<!^)(?=[A-Z])", " ", re.sub("[_-]+", " ", text))
    return [t for t in re.split("[^a-z0-9]+", spaced.lower()) if t]


def is_archive(label: Column) -> Column:
    """Whether the last part of a label names an archive: by its ending, or by a token, digits after it allowed."""
    name = F.element_at(F.split(F.split(label, "::")[0], r"\."), -1)
    numbered = "^(" + "|".join(ARCHIVE_TOKENS) + ")[0-9]*$"
    return F.rlike(name, F.lit(ARCHIVE_SUFFIX)) | F.exists(tokens(name), lambda t: F.rlike(t, F.lit(numbered)))


def archive_name(label: str) -> bool:
    name = label.split("::")[0].split(".")[-1]
    return bool(re.search(ARCHIVE_SUFFIX, name)) or any(re.fullmatch("(" + "|".join(ARCHIVE_TOKENS) + ")[0-9]*", t) for t in token_list(name))


def display(c: Column, limit: int = 120) -> Column:
    """A value as a string of at most ``limit`` characters; bytes are read as UTF-8."""
    return F.substring(c.cast("string"), 1, limit)


def value_pattern(c: Column) -> Column:
    """The first of email, phone, url, percent that a value looks like, else null."""
    out = None
    for name, pattern in VALUE_PATTERNS.items():
        test = F.rlike(c, F.lit(pattern))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def truncate_cell(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def sanitize_type(c: Column) -> Column:
    upper = F.split(F.upper(c), " COLLATE ")[0]
    return F.trim(F.regexp_replace(F.regexp_replace(upper, '"', ""), r"\s+", " "))


def number_variant(t: Column) -> Column:
    """The other grammatical number of a token of three letters or more, else null."""
    return F.when(F.length(t) < 3, F.lit(None)).when(t.endswith("s"), F.regexp_replace(t, "s$", "")).otherwise(F.concat(t, F.lit("s")))


def ngrams(words: Column, joiner: str = "_") -> Column:
    """Unigrams, bigrams, trigrams and all words, joined, without repeats."""

    def of(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), joiner))

    return F.array_distinct(F.concat(words, of(2), of(3), F.array(F.array_join(words, joiner))))


def fold(text: str) -> str:
    """A gazetteer term: no accents, lower case, other characters as single underscores."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", "_", plain.lower()).strip("_")


@F.pandas_udf(StringType())
def fold_column(s: pd.Series) -> pd.Series:
    """``fold`` for a column; Spark has no Unicode decomposition of its own."""
    return s.map(fold, na_action="ignore")


def strip_semicolon(sql: str) -> str:
    """Trimmed, without one semicolon at its end."""
    sql = sql.strip()
    return sql[:-1] if sql.endswith(";") else sql


def preview(sql: str, limit: int = 100) -> str:
    return sql[:limit] + "..." if len(sql) > limit else sql
