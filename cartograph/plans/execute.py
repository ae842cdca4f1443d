"""Guarded, capped execution of a caller's SELECT."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import strip_semicolon
from . import sqltools

ROW_LIMIT, CELL_CHARS, RESULT_BYTES = 200, 200, 200_000


@dataclass
class Limits:
    rows: int = ROW_LIMIT
    cell_chars: int = CELL_CHARS
    result_bytes: int | None = None

    def __post_init__(self) -> None:
        self.rows, self.cell_chars = max(1, self.rows), max(10, self.cell_chars)


@dataclass
class Result:
    status: str
    sql: str
    columns: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    truncated: bool = False
    elapsed_ms: float = 0.0
    summary: str = ""
    error: str | None = None
    notes: list[str] = field(default_factory=list)
    assistance: sqltools.Assistance | None = None
    next_action: str | None = None
    completed_at: str = ""


def cell(value: object, limit: int) -> object:
    """None, numbers and booleans as they are; everything else as a string of at most ``limit`` characters."""
    if value is None or isinstance(value, (bool, int, float)):
        return value
    s = str(value)
    return s if len(s) <= limit else s[: limit - 1] + "…"


def prepared(spark: SparkSession, sql: str, tables: set[str] | None = None) -> DataFrame:
    """The DataFrame of a text that passes the guard, its dialect normalised."""
    text = sqltools.normalize(sql).sql
    if why := (None if sqltools.one_statement(sql) else sqltools.ONLY_SELECT) or sqltools.refusal(spark, text, tables):
        raise ValueError(why)
    return spark.sql(text)


def run(spark: SparkSession, sql: str, limits: Limits | None = None, tables: set[str] | None = None) -> Result:
    """Guard, normalise, validate, execute, and cut rows and cells. One row more than allowed is fetched, so that the
    result knows whether it is whole; the limit is part of the plan."""
    limits = limits or Limits()
    now = lambda: datetime.now(UTC).isoformat()
    done = sqltools.auto_transpile(spark, strip_semicolon(sql))
    text = done.sql
    if why := (None if sqltools.one_statement(sql) else sqltools.ONLY_SELECT) or sqltools.refusal(spark, text, tables):
        return Result("error", sql, error=why, assistance=sqltools.assist(spark, sql, why), completed_at=now())
    notes = list(done.warnings)
    valid = sqltools.validate(spark, text)
    if not valid.is_valid:
        notes.append(f"validation: {valid.error}")
    began = time.perf_counter()
    try:
        df = spark.sql(text)
        got = df.limit(limits.rows + 1).collect()
    except PySparkException as e:
        proposal = (e.getMessageParameters() or {}).get("proposal") if hasattr(e, "getMessageParameters") else None
        said = f"{e.getCondition() or ''} {str(e).splitlines()[0]}"
        return Result("error", text, error=said.strip(), notes=notes, assistance=sqltools.assist(spark, text, said, "spark", [proposal] if proposal else None), elapsed_ms=(time.perf_counter() - began) * 1000, next_action="refine_plan", completed_at=now())
    truncated = len(got) > limits.rows
    rows = [{k: cell(v, limits.cell_chars) for k, v in r.asDict().items()} for r in got[: limits.rows]]
    if limits.result_bytes:
        size = 0
        for i, r in enumerate(rows):
            size += len(str(r))
            if size > limits.result_bytes:
                rows, truncated = rows[:i], True
                break
    said = f"{len(rows)} row(s), {len(df.columns)} column(s)" + ("; truncated" if truncated else "")
    return Result("ok", text, df.columns, rows, truncated, (time.perf_counter() - began) * 1000, said, None, notes + (["narrow the query or aggregate"] if truncated else []), None, "refine_plan" if truncated else None, now())
