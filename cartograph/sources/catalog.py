"""A database for the engine: tables of a folder of files, of a Spark database, or of a JDBC connection, with a manifest
of keys, since files declare none."""

from __future__ import annotations

import hashlib
import json
import os
import threading
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemas that databases keep for themselves.
SYSTEM_SCHEMAS = {
    "postgres": ["information_schema", "pg_catalog", "pg_toast"],
    "mssql": ["information_schema", "sys"],
    "sqlserver": ["information_schema", "sys"],
    "mysql": ["information_schema", "mysql", "performance_schema", "sys"],
    "oracle": ["sys", "system", "xdb", "mdsys", "ctxsys"],
    "snowflake": ["information_schema"],
    "spark": ["information_schema", "global_temp", "sys"],
}
OTHER_SYSTEM_SCHEMAS = ["information_schema", "pg_catalog", "sys"]

COLUMNS = "table string, ord int, column string, dtype string, kind string, nullable boolean, pk_pos int, fk_pos int, ref_table string, ref_column string"
EDGES = "src string, dst string, src_col string, dst_col string, ord int"


class EngineError(Exception):
    """Any error of the engine."""


class ReflectionError(EngineError):
    pass


class SamplingError(EngineError):
    pass


class EmbeddingError(EngineError):
    pass


@dataclass(frozen=True)
class Manifest:
    """Primary keys and foreign keys (table, column, referenced table, referenced column) by table name."""

    primary: dict[str, list[str]] = field(default_factory=dict)
    foreign: list[tuple[str, str, str, str]] = field(default_factory=list)

    @classmethod
    def read(cls, path: str) -> Manifest:
        with open(path) as f:
            d = json.load(f)
        return cls(d.get("primary", {}), [tuple(x) for x in d.get("foreign", [])])


def excluded_schemas(dialect: str) -> list[str]:
    d = dialect.lower()
    return next((v for k, v in SYSTEM_SCHEMAS.items() if k in d), OTHER_SYSTEM_SCHEMAS)


def kind_of(t: T.DataType) -> str:
    """The class of a type, from the type itself."""
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) or type(t).__name__ == "TimeType":
        return "temporal"
    if isinstance(t, T.BinaryType):
        return "lob"
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) or type(t).__name__ == "VariantType":
        return "nested"
    return "other"


def fingerprint(payload: object, digits: int = 16) -> str:
    text = payload if isinstance(payload, str) else json.dumps(payload, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:digits]


def location(path: str | None = None) -> str:
    """The data's place: given, or from the environment."""
    found = path or os.environ.get("CARTOGRAPH_DATA")
    if not found:
        raise EngineError("no data location: pass a path or set CARTOGRAPH_DATA")
    return found


@contextmanager
def time_limit(spark: SparkSession, seconds: float | None, group: str):
    """Cancel the jobs that this thread starts within the block after ``seconds``."""
    if not seconds:
        yield
        return
    sc = spark.sparkContext
    sc.setJobGroup(group, group, interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    timer.daemon = True
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


class Catalog:
    """Tables by name, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], manifest: Manifest | None = None, *, schema: str = "main", place: str = "", dialect: str = "spark", max_tables: int | None = None):
        self.spark, self.schema, self.place, self.dialect = spark, schema, place, dialect
        self._open = dict(list(tables.items())[:max_tables])
        self._seen: dict[str, DataFrame] = {}
        self.manifest = manifest or Manifest()

    @classmethod
    def from_folder(cls, spark: SparkSession, path: str, names: list[str], manifest: Manifest | None = None, fmt: str = "parquet", schema: str = "main", **options) -> Catalog:
        """Tables ``name.fmt`` of a folder: parquet, orc, csv, json, text or any other format that Spark reads."""
        reader = lambda n: lambda: spark.read.format(fmt).options(**options).load(f"{path.rstrip('/')}/{n}.{fmt}")
        return cls(spark, {n: reader(n) for n in names}, manifest, schema=schema, place=path)

    @classmethod
    def from_database(cls, spark: SparkSession, database: str | None = None, manifest: Manifest | None = None) -> Catalog:
        database = database or spark.catalog.currentDatabase()
        names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
        return cls(spark, {n: (lambda n=n: spark.table(f"{database}.{n}")) for n in names}, manifest, schema=database, place=f"spark:{database}")

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, names: list[str], manifest: Manifest | None = None, **options) -> Catalog:
        reader = lambda n: lambda: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load()
        return cls(spark, {n: reader(n) for n in names}, manifest, schema=names[0].split(".")[0] if "." in names[0] else "main", place=url, dialect=url.split(":")[1])

    def names(self) -> list[str]:
        return list(self._open)

    def table(self, name: str) -> DataFrame:
        name = name.split(".")[-1]
        if name not in self._open:
            raise KeyError(name)
        if name not in self._seen:
            self._seen[name] = self._open[name]()
        return self._seen[name]

    def key(self, name: str) -> str:
        return f"{self.schema}.{name}"

    def readable(self) -> list[str]:
        """Names of tables that can be opened; others are left out, never fatal."""
        good = []
        for n in self.names():
            try:
                _ = self.table(n).schema
                good.append(n)
            except Exception:  # noqa: BLE001, S112
                continue
        return good

    def register(self) -> Catalog:
        """Make the tables known to SQL by their names."""
        for n in self.readable():
            self.table(n).createOrReplaceTempView(n)
        return self

    def probe(self) -> bool:
        return self.spark.sql("SELECT 1 AS one").first()["one"] == 1

    def columns(self) -> DataFrame:
        """One row per column, with its keys; a later foreign key on the same column replaces an earlier one."""
        rows = []
        for n in self.readable():
            pk = self.manifest.primary.get(n, [])
            fk = {c: (i, r, rc) for i, (t, c, r, rc) in enumerate(self.manifest.foreign) if t == n}
            for i, f in enumerate(self.table(n).schema.fields):
                at, ref, rc = fk.get(f.name, (None, None, None))
                rows.append((self.key(n), i, f.name, f.dataType.simpleString(), kind_of(f.dataType), f.nullable, pk.index(f.name) if f.name in pk else None, at, self.key(ref) if ref else None, rc))
        return self.spark.createDataFrame(rows, COLUMNS)

    def edges(self) -> DataFrame:
        """One row per column pair of a foreign key between known tables; all keys between two tables are kept."""
        known = set(self.readable())
        rows = [(self.key(t), self.key(r), c, rc, i) for i, (t, c, r, rc) in enumerate(self.manifest.foreign) if t in known and r in known]
        return self.spark.createDataFrame(rows, EDGES)

    def reflection_hash(self) -> str:
        return fingerprint({n: self.table(n).schema.json() for n in self.readable()} | {"keys": [self.manifest.primary, self.manifest.foreign]})

    def place_hash(self) -> str:
        return fingerprint(self.place, 10)

    def sample(self, name: str, columns: list[str] | None = None, rows: int = 50, *, ordered: bool = False, max_columns: int = 15, seconds: float | None = None) -> DataFrame:
        """The first ``rows`` rows of the first ``max_columns`` columns that are no large objects. ``ordered`` takes the
        first by primary key (or by all columns), which reruns repeat. With ``seconds`` the rows are read at once, and
        SamplingError tells of a read that took longer."""
        df = self.table(name)
        fields = [f for f in df.schema.fields if columns is None or f.name in columns][:max_columns]
        take = [f.name for f in fields if kind_of(f.dataType) != "lob"]
        if not take:
            return df.select().limit(0)
        if ordered:
            pk = self.manifest.primary.get(name.split(".")[-1])
            df = df.orderBy(*(pk or [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]))
        out = df.select(*take).limit(rows)
        if not seconds:
            return out
        try:
            with time_limit(self.spark, seconds, f"sample {name}"):
                return self.spark.createDataFrame(out.collect(), out.schema)  # ``rows`` rows at most
        except Exception as e:
            raise SamplingError(f"no sample of {name} within {seconds} seconds") from e


def databases(spark: SparkSession, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Databases without system ones and those that begin with db_; a custom exclude list replaces the default one."""
    try:
        found = [d.name for d in spark.catalog.listDatabases()]
    except Exception:  # noqa: BLE001
        return ["public"]
    skip = set(exclude if exclude is not None else excluded_schemas("spark"))
    return [d for d in found if d not in skip and not d.startswith("db_") and (not include or d in include)]


def discover_keys(catalog: Catalog, primary: dict[str, list[str]]) -> DataFrame:
    """Candidate foreign keys (src, src_col, dst, dst_col): integer columns whose name ends like a single-column primary
    key and whose values are all among that key's. Inclusion alone is no evidence, so the name must agree."""
    spark, out = catalog.spark, None
    for ref, pk in sorted(primary.items()):
        if len(pk) != 1:
            continue
        stem = pk[0].split("_", 1)[-1]
        agrees = lambda c, pk=pk[0], stem=stem: c == pk or (stem not in ("id", "key") and c.split("_", 1)[-1] == stem)
        for t in catalog.names():
            for f in catalog.table(t).schema.fields:
                if t == ref or not isinstance(f.dataType, (T.LongType, T.IntegerType)) or not agrees(f.name):
                    continue
                child = catalog.table(t).select(F.col(f.name).cast("long").alias("k")).where("k is not null").distinct()
                orphans = child.join(catalog.table(ref).select(F.col(pk[0]).cast("long").alias("k")), "k", "left_anti").agg(F.count("*").alias("orphans"))
                row = orphans.select(F.lit(t).alias("src"), F.lit(f.name).alias("src_col"), F.lit(ref).alias("dst"), F.lit(pk[0]).alias("dst_col"), "orphans")
                out = row if out is None else out.unionByName(row)
    empty = spark.createDataFrame([], "src string, src_col string, dst string, dst_col string, orphans long")
    return (out if out is not None else empty).where("orphans = 0").drop("orphans")
