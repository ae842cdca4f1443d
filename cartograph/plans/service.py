"""The engine's facade: one build of metadata, then tools over it."""

from __future__ import annotations

import json
import threading
import time
from dataclasses import dataclass, replace
from enum import Enum
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import classify, profile, retrieve
from ..operators import graph as g
from ..operators.ner import Gazetteer
from ..sources.catalog import Catalog, ReflectionError, fingerprint, time_limit
from . import execute, sqltools
from .planner import Metadata, Plan


class Phase(Enum):
    IDLE = "IDLE"
    STARTING = "STARTING"
    RUNNING = "RUNNING"
    READY = "READY"
    FAILED = "FAILED"
    STOPPED = "STOPPED"


@dataclass(frozen=True)
class Status:
    phase: Phase = Phase.IDLE
    attempts: int = 0
    started_at: float | None = None
    completed_at: float | None = None
    error: str | None = None

    @property
    def description(self) -> str:
        return {"READY": "The schema is indexed", "FAILED": f"The build failed: {self.error}", "STOPPED": "The engine was stopped", "IDLE": "Nothing has been built yet"}.get(self.phase.value, "The schema is being indexed")


@dataclass(frozen=True)
class Options:
    sample_rows: int = 50
    sample_seconds: float | None = 15
    max_sampled_columns: int = 15
    ordered_sample: bool = False
    embedded_columns: int = 20
    approach: str = "emb_table"
    alpha: float = 0.7
    expander: str = "fk_following"
    strict_archives: bool = True
    promote_text: bool = False
    entity_tags: bool = True
    semantic_expansion: bool | None = None  # None: only with an embedder of the caller's, as the default one knows no synonyms
    seed_k: int | None = None
    row_limit: int = execute.ROW_LIMIT
    cell_chars: int = execute.CELL_CHARS
    result_bytes: int | None = None


class Engine:
    """Build with ``build()`` (or ``start()`` on a thread), then ask. ``for_session`` keeps one engine per session."""

    _held: dict[int, Engine] = {}
    _lock = threading.Lock()

    def __init__(self, catalog: Catalog, options: Options | None = None, embedder=None):
        self.catalog, self.options, self.spark = catalog, options or Options(), catalog.spark
        self.embedder = embedder
        self._semantic = (embedder is not None) if self.options.semantic_expansion is None else self.options.semantic_expansion
        self.status = Status()
        self.timings: dict[str, float] = {}
        self._thread: threading.Thread | None = None
        self._hash: str | None = None

    @classmethod
    def for_session(cls, catalog: Catalog, **kw) -> Engine:
        with cls._lock:
            return cls._held.setdefault(id(catalog.spark), cls(catalog, **kw))

    @classmethod
    def reset(cls) -> None:
        with cls._lock:
            cls._held.clear()

    # build

    def build(self) -> Engine:
        """Reflect, profile, classify. Any failure is kept in the status and raised."""
        self.status = Status(Phase.RUNNING, self.status.attempts + 1, time.time())
        try:
            self.catalog.probe()
            step = self._timed
            o = self.options
            self.columns = step("reflect", lambda: self.catalog.columns())
            self.edges = step("edges", lambda: self.catalog.edges())
            with time_limit(self.spark, o.sample_seconds and o.sample_seconds * max(1, len(self.catalog.names())), "profile"):
                stats = profile.profile_catalog(self.catalog, o.sample_rows, o.ordered_sample, o.max_sampled_columns)
                held = step("profile", lambda: self.spark.createDataFrame(stats.collect(), profile.STATS))  # one row per column
            profiles = profile.column_profiles(self.columns, held, o.promote_text)
            if o.entity_tags:
                profiles = step("entities", lambda: profile.entity_tags(profiles, Gazetteer(self.spark)))
            self.profiles = profiles.coalesce(1).persist()
            self.tables = step("classify", lambda: classify.tables(self.profiles, self.edges).coalesce(1).persist())
            self.meta = step("collect", lambda: Metadata.collect(self.tables, self.profiles, self.edges))
            self._hash = fingerprint([self.catalog.reflection_hash(), repr(o)])
            self.__dict__.pop("index", None)
            self.__dict__.pop("vectors", None)
            self.__dict__.pop("lexicon", None)
        except Exception as e:
            self.status = replace(self.status, phase=Phase.FAILED, error=str(e)[:500], completed_at=time.time())
            raise
        self.status = replace(self.status, phase=Phase.READY, completed_at=time.time())
        return self

    def _timed(self, name, f):
        began = time.perf_counter()
        out = f()
        self.timings[name] = time.perf_counter() - began
        return out

    def start(self) -> None:
        """Build on a thread, once."""
        with self._lock:
            if self.status.phase is not Phase.IDLE:
                return
            self.status = Status(Phase.STARTING)

        def work() -> None:
            try:
                self.build()
            except Exception:  # noqa: BLE001, S110
                pass  # the status tells

        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()

    def wait(self, seconds: float | None = None) -> Status:
        if self._thread:
            self._thread.join(seconds)
        return self.status

    def ready(self) -> Engine:
        if self.status.phase is not Phase.READY:
            raise RuntimeError(self.status.description)
        return self

    def stop(self) -> None:
        self.status = replace(self.status, phase=Phase.STOPPED, completed_at=time.time())

    def refresh(self) -> bool:
        """Build again if tables, keys or options have changed."""
        if self._hash == fingerprint([self.catalog.reflection_hash(), repr(self.options)]):
            return False
        self.build()
        return True

    # retrieval

    @cached_property
    def index(self) -> DataFrame:
        return retrieve.schema_index(self.profiles).coalesce(1).persist()

    @cached_property
    def vectors(self) -> tuple[DataFrame, DataFrame] | None:
        """Embedded tables and columns, or None if the embedder fails: retrieval is then lexical."""
        try:
            t, c = retrieve.table_texts(self.profiles, self.tables), retrieve.column_texts(self.profiles, self.tables, self.options.embedded_columns)
            self.embedder = self.embedder or retrieve.HashedEmbedder()
            self.embedder.fit(t.unionByName(c), "text")
            return self.embedder.encode(t, "text").select("item", "vec").coalesce(1).persist(), self.embedder.encode(c, "text").select("item", "vec").coalesce(1).persist()
        except (RuntimeError, OSError, ValueError):
            return None

    @cached_property
    def lexicon(self) -> DataFrame | None:
        """Tokens of the embedded table texts with their mean vectors, for words that mean nearly the same."""
        if self.vectors is None:
            return None
        words = retrieve.table_texts(self.profiles, self.tables).select("item", tokens(F.col("text")).alias("tokens"))
        return retrieve.lexicon(self.vectors[0].join(words, "item")).coalesce(1).persist()

    def prime(self) -> None:
        self.index.count()
        if self.vectors:
            for v in self.vectors:
                v.count()

    def scores(self, query: str, approach: str | None = None, k: int = 8, alpha: float | None = None) -> DataFrame:
        """(item, score) of tables."""
        approach = approach or self.options.approach
        if approach not in retrieve.APPROACHES:
            raise ValueError(approach)
        strict, q = self.options.strict_archives, retrieve.query_tokens(self.spark, query)
        vectors = None if approach == "lexical" else self.vectors
        if q.isEmpty():
            return self.spark.createDataFrame([], "item string, score double")
        v = self.embedder.vector(self.spark, query) if vectors is not None else None
        expanded = retrieve.expand(q, self.lexicon, v) if v is not None and self._semantic else retrieve.expand(q)
        expanded = self.spark.createDataFrame(expanded.collect(), expanded.schema)  # a sentence's words, asked for several times below
        lex = retrieve.lexical(self.index, q, expanded)
        if vectors is None:
            return retrieve.without_archives(retrieve.top(lex, max(3 * k, 50)), k, strict)
        if approach == "emb_column":
            hits = retrieve.knn(vectors[1], v, 50)
            return retrieve.without_archives(retrieve.by_table(hits, F.split("item", "::")[0]), k, strict)
        near = retrieve.knn(vectors[0], v, max(3 * k, 50))
        if approach == "emb_table":
            return retrieve.without_archives(near, k, strict)
        return retrieve.combined(near, lex, self.options.alpha if alpha is None else alpha, self.index, expanded, self.tables, k, strict)

    # tools

    def plan_query_for_intent(self, request: str, full_detail: bool = False, constraints: dict | None = None, budget: dict[str, int] | None = None, approach: str | None = None) -> Plan:
        self.ready()
        b = budget or ({} if full_detail else {"tables": 2, "columns_per_table": 6, "sample_values": 0})
        k = b.get("tables", 5)
        found = [r["item"] for r in self.scores(request, approach, 2 * k).collect()]
        seeds = self.spark.createDataFrame([(t, i) for i, t in enumerate(found[: self.options.seed_k or k])], "table string, pos int")
        grown = g.expand_simple(seeds, self.edges, k) if self.options.expander == "simple" else g.expand_fk(seeds, self.edges, self.tables, k)
        return self.meta.plan(request, [r["table"] for r in grown.collect()], detail="full" if full_detail else "minimal", columns=b.get("columns_per_table"), samples=b.get("sample_values"), constraints=constraints)

    def get_database_overview(self, include_subject_areas: bool = False, area_limit: int = 8) -> dict:
        self.ready()
        flags = classify.patterns(self.tables, self.edges).first()
        areas = self.get_subject_areas(area_limit)
        return {
            "database_name": self.catalog.schema, "database_type": self.catalog.dialect, "total_tables": len(self.meta.tables), "schemas": [self.catalog.schema],
            "key_subject_areas": {a["name"]: a["summary"] for a in areas}, "subject_areas": areas if include_subject_areas else None,
            "most_important_tables": [r["table"] for r in classify.important(self.tables).collect()], "common_patterns": [k for k in ("star", "normalized", "time_series", "analytics") if flags[k]],
        }

    def get_subject_areas(self, limit: int = 12) -> list[dict]:
        self.ready()
        return [r.asDict() for r in classify.areas(self.tables).orderBy(F.desc("n_tables"), "area").limit(limit).collect()]

    def get_table_info(self, table_key: str, include_samples: bool = True, column_role_filter: list[str] | None = None, max_sample_values: int = 5, relationship_limit: int | None = None, count_rows: bool = False) -> dict:
        self.ready()
        rows = self.catalog.table(table_key).count() if count_rows and table_key in self.meta.tables else None
        return self.meta.table_info(table_key, samples=max_sample_values if include_samples else 0, roles=column_role_filter, relationships=relationship_limit, rows=rows)

    def find_tables(self, query: str, limit: int = 10, approach: str = "combo", alpha: float | None = None) -> list[dict]:
        self.ready()
        hits = self.scores(query, approach, min(limit, 50), alpha).collect()
        return [{"table": r["item"], "score": r["score"], "summary": self.meta.tables[r["item"]].summary} for r in hits]

    def find_columns(self, keyword: str, limit: int = 25, by_table: str | None = None) -> list[dict]:
        self.ready()
        limit = min(limit, 200)
        hits = retrieve.knn(self.vectors[1], self.embedder.vector(self.spark, keyword), max(2 * limit, 50)).where("score > 0") if self.vectors else None
        return [r.asDict() for r in retrieve.find_columns(self.profiles, keyword, limit, by_table, hits).collect()]

    def get_init_status(self) -> dict:
        return {"phase": self.status.phase.value, "attempts": self.status.attempts, "error_message": self.status.error, "description": self.status.description, "started_at": self.status.started_at, "completed_at": self.status.completed_at}

    def execute_query(self, sql: str) -> execute.Result:
        o = self.options
        return execute.run(self.spark, sql, execute.Limits(o.row_limit, o.cell_chars, o.result_bytes), set(self.catalog.names()))

    def validate_sql(self, sql: str) -> sqltools.Validation:
        return sqltools.validate(self.spark, sql, analyse=True)

    def transpile_sql(self, sql: str, source: str = "sql") -> sqltools.Transpiled:
        return sqltools.transpile(self.spark, sql, source)

    def optimize_sql(self, sql: str) -> tuple[str, str, list[str]]:
        return sqltools.optimize(self.spark, sql)

    def sql_metadata(self, sql: str) -> sqltools.SqlMetadata:
        return sqltools.metadata(self.spark, sql)

    def assist_error(self, sql: str, error: str, dialect: str = "spark") -> sqltools.Assistance:
        return sqltools.assist(self.spark, sql, error, dialect)

    def auto_transpile(self, sql: str) -> sqltools.Transpiled:
        return sqltools.auto_transpile(self.spark, sql)

    # card

    def card(self) -> dict:
        """All metadata as plain values that JSON can hold."""
        self.ready()
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        return {"dialect": self.catalog.dialect, "place": self.catalog.place_hash(), "reflection_hash": self.catalog.reflection_hash(), "built_at": self.status.completed_at, "tables": rows(self.tables), "columns": rows(self.profiles), "edges": rows(self.edges), "areas": rows(classify.areas(self.tables))}

    def to_json(self) -> str:
        return json.dumps(self.card(), indent=2, default=str)

    @classmethod
    def load(cls, catalog: Catalog, path: str, options: Options | None = None, embedder=None) -> Engine:
        """An engine over a saved card, ready without reading the data. A card of other tables or keys is refused."""
        e, at = cls(catalog, options, embedder), path.rstrip("/")
        kept = catalog.spark.read.parquet(f"{at}/card").first()
        if kept["reflection_hash"] != catalog.reflection_hash():
            raise ReflectionError("the card describes other tables or keys; build anew")
        e.columns = catalog.columns()
        e.profiles, e.tables, e.edges = (catalog.spark.read.parquet(f"{at}/{name}").coalesce(1).persist() for name in ("columns", "tables", "edges"))
        e.meta = Metadata.collect(e.tables, e.profiles, e.edges)
        e._hash = fingerprint([kept["reflection_hash"], repr(e.options)])
        e.status = Status(Phase.READY, 0, None, kept["built_at"])
        return e

    def save(self, path: str) -> None:
        """The card as five Parquet tables."""
        for name, df in (("tables", self.tables), ("columns", self.profiles), ("edges", self.edges), ("areas", classify.areas(self.tables))):
            df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
        about = [(self.catalog.reflection_hash(), self.status.completed_at)]
        self.spark.createDataFrame(about, "reflection_hash string, built_at double").write.mode("overwrite").parquet(f"{path.rstrip('/')}/card")


def engine(spark: SparkSession, path: str, names: list[str], manifest=None, **options) -> Engine:
    """An engine over a folder of Parquet tables, built and with its tables known to SQL."""
    return Engine(Catalog.from_folder(spark, path, names, manifest).register(), Options(**options)).build()
