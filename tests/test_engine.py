"""The engine against literal expectations."""

import json

import pytest

from cartograph.functions import text as tx
from cartograph.operators import classify, graph, profile, retrieve
from cartograph.operators.ner import Gazetteer
from cartograph.plans import execute, sqltools
from cartograph.plans.planner import Metadata
from cartograph.plans.service import Engine, Options, Phase
from cartograph.sources import catalog as cat
from cartograph.workload.tables import MANIFEST, NAMES

GOLDEN = {
    "region": "reference", "nation": "dimension", "customer": "operational", "supplier": "operational", "part": "operational", "orders": "operational", "lineitem": "fact", "events": "operational",
    "documents": "operational", "embeddings": "operational", "pages": "operational", "benchmark": "operational", "labels": "reference", "conversations": "operational",
}


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(cat.Catalog.from_folder(spark, "/root/testdata/sf0.01", NAMES, MANIFEST).register(), Options(ordered_sample=True, sample_seconds=60)).build()


ARCHIVES = ["Orders_Archive", "Cities_ARCHIVED", "Invoices_Hist", "Invoices_History", "InvoicesBackup2", "Backup", "Tmp", "Temp", "Old", "Snapshot_2023_06", "Snap_20240601", "OrdersHistory2021", "CustomersArchive2020", "Archive_Orders", "History_Customers", "threshold", "household"]


def test_archives(spark):
    live = ["ActiveCustomers", "Orders", "SearchLog", "BackOrder"]
    df = spark.createDataFrame([(f"dbo.{x}", x in ARCHIVES) for x in ARCHIVES + live], "x string, want boolean")
    assert all(r.a == r.want and tx.archive_name(r.x) == r.want for r in df.select("x", "want", tx.is_archive(df.x).alias("a")).collect())


def test_text_functions(spark):
    assert tx.token_list("XMLHttp_Request-ID") == ["x", "m", "l", "http", "request", "i", "d"]
    df = spark.createDataFrame([("a@b.co",), ("+1 555-123-4567",), ("https://x",), ("12%",), ("plain",), (None,)], "v string")
    assert [r[0] for r in df.select(tx.value_pattern(df.v)).collect()] == ["email", "phone", "url", "percent", None, None]
    g = spark.sql("SELECT array('a', 'b', 'c') AS w, array() AS e")
    assert g.select(tx.ngrams(g.w)).first()[0] == ["a", "b", "c", "a_b", "b_c", "a_b_c"]
    assert tx.fold("Côte d'Ivoire ") == "cote_d_ivoire" and tx.strip_semicolon(" select 1; ") == "select 1" and tx.preview("x" * 200) == "x" * 100 + "..."


def test_profile_edges(spark):
    df = spark.createDataFrame([(float("nan"), None, "x", [1]), (1.0, 2, "y", [2]), (None, 2, "y", None)], "a double, b int, c string, d array<int>")
    got = {r.column: r for r in profile.profile(df, "t").collect()}
    assert (got["a"].n_null, got["a"].n_distinct, got["a"].min) == (2, 1, 1.0) and got["b"].n_null == 1
    assert got["c"].distinct_values == ["x", "y"] and got["d"].n_distinct is None and got["d"].n_null == 1
    empty = {r.column: r for r in profile.profile(df.limit(0), "t").collect()}
    assert empty["a"].n_rows == 0 and empty["a"].n_null == 0
    assert profile.profile(df.select(), "t").count() == 0


@pytest.mark.parametrize("n,role", [(10, "category"), (11, "metric")])
def test_role_thresholds(spark, n, role):
    cols = spark.createDataFrame([("s.t", 0, "v", "int", "numeric", True, None, None, None, None), ("s.t", 1, "update_flag", "string", "text", True, None, None, None, None), ("s.t", 2, "paid", "int", "numeric", True, None, None, None, None)], cat.COLUMNS)
    stats = profile.profile(spark.range(n).selectExpr("id AS v"), "s.t")
    got = {r.column: r for r in profile.column_profiles(cols, stats).collect()}
    assert got["v"].role == role and got["update_flag"].role == "date" and got["paid"].role == "key"
    assert (got["v"].value_range is not None) == (role == "metric") and got["v"].null_rate == 0 and got["paid"].null_rate is None


def test_golden_schema(engine):
    t = {r.table.split(".")[1]: r for r in engine.tables.collect()}
    assert {k: r.archetype for k, r in t.items()} == GOLDEN
    assert [k for k, r in t.items() if r.is_audit_like] == ["nation"] and not any(r.is_archive for r in t.values())
    areas = {}
    for k, r in t.items():
        areas.setdefault(r.area, set()).add(k)
    assert {frozenset(x) for x in areas.values() if len(x) > 1} == {frozenset(x) for x in ({"supplier", "lineitem", "part"}, {"orders", "customer"}, {"nation", "region"}, {"labels", "documents"})} or {"orders", "customer"} in areas.values()
    o = engine.get_database_overview(True)
    assert [x.split(".")[1] for x in o["most_important_tables"]] == ["lineitem", "customer", "orders", "supplier", "documents", "labels", "part", "region"]
    assert o["common_patterns"] == ["star", "time_series", "analytics"]
    assert all(0 <= r.centrality <= 1 for r in t.values())


def test_bridge_archetype_and_empty_graph(spark):
    cols = spark.createDataFrame([("s.ab", 0, "a_id", "int", "numeric", True, 0, 0, "s.a", "id"), ("s.ab", 1, "b_id", "int", "numeric", True, 1, 1, "s.b", "id"), ("s.a", 0, "id", "int", "numeric", True, 0, None, None, None), ("s.b", 0, "id", "int", "numeric", True, 0, None, None, None)], cat.COLUMNS)
    edges = spark.createDataFrame([("s.ab", "s.a", "a_id", "id", 0), ("s.ab", "s.b", "b_id", "id", 1)], cat.EDGES)
    p = profile.column_profiles(cols, spark.createDataFrame([], profile.STATS))
    t = {r.table: r for r in classify.tables(p, edges).collect()}
    assert t["s.ab"].archetype == "bridge" and t["s.a"].archetype == "reference"
    assert graph.communities(["a", "b"], []) == {"a": 0, "b": 0}
    alone = {r.table: r for r in classify.tables(p, edges.limit(0)).collect()}
    assert {r.area for r in alone.values()} == {"0"} and alone["s.ab"].centrality == 0


def test_composite_and_double_keys():
    from cartograph.plans.planner import Column, Table

    col = lambda t, c, pk=None, fk=None: Column(t, 0, c, "int", "key", pk, fk, None, None, None, None, [])
    tab = lambda t, cols: Table(t, "operational", "0", 0.0, 0, 0, False, False, t, cols)
    m = Metadata(
        {"s.a": tab("s.a", [col("s.a", "x", 0), col("s.a", "y", 1)]), "s.b": tab("s.b", [col("s.b", "ax", None, 0), col("s.b", "ay", None, 1)]), "s.c": tab("s.c", [col("s.c", "k", 0)]), "s.d": tab("s.d", [col("s.d", "k1", None, 0)])},
        [("s.b", "s.a", "ay", "y"), ("s.b", "s.a", "ax", "x"), ("s.d", "s.c", "k1", "k"), ("s.d", "s.c", "k2", "k")],
    )
    assert m.join_plan(["s.a", "s.b"], "s.a", 3)[0].pairs == [("x", "ax"), ("y", "ay")]
    step = m.join_plan(["s.c", "s.d"], "s.d", 3)[0]
    assert step.pairs == [("k1", "k")] and step.to_table == "s.c" and step.relationship == "many:1"
    assert m.draft("s.a", m.join_plan(["s.a", "s.b"], "s.a", 3), []) == "SELECT a.x, a.y FROM a LEFT JOIN b ON a.x = b.ax AND a.y = b.ay"


def test_plan_to_rows(engine):
    p = engine.plan_query_for_intent("quantity of lineitem by part", full_detail=True, approach="lexical")
    assert p.main_table == "main.lineitem" and p.status == "ok" and p.next_action == "execute_query" and p.confidence == 1.0
    r = engine.execute_query(p.draft_sql)
    assert r.status == "ok" and len(r.rows) == 200 and r.truncated and r.next_action == "refine_plan"
    p = engine.meta.plan("how many region rows", ["main.region", "main.pages"])
    assert p.draft_sql == "SELECT COUNT(*) AS count FROM region" and not p.clarifications
    p = engine.meta.plan("x", [])
    assert p.status == "needs_input" and p.main_table is None
    assert engine.meta.plan("orders", ["main.orders"], constraints={"o_orderstatus": "F", "zz": 1}).draft_sql.endswith("WHERE orders.o_orderstatus = 'F'")
    with pytest.raises(KeyError):
        engine.get_table_info("main.nothing")


def test_retrieval(engine, spark):
    assert engine.find_tables("customers", 1, "lexical")[0]["table"] == "main.customer"
    for a in retrieve.APPROACHES:
        assert engine.find_tables("orders of customer", 3, a)
    assert engine.scores("", "lexical").isEmpty()
    with pytest.raises(ValueError):
        engine.scores("x", "nope")
    cols = engine.find_columns("price", 50)
    assert len({(c["table"], c["column"]) for c in cols}) == len(cols)

    class Broken:
        def fit(self, *_):
            raise OSError("no model")

    lame = Engine(engine.catalog, engine.options, Broken())
    lame.__dict__ |= {k: engine.__dict__[k] for k in ("profiles", "tables", "edges", "meta", "status", "columns")}
    assert lame.vectors is None and lame.find_tables("orders", 2, "emb_table")[0]["table"] == "main.orders"


@pytest.mark.parametrize("sql", ["insert into x values (1)", "update t set a = 1", "delete from t", "create table t (a int)", "drop\ttable t", "truncate table t", "grant select on t to u", "with a as (select 1) insert into t select * from a", "select java_method('java.lang.System', 'getenv', 'x')", "select reflect('a', 'b')", "select transform(a) using 'cat' from t", "insert overwrite directory '/tmp/x' select 1", "call f()", "execute immediate 'select 1'", "set a = 1", "select 1; drop table t", "select * from parquet.`/tmp/x`"])
def test_guard_refuses(engine, sql):
    r = engine.execute_query(sql)
    assert r.status == "error" and r.error


@pytest.mark.parametrize("sql", ["select 1;", "select 'please update me' AS x", "with a as (select 1 AS x) select * from a", "values (1), (2)", "select * from region where r_regionkey in (select n_regionkey from nation)", "select * from nation n, lateral (select n.n_name) t", "from nation select count(*)"])
def test_guard_allows(engine, sql):
    r = engine.execute_query(sql)
    assert r.status == "ok", r.error


def test_budgets(spark):
    spark.createDataFrame([(1, "Alice"), (2, "Bob" * 20), (3, None)], "id int, name string").createOrReplaceTempView("people_t")
    r = execute.run(spark, "select id, name from people_t order by id", execute.Limits(2, 10))
    assert [x["name"] for x in r.rows] == ["Alice", "BobBobBob…"] and r.truncated and r.summary == "2 row(s), 2 column(s); truncated"
    assert execute.Limits(0, 1).rows == 1 and execute.Limits(0, 1).cell_chars == 10
    bad = execute.run(spark, "select nme from people_t")
    assert bad.status == "error" and "misspelled" in bad.assistance.likely_causes[0] and bad.next_action == "refine_plan"


def test_sql_tools(spark):
    n = sqltools.normalize
    assert n("SELECT TOP 2 name FROM dbo.Users ORDER BY name").sql.endswith("LIMIT 2")
    assert n("select 'TOP 5 [x] isnull(a,b)' -- top 3").sql == "select 'TOP 5 [x] isnull(a,b)' -- top 3"
    assert n("select a[0], [b] from t").sql == "select a[0], `b` from t" and n("select isnull(a) from t").sql == "select isnull(a) from t"
    assert n("select getdate(), newid(), sysdate from t").sql == "select current_timestamp(), uuid(), current_timestamp() from t"
    assert sqltools.validate(spark, "select 1").is_valid and not sqltools.validate(spark, "selec 1").is_valid
    assert sqltools.detect(spark, "SELECT TOP 5 * FROM t")[0] == "tsql" and sqltools.detect(spark, "select 1")[0] == "postgres"
    assert {k: sqltools.dialect_of(k) for k in ("postgresql", "mssql", "sqlite", "zzz")} == {"postgresql": "postgres", "mssql": "tsql", "sqlite": "sqlite", "zzz": "sql"}
    m = sqltools.metadata(spark, "select count(*) from a join b on a.x = b.x where exists (select 1 from c)")
    assert m.tables == ["a", "b", "c"] and m.has_joins and m.has_subqueries and m.has_aggregations and m.query_type == "SELECT"
    a = sqltools.assist(spark, "SELECT TOP 3 * FROM t", 'syntax error at or near "TOP"', "postgres")
    assert any(f.startswith("Replace") for f in a.suggested_fixes) and a.likely_causes
    assert sqltools.transpile(spark, "selec top 1").sql == "selec top 1"
    assert sqltools.optimize(spark, "select 1 + 1 AS x")[1].count("2")


def test_entities(spark):
    g = Gazetteer(spark, {"California": "US-CA"})
    got = {(e.label, e.canonical) for e in g.analyze("euro in United States, California, America/New_York")}
    assert {("CURRENCY", "EUR"), ("COUNTRY", "US"), ("SUBDIVISION", "US-CA"), ("TIMEZONE", "America/New_York")} <= got
    assert "COUNTRY" in g.labels("USA") and "CURRENCY" in g.labels("EUR amount") and "PERSON" in g.labels("first_name")
    assert "COUNTRY" in g.labels("user_id") and "COUNTRY" not in Gazetteer(spark, strict_codes=True).labels("user_id")
    df = g.tag(spark.createDataFrame([("country_code",), ("zzz",), (None,)], "c string"), "c")
    assert {r.c: r.labels for r in df.collect()}["country_code"] == ["GPE"]


def test_catalog(spark, tmp_path, engine):
    assert cat.excluded_schemas("mssql+pyodbc") == ["information_schema", "sys"] and "pg_catalog" in cat.excluded_schemas("new")
    assert "default" in cat.databases(spark) and cat.databases(spark, exclude=["default"]) == []
    spark.range(3).write.csv(str(tmp_path / "x.csv"), header=True)
    c = cat.Catalog.from_folder(spark, str(tmp_path), ["x", "missing"], fmt="csv", header=True)
    assert c.readable() == ["x"] and c.table("x").count() == 3 and c.probe()
    assert len(c.reflection_hash()) == 16 and len(c.place_hash()) == 10
    spark.createDataFrame([(b"a", 1)], "b binary, i int").write.parquet(str(tmp_path / "y.parquet"))
    y = cat.Catalog.from_folder(spark, str(tmp_path), ["y"])
    assert y.sample("y").columns == ["i"] and y.sample("y", ["b"]).columns == []
    with pytest.raises(cat.EngineError):
        cat.location(None)
    assert json.loads(engine.to_json())["reflection_hash"] == engine.catalog.reflection_hash()
    engine.save(str(tmp_path / "card"))
    assert spark.read.parquet(str(tmp_path / "card/tables")).count() == 14
    assert not engine.refresh()
    late = Engine(cat.Catalog.from_folder(spark, "/nowhere", []))
    assert late.get_init_status()["phase"] == "IDLE"
    late.stop()
    assert late.status.phase is Phase.STOPPED
    with pytest.raises(RuntimeError):
        late.ready()


def test_guard_checks_every_relation(spark, engine, sf):
    from cartograph.plans import sqltools

    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("secret_v")
    file = f"parquet.`{sf}/region.parquet`"
    known = {"region", "nation"}
    for sql in ("select * from secret_v", f"select * from secret_v a cross join {file} b", f"select * from {file} a cross join secret_v b", f"select * from region, {file}", "select * from region, secret_v", "with x as (select 1) select * from x, secret_v", "select * from region where exists (select 1 from secret_v)"):
        assert sqltools.refusal(spark, sql, known), sql
    for sql in ("select * from region, nation", "with secret as (select 1 a) select * from secret, region", "select * from no_such_table"):
        assert sqltools.refusal(spark, sql, known) is None, sql


def test_entity_tags_and_lexicon(engine):
    tags = {r["column"]: r["tags"] for r in engine.profiles.collect()}
    assert "currency" not in tags["l_tax"] and all(t == t.lower() for ts in tags.values() for t in ts)
    assert {r.token for r in engine.lexicon.collect()} >= {"lineitem", "orders"}
    q, v = retrieve.query_tokens(engine.spark, "orders"), engine.embedder.vector(engine.spark, "orders")
    own, more = ({r.token: r.q for r in x.collect()} for x in (retrieve.expand(q), retrieve.expand(q, engine.lexicon, v)))
    assert set(own) < set(more) and len(more) <= len(own) + 16
    assert engine.scores("orders of customers", "combo", 3).count() == 3


def test_entity_tags_follow_own_tags(spark):
    rows = spark.createDataFrame([("t", "customer_name", ["email"]), ("t", "zzz", [])], "table string, column string, tags array<string>")
    got = {r["column"]: r["tags"] for r in profile.entity_tags(rows, Gazetteer(spark)).collect()}
    assert got == {"customer_name": ["email", "person"], "zzz": []}


def test_saved_card_opens_without_a_build(spark, engine, tmp_path):
    engine.save(str(tmp_path / "card"))
    again = Engine.load(engine.catalog, str(tmp_path / "card"), engine.options)
    assert again.status.phase is Phase.READY and again.status.attempts == 0 and not again.refresh()
    assert again.get_table_info("main.orders") == engine.get_table_info("main.orders")
    with pytest.raises(cat.ReflectionError):
        Engine.load(cat.Catalog.from_folder(spark, "/root/testdata/sf0.01", ["region"]), str(tmp_path / "card"))


def test_sample_limit(spark, engine, monkeypatch):
    assert engine.catalog.sample("region", seconds=60).count() == 5
    slow = spark.range(4).selectExpr("id", "reflect('java.lang.Thread', 'sleep', 20000L) AS z")
    with pytest.raises(cat.SamplingError):
        cat.Catalog(spark, {"slow": lambda: slow.selectExpr("CAST(java_method('java.lang.String', 'valueOf', id) AS STRING) AS v", "z")}).sample("slow", seconds=1)


def test_columns_outside_declared_keys(spark):
    rows = spark.createDataFrame([("b", "x_id", "key", 0, 0, 5), ("b", "y_id", "key", 1, 1, 5), ("b", "free_id", "key", None, None, 5)], "table string, column string, role string, pk_pos int, fk_pos int, n_rows int")
    assert classify.counts(rows).first().n_non_key == 1
