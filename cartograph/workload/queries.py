"""Registered queries of the engine's operators, each with an equivalent for another SQL engine where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import classify, graph, profile, retrieve
from ..plans import execute, planner, sqltools
from ..plans.service import Engine, Options
from ..sources.catalog import discover_keys
from . import passthrough
from .tables import FOREIGN, PRIMARY, catalog

_engines: dict[tuple[int, str], Engine] = {}
SCHEMA = "main"
LABELS = ["dbo.Orders_Archive", "dbo.Cities_ARCHIVED", "dbo.Invoices_Hist", "dbo.Invoices_History", "dbo.InvoicesBackup2", "dbo.Backup", "dbo.Tmp", "dbo.Temp", "dbo.Old", "dbo.Snapshot_2023_06", "dbo.Snap_20240601", "dbo.OrdersHistory2021", "dbo.CustomersArchive2020", "dbo.Archive_Orders", "dbo.History_Customers", "dbo.ActiveCustomers", "dbo.Orders", "dbo.SearchLog", "dbo.BackOrder", "dbo.threshold", "dbo.t::old_x"]
SQL_TEXTS = ["SELECT TOP 5 * FROM dbo.Users", "select a::int from t where b ilike 'x'", "select `a` from `b`", "select group_concat( x) from t", "select nvl(a, b) from t", "select split_part(a, b, 1) from t", "select unnest(a) from t", "select 1"]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    key = (id(spark), sf_dir)
    if key not in _engines:
        _engines[key] = Engine(catalog(spark, sf_dir), Options(ordered_sample=True, sample_seconds=None)).build()
    else:
        _engines[key].catalog.register()
    return _engines[key]


def quoted(values) -> str:
    return ", ".join("('" + str(v).replace("'", "''") + "')" for v in values)


# SQL pieces that rebuild the metadata

EDGES = "edges(src, dst, src_col, dst_col, ord) AS (VALUES " + ", ".join(f"('{SCHEMA}.{a}', '{SCHEMA}.{c}', '{b}', '{d}', {i})" for i, (a, b, c, d) in enumerate(FOREIGN)) + ")"
PKS = "pks(tbl, col, pos) AS (VALUES " + ", ".join(f"('{t}', '{c}', {i})" for t, cs in PRIMARY.items() for i, c in enumerate(cs)) + ")"
KIND = "CASE WHEN data_type IN ('INTEGER', 'BIGINT', 'DOUBLE', 'FLOAT', 'SMALLINT') THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'temporal' ELSE 'nested' END"
NUMERIC = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey", "c_acctbal"], "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], "events": ["event_id", "user_id", "value"],
    "documents": ["doc_id", "n_chars"], "embeddings": ["vec_id", "label"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn"],
}
DISTINCT = "dist(tbl, col, n) AS (" + " UNION ALL ".join(
    f"SELECT '{t}', '{c}', count(DISTINCT {c}) FROM (SELECT * FROM {t} ORDER BY {', '.join(PRIMARY.get(t, ['ALL']))} LIMIT 50)" for t, cs in NUMERIC.items() for c in cs
) + ")"
COLS = f"cols AS (SELECT '{SCHEMA}.' || table_name AS tbl, CAST(ordinal_position - 1 AS INTEGER) AS ord, column_name AS col, {KIND} AS kind, p.pos AS pk_pos, f.ord AS fk_pos FROM information_schema.columns c LEFT JOIN pks p ON p.tbl = c.table_name AND p.col = c.column_name LEFT JOIN edges f ON f.src = '{SCHEMA}.' || c.table_name AND f.src_col = c.column_name WHERE table_name IN ({', '.join(repr(t) for t in NUMERIC)}))"
ROLES = (
    "roles AS (SELECT c.tbl, c.ord, c.col, c.pk_pos, c.fk_pos, CASE WHEN kind = 'temporal' OR (kind <> 'numeric' AND regexp_matches(c.col, 'date|time')) THEN 'date' WHEN pk_pos IS NOT NULL OR fk_pos IS NOT NULL "
    "OR lower(c.col) LIKE '%\\_id' ESCAPE '\\' OR regexp_replace(lower(c.col), '[^a-z0-9]', '', 'g') LIKE '%id' THEN 'key' WHEN kind = 'numeric' THEN CASE WHEN d.n > 10 THEN 'metric' ELSE 'category' END WHEN kind = 'text' THEN 'text' ELSE 'category' END AS role "
    f"FROM cols c LEFT JOIN dist d ON c.tbl = '{SCHEMA}.' || d.tbl AND c.col = d.col)"
)
DEGREES = (
    "near AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), names AS (SELECT DISTINCT tbl FROM cols), "
    "degrees AS (SELECT n.tbl, (SELECT count(DISTINCT src) FROM edges WHERE dst = n.tbl) AS in_degree, (SELECT count(DISTINCT dst) FROM edges WHERE src = n.tbl) AS out_degree, (SELECT count(*) FROM near WHERE a = n.tbl) / 13.0 AS centrality FROM names n)"
)
COUNTS = "counts AS (SELECT tbl, count(*) AS n_columns, count(*) FILTER (role = 'metric') AS n_metrics, count(*) FILTER (role = 'date') AS n_dates, count(*) FILTER (pk_pos IS NULL AND fk_pos IS NULL) AS n_non_key, count(pk_pos) AS n_pk, count(*) FILTER (pk_pos IS NOT NULL AND fk_pos IS NOT NULL) AS n_pk_fk FROM roles GROUP BY tbl)"
KINDS = (
    "kinds AS (SELECT tbl, n_metrics, n_dates, in_degree, out_degree, centrality, CASE WHEN n_pk >= 2 AND n_pk = n_pk_fk AND n_non_key <= 1 AND in_degree + out_degree >= 2 THEN 'bridge' WHEN n_metrics >= 2 AND n_dates >= 1 AND in_degree + out_degree >= 2 THEN 'fact' "
    "WHEN in_degree >= 2 AND n_metrics <= 1 AND n_pk = 1 THEN 'dimension' WHEN n_columns <= 4 AND n_metrics = 0 AND in_degree + out_degree >= 1 THEN 'reference' ELSE 'operational' END AS archetype FROM counts JOIN degrees USING (tbl))"
)
FLAGS = "flags AS (SELECT *, centrality >= (SELECT quantile_cont(centrality, 0.8) FROM degrees) AND n_metrics = 0 AND n_dates = 0 AS is_audit_like FROM kinds)"
UTILITY = "CASE archetype WHEN 'fact' THEN 2.0 WHEN 'dimension' THEN 1.0 ELSE 0.5 END + 0.3 * least(2, n_metrics) + CASE WHEN n_dates > 0 THEN 0.2 ELSE 0 END + 0.2 * centrality - CASE WHEN is_audit_like THEN 0.5 ELSE 0 END"
AREAS = {"lineitem": "0", "part": "0", "supplier": "0", "customer": "1", "orders": "1", "documents": "2", "labels": "2", "nation": "3", "region": "3"}
WITH = f"WITH {EDGES}, {PKS}, {DISTINCT}, {COLS}, {ROLES}, {DEGREES}, {COUNTS}, {KINDS}, {FLAGS} "

NORMAL = "lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '[_-]+', ' ', 'g'), '([A-Z])', ' \\1', 'g'), '\\s+', ' ', 'g')))"
TOKENS = "[tk for tk in string_split_regex(" + NORMAL + ", '[^a-z0-9]+') if tk <> '']"
ARCHIVE = "(regexp_matches({0}, '(archive|archived|hist|history|backup|bak|old|tmp|temp)$', 'i') OR len([tt for tt in " + TOKENS + " if regexp_full_match(tt, '(archive|archived|hist|history|backup|bak|snapshot|snap|temp|tmp|old)[0-9]*')]) > 0)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# scans and keys


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def sample_scan(spark, sf):
    return catalog(spark, sf).sample("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], 50, ordered=True)


@query(f"WITH {EDGES}, {PKS}, {COLS} SELECT tbl AS table_key, ord, col, kind, pk_pos IS NOT NULL AS is_pk, fk_pos IS NOT NULL AS is_fk FROM cols")
def column_inventory(spark, sf):
    return catalog(spark, sf).columns().select(F.col("table").alias("table_key"), "ord", F.col("column").alias("col"), "kind", F.col("pk_pos").isNotNull().alias("is_pk"), F.col("fk_pos").isNotNull().alias("is_fk"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS src, '{c}' AS dst, count(*) AS orphans FROM {a} WHERE {b} NOT IN (SELECT {d} FROM {c})" for a, b, c, d in FOREIGN))
def fk_orphans(spark, sf):
    c, out = catalog(spark, sf), None
    for a, b, r, d in FOREIGN:
        x = c.table(a).select(F.col(b).cast("long").alias("k")).join(c.table(r).select(F.col(d).cast("long").alias("k")), "k", "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(a).alias("src"), F.lit(r).alias("dst"), "orphans")
        out = x if out is None else out.unionByName(x)
    return out


@query(" UNION ALL ".join(f"SELECT '{a}' AS src, '{b}' AS src_col, '{c}' AS dst, '{d}' AS dst_col WHERE NOT EXISTS (SELECT 1 FROM {a} WHERE {b} NOT IN (SELECT {d} FROM {c}))" for a, b, c, d in FOREIGN))
def fk_discovery(spark, sf):
    return discover_keys(catalog(spark, sf), PRIMARY)


# statistics


def _stats_sql(table: str, cols: list[str], numeric: set[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, count(*) AS n_rows, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate, round(count(DISTINCT {c}) / count(*), 6) AS distinct_ratio, "
        f"CASE WHEN count(DISTINCT {c}) <= 20 THEN (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {table})) END AS vals, "
        + (f"round(min({c}), 4) AS lo, round(max({c}), 4) AS hi" if c in numeric else "CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi") + f" FROM {table}"
        for c in cols
    )


def _stats(df: DataFrame) -> DataFrame:
    return profile.profile_full(df, "t", approximate=False).select(
        F.col("column").alias("col"), "n_rows", F.round(F.col("n_null") / F.col("n_rows"), 6).alias("null_rate"), F.round(F.col("n_distinct") / F.col("n_rows"), 6).alias("distinct_ratio"),
        F.array_join("distinct_values", ",").alias("vals"), F.round("min", 4).alias("lo"), F.round("max", 4).alias("hi"),
    )


@query(_stats_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], {"o_orderkey", "o_custkey", "o_totalprice"}))
def profile_orders(spark, sf):
    return _stats(catalog(spark, sf).table("orders"))


@query(_stats_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"], {"doc_id", "n_chars"}))
def profile_documents(spark, sf):
    return _stats(catalog(spark, sf).table("documents"))


@query()
def profile_full_lineitem(spark, sf):
    return profile.profile_full(catalog(spark, sf).table("lineitem"), "lineitem").select("column", "n_rows", "n_null", "n_distinct", F.array_join("distinct_values", ",").alias("vals"), "min", "max")


@query("SELECT CASE WHEN regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'email' WHEN regexp_matches(v, '^\\+?\\d[\\d\\-\\s]{7,}\\d$') THEN 'phone' WHEN regexp_matches(v, '^https?://') THEN 'url' WHEN regexp_matches(v, '%$') THEN 'percent' END AS pattern, count(*) AS n FROM (SELECT substring(url, 1, 120) AS v FROM pages UNION ALL SELECT unnest(string_split(text, ' ')) FROM documents) GROUP BY 1")
def value_patterns(spark, sf):
    c = catalog(spark, sf)
    v = c.table("pages").select(tx.display(F.col("url")).alias("v")).unionByName(c.table("documents").select(F.explode(F.split("text", " ")).alias("v")))
    return v.groupBy(tx.value_pattern(F.col("v")).alias("pattern")).agg(F.count("*").alias("n"))


# text functions


@query(f"SELECT x, {NORMAL.format('x')} AS normal, array_to_string({TOKENS.format('x')}, ' ') AS toks FROM (SELECT unnest(['XMLHttp_Request', 'order-ID', 'camelCaseName', '__a__B', '', 'l_orderkey', 'Ünder Score9']) AS x UNION ALL SELECT column_name FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in NUMERIC)}))")
def tokenize_identifiers(spark, sf):
    names = ["XMLHttp_Request", "order-ID", "camelCaseName", "__a__B", "", "l_orderkey", "Ünder Score9"]
    x = spark.createDataFrame([(n,) for n in names], "x string").unionByName(catalog(spark, sf).columns().select(F.col("column").alias("x")))
    return x.select("x", tx.normalize_identifier(F.col("x")).alias("normal"), F.array_join(tx.tokens(F.col("x")), " ").alias("toks"))


@query(f"SELECT x, {ARCHIVE.format('part')} AS is_archive FROM (SELECT x, string_split(string_split(x, '::')[1], '.')[-1] AS part FROM (VALUES {quoted(LABELS)}) v(x))")
def archive_labels(spark, sf):
    return spark.createDataFrame([(x,) for x in LABELS], "x string").select("x", tx.is_archive(F.col("x")).alias("is_archive"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substring(text, 1, 39) || '…' ELSE text END AS cell FROM documents")
def cell_truncation(spark, sf):
    return catalog(spark, sf).table("documents").select("doc_id", tx.truncate_cell(F.col("text"), 40).alias("cell"))


@query("SELECT x, trim(regexp_replace(replace(string_split(upper(x), ' COLLATE ')[1], '\"', ''), '\\s+', ' ', 'g')) AS t FROM (VALUES ('varchar(20)  collate \"C\"'), ('\"numeric\" ( 10,2 )'), ('int')) v(x)")
def sanitize_type(spark, sf):
    return spark.createDataFrame([('varchar(20)  collate "C"',), ('"numeric" ( 10,2 )',), ("int",)], "x string").select("x", tx.sanitize_type(F.col("x")).alias("t"))


@query("SELECT x, CASE WHEN length(x) < 3 THEN NULL WHEN x LIKE '%s' THEN substring(x, 1, length(x) - 1) ELSE x || 's' END AS v FROM (VALUES ('orders'), ('order'), ('is'), ('a'), ('address')) t(x)")
def number_variants(spark, sf):
    return spark.createDataFrame([("orders",), ("order",), ("is",), ("a",), ("address",)], "x string").select("x", tx.number_variant(F.col("x")).alias("v"))


# roles, archetypes, graph


@query(WITH + "SELECT tbl AS table_key, col, role FROM roles")
def role_inference(spark, sf):
    return engine(spark, sf).profiles.select(F.col("table").alias("table_key"), F.col("column").alias("col"), "role")


@query(f"WITH {EDGES} SELECT src, dst, src_col, dst_col FROM edges")
def fk_edges(spark, sf):
    return catalog(spark, sf).edges().drop("ord")


@query(WITH + "SELECT tbl AS table_key, in_degree, out_degree, round(centrality, 6) AS centrality FROM degrees")
def degree_centrality(spark, sf):
    c = catalog(spark, sf)
    return graph.degrees(c.columns().select("table").distinct(), c.edges()).select(F.col("table").alias("table_key"), "in_degree", "out_degree", F.round("centrality", 6).alias("centrality"))


@query(WITH + "SELECT round(quantile_cont(centrality, 0.8), 6) AS p80 FROM degrees")
def centrality_p80(spark, sf):
    return engine(spark, sf).tables.agg(F.round(F.percentile("centrality", 0.8), 6).alias("p80"))


@query(WITH + "SELECT tbl AS table_key, n_metrics, n_dates, archetype, is_audit_like FROM flags")
def archetypes(spark, sf):
    return engine(spark, sf).tables.select(F.col("table").alias("table_key"), "n_metrics", "n_dates", "archetype", "is_audit_like")


@query(WITH + f"SELECT tbl AS table_key, round({UTILITY}, 6) AS utility FROM flags")
def node_utility(spark, sf):
    return engine(spark, sf).tables.select(F.col("table").alias("table_key"), F.round(graph.utility(), 6).alias("utility"))


@query(WITH + "SELECT tbl AS table_key FROM (SELECT 'main.orders' AS tbl UNION SELECT b FROM near WHERE a = 'main.orders') ORDER BY tbl <> 'main.orders', tbl LIMIT 3")
def expand_simple(spark, sf):
    e = engine(spark, sf)
    return graph.expand_simple(spark.createDataFrame([("main.orders", 0)], "table string, pos int"), e.edges, 3).select(F.col("table").alias("table_key"))


@query(WITH + f"SELECT 'main.lineitem' AS table_key, 0.0::DOUBLE AS score UNION ALL (SELECT f.tbl, round({UTILITY} + CASE WHEN f.tbl IN ('main.part', 'main.supplier') THEN 0.2 ELSE 0 END, 6)::DOUBLE AS s FROM flags f JOIN near n ON n.a = 'main.lineitem' AND n.b = f.tbl ORDER BY s DESC, f.tbl LIMIT 2)")
def expand_fk_following(spark, sf):
    e = engine(spark, sf)
    return graph.expand_fk(spark.createDataFrame([("main.lineitem", 0)], "table string, pos int"), e.edges, e.tables, 3).select(F.col("table").alias("table_key"), F.round("score", 6).alias("score"))


@query(WITH + ", a(tbl, area) AS (VALUES " + ", ".join(f"('main.{t}', '{a}')" for t, a in AREAS.items()) + ") SELECT p.b AS table_key, p.x AS bridge, round(CASE WHEN f.is_audit_like THEN -0.6 ELSE 0 END + CASE WHEN ax.area = '0' THEN 0.2 ELSE 0 END + CASE WHEN ax.area = ab.area THEN 0.2 ELSE 0 END, 6) AS score FROM (SELECT n2.b, n1.b AS x FROM near n1 JOIN near n2 ON n1.b = n2.a WHERE n1.a = 'main.lineitem' AND n2.b <> 'main.lineitem' AND n2.b NOT IN (SELECT b FROM near WHERE a = 'main.lineitem')) p JOIN flags f ON f.tbl = p.x JOIN a ax ON ax.tbl = p.x JOIN a ab ON ab.tbl = p.b")
def one_hop_bridges(spark, sf):
    e = engine(spark, sf)
    return graph.bridges(e.edges, e.tables, "main.lineitem", e.tables.select("table")).select(F.col("table").alias("table_key"), "bridge", F.round("score", 6).alias("score"))


@query()
def subject_areas(spark, sf):
    return classify.areas(engine(spark, sf).tables)


@query(WITH + ", a(tbl, area) AS (VALUES " + ", ".join(f"('main.{t}', '{a}')" for t, a in AREAS.items()) + ") SELECT area, archetype, count(*) AS n FROM flags JOIN a USING (tbl) GROUP BY ALL")
def area_archetypes(spark, sf):
    return classify.archetype_distribution(engine(spark, sf).tables).where("area <= '3'")


@query(WITH + "SELECT tbl AS table_key, round(centrality, 6) AS centrality FROM flags ORDER BY is_audit_like, centrality DESC, tbl LIMIT 8")
def important_tables(spark, sf):
    return classify.important(engine(spark, sf).tables).select(F.col("table").alias("table_key"), F.round("centrality", 6).alias("centrality"))


@query(WITH + "SELECT bool_or(archetype = 'fact') AND bool_or(archetype = 'dimension') AS star, (SELECT count(*) FROM edges) > count(*) AS normalized, bool_or(n_dates > 0) AS time_series, bool_or(n_metrics > 0) AS analytics FROM flags")
def common_patterns(spark, sf):
    e = engine(spark, sf)
    return classify.patterns(e.tables, e.edges)


# retrieval

_WORDS = "w AS (SELECT CAST(doc_id AS VARCHAR) AS item, unnest(" + TOKENS.format("text") + ") AS token FROM documents), idx AS (SELECT item, token, CAST(count(*) AS DOUBLE) AS weight FROM w GROUP BY ALL)"
_QUERY = "q(token, q) AS (VALUES ('the', 1.0), ('thes', 0.3), ('onion', 1.0), ('onions', 0.3), ('ing', 1.0), ('ings', 0.3)), raw(token) AS (VALUES ('the'), ('onion'), ('ing'))"
_BOOST = "ranked AS (SELECT i.*, row_number() OVER (PARTITION BY token ORDER BY weight DESC, item) AS rn FROM idx i JOIN raw USING (token)), boost AS (SELECT item, sum(least(0.25, 0.05 + 0.02 * weight)) AS boost FROM ranked WHERE rn <= 20 GROUP BY item)"
_LEX = "lex AS (SELECT i.item, sum(weight * coalesce(q.q, 0)) / (sqrt(sum(weight * weight)) + 1e-8) + coalesce(any_value(boost), 0) AS score FROM idx i LEFT JOIN q USING (token) LEFT JOIN boost USING (item) GROUP BY i.item)"


def _docs_index(spark, sf):
    return retrieve.text_index(catalog(spark, sf).table("documents"), "doc_id", "text")


@query(f"WITH {_WORDS} SELECT item, token, weight FROM idx")
def text_index(spark, sf):
    return _docs_index(spark, sf)


@query()
def schema_index(spark, sf):
    return retrieve.schema_index(engine(spark, sf).profiles)


@query(f"WITH {_WORDS}, {_QUERY}, {_BOOST} SELECT item, round(boost, 6) AS boost FROM boost")
def hint_boosts(spark, sf):
    return retrieve.boosts(_docs_index(spark, sf), retrieve.query_tokens(spark, "the onion ing")).select("item", F.round("boost", 6).alias("boost"))


@query(f"WITH {_WORDS}, {_QUERY}, {_BOOST}, {_LEX} SELECT item, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, item LIMIT 50")
def lexical_top(spark, sf):
    return retrieve.top(retrieve.lexical(_docs_index(spark, sf), retrieve.query_tokens(spark, "the onion ing")), 50).select("item", F.round("score", 6).alias("score"))


@query(f"WITH {_WORDS} SELECT token, count(DISTINCT item) AS df FROM w WHERE NOT regexp_matches(token, '^[0-9]+$') GROUP BY token")
def token_df(spark, sf):
    return retrieve.token_df(catalog(spark, sf).table("documents").select(F.col("doc_id").alias("item"), tx.tokens(F.col("text")).alias("tokens")))


_SIM = "list_sum([CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE) for i in range(1, 65)])"
_NORM = "(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in {0}.embedding])) + 1e-8)"
_NEAR = f"near AS (SELECT a.vec_id AS item, a.label, {_SIM} / ({_NORM.format('a')} * {_NORM.format('b')}) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b)"


def _vector(spark, sf):
    return [float(x) for x in catalog(spark, sf).table("embeddings").where("vec_id = 0").first()["embedding"]]


def _near(spark, sf, k):
    return retrieve.knn(catalog(spark, sf).table("embeddings"), _vector(spark, sf), k, "vec_id", "embedding")


@query(f"WITH {_NEAR} SELECT item, round(score, 5) AS score FROM near ORDER BY near.score DESC, item LIMIT 20")
def knn_cosine(spark, sf):
    return _near(spark, sf, 20).select("item", F.round("score", 5).alias("score"))


@query()
def knn_approximate(spark, sf):
    return retrieve.knn_lsh(catalog(spark, sf).table("embeddings"), _vector(spark, sf), 20, "vec_id", "embedding")


@query(f"WITH {_NEAR}, t AS (SELECT * FROM near ORDER BY score DESC, item LIMIT 50) SELECT label AS item, round(sum(greatest(0, score)), 5) AS score FROM t GROUP BY label")
def column_to_table_scores(spark, sf):
    hits = _near(spark, sf, 50).join(catalog(spark, sf).table("embeddings").select(F.col("vec_id").alias("item"), "label"), "item")
    return retrieve.by_table(hits, F.col("label")).select("item", F.round("score", 5).alias("score"))


@query("WITH x AS (SELECT CAST(label AS VARCHAR) AS token, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS v FROM embeddings) SELECT 'l' || token AS token, CAST(pos AS INTEGER) AS pos, round(avg(CAST(v AS DOUBLE)), 5) AS x FROM x GROUP BY ALL")
def token_centroids(spark, sf):
    items = catalog(spark, sf).table("embeddings").select(F.col("vec_id").alias("item"), F.array(F.concat(F.lit("l"), F.col("label").cast("string"))).alias("tokens"), F.col("embedding").alias("vec"))
    return retrieve.lexicon(items).select("token", F.posexplode("vec").alias("pos", "x")).select("token", "pos", F.round("x", 5).alias("x"))


@query("SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / ((SELECT max(o_totalprice) - min(o_totalprice) FROM orders) + 1e-8), 6) AS s FROM orders")
def min_max_scores(spark, sf):
    orders = catalog(spark, sf).table("orders")
    return orders.select("o_orderkey", F.round(vx.scaled(orders, "o_totalprice"), 6).alias("s"))


@query(f"WITH {_WORDS}, {_QUERY}, {_BOOST}, {_LEX}, {_NEAR}, e AS (SELECT CAST(item AS VARCHAR) AS item, score FROM near ORDER BY score DESC, CAST(item AS BIGINT) LIMIT 50), l AS (SELECT * FROM lex ORDER BY score DESC, item LIMIT 50), en AS (SELECT item, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER () + 1e-8) AS s FROM e), ln AS (SELECT item, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER () + 1e-8) AS s FROM l) SELECT item, round(s, 4) AS score FROM (SELECT item, 0.7 * coalesce(en.s, 0) + 0.3 * coalesce(ln.s, 0) AS s FROM en FULL OUTER JOIN ln USING (item)) ORDER BY s DESC, item LIMIT 50")
def combined_scores(spark, sf):
    lex = retrieve.lexical(_docs_index(spark, sf), retrieve.query_tokens(spark, "the onion ing"))
    near = _near(spark, sf, 50).select(F.col("item").cast("string").alias("item"), "score")
    return retrieve.combined(near, lex, k=50).select("item", F.round("score", 4).alias("score"))


@query("SELECT item, score FROM (VALUES ('a.orders', 1.0), ('a.orders_old', 9.0), ('a.parts', 2.0)) v(item, score) WHERE item NOT LIKE '%old' ORDER BY score DESC LIMIT 2")
def archive_filter(spark, sf):
    return retrieve.without_archives(spark.createDataFrame([("a.orders", 1.0), ("a.orders_old", 9.0), ("a.parts", 2.0)], "item string, score double"), 2)


@query(WITH + f"SELECT tbl AS table_key, col, CASE WHEN list_has_any({TOKENS.format('col')}, ['key', 'comment']) THEN 1.0 ELSE 0 END + CASE WHEN role IN ('key', 'comment') THEN 0.3 ELSE 0 END AS score FROM roles WHERE list_has_any({TOKENS.format('col')}, ['key', 'comment']) OR role = 'key'")
def find_columns(spark, sf):
    return retrieve.find_columns(engine(spark, sf).profiles, "key comment", 1000).select(F.col("table").alias("table_key"), F.col("column").alias("col"), "score")


@query("SELECT sum(n) AS total, avg(n) AS mean, max(n) AS most, count(*) AS tables FROM (" + " UNION ALL ".join(f"SELECT least(count(*), 50) AS n FROM {t}" for t in NUMERIC) + ")")
def sample_coverage(spark, sf):
    return profile.coverage(engine(spark, sf).profiles)


@query()
def find_tables(spark, sf):
    return engine(spark, sf).scores("orders of customers by segment", "combo", 8)


# plans

TABLES = ["main.lineitem", "main.orders", "main.customer", "main.part"]


def _plan(spark, sf, request="total price of orders by customer", tables=("main.orders", "main.customer", "main.lineitem"), **kw):
    return engine(spark, sf).meta.plan(request, list(tables), **kw)


@query("SELECT s.l_quantity, s.l_shipdate, p.p_size IS NULL AS no_part FROM lineitem s LEFT JOIN part p ON s.l_partkey = p.p_partkey WHERE FALSE UNION ALL SELECT l_quantity, l_shipdate, FALSE FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def draft_sql(spark, sf):
    p = _plan(spark, sf, "quantity by part", ("main.lineitem", "main.part"))
    df = execute.prepared(spark, p.draft_sql)
    return df.select("l_quantity", "l_shipdate", F.lit(False).alias("no_part"))


@query("SELECT count(*) AS count FROM region")
def count_fallback(spark, sf):
    p = engine(spark, sf).meta.plan("how many region rows", ["main.region", "main.pages"])
    return execute.prepared(spark, p.draft_sql)


@query("SELECT round(sum(o_totalprice), 2) AS total FROM orders")
def typical_sum(spark, sf):
    q = engine(spark, sf).meta.typical_queries("main.orders")[0]
    return execute.prepared(spark, q).select(F.round("total", 2).alias("total"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")
def typical_date_range(spark, sf):
    q = engine(spark, sf).meta.typical_queries("main.orders")[1].replace(":date_from", "TIMESTAMP '1997-01-01 00:00:00'")
    return execute.prepared(spark, q).select("o_orderkey")


@query("SELECT c_name FROM customer WHERE c_custkey = 42")
def typical_pk_lookup(spark, sf):
    q = engine(spark, sf).meta.typical_queries("main.customer")[-1].replace(":value", "42")
    return execute.prepared(spark, q).select("c_name")


@query("SELECT * FROM (VALUES (200, TRUE)) v(n, truncated)")
def row_cap(spark, sf):
    r = engine(spark, sf).execute_query("SELECT * FROM lineitem")
    return spark.createDataFrame([(len(r.rows), r.truncated)], "n int, truncated boolean")


@query(f"WITH {EDGES} SELECT src AS from_table, dst AS to_table, src_col || '=' || dst_col AS pairs FROM edges WHERE src = 'main.lineitem' AND dst IN ('main.orders', 'main.part') UNION ALL SELECT dst, src, dst_col || '=' || src_col FROM edges WHERE src = 'main.orders' AND FALSE UNION ALL SELECT src, dst, src_col || '=' || dst_col FROM edges WHERE src = 'main.orders'")
def join_plan(spark, sf):
    p = _plan(spark, sf, "lines", TABLES)
    return spark.createDataFrame([(s.from_table, s.to_table, ",".join(f"{a}={b}" for a, b in s.pairs)) for s in p.join_plan], "from_table string, to_table string, pairs string")


@query(WITH + "SELECT e.src AS from_table, e.dst AS to_table, CAST(round(CASE WHEN 'main.lineitem' IN (e.src, e.dst) THEN 1.0 ELSE 0 END + CASE WHEN a.archetype = 'fact' AND b.archetype = 'dimension' THEN 0.2 ELSE 0 END - CASE WHEN a.archetype = 'dimension' AND b.archetype = 'dimension' THEN 0.2 ELSE 0 END + CASE WHEN 'main.customer' IN (e.src, e.dst) THEN 0.2 ELSE 0 END, 6) AS DOUBLE) AS score FROM edges e JOIN flags a ON a.tbl = e.src JOIN flags b ON b.tbl = e.dst WHERE e.src IN ('main.lineitem', 'main.orders', 'main.customer', 'main.part') AND e.dst IN ('main.lineitem', 'main.orders', 'main.customer', 'main.part')")
def join_examples(spark, sf):
    found = engine(spark, sf).meta.join_examples(TABLES, "main.lineitem", 100, "partkey of a customer")
    return spark.createDataFrame([(x["from_table"], x["to_table"], float(x["score"])) for x in found], "from_table string, to_table string, score double")


@query(WITH + "SELECT tbl AS table_key, col, CASE role WHEN 'date' THEN '>=,<=,BETWEEN' ELSE '>=,<=,>,<' END AS operators FROM roles WHERE tbl IN ('main.lineitem', 'main.orders') AND role IN ('date', 'metric')")
def filter_candidates(spark, sf):
    found = [x for x in engine(spark, sf).meta.filters(["main.lineitem", "main.orders"], 100) if x["operators"][0] != "="]
    return spark.createDataFrame([(x["table"], x["column"], ",".join(x["operators"])) for x in found], "table_key string, col string, operators string")


@query(WITH + "SELECT tbl || '.' || col AS col FROM roles WHERE (tbl = 'main.lineitem' AND role = 'date') OR (tbl = 'main.part' AND role = 'category')")
def group_by_candidates(spark, sf):
    return spark.createDataFrame([(x,) for x in engine(spark, sf).meta.group_by("main.lineitem", ["main.part"])], "col string")


@query(WITH + "SELECT tbl AS table_key FROM flags WHERE tbl IN ('main.lineitem', 'main.orders', 'main.customer', 'main.part') ORDER BY CASE WHEN n_metrics > 0 THEN 2.0 ELSE 0 END + CASE WHEN n_dates > 0 THEN 1 ELSE 0 END + CASE WHEN archetype = 'fact' THEN 1.5 ELSE 0 END + 0.3 * centrality DESC, tbl LIMIT 1")
def main_table(spark, sf):
    return spark.createDataFrame([(engine(spark, sf).meta.main_table(TABLES, "zzz"),)], "table_key string")


@query()
def plan_summary(spark, sf):
    p = engine(spark, sf).plan_query_for_intent("quantity of lineitem by part", full_detail=True, approach="lexical")
    return spark.createDataFrame([(p.main_table, p.draft_sql, p.status, p.confidence, len(p.relevant_tables))], "main_table string, draft_sql string, status string, confidence double, tables int")


@query()
def database_overview(spark, sf):
    o = engine(spark, sf).get_database_overview()
    return spark.createDataFrame([(o["database_name"], o["total_tables"], ",".join(o["most_important_tables"]), ",".join(o["common_patterns"]))], "name string, tables int, important string, patterns string")


def _cue_sql() -> str:
    s = "lower(x)"
    has = lambda words, raw: " OR ".join(f"contains({'x' if raw else s}, '{w}')" for w in words)
    out = []
    for d in sqltools.DIALECTS:
        parts = [f"CASE WHEN {has(words, False)} THEN {points[d]} ELSE 0 END" for words, points in sqltools.CUES if d in points]
        if d == "snowflake":
            parts.append(f"CASE WHEN contains({s}, '::') AND contains({s}, ' ilike ') THEN 1 ELSE 0 END")
        out.append(f"CAST({' + '.join(parts) or '0'} AS INTEGER) AS {d}_score")
    return f"SELECT x, {', '.join(out)} FROM (VALUES {quoted(SQL_TEXTS)}) v(x)"


@query(_cue_sql())
def dialect_cues(spark, sf):
    rows = [(x, *(sqltools.cues(x)[d] for d in sqltools.DIALECTS)) for x in SQL_TEXTS]
    return spark.createDataFrame(rows, "x string, " + ", ".join(f"{d}_score int" for d in sqltools.DIALECTS))


@query()
def name_entities(spark, sf):
    from ..operators.ner import Gazetteer

    return Gazetteer(spark).tag(engine(spark, sf).profiles.select("table", "column"), "column").select("table", "column", F.array_join("labels", ",").alias("labels"))


def _pass(text: str):
    return lambda spark, sf: (catalog(spark, sf), execute.prepared(spark, text))[1]


for _name, _text in passthrough.QUERIES.items():
    QUERIES[_name], SQL[_name] = _pass(_text), _text
for _name, (_text, _meaning) in (passthrough.WORDED | passthrough.DIALECTS).items():
    QUERIES[_name], SQL[_name] = _pass(_text), _meaning


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request in words to rows: retrieve, plan, draft, guard, run."""
    p = engine(spark, sf_dir).plan_query_for_intent("quantity of lineitem by part", full_detail=True, approach="lexical")
    return execute.prepared(spark, p.draft_sql)


__all__ = ["QUERIES", "SQL", "flagship", "engine", "planner"]
