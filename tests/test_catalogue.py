"""Queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from telemill import registry
from telemill.functions.scalars import DAY
from telemill.plans import views as V

SF = "/root/testdata/sf0.001"
END = (1 << 63) - 1
SOME = ("tick_sessions", "process_births", "connection_completed", "file_changed_coalesced", "asof_enrichment", "socket_fold", "components", "merge_edges", "top_endpoints", "capped_flags", "metric_baseline", "fmt_duration", "ewma", "frontmost_overlap", "store_rows_of_graph", "graph_of_store", "node_labels_of_things", "enriched_events", "graph_facts", "graph_candidates")


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    a = sorted((tuple(show(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(show(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert a == b and a


@pytest.fixture(scope="module")
def far_tables(spark, tmp_path_factory):
    """Tables with part keys whose day is beyond the last one that ns have: brand A has one from key 5 on, brand B only such, brand C none."""
    d = str(tmp_path_factory.mktemp("far"))
    at = lambda *days: [V.EPOCH // 10**9 + x * 86400 for x in days]  # noqa: E731  days since 1995
    tables = {
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"c{i}", 0, 0.0, "m") for i in (5, 10, 50)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(i, c, "O", 1.0, t, "5") for i, (c, t) in enumerate(zip((5, 5, 10, 50), at(0, 2200, 2195, 10), strict=True))], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, t long, o_orderpriority string"),
        "part": ([(k, "p", b, "t", 1, 1.0) for k, b in ((5, "A"), (200_000, "A"), (150_000, "B"), (10, "C"), (50, "C"))], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "events": ([(0, t, 1, "click", 1.0, '{"k": 1}') for t in at(0)], "event_id long, t long, user_id long, event_type string, value double, props string"),
    }
    for name, (rows, schema) in tables.items():
        f = spark.createDataFrame(rows, schema)
        if "t" in f.columns:
            f = f.withColumn("o_orderdate" if name == "orders" else "ts", F.timestamp_seconds("t")).drop("t")
        f.write.parquet(f"{d}/{name}.parquet")
    return d


def wide(name, d):
    """Rows of a query's SQL, with the domains' times computed beyond a long and held at its end."""
    sql = registry.oracle_sql()[name]
    for f in ("min", "max"):
        time = f"{V.EPOCH} + {f}(p_partkey) * {DAY}"
        assert time in sql
        sql = sql.replace(time, f"least({V.EPOCH}::hugeint + {f}(p_partkey)::hugeint * {DAY}, {END})::bigint")
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}/*.parquet'")
    return con.sql(sql)


def test_pruning_beyond_the_last_time(spark, far_tables):
    """Too old are the process of customer 50, two sockets and C; edges from or to them; two orders."""
    got = [tuple(r) for r in registry.queries()["prune_report"](spark, far_tables).collect()]
    assert got == [(4, 5, 2)] == wide("prune_report", far_tables).fetchall()


def test_summary_beyond_the_last_time(spark, far_tables):
    got = sorted(tuple(r) for r in registry.queries()["store_summary"](spark, far_tables).collect())
    assert got == sorted(wide("store_summary", far_tables).fetchall()) and {("span", "first", V.EPOCH), ("span", "last", END), ("nodes", "domain", 3)} <= set(got)


def test_window_edges_beyond_the_last_time(spark, far_tables):
    got = sorted(tuple(r) for r in registry.queries()["window_edges"](spark, far_tables).collect())
    assert got == sorted(wide("window_edges", far_tables).fetchall()) and ("queried_domain", "5:0", "a.example") in got


def test_window_nodes_beyond_the_last_time(spark, far_tables):
    """A domain whose first time is beyond the last one isn't in the window, one whose last time is may be."""
    got = sorted(tuple(r) for r in registry.queries()["window_nodes"](spark, far_tables).collect())
    assert got == sorted(wide("window_nodes", far_tables).fetchall()) and [i for k, i in got if k == "domain"] == ["a.example"]
