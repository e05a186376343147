"""How often a query reads its input and its intermediate tables: work that Spark would otherwise repeat for each use."""

from __future__ import annotations

from pathlib import Path

import pytest

from tideblock import scratch
from tideblock.functions import quoting
from tideblock.operators.asof import Ask, Source, asof, lookups
from tideblock.plans import all_queries
from tideblock.sources import events as ev

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables that are written on the way, by label."""
    plans, keep = [], scratch.keep

    def noted(df, label="table"):
        plans.append((label, plan(df)))
        return keep(df, label)

    monkeypatch.setattr(scratch, "keep", noted)
    return plans


def reads(plans, df, folder: str) -> int:
    """Scans of the table ``events`` in all plans of a query."""
    return sum(p.count(f"{folder}/events.parquet") for _, p in plans) + plan(df).count(f"{folder}/events.parquet")


def _paths(spark, *labels):
    """The last written table of each label."""
    folder = Path(scratch.folder(spark))
    return [str(max(folder.glob(f"{label}-*"), key=lambda p: p.stat().st_mtime_ns)) for label in labels]


def _quotes(spark, path):
    rows = [("a", t, t % 3, float(t)) for t in range(0, 50, 2)]
    spark.createDataFrame(rows, "k string, t bigint, id bigint, x double").write.parquet(path)
    return spark.read.parquet(path)


def test_asof_reduces_its_quotes_once(spark, tmp_path):
    quotes = _quotes(spark, f"{tmp_path}/quotes")
    probes = spark.createDataFrame([("a", 5), ("a", 8), ("b", 1)], "k string, at bigint")
    out = asof(probes, quotes, ["k"], at="at", quote_at="t", payload=["x"], ties=["id"], bucket_ms=4)
    assert not any("/quotes/" in f for f in out.inputFiles())
    assert {(r.k, r.at): r.quote and r.quote.x for r in out.collect()} == {("a", 5): 4.0, ("a", 8): 8.0, ("b", 1): None}


@pytest.mark.parametrize("asked", [["backward"], ["forward"], ["backward", "forward"]])
def test_lookups_reduce_their_quotes_once_and_in_the_directions_asked(spark, tmp_path, written, asked):
    quotes = _quotes(spark, f"{tmp_path}/quotes")
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", 5), ("a", 8), ("a", 60), ("b", 1)], "k string, at bigint")
    asks = {d: Ask("q", F.col("at"), d) for d in asked}
    out = lookups(rows, ["k"], asks, {"q": Source(quotes, "t", ["x"], ["id"])}, 4)
    assert not any("/quotes/" in f for f in out.inputFiles())
    reduced = dict(written)["instants"]
    assert ("max_by" in reduced, "min_by" in reduced) == ("backward" in asked, "forward" in asked)
    wanted = {"backward": {5: 4.0, 8: 8.0, 60: 48.0, 1: None}, "forward": {5: 6.0, 8: 8.0, 60: None, 1: None}}
    for d in asked:
        assert {r.at: r[d] and r[d].x for r in out.collect()} == wanted[d]


# The span of the runs, the fills, and one reduction of market, orders and decisions; for cohorts also the orders sent.
@pytest.mark.parametrize(
    "name, most",
    [("d34_order_match_quality", 5), ("d37_cohort_rates", 6), ("d44_status_counts", 5), ("a14_scan_run_reports", 5), ("d32_fill_decomp", 5)],
)
def test_each_log_is_read_once(spark, written, name, most):
    df = all_queries()[name].build(spark, SMALL)
    assert reads(written, df, SMALL) <= most


# The span of the runs, the fills, and the logs that the measures need.
@pytest.mark.parametrize("name, most", [("d32_fill_decomp", 4), ("d37_cohort_stats_by_bucket", 4), ("d28_d29_fill_edge_stats", 3)])
def test_fills_are_joined_to_the_logs_they_need_by_a_hashed_reduction(spark, written, name, most):
    df = all_queries()[name].build(spark, SMALL)
    assert reads(written, df, SMALL) <= most
    assert "HashAggregate" in (reduced := next(p for label, p in written if label == "instants")) and "SortAggregate" not in reduced


def test_fills_are_parsed_once_and_written_with_what_edges_read(spark, written):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")  # the runs' spans are smaller, the logs are not
    try:
        df = all_queries()["d28_d29_fill_edge_stats"].build(spark, SMALL)
    finally:
        spark.conf.set(name, before)
    probes = dict(written)["probes"]
    assert "SortMergeJoin" not in probes and probes.count("get_json_object") == 1
    columns = [set(spark.read.parquet(p).columns) for p in _paths(spark, "probes", "instants")]
    assert columns[0] == {"run_id", "time", "ts_ms", "side", "px", "sz", "fee", "out_of_run"}
    assert columns[1] == {"run_id", "_t", "_is_mid", "_probe", "_mid_0_backward", "_bucket"}
    assert "_row" not in dict(written)["chunks"] and df.count() > 0


def test_one_question_is_joined_back_by_instant(spark, tmp_path, written):
    quotes = _quotes(spark, f"{tmp_path}/quotes")
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, "a", 5, "1"), (1, "a", 5, "1"), (2, "a", None, "1"), (3, "a", 5, None), (4, "b", 5, "1")], "i int, k string, at bigint, side string")
    one = lookups(rows, ["k"], {"q": Ask("q", F.col("at"))}, {"q": Source(quotes, "t", ["x"], ["id"])}, 4)
    assert "_row" not in plan(one) and one.columns == ["i", "k", "at", "side", "q"]
    assert {r.i: r.q and r.q.x for r in one.collect()} == {0: 4.0, 1: 4.0, 2: None, 3: 4.0, 4: None}
    keyed = lookups(rows, ["k"], {"q": Ask("q", F.col("at"), extra=F.col("side"))}, {"q": Source(quotes, "t", ["x"], ["id"], F.col("id"))}, 4)
    assert {r.i: r.q and r.q.x for r in keyed.collect()} == {0: 4.0, 1: 4.0, 2: None, 3: None, 4: None}


def test_fills_are_counted_once_for_all_cohort_flags(spark, written):
    all_queries()["d37_cohort_stats_by_bucket"].build(spark, SMALL)
    fills, counted = [spark.read.parquet(p) for p in _paths(spark, "fills", "chunks")]
    matched = fills.filter("order_match = 'matched' AND edge_bps IS NOT NULL").count()
    assert 0 < counted.selectExpr("sum(_n)").first()[0] <= 2 * matched


def test_sources_without_a_further_key_share_their_instants(spark, tmp_path, written):
    quotes = _quotes(spark, f"{tmp_path}/quotes")
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", 5, "0"), ("a", 9, None)], "k string, at bigint, side string")
    ties = quotes.select("k", F.lit(4).cast("bigint").alias("t"), F.lit(None).cast("bigint").alias("id"), F.lit(-1.0).alias("x"))
    sources = {"q": Source(quotes.unionByName(ties), "t", ["x"], ["id"]), "p": Source(quotes, "t", ["id"], ["id"]), "s": Source(quotes, "t", ["x"], ["id"], F.col("id"))}
    asks = {"q": Ask("q", F.col("at")), "next": Ask("q", F.col("at") - 1, "forward"), "p": Ask("p", F.col("at")), "s": Ask("s", F.col("at"), extra=F.col("side"))}
    out = {r.at: r for r in lookups(rows, ["k"], asks, sources, 4).collect()}
    assert [label for label, _ in written] == ["probes", "instants", "instants"]
    # A tie without a number counts as the smallest: the last of an instant never, the first always.
    assert (out[5].q.x, out[5].p.id, out[5].s.asDict()) == (4.0, 1, {"x": 0.0, "at_ms": 0})
    assert (out[5].next.x, out[9].q.x, out[9].s) == (-1.0, 8.0, None)
    with pytest.raises(ValueError):
        lookups(rows, ["k"], {"s": Ask("s", F.col("at"))}, sources)


def test_quotes_of_few_variants_carry_no_parameter_columns(spark, written):
    out = plan(all_queries()["b14_quote_whatif"].build(spark, SMALL))
    assert "p_pull_size_factor" not in out and "Generate" not in out
    assert [label for label, _ in written].count("states") == 1


def test_quotes_of_few_and_many_variants_agree(spark, monkeypatch):
    few = all_queries()["b14_quote_whatif"].build(spark, SMALL)
    monkeypatch.setattr(quoting, "FEW", 0)
    many = all_queries()["b14_quote_whatif"].build(spark, SMALL)
    assert few.columns == many.columns and few.count() == many.count() > 0
    assert few.exceptAll(many).isEmpty()


def test_flow_markout_reads_mids_fills_and_features_once(spark, written):
    df = all_queries()["c12_d22_flow_markout"].build(spark, SMALL)
    assert reads(written, df, SMALL) <= 3
    assert [label for label, _ in written].count("instants") == 1


def test_scanned_rows_are_spread_before_they_are_sorted_for_deduplication(spark):
    rows = spark.createDataFrame([(f"k{i % 7}", i, 1000 - i, "f", f"e{i}") for i in range(1000)], "dedupe_key string, line bigint, recv_ts_ms bigint, source_file string, event_id string")
    out = ev.dedupe(rows.coalesce(1))  # one file that can't be split
    lines = plan(out).splitlines()
    first_sort = max(i for i, text in enumerate(lines) if "Sort [" in text)
    assert any("Exchange hashpartitioning(line" in text for text in lines[first_sort:])
    assert {(r.dedupe_key, r.line) for r in out.collect()} == {(f"k{i % 7}", i) for i in range(993, 1000)}
