"""Blocks and classes of like rows: what they stand for, and that pairs are neither built nor left to one task where rows are alike."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cellsift import detection, queries
from cellsift.operators import pairs, selection
from cellsift.plans import strategy
from cellsift.plans.constraints import STRING, dependency, equal
from cellsift.sources.tables import IDX
from tests import plain
from tests.test_detection import DDS, KINDS, TAUS, chances, frame, table

MANY = 400_000
DATA = Path("/root/testdata/sf0.001")
#: Queries whose frequent keys were one task's work.
DEALT = ["violations_nulls", "violations_fd", "clusters_refined", "delta_violations", "violations_fuzzy", "delta_clusters", "delta_violations_several", "hyper_edges", "violations_no_le"]


def alike(spark, size=MANY):
    """Two groups of two classes; all pairs of them are tens of thousands of millions."""
    return spark.range(size).select(F.col("id").alias(IDX), F.concat(F.lit("g"), F.col("id") % 2).alias("a"), F.concat(F.lit("v"), F.floor(F.col("id") / 2) % 2).alias("b"), F.lit(0).cast("long").alias("n"))


def made_up(df):
    """Row 0 alone is low in `b`, none in `a`; the greatest is the last."""
    return df.select(IDX, F.lit(0.9).alias("a"), (F.when(F.col(IDX) == 0, 0.01).otherwise(0.3) + F.col(IDX) / 1e8).alias("b"))


@pytest.mark.parametrize("seed", [21, 22])
@pytest.mark.parametrize("n_old", [None, 20])
def test_classes_give_the_errors_of_pairs(spark, seed, n_old):
    rows = table(seed, 26)
    df = frame(spark, rows)
    p, wide = chances(spark, seed, rows)
    expected = plain.violations(rows, DDS, KINDS, n_old)
    for fallback in ("first", "edge"):
        for k, d in enumerate(DDS):
            found = {(0, i, j) for x, i, j in expected if x == k}
            got = selection.class_errors(df, d, KINDS, wide, TAUS, fallback, n_old)
            assert {tuple(r) for r in got.collect()} == plain.errors(found, [d], p, TAUS, fallback), (d, fallback)


@pytest.mark.parametrize(("fallback", "strategy"), [("edge", "auto"), ("first", "pairs"), ("edge", "pairs")], ids=["f4", "f8", "f4-pairs"])
def test_errors_of_like_rows_need_no_pairs(spark, fallback, strategy):
    df = alike(spark)
    found = detection.detect(df, [equal("a", "b")], TAUS | {"b": 0.02}, {"a": STRING, "b": STRING}, made_up(df), fallback=fallback, strategy=strategy)
    missed = df.join(found.withColumnRenamed("idx", IDX), IDX, "left_anti")
    assert found.where("attr = 'b'").count() == found.count() and {r[IDX] for r in missed.collect()} <= set(range(MANY - 4, MANY))


def test_a_report_spells_no_pairs_out_f2(spark):
    df = alike(spark)
    row = detection.report(df, df, [equal("a", "b")], TAUS, KINDS, made_up(df)).first()
    assert "covered" in row.Coverage and row.ClusterTime > 0 and row.FindVioPairsTime > 0
    folded = pairs.folded_violations(df, [equal("a", "b")], KINDS)
    assert folded.count() < 500_000 and folded.agg(F.sum("n")).first()[0] == 2 * (MANY // 4) ** 2
    clusters = pairs.folded_clusters(df, [equal("a", "b")], KINDS).groupBy("attr").agg(F.sum("n").alias("n"))
    assert {r.attr: r.n for r in clusters.collect()} == dict.fromkeys("ab", 2 * (MANY // 2) * (MANY // 2 - 1) // 2)


def test_a_delta_of_like_rows_is_compared_by_classes_f3(spark):
    df = alike(spark)
    dd = dependency({"a": ("<=", 1.0)}, ("b", ("<=", 0.0)))
    base, delta = df.where(F.col(IDX) < MANY // 2), df.where(F.col(IDX) >= MANY // 2)
    found = detection.detect_delta(base, delta, [dd], TAUS, KINDS, made_up(df), MANY // 2)
    assert found.where("idx = 0").first().attr == "b" and found.where(F.col("idx") >= MANY - 2).count() == 0


@pytest.mark.parametrize("seed", [24, 25])
def test_groups_give_the_edge_fallback(spark, seed):
    rows = table(seed, 40)
    df = frame(spark, rows)
    p, wide = chances(spark, seed, rows)
    for d in (equal("a", "b"), equal(["n", "a"], "b"), dependency({"n": ("<=", 0.0)}, ("b", (">", 0.0)))):
        got = detection.detect(df, [d], TAUS, KINDS, wide, fallback="edge")
        assert {tuple(r) for r in got.collect()} == plain.errors(plain.violations(rows, [d], KINDS), [d], p, TAUS, "edge"), d


@pytest.mark.parametrize("size", [1, 3])
def test_large_blocks_are_spelt_out_whole(spark, monkeypatch, size):
    monkeypatch.setattr(pairs, "SPAN", 16)
    monkeypatch.setattr(pairs, "SIZE", size)
    monkeypatch.setattr(pairs, "LARGE", 2)
    rows = table(23, 40)
    dds = [DDS[0], DDS[3], DDS[6], DDS[7]]
    for n_old in (None, 30):
        got = [tuple(r) for r in pairs.violations(frame(spark, rows), dds, KINDS, n_old).collect()]
        assert len(got) == len(set(got)) and set(got) == plain.violations(rows, dds, KINDS, n_old)


def dealt(df):
    """Whether the plan deals pairs of blocks to tasks after a join."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "RepartitionByExpression [lid" in plan and "Join" in plan.split("RepartitionByExpression [lid")[1]


def test_pairs_of_a_frequent_key_are_dealt_to_tasks_f1(spark):
    df = alike(spark, 400).withColumn("a", F.when(F.col(IDX) % 5 != 0, F.col("a"))).withColumn("b", F.when(F.col(IDX) % 7 != 0, F.col("b")))
    found = pairs.violations(df, [equal("a", "b"), equal("b", "a")], KINDS)
    assert dealt(found)
    rows = {r[IDX]: r.asDict() for r in df.collect()}
    assert {tuple(r) for r in found.collect()} == plain.violations(rows, [equal("a", "b"), equal("b", "a")], KINDS)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", DEALT)
def test_queries_deal_frequent_keys(spark, name):
    assert dealt(queries.QUERIES[name](spark, str(DATA)))


def test_few_new_rows_a_key_are_dealt_with_their_base_f10_f11(spark):
    """50 keys of 48 rows in the base and 12 in the delta."""
    df = spark.range(3000).select(F.col("id").alias(IDX), F.concat(F.lit("k"), F.col("id") % 50).alias("a"), F.lit(0).alias("n"))
    found = pairs.clusters(df, [equal([], "a")], {"a": STRING}, 2400).groupBy(F.spark_partition_id().alias("task")).count().collect()
    total = sum(r["count"] for r in found)
    assert total == 50 * (12 * 48 + 12 * 11 // 2) and max(r["count"] for r in found) < total // 2


def test_neighbouring_strings_are_found_once_and_by_many_tasks_f6_f9(spark):
    """Names that share all but their ends meet on the same segments."""
    df = spark.range(120).select(F.col("id").alias(IDX), F.format_string("name#%04d", F.floor(F.col("id") / 2)).alias("a"), F.col("id").alias("n"))
    dd = dependency({"a": ("<=", 1.0)}, ("n", ("<=", 0.0)))
    met = pairs.meeting(pairs.blocks(pairs.keyed(df, [*dd.left, dd.right], KINDS)), dd.left, KINDS)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3 and "RepartitionByExpression [k" in plan
    found = pairs.violations(df, [dd], KINDS)
    rows = {r[IDX]: r.asDict() for r in df.collect()}
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain.violations(rows, [dd], KINDS))
    executed = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("levenshtein(" in x and " AS dist#" in x for x in executed.splitlines()) == 1


def test_rows_of_keys_far_apart_share_blocks_f13(spark):
    """Each _idx is thousands of millions from the next."""
    df = alike(spark, 600).withColumn(IDX, F.col(IDX) * 5_000_000_000)
    dd = dependency({"a": (">", 0.0)}, ("b", ("<=", 0.0)))
    assert pairs.blocks(pairs.keyed(df, [*dd.left, dd.right], KINDS)).count() == 4
    rows = {r[IDX]: r.asDict() for r in df.collect()}
    got = [tuple(r) for r in pairs.violations(df, [dd], KINDS).collect()]
    assert len(got) == len(set(got)) and set(got) == plain.violations(rows, [dd], KINDS)


@pytest.mark.parametrize("span", [16, 1 << 20])
def test_lots_are_the_same_on_both_sides_f13(spark, monkeypatch, span):
    monkeypatch.setattr(pairs, "SPAN", span)
    rows = {k * 7_000_000: r for k, r in table(26, 40).items()}
    for n_old in (None, 30 * 7_000_000):
        got = [tuple(r) for r in pairs.violations(frame(spark, rows), DDS, KINDS, n_old).collect()]
        assert len(got) == len(set(got)) and set(got) == plain.violations(rows, DDS, KINDS, n_old)


def test_pairs_are_spelt_out_in_two_chains_f5_f7(spark):
    """Between the steps from blocks to rows and from rows to pairs stands the union, so that no chain holds all pairs of two blocks."""
    df = alike(spark, 400)
    for n_old in (None, 300):
        plan = pairs.violations(df, [equal("a", "b")], KINDS, n_old)._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan.split("Union", 1)
        assert "Generate explode(rids" in above and "Generate explode(rids" not in below and below.count("Generate explode(lids") == 2


def test_cells_of_pairs_come_from_a_constant_f12(spark):
    df = alike(spark, 40)
    found = pairs.hyper_edges(pairs.violations(df, [equal("a", "b")], KINDS), [equal("a", "b")])
    generators = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in x]
    assert "explode([" in generators[0] and found.columns == ["dd_id", "i", "j", "pos", "idx", "attr"]
    rows = {r[IDX]: r.asDict() for r in df.collect()}
    expected = [(*v, 2 * p + s, v[1 + s], n) for v in plain.violations(rows, [equal("a", "b")], KINDS) for p, n in enumerate("ab") for s in range(2)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_pairs_of_many_rows_are_dealt_to_more_tasks_f7(spark, monkeypatch):
    """Pairs grow faster than rows, so a fixed number of tasks would be ever longer ones."""
    df = alike(spark, 400)
    expected = plain.violations({r[IDX]: r.asDict() for r in df.collect()}, [equal("a", "b")], KINDS, 300)
    few = strategy.tasks(spark)
    for rows, most, n in ((2, 1000, 200), (1, 5, 5 * spark.sparkContext.defaultParallelism), (401, 1000, few)):
        monkeypatch.setattr(strategy, "ROWS", rows)
        monkeypatch.setattr(strategy, "MOST", most)
        found = pairs.violations(df, [equal("a", "b")], KINDS, 300)
        dealt_to = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression [lid" in x]
        assert len(dealt_to) == 1 and f", {n}" in dealt_to[0]
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == expected
