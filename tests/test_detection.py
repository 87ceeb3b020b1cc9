import random

import pytest
from pyspark.sql import functions as F

from cellsift import detection
from cellsift.functions.values import strip
from cellsift.operators import distances, evaluation, grouped, pairs, probability, selection
from cellsift.plans.constraints import INT, STRING, Atom, dependency, equal, parse_dependencies, parse_thresholds, threshold_index, validate
from cellsift.plans.strategy import ALL, EMPTY, EQUALITY, FUZZY, choose, groups_suffice
from cellsift.sources.tables import IDX, read_csv, with_index, write_csv
from cellsift.streaming.incremental import AppendOnly
from tests import plain

KINDS = {"a": STRING, "b": STRING, "n": INT}
SCHEMA = "_idx long, a string, b string, n long"


def table(seed, size):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "x", "x ", "y", "xy", "x y", "\tz", "é", "abc", "abd"])
    return {i: {"a": text(), "b": text(), "n": rng.choice([None, 0, 1, 2, 5])} for i in range(size)}


def frame(spark, rows):
    return spark.createDataFrame([(i, r["a"], r["b"], r["n"]) for i, r in rows.items()], SCHEMA)


def chances(spark, seed, rows, names=("a", "b", "n")):
    rng = random.Random(seed)
    p = {i: {n: rng.choice([None, 0.05, 0.2, 0.2, 0.5, 0.9]) for n in names} for i in rows}
    wide = spark.createDataFrame([(i, *(p[i][n] for n in names)) for i in rows], "_idx long, " + ", ".join(f"{n} double" for n in names))
    return p, wide


DDS = [
    equal("a", "b"), equal(["a", "n"], "b"), dependency({"n": ("<=", 0.0)}, ("a", (">", 0.5))), dependency({"a": ("<=", 1.0)}, ("b", ("<=", 1.0))), dependency({"n": ("<=", 1.0)}, ("a", ("<=", 0.0))),
    dependency({"a": ("<=", 0.0), "n": (">", 1.0)}, ("b", ("<=", 0.0))), dependency({"n": (">", 1.0)}, ("b", ("<=", 2.0))), dependency({}, ("b", ("<=", 0.0))), dependency({"a": ("<=", -1.0)}, ("b", ("<=", 0.0))),
    dependency({"a": ("<=", 2.0), "n": ("<=", 2.0)}, ("b", (">", 1.0))),
]
TAUS = {"a": 0.1, "b": 0.3, "n": 0.1}


@pytest.mark.parametrize("seed", [1, 2])
def test_violations_and_errors_match_a_pairwise_evaluator(spark, seed):
    rows = table(seed, 26)
    df = frame(spark, rows)
    found = pairs.violations(df, DDS, KINDS)
    expected = plain.violations(rows, DDS, KINDS)
    assert {tuple(r) for r in found.collect()} == expected
    late = pairs.violations(df, DDS, KINDS, 20)
    assert {tuple(r) for r in late.collect()} == plain.violations(rows, DDS, KINDS, 20)
    p, wide = chances(spark, seed, rows)
    for fallback in ("first", "edge"):
        got = selection.select_errors(found, DDS, wide, TAUS, fallback)
        assert {tuple(r) for r in got.collect()} == plain.errors(expected, DDS, p, TAUS, fallback)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_groups_give_what_pairs_give(spark, seed):
    rows = table(seed, 40)
    df = frame(spark, rows)
    dds = [equal("a", "b"), equal(["n", "a"], "b"), equal("n", "a"), dependency({"n": ("<=", 0.0)}, ("b", (">", 0.0)))]
    assert all(map(groups_suffice, dds))
    expected = plain.violations(rows, dds, KINDS)
    counts = {r.dd_id: r.n for r in grouped.pair_counts(df, dds, KINDS).collect()}
    assert counts == {k: sum(x[0] == k for x in expected) for k in range(len(dds))}
    p, wide = chances(spark, seed, rows)
    for k, d in enumerate(dds):
        got = grouped.error_cells(df, [d], KINDS, wide, TAUS)
        assert {tuple(r) for r in got.collect()} == plain.errors({(0, i, j) for x, i, j in expected if x == k}, [d], p, TAUS), d


def test_delta_adds_up_to_the_whole(spark):
    rows = table(6, 30)
    df = frame(spark, rows)
    dds = [equal("a", "b"), dependency({"n": ("<=", 1.0)}, ("b", ("<=", 0.0)))]
    _, wide = chances(spark, 6, rows)
    base, delta = df.where("_idx < 20"), df.where("_idx >= 20")
    both = detection.detect_incremental(base, delta, dds, TAUS, KINDS, wide, 20)
    assert set(both.collect()) == set(detection.detect(df, dds, TAUS, KINDS, wide).collect())
    nothing = detection.detect_delta(df, df.where("false"), dds, TAUS, KINDS, wide, 30)
    assert nothing.count() == 0


def test_a_delta_must_follow_its_base(spark):
    df = frame(spark, table(6, 12))
    _, wide = chances(spark, 6, range(12))
    with pytest.raises(ValueError, match="begin at 9"):
        detection.detect_delta(df.where("_idx < 9"), df.where("_idx >= 8"), [equal("a", "b")], TAUS, KINDS, wide, 9)


def test_rows_without_probabilities_are_partners_like_any(spark):
    """Of unknown probability, by groups and by pairs: never an error themselves, but their partners may be."""
    rows = {0: {"a": "x", "b": "1", "n": 0}, 1: {"a": "x", "b": "2", "n": 0}, 2: {"a": "x", "b": "3", "n": 0}}
    df = frame(spark, rows)
    p, wide = {0: {"a": 0.9, "b": 0.05}, 1: {"a": 0.9, "b": 0.5}, 2: {"a": None, "b": None}}, spark.createDataFrame([(0, 0.9, 0.05), (1, 0.9, 0.5)], "_idx long, a double, b double")
    dds = [equal("a", "b")]
    expected = plain.errors(plain.violations(rows, dds, KINDS), dds, p, TAUS)
    for strategy in ("auto", "pairs"):
        assert {tuple(r) for r in detection.detect(df, dds, TAUS, KINDS, wide, strategy=strategy).collect()} == expected == {(0, "b"), (1, "b")}


def test_stream_scores_rows_as_they_arrive(spark, tmp_path):
    rows = {0: {"a": "x", "b": "1", "n": 0}, 1: {"a": "x", "b": "2", "n": 0}, 2: {"a": "x", "b": "3", "n": 0}, 3: {"a": "y", "b": "3", "n": 0}}
    df = frame(spark, rows)
    scored = lambda old, new: old.unionByName(new).select(IDX, F.lit(0.9).alias("a"), (0.05 + 0.1 * F.col(IDX)).alias("b"))
    fixed = scored(df.where("_idx < 2"), df.where("false"))
    for name, wide, expected in (("live", scored, {(0, "b"), (1, "b")}), ("fixed", fixed, {(0, "b"), (1, "b")})):
        sink = AppendOnly(str(tmp_path / f"rows-{name}"), str(tmp_path / f"errors-{name}"), [equal("a", "b")], {"a": 0.1, "b": 0.1}, KINDS, wide)
        sink(df.where("_idx < 2"), 0)
        sink(df.where("_idx >= 2"), 1)
        errors = spark.read.parquet(str(tmp_path / f"errors-{name}"))
        assert {tuple(r) for r in errors.select("idx", "attr").distinct().collect()} == expected, name
        assert errors.where("batch = 1").count() == 2  # rows 0 and 1 again, which row 2 contradicts


def test_index_is_dense_in_order_and_without_python(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).where("id % 3 != 0 or id > 600").withColumnRenamed("id", "v")
    got = with_index(df, start=5)
    assert [(r.v, r[IDX]) for r in got.collect()] == [(r.v, k + 5) for k, r in enumerate(df.collect())]
    assert "Python" not in got._jdf.queryExecution().toString()
    assert with_index(df.where("false")).count() == 0
    mixed = with_index(spark.range(500).withColumn("k", F.col("id") % 7).repartition(5, "k").groupBy("id").agg(F.max("k").alias("k")))
    assert sorted(r[IDX] for r in mixed.where("k > 2 or k < 2").collect()) == sorted(r[IDX] for r in mixed.collect() if r.k != 2) and sorted(r[IDX] for r in mixed.collect()) == list(range(500))


def test_stream_of_deltas_adds_up_to_the_whole(spark, tmp_path):
    rows = table(7, 24)
    df = frame(spark, rows)
    dds = [equal("a", "b")]
    _, wide = chances(spark, 7, rows)
    df.where("_idx < 10").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    df.where("_idx >= 10").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    sink = AppendOnly(str(tmp_path / "rows"), str(tmp_path / "errors"), dds, TAUS, KINDS, wide)
    for k in (0, 1, 1):  # a batch that is repeated changes nothing
        sink(spark.read.parquet(str(tmp_path / f"in/{k}")), k)
    got = spark.read.parquet(str(tmp_path / "errors")).select("idx", "attr").distinct()
    assert set(got.collect()) == set(detection.detect(df, dds, TAUS, KINDS, wide).collect())
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*"))
    other = AppendOnly(str(tmp_path / "rows2"), str(tmp_path / "errors2"), dds, TAUS, KINDS, wide)
    source.writeStream.foreachBatch(other).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert set(spark.read.parquet(str(tmp_path / "errors2")).select("idx", "attr").distinct().collect()) == set(got.collect())


@pytest.mark.parametrize("seed", [8, 9])
def test_joint_probability_matches_the_dense_formula(spark, seed, monkeypatch):
    rows = table(seed, 30)
    df = frame(spark, rows)
    for split in (None, lambda r, t, f: (f[:1], f[1:]), lambda r, t, f: (f, []), lambda r, t, f: ([], f)):
        if split:
            monkeypatch.setattr(probability, "_split", split)
        for target in ("a", "n"):
            got = {r[0]: r[1] for r in probability.joint_probability(df, target).collect()}
            expected = plain.joint(rows, target)
            assert got.keys() == expected.keys()
            assert all(abs(got[i] - expected[i]) < 1e-9 for i in got)


def test_marginal_probability_and_constant_columns(spark):
    df = spark.createDataFrame([(0, "x", "c"), (1, "x", "c"), (2, "y", "c"), (3, None, "c")], "_idx long, a string, c string")
    got = {r[0]: r[1] for r in probability.marginal_probability(df, "a").collect()}
    assert got == pytest.approx({0: 1.0, 1: 1.0, 2: 0.5, 3: 0.0})
    assert {r[1] for r in probability.marginal_probability(df, "c").collect()} == {None}
    assert {r[1] for r in probability.joint_probability(df, "c").collect()} == {1.0}
    assert probability.joint_probabilities(df.select(IDX, "a")).columns == [IDX]


def test_worked_example(spark):
    df = spark.createDataFrame([(0, "x", "1"), (1, "x", "2"), (2, "x", None), (3, "x ", "2")], "_idx long, a string, b string")
    wide = spark.createDataFrame([(0, 0.9, 0.05), (1, 0.9, 0.5), (2, 0.9, 0.3), (3, 0.9, 0.01)], "_idx long, a double, b double")
    taus = {"a": 0.1, "b": 0.1}
    for strategy in ("auto", "pairs"):
        assert {tuple(r) for r in detection.detect(df, [equal("a", "b")], taus, KINDS, wide, strategy=strategy).collect()} == {(0, "b"), (2, "b")}


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_neighbours_of_strings(spark, threshold):
    rng = random.Random(threshold)
    values = sorted({"".join(rng.choices("abé", k=rng.randint(0, 9))) for _ in range(120)})
    got = distances.neighbours(spark.createDataFrame([(v,) for v in values], "k string"), STRING, threshold)
    expected = {(min(x, y), max(x, y), d) for x in values for y in values if (d := plain.edit(x, y)) <= threshold}
    assert {(min(r[0], r[1]), max(r[0], r[1]), r[2]) for r in got.collect()} == expected
    assert got.count() == len(expected)


def test_neighbours_of_numbers_and_value_distances(spark):
    values = [-7, -3, -2, 0, 1, 4, 5, 9]
    got = distances.neighbours(spark.createDataFrame([(v,) for v in values], "k long"), INT, 3)
    assert {tuple(r) for r in got.collect()} == {(x, y, y - x) for x in values for y in values if 0 <= y - x <= 3}
    df = spark.createDataFrame([(0, " a b"), (1, "ab"), (2, None), (3, "b")], "_idx long, v string")
    assert {tuple(r) for r in distances.value_distances(df, {"v": STRING}).collect()} == {("v", "a b", "a b", 0), ("v", "a b", "ab", 0), ("v", "ab", "ab", 0), ("v", "a b", "b", 1), ("v", "ab", "b", 1), ("v", "b", "b", 0)}
    numbers = spark.createDataFrame([(0, "12.7"), (1, "12.1"), (2, "-3.9")], "_idx long, v string")
    assert {r.dist for r in distances.value_distances(numbers, {"v": INT}).collect()} == {0, 15}


def test_clusters_refine(spark):
    rows = table(10, 20)
    dds = [dependency({"a": ("<=", 2.0)}, ("n", ("<=", 1.0))), equal("a", "n")]
    got = {tuple(r) for r in pairs.clusters(frame(spark, rows), dds, KINDS).collect()}
    expected = {(x, t, i, j) for x, ts in threshold_index(dds).items() for t in ts for i in rows for j in rows if i < j and plain.within(Atom(x, "<=", t), KINDS, rows[i], rows[j])}
    assert got == expected


def test_difference_and_scores(spark):
    dirty = spark.createDataFrame([(0, "x ", None), (1, "y", "1"), (2, "", "2")], "_idx long, a string, b string")
    clean = spark.createDataFrame([(0, "x", ""), (1, "z", None), (2, None, "2")], "_idx long, a string, b string")
    truth = evaluation.difference(dirty, clean)
    assert {tuple(r) for r in truth.collect()} == {(1, "a"), (1, "b")}
    found = spark.createDataFrame([(1, "a"), (0, "a")], "idx long, attr string")
    row = evaluation.scores(found, truth).first()
    assert (row.tp, row.fp, row.fn, row.precision, row.recall, row.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert evaluation.scores(found.where("false"), truth.where("false")).first().f1 == 0
    with pytest.raises(ValueError):
        evaluation.difference(dirty, clean.where("_idx < 2"))
    with pytest.raises(ValueError):
        evaluation.difference(dirty, clean.drop("b"))
    pairs_ = spark.createDataFrame([(0, 1), (2, 3), (3, 4)], "i long, j long")
    missing = evaluation.uncovered(pairs_, spark.createDataFrame([(1, "a"), (4, "b")], "idx long, attr string"))
    assert {tuple(r) for r in missing.collect()} == {(2, 3)}
    assert "(2, 3)" in evaluation.coverage_message(missing) and "covered" in evaluation.coverage_message(missing.where("false"))


def test_strip_removes_what_python_strips(spark):
    texts = [f"{chr(c)}a {chr(c)}" for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B, 0x1F]] + ["", " ", "a"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t"))).collect()]
    assert got == [t.strip() for t in texts]


def test_constraints():
    dds = parse_dependencies("[({'b': ('<=', 0.0), 'a': ('>', 2)}, ('c', ('<=', 1.0)))]")
    assert [a.attr for a in dds[0].left] == ["b", "a"] and threshold_index(dds) == {"b": [0.0], "a": [2.0], "c": [1.0]}
    assert parse_thresholds("{'a': 0.1}") == {"a": 0.1}
    with pytest.raises(ValueError):
        parse_dependencies("__import__('os').getcwd()")
    with pytest.raises(ValueError):
        Atom("a", ">=", 0)
    with pytest.raises(ValueError):
        validate([equal("a", "b")], {"a": STRING}, ["a", "b"])
    with pytest.raises(ValueError):
        validate([equal("a", "b")], KINDS, ["a", "b"], {"a": 0.1})
    assert [choose(d.left)[0] for d in (DDS[0], DDS[3], DDS[6], DDS[8])] == [EQUALITY, FUZZY, ALL, EMPTY]


def test_degenerate_tables(spark):
    empty = frame(spark, {})
    _, wide = chances(spark, 0, {0: None})
    for rows in ({}, {0: {"a": "x", "b": "y", "n": 1}}, {i: {"a": None, "b": None, "n": None} for i in range(3)}):
        df = frame(spark, rows) if rows else empty
        for strategy in ("auto", "pairs"):
            assert detection.detect(df, [equal("a", "b"), equal("n", "b")], TAUS, KINDS, wide, strategy=strategy).count() == 0


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,v,w\n1,"a ""q"", b",NA\n2, x ,\n3,"two\nlines",nan\n')
    df = read_csv(spark, str(tmp_path / "in.csv"))
    assert [tuple(r) for r in df.collect()] == [("1", 'a "q", b', None), ("2", " x ", None), ("3", "two\nlines", None)]
    assert [r[IDX] for r in with_index(df).collect()] == [0, 1, 2]
    write_csv(df, str(tmp_path / "out"))
    assert set(read_csv(spark, str(tmp_path / "out")).collect()) == set(df.collect())


def test_plans_have_no_nested_loops(spark):
    df = frame(spark, table(1, 5))
    for d in (DDS[0], DDS[1], DDS[3], DDS[6]):
        plan = pairs.violating_pairs(df, d, KINDS)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_report(spark):
    rows = {i: {"a": "x" if i < 4 else "y", "b": "1" if i != 2 else "9", "n": i % 2} for i in range(8)}
    df, clean = frame(spark, rows), frame(spark, {i: r | {"b": "1"} for i, r in rows.items()})
    row = detection.report(df, clean, [equal("a", "b")], {"a": 0.0, "b": 0.0}, KINDS).first()
    assert row.Recall == 1.0 and "covered" in row.Coverage and row.TotalTime >= row.EDetTime > 0
    wide = df.select(IDX, F.lit(0.5).alias("a"), (F.col(IDX) / 100).alias("b"))
    row = detection.summary(df.where("_idx < 6"), df.where("_idx >= 6"), clean, [equal("a", "b")], {"a": 0.0, "b": 0.0}, KINDS, wide, 6).first()
    assert (row["Base_Size(k)"], row["Inc_Size(k)"], row.Length_Original, row.Length_Incremental) == (0, 0, 6, 2) and row.Time_Inc_Total > 0
