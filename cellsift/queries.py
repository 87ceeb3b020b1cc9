"""Queries over the star-schema tables, one for each operator, and the SQL they must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift import detection
from cellsift.functions.values import strip
from cellsift.operators import distances, evaluation, grouped, pairs, probability, selection
from cellsift.plans.constraints import INT, STRING, dependency, equal, parse_dependencies, parse_thresholds, threshold_index
from cellsift.sources.tables import IDX, cell_id, parse_cell_id, read_csv, shared_folder, with_index, write_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, sf_dir: str, name: str, by: str, *columns: str) -> DataFrame:
    return with_index(spark.read.parquet(f"{sf_dir}/{name}.parquet"), by).select(IDX, *columns)


# Dependencies and thresholds that the queries share.
NATION = equal("c_nationkey", "c_mktsegment")
CUSTOMER = ["c_nationkey", "c_mktsegment"]
CUSTOMER_KINDS = {"c_nationkey": INT, "c_mktsegment": STRING}
CUSTOMER_TAUS = {"c_nationkey": 0.15, "c_mktsegment": 0.1}
PRIORITY = equal("o_custkey", "o_orderpriority")
ORDER_KINDS = {"o_custkey": INT, "o_orderpriority": STRING}
ORDER_TAUS = {"o_custkey": 0.2, "o_orderpriority": 0.25}
EVENT = equal(["user_id", "event_type"], "props")
EVENT_KINDS = {"user_id": INT, "event_type": STRING, "props": STRING}
PART = equal(["p_name", "p_brand"], "p_type")
PART_KINDS = {"p_name": STRING, "p_brand": STRING, "p_type": STRING}


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, "customer", "c_custkey", *CUSTOMER)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")


def made_up(df: DataFrame, attrs: list[str]) -> DataFrame:
    """Probabilities by formula, so that tests of selection don't depend on scoring."""
    return df.select(IDX, *(((F.col(IDX) * 37 + 101 * k) % 1000 / 1000).alias(a) for k, a in enumerate(attrs)))


def dirt(df: DataFrame) -> DataFrame:
    """customer with nulls and padding in place of some values."""
    nation = F.when(F.col(IDX) % 11 == 0, None).otherwise(F.col("c_nationkey").cast("string"))
    segment = F.when(F.col(IDX) % 10 == 0, None).when(F.col(IDX) % 7 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return df.select(IDX, nation.alias("c_nationkey"), segment.alias("c_mktsegment"))


DIRT_SQL = "SELECT c_custkey AS idx, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS n, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS s FROM customer"


def base_rows(df: DataFrame) -> int:
    """The first four fifths are the base, the rest the delta."""
    return df.count() * 4 // 5


@query("SELECT attr, place, CAST(threshold AS DOUBLE) AS threshold FROM (VALUES ('a', 0, 2.0), ('a', 1, 0.0), ('b', 0, 3.0), ('b', 1, 1.0), ('c', 0, 0.0)) t(attr, place, threshold)")
def threshold_index_query(spark, sf_dir):
    found = threshold_index([dependency({"a": ("<=", 0.0), "b": (">", 1.0)}, ("c", ("<=", 0.0))), dependency({"a": ("<=", 2.0)}, ("b", ("<=", 3.0)))])
    return spark.createDataFrame([(a, k, t) for a, ts in found.items() for k, t in enumerate(ts)], "attr string, place int, threshold double")


@query("SELECT conv_id, turn, regexp_replace(regexp_replace('  ' || chr(9) || text || chr(160) || ' ', '^[\\s\\x{A0}\\x{85}]+', ''), '[\\s\\x{A0}\\x{85}]+$', '') AS stripped FROM conversations")
def strip_clean(spark, sf_dir):
    padded = F.concat(F.lit("  \t"), "text", F.lit("  "))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", strip(padded).alias("stripped"))


@query(
    "WITH v AS (SELECT DISTINCT 'p_type' AS attr, trim(p_type) AS v FROM part UNION SELECT DISTINCT 'p_brand', trim(p_brand) FROM part) SELECT a.attr, a.v AS v1, b.v AS v2, CAST(levenshtein(replace(a.v, ' ', ''), replace(b.v, ' ', '')) AS BIGINT) AS dist FROM v a JOIN v b ON a.attr = b.attr AND a.v <= b.v"
)
def string_distance_distinct(spark, sf_dir):
    return distances.value_distances(rows(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand"), {"p_type": STRING, "p_brand": STRING})


@query(
    "WITH v AS (SELECT DISTINCT 'balance' AS attr, CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) || '.75' AS v FROM supplier UNION SELECT DISTINCT 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier) SELECT a.attr, a.v AS v1, b.v AS v2, CAST(abs(trunc(CAST(a.v AS DOUBLE)) - trunc(CAST(b.v AS DOUBLE))) AS BIGINT) AS dist FROM v a JOIN v b ON a.attr = b.attr AND a.v <= b.v"
)
def int_distance_distinct(spark, sf_dir):
    """Texts of numbers with a fraction, negative ones too: the distance is between whole parts."""
    df = rows(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal", "s_nationkey")
    text = df.select(IDX, F.concat(F.floor("s_acctbal").cast("string"), F.lit(".75")).alias("balance"), F.col("s_nationkey").cast("string").alias("nation"))
    return distances.value_distances(text, {"balance": INT, "nation": INT})


@query("SELECT 's_nationkey' AS attr, a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def clusters_eq(spark, sf_dir):
    return pairs.clusters(rows(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), [equal([], "s_nationkey")], {"s_nationkey": INT}).select("attr", "i", "j")


REFINED = [dependency({"s_nationkey": ("<=", 2.0)}, ("s_name", ("<=", 1.0))), dependency({"s_nationkey": ("<=", 0.0)}, ("s_name", ("<=", 0.0)))]


@query(
    "SELECT 's_nationkey' AS attr, CAST(t.threshold AS DOUBLE) AS threshold, a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey JOIN (VALUES (0.0), (2.0)) t(threshold) ON abs(a.s_nationkey - b.s_nationkey) <= t.threshold UNION ALL SELECT 's_name', CAST(t.threshold AS DOUBLE), a.s_suppkey, b.s_suppkey FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey JOIN (VALUES (0.0), (1.0)) t(threshold) ON levenshtein(replace(a.s_name, ' ', ''), replace(b.s_name, ' ', '')) <= t.threshold"
)
def clusters_refined(spark, sf_dir):
    return pairs.clusters(rows(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_name"), REFINED, {"s_nationkey": INT, "s_name": STRING})


@query("SELECT 's_nationkey' AS attr, a.s_suppkey AS i, string_agg(CAST(b.s_suppkey AS VARCHAR), ',' ORDER BY b.s_suppkey) AS js FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY a.s_suppkey")
def clusters_nested(spark, sf_dir):
    found = pairs.nested(pairs.clusters(rows(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), [equal([], "s_nationkey")], {"s_nationkey": INT}))
    return found.select("attr", "i", F.array_join(F.transform("js", lambda j: j.cast("string")), ",").alias("js"))


FD_SQL = (
    "SELECT 0 AS dd_id, a.c_custkey AS i, b.c_custkey AS j FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE replace(a.c_mktsegment, ' ', '') <> replace(b.c_mktsegment, ' ', '')"
)


@query(FD_SQL)
def violations_fd(spark, sf_dir):
    return pairs.violations(customer(spark, sf_dir), [NATION], CUSTOMER_KINDS)


@query("SELECT 0 AS dd_id, a.o_orderkey AS i, b.o_orderkey AS j FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE replace(a.o_orderpriority, ' ', '') <> replace(b.o_orderpriority, ' ', '')")
def violations_orders(spark, sf_dir):
    return pairs.violations(orders(spark, sf_dir), [PRIORITY], ORDER_KINDS)


@query(
    "SELECT 'events' AS t, a.event_id AS i, b.event_id AS j FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id WHERE replace(a.props, ' ', '') <> replace(b.props, ' ', '') UNION ALL SELECT 'part', a.p_partkey, b.p_partkey FROM part a JOIN part b ON replace(a.p_name, ' ', '') = replace(b.p_name, ' ', '') AND replace(a.p_brand, ' ', '') = replace(b.p_brand, ' ', '') AND a.p_partkey < b.p_partkey WHERE replace(a.p_type, ' ', '') <> replace(b.p_type, ' ', '')"
)
def violations_multi_lhs(spark, sf_dir):
    event = pairs.violations(rows(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props"), [EVENT], EVENT_KINDS)
    part = pairs.violations(rows(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type"), [PART], PART_KINDS)
    return event.select(F.lit("events").alias("t"), "i", "j").union(part.select(F.lit("part").alias("t"), "i", "j"))


@query("SELECT 0 AS dd_id, a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE NOT abs(trunc(a.s_acctbal) - trunc(b.s_acctbal)) <= 1000 AND NOT levenshtein(replace(a.s_name, ' ', ''), replace(b.s_name, ' ', '')) <= 1")
def violations_gt_lhs(spark, sf_dir):
    dd = dependency({"s_nationkey": ("<=", 0.0), "s_acctbal": (">", 1000.0)}, ("s_name", ("<=", 1.0)))
    return pairs.violations(rows(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal", "s_name"), [dd], {"s_nationkey": INT, "s_acctbal": INT, "s_name": STRING})


@query("SELECT 0 AS dd_id, CAST(a.n_nationkey AS BIGINT) AS i, CAST(b.n_nationkey AS BIGINT) AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE levenshtein(replace(a.n_name, ' ', ''), replace(b.n_name, ' ', '')) <= 6")
def violations_gt_rhs(spark, sf_dir):
    dd = dependency({"n_regionkey": ("<=", 0.0)}, ("n_name", (">", 6.0)))
    return pairs.violations(rows(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", "n_name"), [dd], {"n_regionkey": INT, "n_name": STRING})


@query("SELECT 0 AS dd_id, a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE NOT abs(a.s_nationkey - b.s_nationkey) <= 3 AND NOT abs(trunc(a.s_acctbal) - trunc(b.s_acctbal)) <= 5000")
def violations_no_le(spark, sf_dir):
    dd = dependency({"s_nationkey": (">", 3.0)}, ("s_acctbal", ("<=", 5000.0)))
    return pairs.violations(rows(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal"), [dd], {"s_nationkey": INT, "s_acctbal": INT})


@query("SELECT 0 AS dd_id, a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND levenshtein(replace(a.s_name, ' ', ''), replace(b.s_name, ' ', '')) <= 2 WHERE a.s_nationkey <> b.s_nationkey")
def violations_fuzzy(spark, sf_dir):
    dd = dependency({"s_name": ("<=", 2.0)}, ("s_nationkey", ("<=", 0.0)))
    return pairs.violations(rows(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey"), [dd], {"s_nationkey": INT, "s_name": STRING})


@query(
    f"WITH d AS ({DIRT_SQL}), m AS (SELECT idx, n, CASE WHEN s = trim(s) THEN replace(s, ' ', '') END AS s FROM d) SELECT 0 AS dd_id, a.idx AS i, b.idx AS j FROM m a JOIN m b ON a.idx < b.idx WHERE coalesce(a.n = b.n, false) AND NOT coalesce(a.s = b.s, false) UNION ALL SELECT 1, a.idx, b.idx FROM m a JOIN m b ON a.idx < b.idx WHERE coalesce(a.s = b.s, false) AND NOT coalesce(a.n = b.n, false)"
)
def violations_nulls(spark, sf_dir):
    dds = [NATION, equal("c_mktsegment", "c_nationkey")]
    return pairs.violations(dirt(customer(spark, sf_dir)), dds, {"c_nationkey": STRING, "c_mktsegment": STRING})


@query(
    f"SELECT 'customer' AS t, count(*) AS n FROM ({FD_SQL}) UNION ALL SELECT 'orders', count(*) FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_orderpriority <> b.o_orderpriority UNION ALL SELECT 'documents', count(*) FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id WHERE a.source <> b.source"
)
def violation_counts_per_dd(spark, sf_dir):
    """By group aggregates; no pair is built."""
    document = rows(spark, sf_dir, "documents", "doc_id", "text", "source")
    parts = [("customer", customer(spark, sf_dir), NATION, CUSTOMER_KINDS), ("orders", orders(spark, sf_dir), PRIORITY, ORDER_KINDS), ("documents", document, equal("text", "source"), {"text": STRING, "source": STRING})]
    found = [grouped.pair_counts(df, [dd], kinds).select(F.lit(t).alias("t"), "n") for t, df, dd, kinds in parts]
    return found[0].union(found[1]).union(found[2])


PART_PAIRS = "SELECT a.p_partkey AS i, b.p_partkey AS j FROM part a JOIN part b ON replace(a.p_name, ' ', '') = replace(b.p_name, ' ', '') AND replace(a.p_brand, ' ', '') = replace(b.p_brand, ' ', '') AND a.p_partkey < b.p_partkey WHERE replace(a.p_type, ' ', '') <> replace(b.p_type, ' ', '')"


@query(
    f"WITH p AS ({PART_PAIRS}) SELECT 0 AS dd_id, i, j, pos, CASE WHEN pos % 2 = 0 THEN i ELSE j END AS idx, attr, 't' || CAST(CASE WHEN pos % 2 = 0 THEN i ELSE j END AS VARCHAR) || '.' || attr AS cell FROM p, (VALUES (0, 'p_name'), (1, 'p_name'), (2, 'p_brand'), (3, 'p_brand'), (4, 'p_type'), (5, 'p_type')) c(pos, attr)"
)
def hyper_edges(spark, sf_dir):
    found = pairs.violations(rows(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type"), [PART], PART_KINDS)
    return pairs.hyper_edges(found, [PART]).withColumn("cell", cell_id())


@query("SELECT p_partkey AS idx, 'p.type' AS attr FROM part")
def parse_cells(spark, sf_dir):
    named = rows(spark, sf_dir, "part", "p_partkey").withColumn("attr", F.lit("p.type")).select(cell_id(IDX, "attr").alias("cell"))
    return named.select(parse_cell_id(F.col("cell")).alias("c")).select("c.*")


NB_ROWS = "SELECT c_custkey AS idx, CAST(c_nationkey AS VARCHAR) AS x, c_mktsegment AS y, CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR) AS z FROM customer"


def nb_sql(t: str, a: str, b: str) -> str:
    """The dense formula: every row against every class."""
    n = lambda f: f"SELECT {t} AS c, {f} AS v, count(*) AS n FROM r GROUP BY 1, 2"
    return (
        f"SELECT idx, sum(CASE WHEN own = c THEN e ELSE 0 END) / sum(e) AS p FROM (SELECT r.idx, r.{t} AS own, k.c, exp(ln(k.n / tot.n) - 2 * ln(k.n * 2 + f.f) + ln(1 + coalesce(na.n, 0)) + ln(1 + coalesce(nb.n, 0)) + 20) AS e "
        f"FROM r CROSS JOIN (SELECT {t} AS c, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY 1) k CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM r) tot CROSS JOIN (SELECT count(DISTINCT {a}) + count(DISTINCT {b}) AS f FROM r) f "
        f"LEFT JOIN ({n(a)}) na ON na.c = k.c AND na.v = r.{a} LEFT JOIN ({n(b)}) nb ON nb.c = k.c AND nb.v = r.{b}) GROUP BY idx"
    )


JOINT_SQL = f"WITH r AS ({NB_ROWS}), px AS ({nb_sql('x', 'y', 'z')}), py AS ({nb_sql('y', 'x', 'z')}) SELECT px.idx, round(px.p, 6) AS p_nation, round(py.p, 6) AS p_segment FROM px JOIN py ON px.idx = py.idx"


def scored_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_index(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey")
    return df.select(IDX, *CUSTOMER, F.floor(F.col("c_acctbal") / 1000).alias("thousands"))


@query(JOINT_SQL)
def joint_probability(spark, sf_dir):
    found = probability.joint_probabilities(scored_customer(spark, sf_dir), CUSTOMER)
    return found.select(F.col(IDX).alias("idx"), F.round("c_nationkey", 6).alias("p_nation"), F.round("c_mktsegment", 6).alias("p_segment"))


@query(
    "WITH f AS (SELECT p_brand AS v, count(*) * 1.0 / (SELECT count(p_brand) FROM part) AS p FROM part WHERE p_brand IS NOT NULL GROUP BY 1), c AS (SELECT p_partkey AS idx, coalesce(f.p, 0) AS p FROM part LEFT JOIN f ON f.v = p_brand) SELECT idx, round(CAST((p - (SELECT min(p) FROM c)) / ((SELECT max(p) FROM c) - (SELECT min(p) FROM c)) AS DOUBLE), 6) AS p FROM c"
)
def marginal_probability(spark, sf_dir):
    found = probability.marginal_probability(rows(spark, sf_dir, "part", "p_partkey", "p_brand"), "p_brand")
    return found.select(F.col(IDX).alias("idx"), F.round("p", 6).alias("p"))


def errors_sql(pairs_sql: str, names: list[str], taus: dict[str, float], edge: bool = False, scored: bool = False) -> str:
    """Selection by pairs, with the made-up probabilities, or those that the pairs bring along as i0, j0, i1, ..."""
    p = lambda k, side: f"{side}{k}" if scored else f"(({side} * 37 + {101 * k}) % 1000) / 1000.0"
    cells = " UNION ALL ".join(f"SELECT i, j, {k} AS pos, {side} AS idx, '{n}' AS attr, {p(k, side)} AS p, {p(k, side)} < {taus[n]} AS low FROM v" for k, n in enumerate(names) for side in "ij")
    asked = "bool_or(low)" if edge else "bool_or(low AND pos = 0)"
    return (
        f"WITH v AS ({pairs_sql}), c AS ({cells}), l AS (SELECT i, j, {asked} AS has FROM c GROUP BY i, j), o AS (SELECT c.*, row_number() OVER (PARTITION BY c.i, c.j ORDER BY p, pos, idx) AS k FROM c) "
        "SELECT idx, attr FROM c WHERE low UNION SELECT o.idx, o.attr FROM o JOIN l ON o.i = l.i AND o.j = l.j WHERE o.k = 1 AND NOT l.has"
    )


ORDERS_PAIRS = "SELECT a.o_orderkey AS i, b.o_orderkey AS j FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_orderpriority <> b.o_orderpriority"
ERRORS_SQL = errors_sql(FD_SQL, CUSTOMER, CUSTOMER_TAUS)
ORDER_ERRORS_SQL = errors_sql(ORDERS_PAIRS, ["o_custkey", "o_orderpriority"], ORDER_TAUS)


@query(ERRORS_SQL)
def error_cells_pairwise(spark, sf_dir):
    df = customer(spark, sf_dir)
    return detection.detect(df, [NATION], CUSTOMER_TAUS, CUSTOMER_KINDS, made_up(df, CUSTOMER), strategy="pairs")


@query(ERRORS_SQL)
def error_cells_grouped(spark, sf_dir):
    df = customer(spark, sf_dir)
    return detection.detect(df, [NATION], CUSTOMER_TAUS, CUSTOMER_KINDS, made_up(df, CUSTOMER))


@query(ORDER_ERRORS_SQL)
def error_cells_orders(spark, sf_dir):
    df = orders(spark, sf_dir)
    return detection.detect(df, [PRIORITY], ORDER_TAUS, ORDER_KINDS, made_up(df, ["o_custkey", "o_orderpriority"]))


@query(errors_sql(FD_SQL, CUSTOMER, CUSTOMER_TAUS, edge=True))
def error_cells_edge_fallback(spark, sf_dir):
    df = customer(spark, sf_dir)
    return detection.detect(df, [NATION], CUSTOMER_TAUS, CUSTOMER_KINDS, made_up(df, CUSTOMER), fallback="edge")


# The clean copy of customer has other segments in some rows; the dirty one is padded in others, which is no difference.
DIFF_SQL = "SELECT c_custkey AS idx, 'c_mktsegment' AS attr FROM customer WHERE c_custkey % 9 = 0 AND trim(c_mktsegment) <> 'HOUSEHOLD' UNION ALL SELECT c_custkey, 'c_nationkey' FROM customer WHERE c_custkey % 13 = 0"


def clean_customer(df: DataFrame) -> DataFrame:
    segment = F.when(F.col(IDX) % 9 == 0, F.lit("HOUSEHOLD")).otherwise(F.col("c_mktsegment"))
    nation = F.when(F.col(IDX) % 13 == 0, None).otherwise(F.col("c_nationkey").cast("string"))
    return df.select(IDX, nation.alias("c_nationkey"), segment.alias("c_mktsegment"))


def padded_customer(df: DataFrame) -> DataFrame:
    segment = F.when(F.col(IDX) % 4 == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit("\t"))).otherwise(F.col("c_mktsegment"))
    return df.select(IDX, F.col("c_nationkey").cast("string").alias("c_nationkey"), segment.alias("c_mktsegment"))


@query(DIFF_SQL)
def diff_cells(spark, sf_dir):
    df = customer(spark, sf_dir)
    return evaluation.difference(padded_customer(df), clean_customer(df))


@query(
    f"WITH e AS ({ERRORS_SQL}), t AS ({DIFF_SQL}), s AS (SELECT count(*) FILTER (WHERE e.idx IS NOT NULL AND t.idx IS NOT NULL) AS tp, count(*) FILTER (WHERE t.idx IS NULL) AS fp, count(*) FILTER (WHERE e.idx IS NULL) AS fn FROM e FULL JOIN t ON e.idx = t.idx AND e.attr = t.attr) SELECT tp, fp, fn, round(tp * 1.0 / nullif(tp + fp, 0), 9) AS precision_, round(tp * 1.0 / nullif(tp + fn, 0), 9) AS recall_, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM s"
)
def precision_recall_f1(spark, sf_dir):
    df = customer(spark, sf_dir)
    found = evaluation.scores(error_cells_grouped(spark, sf_dir), evaluation.difference(padded_customer(df), clean_customer(df)))
    return found.select("tp", "fp", "fn", *(F.round(c, 9).alias(n) for c, n in (("precision", "precision_"), ("recall", "recall_"), ("f1", "f1"))))


SUPPLIER_NAME = equal("s_nationkey", "s_name")
TRUTH_ROWS = "SELECT s_suppkey AS idx FROM supplier WHERE ((s_suppkey * 37) % 1000) / 1000.0 < 0.3"


@query(
    f"WITH e AS ({TRUTH_ROWS}) SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND replace(a.s_name, ' ', '') <> replace(b.s_name, ' ', '') WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.idx = a.s_suppkey) AND NOT EXISTS (SELECT 1 FROM e WHERE e.idx = b.s_suppkey)"
)
def uncovered_pairs(spark, sf_dir):
    """Pairs that low cells alone, without the fallback, leave uncovered."""
    df = rows(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_name")
    found = pairs.violations(df, [SUPPLIER_NAME], {"s_nationkey": INT, "s_name": STRING})
    low = selection.long_probabilities(made_up(df, ["s_nationkey"]), {"s_nationkey": 0.3}).where("p < tau").select("idx", "attr")
    return evaluation.uncovered(found, low)


CUT = "(SELECT count(*) * 4 // 5 FROM {t})"


@query(
    f"WITH c AS (SELECT c_custkey AS idx, CAST(CAST(floor(c_acctbal / 10) AS BIGINT) AS VARCHAR) AS v FROM customer), o AS (SELECT DISTINCT v FROM c WHERE idx < {CUT.format(t='customer')}), n AS (SELECT DISTINCT v FROM c WHERE idx >= {CUT.format(t='customer')} AND v NOT IN (SELECT v FROM o)) "
    "SELECT 'tens' AS attr, o.v AS v1, n.v AS v2, CAST(abs(CAST(o.v AS BIGINT) - CAST(n.v AS BIGINT)) AS BIGINT) AS dist FROM o, n UNION ALL SELECT 'tens', a.v, b.v, CAST(abs(CAST(a.v AS BIGINT) - CAST(b.v AS BIGINT)) AS BIGINT) FROM n a JOIN n b ON a.v <= b.v"
)
def delta_distances(spark, sf_dir):
    df = with_index(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey").select(IDX, F.floor(F.col("c_acctbal") / 10).cast("string").alias("tens"))
    n = base_rows(df)
    return distances.delta_distances(df.where(F.col(IDX) < n), df.where(F.col(IDX) >= n), {"tens": INT})


@query(
    f"SELECT 's_nationkey' AS attr, CAST(t.threshold AS DOUBLE) AS threshold, a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND b.s_suppkey >= {CUT.format(t='supplier')} JOIN (VALUES (0.0), (2.0)) t(threshold) ON abs(a.s_nationkey - b.s_nationkey) <= t.threshold UNION ALL SELECT 's_name', CAST(t.threshold AS DOUBLE), a.s_suppkey, b.s_suppkey FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND b.s_suppkey >= {CUT.format(t='supplier')} JOIN (VALUES (0.0), (1.0)) t(threshold) ON levenshtein(replace(a.s_name, ' ', ''), replace(b.s_name, ' ', '')) <= t.threshold"
)
def delta_clusters(spark, sf_dir):
    df = rows(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_name")
    return pairs.clusters(df, REFINED, {"s_nationkey": INT, "s_name": STRING}, base_rows(df))


@query(f"SELECT * FROM ({FD_SQL}) WHERE j >= {CUT.format(t='customer')}")
def delta_violations(spark, sf_dir):
    df = customer(spark, sf_dir)
    return pairs.violations(df, [NATION], CUSTOMER_KINDS, base_rows(df))


TOUCHED = f"{ORDERS_PAIRS} AND a.o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey >= {CUT.format(t='orders')})"


@query(errors_sql(TOUCHED, ["o_custkey", "o_orderpriority"], ORDER_TAUS))
def delta_error_cells(spark, sf_dir):
    """The delta alone: error cells of the groups that it touches."""
    df = orders(spark, sf_dir)
    n = base_rows(df)
    return detection.detect_delta(df.where(F.col(IDX) < n), df.where(F.col(IDX) >= n), [PRIORITY], ORDER_TAUS, ORDER_KINDS, made_up(df, ["o_custkey", "o_orderpriority"]), n)


@query(ORDER_ERRORS_SQL)
def incremental_error_cells(spark, sf_dir):
    """Base and delta one after the other; the SQL looks at the whole table."""
    df = orders(spark, sf_dir)
    n = base_rows(df)
    return detection.detect_incremental(df.where(F.col(IDX) < n), df.where(F.col(IDX) >= n), [PRIORITY], ORDER_TAUS, ORDER_KINDS, made_up(df, ["o_custkey", "o_orderpriority"]), n)


SCORED_PAIRS = f"WITH r AS ({NB_ROWS}), px AS ({nb_sql('x', 'y', 'z')}), py AS ({nb_sql('y', 'x', 'z')}), p AS (SELECT px.idx, round(px.p, 12) AS p0, round(py.p, 12) AS p1 FROM px JOIN py ON px.idx = py.idx) SELECT f.i, f.j, a.p0 AS i0, a.p1 AS i1, b.p0 AS j0, b.p1 AS j1 FROM ({FD_SQL}) f JOIN p a ON a.idx = f.i JOIN p b ON b.idx = f.j"


@query(errors_sql(SCORED_PAIRS, CUSTOMER, CUSTOMER_TAUS, scored=True))
def detection_with_scores(spark, sf_dir):
    """The complete batch: naive-Bayes scores, then error cells."""
    return detection.detect(scored_customer(spark, sf_dir), [NATION], CUSTOMER_TAUS, CUSTOMER_KINDS)


SEVERAL = [dependency({"s_name": ("<=", 2.0)}, ("s_nationkey", ("<=", 0.0))), dependency({"s_nationkey": ("<=", 0.0), "s_acctbal": (">", 1000.0)}, ("s_name", ("<=", 1.0))), dependency({"s_nationkey": (">", 3.0)}, ("s_acctbal", ("<=", 5000.0)))]
SEVERAL_KINDS = {"s_nationkey": INT, "s_acctbal": INT, "s_name": STRING}
SEVERAL_TAUS = {"s_name": 0.1, "s_nationkey": 0.2, "s_acctbal": 0.15}
_name, _balance = "levenshtein(replace(a.s_name, ' ', ''), replace(b.s_name, ' ', ''))", "abs(trunc(a.s_acctbal) - trunc(b.s_acctbal))"
_wheres = [f"{_name} <= 2 AND a.s_nationkey <> b.s_nationkey", f"a.s_nationkey = b.s_nationkey AND NOT {_balance} <= 1000 AND NOT {_name} <= 1", f"NOT abs(a.s_nationkey - b.s_nationkey) <= 3 AND NOT {_balance} <= 5000"]
SEVERAL_SQL = [f"SELECT {k} AS dd_id, a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND b.s_suppkey >= {CUT.format(t='supplier')} WHERE {w}" for k, w in enumerate(_wheres)]


@query(" UNION ALL ".join(SEVERAL_SQL))
def delta_violations_several(spark, sf_dir):
    """Fuzzy rules and ones with `>`, several at once, for appended rows."""
    df = rows(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal", "s_name")
    return pairs.violations(df, SEVERAL, SEVERAL_KINDS, base_rows(df))


@query(" UNION ".join(f"SELECT * FROM ({errors_sql(sql, [*(a.attr for a in d.left), d.right.attr], SEVERAL_TAUS)})" for sql, d in zip(SEVERAL_SQL, SEVERAL, strict=True)))
def delta_errors_several(spark, sf_dir):
    """Error cells that appended rows add, rule by rule, as made-up probabilities follow a rule's own order of attributes."""
    df = rows(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal", "s_name")
    n = base_rows(df)
    base, delta = df.where(F.col(IDX) < n), df.where(F.col(IDX) >= n)
    parts = [detection.detect_delta(base, delta, [d], SEVERAL_TAUS, SEVERAL_KINDS, made_up(df, list(d.attrs)), n) for d in SEVERAL]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


LITERAL = """[({'city': ('<=', 0.0), 'name': ('>', 2)}, ('zip', ('<=', 1.5))), ({'zip': ('<=', 0.0)}, ('city', ('<=', 0.0)))]"""
LITERAL_TAUS = "{'city': 0.1, 'zip': 0.65, 'name': 1}"


@query("SELECT dd_id, place, attr, op, CAST(threshold AS DOUBLE) AS threshold, CAST(tau AS DOUBLE) AS tau FROM (VALUES (0, 0, 'city', '<=', 0.0, 0.1), (0, 1, 'name', '>', 2.0, 1.0), (0, 2, 'zip', '<=', 1.5, 0.65), (1, 0, 'zip', '<=', 0.0, 0.65), (1, 1, 'city', '<=', 0.0, 0.1)) t(dd_id, place, attr, op, threshold, tau)")
def literal_configuration(spark, sf_dir):
    """Rules and probability thresholds from their text form."""
    taus = parse_thresholds(LITERAL_TAUS)
    atoms = [(k, p, a.attr, a.op, a.threshold, taus[a.attr]) for k, d in enumerate(parse_dependencies(LITERAL)) for p, a in enumerate((*d.left, d.right))]
    return spark.createDataFrame(atoms, "dd_id int, place int, attr string, op string, threshold double, tau double")


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, CASE WHEN turn % 7 = 0 THEN NULL WHEN turn % 5 = 0 THEN ' a \"quoted\", text' || chr(10) || 'in two lines ' ELSE text END AS text FROM conversations")
def csv_round_trip(spark, sf_dir):
    """Cells written as CSV and read again as text: quotes, line ends and blanks stay, NA comes back as null."""
    turn = F.col("turn")
    text = F.when(turn % 7 == 0, F.lit("NA")).when(turn % 5 == 0, F.lit(' a "quoted", text\nin two lines ')).otherwise(F.col("text"))
    return again(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", text.alias("text")), "cells")


def again(df: DataFrame, name: str) -> DataFrame:
    """df after a way through CSV files in a folder that all machines share."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    write_csv(df, path)
    return read_csv(df.sparkSession, path)


@query(JOINT_SQL)
def probability_file(spark, sf_dir):
    """Probabilities as a CSV file, read back as numbers."""
    read = again(probability.joint_probabilities(scored_customer(spark, sf_dir), CUSTOMER), "probabilities")
    number = lambda c, name: F.round(F.col(c).cast("double"), 6).alias(name)
    return read.select(F.col(IDX).cast("bigint").alias("idx"), number("c_nationkey", "p_nation"), number("c_mktsegment", "p_segment"))


@query("SELECT 'c_mktsegment' AS attr, count(*) FILTER (WHERE c_custkey % 9 <> 0 AND c_mktsegment IS NULL) AS n FROM customer UNION ALL SELECT 'c_nationkey', count(*) FILTER (WHERE c_custkey % 13 = 0) FROM customer")
def null_clean_cells(spark, sf_dir):
    return evaluation.null_cells(clean_customer(customer(spark, sf_dir)))


SCORES_SQL = "SELECT round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 9) AS precision_, round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 9) AS recall_, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM (SELECT count(*) FILTER (WHERE e.idx IS NOT NULL AND t.idx IS NOT NULL) AS tp, count(*) FILTER (WHERE t.idx IS NULL) AS fp, count(*) FILTER (WHERE e.idx IS NULL) AS fn FROM e FULL JOIN t ON e.idx = t.idx AND e.attr = t.attr)"


def rounded_scores() -> list:
    return [F.round(c, 9).alias(n) for c, n in (("Precision", "precision_"), ("Recall", "recall_"), ("F1", "f1"))]


@query(f"WITH e AS ({ERRORS_SQL}), t AS ({DIFF_SQL}), s AS ({SCORES_SQL}) SELECT precision_, recall_, f1, true AS timed, 'All violating pairs are covered.' AS coverage FROM s")
def batch_result(spark, sf_dir):
    """The row that a batch run ends with; its seconds only as far as they add up."""
    df = customer(spark, sf_dir)
    found = detection.report(df, clean_customer(df), [NATION], CUSTOMER_TAUS, CUSTOMER_KINDS, made_up(df, CUSTOMER))
    times = [F.col(c) for c in ("BuildLookupTime", "ClusterTime", "FindVioPairsTime", "EDetTime")]
    timed = (F.least(*times) > 0) & (F.abs(F.col("TotalTime") - sum(times[1:], times[0])) < 1e-9)
    return found.select(*rounded_scores(), timed.alias("timed"), F.col("Coverage").alias("coverage"))


@query(
    f"WITH e AS ({ERRORS_SQL}), t AS ({DIFF_SQL}), s AS ({SCORES_SQL}), n AS (SELECT count(*) AS rows_, count(*) * 4 // 5 AS cut FROM customer) "
    "SELECT CAST(count(*) FILTER (WHERE c_custkey < cut) // 1000 AS BIGINT) AS base_size, CAST(count(*) // 1000 AS BIGINT) AS inc_size, count(*) FILTER (WHERE c_custkey < cut) AS length_original, count(*) FILTER (WHERE c_custkey >= cut) AS length_incremental, precision_, recall_, f1, true AS timed FROM customer, n, s GROUP BY precision_, recall_, f1"
)
def incremental_summary(spark, sf_dir):
    """The row that a base run and a delta run end with."""
    df = customer(spark, sf_dir)
    n = base_rows(df)
    found = detection.summary(df.where(F.col(IDX) < n), df.where(F.col(IDX) >= n), clean_customer(df), [NATION], CUSTOMER_TAUS, CUSTOMER_KINDS, made_up(df, CUSTOMER), n)
    sizes = [F.col(a).alias(b) for a, b in (("`Base_Size(k)`", "base_size"), ("`Inc_Size(k)`", "inc_size"), ("Length_Original", "length_original"), ("Length_Incremental", "length_incremental"))]
    return found.select(*sizes, *rounded_scores(), (F.least("Time_Original_Total", "Time_Inc_Total") > 0).alias("timed"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection_with_scores(spark, sf_dir)


QUERIES["threshold_index"] = QUERIES.pop("threshold_index_query")
SQL["threshold_index"] = SQL.pop("threshold_index_query")
