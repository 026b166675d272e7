"""Golden cases of the batch operators."""

import math

import pytest
from pyspark.sql import functions as F

from driftline.operators import aggregates, changelog, joins
from driftline.plans.risk import issuer_risk_flow
from driftline.schemas import ROLLDOWN
from driftline.sources import generators, readers

# value, accumulator, retract, expected; (offset in days, amount)
ROLLDOWNS = [
    ([(0, 100), (5, 0)], [], False, [(0, 100), (5, 0)]),
    ([(0, 100), (5, 0)], [(0, 200), (5, 0)], False, [(0, 300), (5, 0)]),
    ([(0, 100), (5, 0)], [(0, 200), (5, 0)], True, [(0, 100), (5, 0)]),
    ([(0, 100), (5, 0)], [(0, 200), (3, 0)], False, [(0, 300), (3, 100), (5, 0)]),
    ([(0, 100), (5, 0)], [(0, 200), (3, 0)], True, [(0, 100), (3, -100), (5, 0)]),
    ([(0, 100), (3, 0)], [(0, 200), (3, 50), (5, 0)], False, [(0, 300), (3, 50), (5, 0)]),
    ([(0, 100), (3, 0)], [(0, 200), (3, 50), (5, 0)], True, [(0, 100), (3, 50), (5, 0)]),
]


def test_rolldowns(spark):
    from datetime import date, timedelta

    day = lambda n: date(2020, 1, 1) + timedelta(n)
    rows = [(i, w, [(day(d), float(x)) for d, x in f]) for i, (value, acc, retract, _) in enumerate(ROLLDOWNS) for w, f in ((-1 if retract else 1, value), (1, acc))]
    df = spark.createDataFrame(rows, f"case int, w int, f {ROLLDOWN}")
    out = aggregates.as_rolldown(aggregates.rolldown_sum(aggregates.rolldown_deltas(df, "f", F.col("w")), ["case"]), ["case"]).collect()
    assert {r.case: [((x.Date - day(0)).days, x.JTD) for x in r.rolldown] for r in out} == {i: c[3] for i, c in enumerate(ROLLDOWNS)}


def test_rolldown_unsorted_and_repeated_dates(spark):
    df = spark.sql("SELECT 1 AS k, array(named_struct('Date', date'2020-01-03', 'JTD', 0D), named_struct('Date', date'2020-01-01', 'JTD', 5D), named_struct('Date', date'2020-01-01', 'JTD', 7D)) AS f")
    out = aggregates.rolldown_sum(aggregates.rolldown_deltas(df, "f"), ["k"]).orderBy("date").collect()
    assert [(str(r.date), r.jtd) for r in out] == [("2020-01-01", 7.0), ("2020-01-03", 0.0)]


CUBE = [("FLOW", "NAM.IG", "CDS", "IBM", 1000.0, 1e6), ("FLOW", "NAM.IG", "BOND", "IBM", 500.0, 4e5), ("FLOW", "EMEA.IG", "BOND", "BMW", 200.0, 3e5)]


def test_grouping_sets(spark):
    df = spark.createDataFrame(CUBE, "business string, desk string, product string, issuer string, cr01 double, jtd double")
    sums, dims = [F.sum("jtd").alias("jtd")], ["business", "desk", "product"]
    sets = [["business"], ["business", "desk"], ["business", "product"]]
    assert (df.cube(*dims).agg(*sums).count(), df.rollup(*dims).agg(*sums).count()) == (16, 7)
    one = aggregates.grouping_sets(df, sets, dims, sums)
    assert one.count() == 5
    changes = aggregates.grouping_sets_of_changes(df.withColumn("op", F.lit("+I")), sets, dims, {"jtd": ("jtd", aggregates.Sum(2))})
    assert {tuple(r) for r in one.select(*dims, "gset", "jtd").collect()} == {tuple(r) for r in changes.select(*dims, "gset", "jtd").collect()}


def test_multi_left(spark):
    left = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6)], "n int, seq int")
    left = changelog.latest(left, ["n"], ["seq"]).drop("seq")
    one = spark.createDataFrame([(x,) for x in (2, 4, 6, 8, 10)], "a int").withColumn("n", F.expr("a div 2").cast("int"))
    two = spark.createDataFrame([(x,) for x in (1, 4, 9, 16, 25)], "b int").withColumn("n", F.sqrt("b").cast("int"))
    assert sorted(map(tuple, joins.multi_left(left, [one, two], ["n"]).collect())) == [(1, 2, 1), (2, 4, 4), (3, 6, 9), (4, 8, 16), (5, 10, 25)]


def test_risk_cardinality_and_flow(spark):
    n = 1000
    flow = issuer_risk_flow(generators.issuers(spark, n, 100), generators.accounts(spark, 50), generators.positions(spark, n, 50), generators.batch_risk(spark, n, n), generators.thresholds(spark, 100))
    assert flow.lines.count() == 25_800
    total = flow.lines.agg(F.sum(F.col("JTD").cast("decimal(18,4)")).cast("double")).first()[0]
    assert math.isclose(flow.by_parent.agg(F.sum("JTD")).first()[0], total, abs_tol=1e-3)
    assert flow.utilization.count() == flow.by_parent.count()
    assert flow.by_set.count() > 0 and flow.rolldown.count() > 0
    assert generators.issuer_risk(spark, 10, 5).count() == 10 and readers.sequence(spark, 3).count() == 3 and readers.empty(spark, "a int").count() == 0


def test_utilisation_of_nothing_is_null(spark):
    from driftline.functions.scalars import utilization

    assert [r[0] for r in spark.sql("SELECT 1D AS a, 0D AS b UNION ALL SELECT -5D, 10D").select(utilization(F.col("a"), F.col("b"))).collect()] == [None, 50.0]


RISKS = {
    "aggregation": ([("IBM", "T1", 100, 1), ("IBM", "T2", -50, 2)], {"IBM": 50}),
    "duplicate": ([("IBM", "T1", 100, 1), ("IBM", "T1", 100, 2)], {"IBM": 100}),
    "several issuers": ([("IBM", "T1", 100, 1), ("IBM", "T2", -50, 2), ("MSFT", "T3", 1000, 3)], {"IBM": 50, "MSFT": 1000}),
    "amount update": ([("IBM", "T1", 100, 1), ("IBM", "T2", -50, 2), ("IBM", "T2", -100, 3)], {"IBM": 0}),
    "out of order": ([("IBM", "T1", 100, 1), ("IBM", "T2", -50, 3), ("IBM", "T2", -100, 2)], {"IBM": 50}),
    "issuer changes": ([("IBM", "T1", 100, 1), ("IBM", "T2", -50, 2), ("MSFT", "T3", 1000, 3), ("MSFT", "T2", -50, 4)], {"IBM": 100, "MSFT": 950}),
}


@pytest.mark.parametrize("name", RISKS)
def test_risk_behaviour(spark, name):
    rows, expected = RISKS[name]
    df = spark.createDataFrame([(*r, "+U") for r in rows], "issuer string, uid string, jtd int, ts int, op string")
    changes = changelog.to_changelog(df, ["uid"], ["ts"], suppress_equal=True)
    out = aggregates.aggregate(changes, ["issuer"], {"jtd": ("jtd", aggregates.Sum())})
    assert {r.issuer: r.jtd for r in out.collect()} == expected


def test_changelog_invariant(spark):
    import random

    r = random.Random(5)
    rows = [(r.randrange(6), i, r.choice(["+U", "+U", "-D"]), r.randrange(4)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, seq int, op string, v int")
    snapshot = sorted(map(tuple, changelog.materialize(df, ["k"], ["seq"]).select("k", "v").collect()))
    live = {}
    for k, _, op, v in rows:
        live.pop(k, None) if op == "-D" else live.__setitem__(k, v)
    assert snapshot == sorted(live.items())
    for suppress in (False, True):
        changes = changelog.to_changelog(df, ["k"], ["seq"], suppress)
        weights = changes.groupBy("k", "v").agg(F.sum(changelog.weight()).alias("w")).filter("w <> 0").collect()
        assert sorted((x.k, x.v, x.w) for x in weights) == [(k, v, 1) for k, v in snapshot]


def test_diff_and_modes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    changes = changelog.diff(old, new, ["k"])
    assert sorted(map(tuple, changes.collect())) == [(1, "-D", "a"), (2, "+U", "c"), (2, "-U", "b"), (4, "+I", "d")]
    assert {r.op for r in changelog.to_append(changes).collect()} == {"+I"}
    assert {r.op for r in changelog.to_keyed(changes).collect()} == {"+U", "-D"}


def test_nested_records_round_trip(spark, tmp_path):
    df = spark.sql("SELECT 1L AS l, 'a' AS s, null AS n, named_struct('x', 1.5D, 'y', cast(null AS string)) AS r, array(named_struct('Date', date'2020-01-01', 'JTD', 2D)) AS list, map('JTD', 3D) AS m").withColumn("n", F.col("n").cast("double"))
    df.write.parquet(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).collect() == df.collect()


def test_repeated_output_names_are_refused(spark):
    with pytest.raises(ValueError):
        aggregates.aggregate(spark.createDataFrame([(1, 2)], "a int, b int"), ["a"], [F.sum("b").alias("a")])


def test_concatenation_of_all_rows(spark):
    from driftline import queries

    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet").collect()
    got = sorted(tuple(r) for r in queries.QUERIES["concatenated_events"](spark, folder).collect())
    assert got == sorted((e.user_id, int(e.event_type != "signup"), e.event_id) for e in events)
