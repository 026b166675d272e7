"""Live operators: the same input in one or several micro-batches leads to the same snapshot as the batch form."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from driftline.operators import aggregates, changelog, joins
from driftline.schemas import ROLLDOWN
from driftline.sources.readers import files
from driftline.streaming import processors, sinks


def feed(spark, folder, df, parts):
    """df's rows as a stream of so many files, in the order of seq."""
    rows = df.orderBy("seq").collect()
    for i in range(parts):
        own = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(own, df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    return files(spark, str(folder), df.schema)


def changes_of(df, tmp_path):
    sinks.to_batches(df, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    return df.sparkSession.read.parquet(str(tmp_path / "out"))


def live(changes, columns):
    """Rows whose additions exceed their retractions."""
    out = changes.groupBy(*columns).agg(F.sum(changelog.weight()).alias("w")).filter("w <> 0").collect()
    assert all(r.w == 1 for r in out)
    return sorted(tuple(r[c] for c in columns) for r in out)


@pytest.fixture
def upserts(spark):
    r = random.Random(3)
    return spark.createDataFrame([(r.randrange(5), i, r.choice(["+U", "+U", "-D"]), r.randrange(3), float(r.randrange(9))) for i in range(60)], "k int, seq int, op string, g int, v double")


@pytest.mark.parametrize("parts", [1, 3])
def test_normalize(spark, tmp_path, upserts, parts):
    got = changes_of(processors.normalize(feed(spark, tmp_path / "in", upserts, parts), ["k"], ["seq"]), tmp_path)
    wanted = changelog.to_changelog(upserts, ["k"], ["seq"])
    assert sorted(map(tuple, got.select(wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("parts", [1, 3])
def test_live_join(spark, tmp_path, upserts, parts):
    left = changelog.to_changelog(upserts, ["k"], ["seq"])
    right = spark.createDataFrame([(i % 3, i, "+U", f"name{i}") for i in range(7)], "g int, seq int, op string, name string")
    joined = processors.live_join(feed(spark, tmp_path / "left", left, parts), feed(spark, tmp_path / "right", right, parts), ["g"], ["k"], ["seq"])
    wanted = joins.many_to_one(changelog.materialize(upserts, ["k"], ["seq"]), changelog.latest(right, ["g"], ["seq"]).drop("seq", "op"), ["g"])
    assert live(changes_of(joined, tmp_path), ["g", "k", "v", "name"]) == sorted(tuple(r) for r in wanted.select("g", "k", "v", "name").collect())


@pytest.mark.parametrize("parts", [1, 3])
def test_live_join_keeps_rows_that_are_updated_to_equal_values(spark, tmp_path, parts):
    left = spark.createDataFrame([(1, 0, 1, "+I", 5.0), (1, 1, 2, "-U", 5.0), (1, 2, 2, "+U", 5.0)], "k int, seq int, at int, op string, v double").withColumn("g", F.lit(7))
    right = spark.createDataFrame([(7, 0, 0, "+U", "name")], "g int, seq int, at int, op string, name string")
    joined = processors.live_join(feed(spark, tmp_path / "left", left, parts).drop("seq"), feed(spark, tmp_path / "right", right, 1).drop("seq"), ["g"], ["k"], ["at"])
    assert live(changes_of(joined, tmp_path), ["g", "k", "v", "name"]) == [(7, 1, 5.0, "name")]


@pytest.mark.parametrize("parts", [1, 2])
def test_multi_left(spark, tmp_path, parts):
    sides = [spark.createDataFrame([(i % 4 if j == 0 else i % 6, i, "+U", i * (j + 1)) for i in range(9)], f"k int, seq int, op string, v{j} int") for j in range(3)]
    streams = [feed(spark, tmp_path / f"in{j}", s, parts) for j, s in enumerate(sides)]
    got = changes_of(processors.multi_left(streams, ["k"], ["seq"], {0: lambda a, b: a != b}), tmp_path)
    last = [changelog.latest(s, ["k"], ["seq"]).drop("seq", "op") for s in sides]
    wanted = joins.multi_left(last[0], last[1:], ["k"]).select("k", "v0", "v1", "v2").collect()
    assert live(got, ["k", "v0", "v1", "v2"]) == sorted(map(tuple, wanted))


def test_gate_releases_the_latest(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "id string, seq int, v string")
    ids = spark.createDataFrame([("a", 4)], "id string, seq int")
    out = processors.gate(feed(spark, tmp_path / "rows", rows, 1), feed(spark, tmp_path / "ids", ids, 1), "id", ["seq"])
    assert [(r.id, r.v) for r in changes_of(out, tmp_path).collect()] == [("a", "y")]


def test_sums(spark, tmp_path, upserts):
    changes = changelog.to_changelog(upserts, ["k"], ["seq"])
    got = changes_of(processors.throttled_sums(feed(spark, tmp_path / "in", changes, 2), ["g"], ["v"]), tmp_path)
    wanted = aggregates.aggregate(changes, ["g"], {"v": ("v", aggregates.Sum())})
    assert live(got, ["g", "v"]) == sorted(tuple(r) for r in wanted.collect())


ALL = {"total": ("v", aggregates.Sum(4)), "last": ("v", aggregates.Last("seq"))}


@pytest.mark.parametrize("parts", [1, 4])
def test_sums_and_last_with_nulls_and_retraction(spark, tmp_path, upserts, parts):
    rows = upserts.withColumn("v", F.when(F.col("seq") % 7 != 0, F.col("v") + F.lit(0.1)))
    changes = changelog.to_changelog(rows, ["k"], ["seq"])
    got = changes_of(processors.live_aggregate(feed(spark, tmp_path / "in", changes, parts), ["g"], ALL, ["seq", "op"]), tmp_path)
    wanted = aggregates.aggregate(changes, ["g"], ALL)
    assert live(got, ["g", "total", "last"]) == sorted((tuple(r) for r in wanted.collect()), key=str)


def test_keys_without_rows_go(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "+I", 0.1), ("a", 1, "-D", 0.1), ("b", 2, "+I", None), ("a", 3, "+I", 0.2)], "g string, seq int, op string, v double")
    got = changes_of(processors.live_aggregate(feed(spark, tmp_path / "in", rows, 4), ["g"], {"total": ("v", aggregates.Sum(4))}, ["seq"]), tmp_path)
    assert sorted(((r.g, r.op, r.total) for r in got.collect()), key=str) == sorted([("a", "+I", 0.1), ("a", "-D", 0.1), ("b", "+I", None), ("a", "+I", 0.2)], key=str)


class Product(aggregates.Plain):
    """An aggregation of a user's own: the product of what is live."""

    def batch(self, value, w):
        return F.product(F.pow(value, w))

    def init(self, value, retract):
        return 1 / value if retract else value

    def update(self, value, accumulator, retract):
        return accumulator * self.init(value, retract)

    def nothing(self, accumulator):
        return accumulator == 1


@pytest.mark.parametrize("parts", [1, 3])
def test_own_aggregations(spark, tmp_path, parts):
    rows = spark.createDataFrame([("a", 0, "+I", 2.0), ("a", 1, "+I", 8.0), ("a", 2, "-D", 2.0), ("b", 3, "+I", 4.0)], "g string, seq int, op string, v double")
    aggs = {"product": ("v", Product())}
    got = changes_of(processors.live_aggregate(feed(spark, tmp_path / "in", rows, parts), ["g"], aggs, ["seq"]), tmp_path)
    assert live(got, ["g", "product"]) == [("a", 8.0), ("b", 4.0)] == sorted(map(tuple, aggregates.aggregate(rows, ["g"], aggs).collect()))


@pytest.mark.parametrize("parts", [1, 3])
def test_live_rolldowns(spark, tmp_path, parts):
    from datetime import date

    step = lambda *x: [(date(2020, 1, d), v) for d, v in x]
    rows = [("a", 0, "+I", step((1, 100.25), (6, 0.0))), ("a", 1, "+I", step((4, 0.0), (1, 200.0))), ("b", 2, "+I", step((1, 5.0), (1, 7.0), (3, 0.0))), ("a", 3, "-D", step((1, 100.25), (6, 0.0))), ("b", 4, "+I", None)]
    df = spark.createDataFrame(rows, f"g string, seq int, op string, f {ROLLDOWN}")
    got = changes_of(processors.live_aggregate(feed(spark, tmp_path / "in", df, parts), ["g"], {"f": ("f", aggregates.Rolldown())}, ["seq"]), tmp_path)
    wanted = aggregates.rolldown_sum(aggregates.rolldown_deltas(df, "f", changelog.weight()), ["g"]).collect()
    found = live(got.select("g", "op", F.explode("f").alias("x")).select("g", "op", F.col("x.Date").alias("date"), F.col("x.JTD").alias("jtd")), ["g", "date", "jtd"])
    assert found == sorted(tuple(r) for r in wanted)


CUBE = [("FLOW", "NAM.IG", "CDS", "IBM", 1000.0, 1e6), ("FLOW", "NAM.IG", "BOND", "IBM", 500.0, 4e5), ("FLOW", "EMEA.IG", "BOND", "BMW", 200.0, 3e5)]
DIMS = ["business", "desk", "product"]
SETS = {
    "cube": ([list(x) for n in range(4) for x in itertools.combinations(DIMS, n)], 32),
    "rollup": ([DIMS[:n] for n in range(4)], 17),
    "sets": ([["business"], ["business", "desk"], ["business", "product"]], 13),
}


@pytest.mark.parametrize("name", SETS)
def test_live_grouping_sets(spark, tmp_path, name):
    """Changes of three rows that come one by one, and the snapshot that they lead to."""
    rows = [(*r, i, "+I") for i, r in enumerate(CUBE)]
    df = spark.createDataFrame(rows, "business string, desk string, product string, issuer string, cr01 double, jtd double, seq int, op string")
    (sets, n), aggs = SETS[name], {"cr01": ("cr01", aggregates.Sum(4)), "jtd": ("jtd", aggregates.Sum(4))}
    got = changes_of(processors.live_grouping_sets(feed(spark, tmp_path / "in", df, 3), sets, DIMS, aggs), tmp_path)
    assert got.count() == n
    wanted = aggregates.grouping_sets_of_changes(df, sets, DIMS, aggs).select(*DIMS, "gset", "cr01", "jtd").collect()
    found = got.groupBy(*DIMS, "gset", "cr01", "jtd").agg(F.sum(changelog.weight()).alias("w")).filter("w <> 0").drop("w").collect()
    assert sorted(map(str, found)) == sorted(map(str, wanted))


def following(df, name, tmp_path, every="1 second"):
    """A query that goes on, into memory."""
    return df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(processingTime=every).start()


def wait_for(spark, name, n, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if len(found := [tuple(r) for r in spark.table(name).collect()]) >= n:
            return found
        time.sleep(0.5)
    return found


def test_throttle_coalesces_and_arms_again(spark, tmp_path):
    """Three changes of one key within the interval are published once, when the timer fires; later changes arm it again."""
    schema = "g string, seq int, op string, v double"
    first = spark.createDataFrame([("IBM", i, "+I", v) for i, v in enumerate((200.0, 100.0, 50.0))], schema)
    out = processors.throttled_sums(feed(spark, tmp_path / "in", first, 1), ["g"], ["v"], 500)
    query = following(out, "throttled", tmp_path)
    try:
        assert wait_for(spark, "throttled", 1) == [("IBM", "+I", 350.0)]
        for more in ([("IBM", 3, "+I", 1.0), ("IBM", 4, "+I", 2.0)], [("IBM", 5, "-D", 350.0), ("IBM", 6, "-D", 1.0), ("IBM", 7, "-D", 2.0), ("IBM", 8, "+I", 9.0)]):
            n = spark.table("throttled").count()
            spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            found = wait_for(spark, "throttled", n + 2)
        assert found[1:3] == [("IBM", "-U", 350.0), ("IBM", "+U", 353.0)] and found[3:] == [("IBM", "-U", 353.0), ("IBM", "+U", 9.0)]
    finally:
        query.stop()


def test_states_expire(spark, tmp_path):
    """An upsert after its key's state has expired is an insert again."""
    schema = "k int, seq int, op string, v double"
    query = following(processors.normalize(feed(spark, tmp_path / "in", spark.createDataFrame([(1, 0, "+U", 1.0)], schema), 1), ["k"], ["seq"], ttl_ms=3000), "expiring", tmp_path)
    try:
        assert [r[2] for r in wait_for(spark, "expiring", 1)] == ["+I"]
        time.sleep(5)
        spark.createDataFrame([(1, 1, "+U", 2.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert [r[2] for r in wait_for(spark, "expiring", 2)] == ["+I", "+I"]
    finally:
        query.stop()


@pytest.mark.parametrize("parts", [1, 3])
def test_live_one_to_one(spark, tmp_path, upserts, parts):
    left = changelog.to_changelog(upserts, ["k"], ["seq"])
    right = spark.createDataFrame([(i % 3, i, "+U", f"name{i}") for i in range(7)], "k int, seq int, op string, name string")
    joined = processors.live_one_to_one(feed(spark, tmp_path / "left", left, parts), feed(spark, tmp_path / "right", right, parts), ["k"], ["seq"])
    wanted = joins.one_to_one(changelog.materialize(upserts, ["k"], ["seq"]).drop("seq"), changelog.latest(right, ["k"], ["seq"]).drop("seq", "op"), ["k"])
    assert live(changes_of(joined, tmp_path), ["k", "g", "v", "name"]) == sorted(tuple(r) for r in wanted.select("k", "g", "v", "name").collect())


@pytest.mark.parametrize("parts", [1, 2])
def test_joins_that_combine_rows(spark, tmp_path, parts):
    """A user's own join output: as many rows as the right side says."""
    left = spark.createDataFrame([(1, 0, "+U", "a"), (2, 1, "+U", "b")], "k int, seq int, op string, v string")
    right = spark.createDataFrame([(1, 0, "+U", 2), (2, 1, "+U", 0), (1, 2, "+U", 3)], "k int, seq int, op string, n int")
    joined = processors.live_one_to_one(feed(spark, tmp_path / "left", left, parts), feed(spark, tmp_path / "right", right, parts), ["k"], ["seq"], combine=lambda x, y: [(f"{x[0]}{i}",) for i in range(y[0])], result="made string")
    assert live(changes_of(joined, tmp_path), ["k", "made"]) == [(1, "a0"), (1, "a1"), (1, "a2")]
    batch = joins.one_to_one(left.drop("seq", "op"), changelog.latest(right, ["k"], ["seq"]).drop("seq", "op"), ["k"], combine=lambda df: df.select("k", F.explode(F.expr("transform(filter(sequence(0, n), i -> i < n), i -> concat(v, i))")).alias("made")))
    assert sorted(map(tuple, batch.collect())) == [(1, "a0"), (1, "a1"), (1, "a2")]


@pytest.mark.parametrize("later, kept", [(None, "new"), (lambda held, new: new["v"] < held["v"], "low")])
def test_gate_holds_what_is_later(spark, tmp_path, later, kept):
    rows = spark.createDataFrame([("a", 5, "new"), ("a", 2, "low"), ("a", 3, "mid")], "id string, at int, v string").withColumn("seq", F.monotonically_increasing_id())
    ids = spark.createDataFrame([("a", 4)], "id string, seq int")
    source = feed(spark, tmp_path / "rows", rows, 3).drop("seq")
    out = processors.gate(source, feed(spark, tmp_path / "ids", ids.limit(0), 1).select("id"), "id", ["at"], later)
    folder, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    sinks.to_batches(out, folder, checkpoint).awaitTermination()
    ids.coalesce(1).write.mode("append").parquet(str(tmp_path / "ids"))
    sinks.to_batches(out, folder, checkpoint).awaitTermination()
    assert [r.v for r in spark.read.parquet(folder).collect()] == [kept]
    spark.createDataFrame([("a", 1, "old", 9)], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    sinks.to_batches(out, folder, checkpoint).awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(folder).collect()) == sorted([kept, "old"])


@pytest.mark.parametrize("parts", [1, 3])
def test_issuer_updates_reach_their_lines(spark, tmp_path, parts):
    line = "array<struct<issuer:int,jtd:double>>"
    batches = spark.createDataFrame([("T1", 1, [(1, 10.0), (2, 20.0)]), ("T2", 2, [(1, 5.0)]), ("T1", 5, [(2, 20.0), (3, 1.0)])], f"uid string, seq int, lines {line}")
    positions = spark.createDataFrame([("T1", 3, "CDS"), ("T2", 4, "Bond"), ("T2", 6, "CDX")], "uid string, seq int, product string")
    issuers = spark.createDataFrame([(1, 1, "+U", "one"), (2, 2, "+U", "two"), (2, 7, "+U", "two again"), (1, 8, "+U", "one again"), (3, 9, "+U", "three"), (3, 10, "-D", "three")], "issuer int, seq int, op string, name string")
    out = processors.live_risk_lines(*[feed(spark, tmp_path / n, x, parts) for n, x in (("b", batches), ("p", positions), ("i", issuers))], ["uid"], ["seq"], "lines", "issuer")
    sinks.to_batches(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"), mode="append").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    known = changelog.materialize(issuers, ["issuer"], ["seq"]).drop("seq").withColumnRenamed("issuer", "id")
    wanted = joins.risk_lines(batches, positions, known, ["uid"], "issuer", "lines", "id", ["seq"], ["seq"])
    columns = ["uid", "product", "issuer", "jtd", "name"]
    assert live(got, columns) == sorted(tuple(r) for r in wanted.select(*columns).collect())
    if parts > 1:
        assert got.filter("name = 'two' AND op = '-U'").count() == got.filter("name = 'two again' AND op = '+U'").count() == 1


def test_nested_values_are_compared_and_kept(spark, tmp_path):
    schema = "k int, seq int, op string, line struct<issuer:string,steps:array<struct<Date:date,JTD:double>>>"
    day = __import__("datetime").date(2020, 1, 1)
    one, two = ("IBM", [(day, 1.0)]), ("IBM", [(day, 2.0)])
    rows = spark.createDataFrame([(1, 0, "+U", one), (1, 1, "+U", one), (1, 2, "+U", two), (1, 3, "+U", two)], schema)
    got = changes_of(processors.normalize(feed(spark, tmp_path / "in", rows, 4), ["k"], ["seq"], suppress_equal=True), tmp_path)
    assert sorted((r.seq, r.op, r.line.steps[0].JTD) for r in got.collect()) == [(0, "+I", 1.0), (2, "+U", 2.0), (2, "-U", 1.0)]
    with pytest.raises(TypeError):
        processors.normalize(rows.withColumn("limits", F.create_map(F.lit("JTD"), F.lit(5.0))), ["k"], ["seq"])


def test_types_of_one_uid_stay_apart(spark, tmp_path):
    rows = spark.createDataFrame([("UIPID", "1", 0, "+U", 5.0), ("UITID", "1", 1, "+U", 7.0), ("UIPID", "1", 2, "+U", 6.0)], "type string, uid string, seq int, op string, v double")
    got = changes_of(processors.normalize(feed(spark, tmp_path / "in", rows, 3), ["type", "uid"], ["seq"]), tmp_path)
    assert live(got, ["type", "uid", "v"]) == [("UIPID", "1", 6.0), ("UITID", "1", 7.0)]
    assert sorted(map(tuple, changelog.latest(rows, ["type", "uid"], ["seq"]).select("type", "v").collect())) == [("UIPID", 6.0), ("UITID", 7.0)]


@pytest.mark.parametrize("parts", [1, 2])
def test_risk_join(spark, tmp_path, parts):
    line = "array<struct<issuer:int,jtd:double>>"
    batches = spark.createDataFrame([("T1", 1, [(1, 10.0), (2, 20.0)]), ("T2", 2, [(1, 5.0)]), ("T1", 5, [(2, 20.0), (3, 1.0)])], f"uid string, seq int, lines {line}")
    positions = spark.createDataFrame([("T1", 3, "CDS"), ("T2", 4, "Bond"), ("T2", 6, "CDX")], "uid string, seq int, product string")
    out = processors.batch_lines(feed(spark, tmp_path / "b", batches, parts), feed(spark, tmp_path / "p", positions, parts), ["uid"], ["seq"], "lines")
    wanted = joins.risk_lines(batches, positions, spark.createDataFrame([(1,), (2,), (3,)], "id int"), ["uid"], "issuer", "lines", "id", ["seq"], ["seq"])
    assert live(changes_of(out, tmp_path), ["uid", "product", "issuer", "jtd"]) == sorted(tuple(r) for r in wanted.select("uid", "product", "issuer", "jtd").collect())
