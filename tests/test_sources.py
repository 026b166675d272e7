"""Sources, sinks and relations: what starts, names, counts and shows a flow."""

import logging
import threading

import pytest
from pyspark.sql import functions as F

from driftline import schemas
from driftline.functions import scalars
from driftline.operators import changelog
from driftline.sources import generators, readers
from driftline.streaming import processors, sinks

from .test_streaming import wait_for


def test_fields_of_source_objects(spark):
    rows = readers.collection(spark, [(1, "a", [("x", 2.5)]), (2, "b", [])], "id int, name string, parts array<struct<code:string,size:double>>")
    made = changelog.from_rows(rows, key=F.col("id"), code=F.get("parts", F.lit(0))["code"])
    assert made.mode == "append" and [tuple(r) for r in made.df.orderBy("key").collect()] == [(1, "x", "+I"), (2, None, "+I")]


def test_chain_of_sources(spark, tmp_path):
    chain = readers.start(spark, "n int").then([(1,), (2,)]).delay(0.2).then(spark.createDataFrame([(3,)], "n int")).delay(0.1).then([(4,)])
    assert sorted((r.n, r.seq) for r in chain.batch().collect()) == [(1, 0), (2, 0), (3, 1), (4, 2)]
    assert readers.start(spark, "n int").delay(9).batch().count() == 0
    stream = chain.stream(str(tmp_path / "in"))
    player = threading.Thread(target=chain.play, args=(str(tmp_path / "in"),))
    player.start()
    query = stream.writeStream.format("memory").queryName("chained").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        found = wait_for(spark, "chained", 4)
        player.join()
    finally:
        query.stop()
    assert found[:2] in ([(1,), (2,)], [(2,), (1,)]) and found[2:] == [(3,), (4,)]


def test_facts_start_after_what_they_refer_to(spark, tmp_path):
    issuers = readers.start(spark, "issuer int, name string").then([(1, "one")])
    stream = issuers.stream(str(tmp_path / "issuers"))
    issuers.play(str(tmp_path / "issuers"))
    first = readers.bounded(stream.writeStream.format("parquet").option("path", str(tmp_path / "known")).option("checkpointLocation", str(tmp_path / "c1"))).start()
    facts = readers.start(spark, "issuer int, v double").then([(1, 2.0), (5, 1.0)])
    rows = facts.stream(str(tmp_path / "facts"))
    facts.play(str(tmp_path / "facts"))

    def start():
        joined = rows.join(spark.read.parquet(str(tmp_path / "known")), "issuer")
        return readers.bounded(joined.writeStream.format("memory").queryName("facts").option("checkpointLocation", str(tmp_path / "c2"))).start()

    readers.started_after([first], start, 120).awaitTermination()
    assert [tuple(r) for r in spark.table("facts").collect()] == [(1, 2.0, "one")]


def test_endless_generators(spark, tmp_path):
    risk, batches = generators.issuer_risk(spark, 5, 3, per_second=20), generators.batch_risk(spark, 5, 3, per_second=20)
    assert risk.isStreaming and risk.columns == generators.issuer_risk(spark, 5, 3).columns and batches.columns == generators.batch_risk(spark, 5, 3).columns
    rows = risk.select("UID", "SMCI", "CR01", "JTD", "AuditDateTimeUTC").unionByName(batches.select("UID", F.lit(None).cast("string").alias("SMCI"), F.lit(0.0).alias("CR01"), F.size("risk").cast("double").alias("JTD"), "AuditDateTimeUTC"))
    query = sinks.to_memory(rows, "endless", str(tmp_path / "c"), once=False)
    try:
        found = wait_for(spark, "endless", 30)
    finally:
        query.stop()
    known = {(r.UID, r.SMCI): (r.CR01, r.JTD) for r in generators.issuer_risk(spark, 5, 3).collect()}
    own = [r for r in found if r[1] is not None]
    assert own and all(known[r[0], r[1]] == (r[2], r[3]) and int(r[0]) == r[4] % 5 for r in own)
    sizes = {r.UID: len(r.risk) for r in generators.batch_risk(spark, 5, 3).collect()}
    assert all(sizes[r[0]] == r[3] for r in found if r[1] is None)


def test_ticks(spark, tmp_path):
    query = sinks.to_memory(readers.ticks(spark, 10), "ticking", str(tmp_path / "c"), once=False)
    try:
        found = sorted(r[0] for r in wait_for(spark, "ticking", 5))
    finally:
        query.stop()
    assert found == list(range(len(found))) and len(found) >= 5


def test_rows_are_shown_and_counted(spark, tmp_path, capfd, caplog):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    sinks.print_rows(df, "lines")
    assert "lines:" in (shown := capfd.readouterr().out) and "|1  |2.0|" in shown
    seen, observation = sinks.counted(df, "lines", F.sum("v").alias("total"))
    assert seen.count() == 2 and observation.get == {"rows": 2, "total": 5.0}
    readers.start(spark, "k int").then([(i,) for i in range(30)]).play(str(tmp_path / "in"))
    listener = sinks.RateLog(interval=10)
    spark.streams.addListener(listener)
    try:
        with caplog.at_level(logging.INFO, logger="driftline"):
            query = sinks.to_console(readers.files(spark, str(tmp_path / "in"), "k int"), "shown")
            query.processAllAvailable()
            for _ in range(60):
                if caplog.records:
                    break
                query.awaitTermination(0.5)
            query.stop()
    finally:
        spark.streams.removeListener(listener)
    assert "shown" in caplog.text and "rows/s" in caplog.text


def test_relations_carry_mode_and_key(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 1.0), ("a", 3, 6.0)], "k string, seq int, v double")
    plain = changelog.from_rows(rows)
    assert plain.mode == "append" and plain.snapshot().count() == 3
    with pytest.raises(ValueError):
        plain.keyed()
    keyed = plain.keyed_by("k", order=["seq"]).where("v > 0").name("risk")
    assert (keyed.mode, keyed.key) == ("keyed", ("k",)) and spark.sparkContext.getLocalProperty("spark.job.description") == "risk"
    spark.sparkContext.setJobDescription(None)
    assert {r.op for r in keyed.df.collect()} == {"+U"}
    changes = keyed.changelog()
    assert changes.mode == "changelog" and sorted((r.k, r.op, r.v) for r in changes.df.collect()) == [("a", "+I", 5.0), ("a", "+U", 6.0), ("a", "-U", 5.0), ("b", "+I", 1.0)]
    assert sorted((r.k, r.v) for r in changes.snapshot().collect()) == [("a", 6.0), ("b", 1.0)] == sorted((r.k, r.v) for r in changes.keyed().snapshot().collect())
    added = changes.append()
    assert (added.mode, added.key, added.df.count()) == ("append", (), 3)
    assert keyed.select("k", "v").df.columns == ["k", "v", "op"] and changes.select("*").df.columns == changes.df.columns
    assert keyed.df.select("risk.k").count() == 3


def test_names_keys_and_known_values(spark):
    df = spark.createDataFrame([("UIPID", "7"), ("Other", "8")], "type string, uid string")
    out = df.select(scalars.known(F.col("type"), schemas.UID_TYPES).alias("type"), scalars.composite_key(F.col("type"), F.col("uid")).alias("key")).collect()
    assert [tuple(r) for r in out] == [("UIPID", "UIPID:7"), (None, "Other:8")]
    assert schemas.column_name("issuer-risk", "a.b") == "issuer_risk_a_b"
    assert [r.w for r in changelog.with_weight(spark.createDataFrame([("+I",), ("-U",), ("+U",), ("-D",)], "op string")).collect()] == [1, -1, 1, -1]


def test_generated_rows_fit_the_schemas(spark):
    made = {
        schemas.ISSUER_RISK: generators.issuer_risk(spark, 8, 4), schemas.ISSUER_RISK_BATCH: generators.batch_risk(spark, 8, 4), schemas.ISSUER: generators.issuers(spark, 8, 4),
        schemas.RISK_POSITION: generators.positions(spark, 8, 4), schemas.RISK_THRESHOLD: generators.thresholds(spark, 8), schemas.FIRM_ACCOUNT: generators.accounts(spark, 8),
    }
    for schema, df in made.items():
        wanted = spark.createDataFrame([], schema).schema
        assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [(f.name, f.dataType.simpleString()) for f in wanted]
        assert df.to(wanted).count() == 8


def test_facts_wait_for_both_dimensions(spark, tmp_path):
    """Live joins one after another: a fact shows once its account and its issuer are known."""
    facts = spark.createDataFrame([(1, "A", 10, "+U", 0)], "id int, account string, issuer int, op string, seq int")
    accounts = spark.createDataFrame([("A", "fund", "+U", 1)], "account string, strategy string, op string, seq int")
    issuers = spark.createDataFrame([(10, "ten", "+U", 2)], "issuer int, name string, op string, seq int")
    paths = []
    for name, df in (("f", facts), ("a", accounts), ("i", issuers)):
        df.coalesce(1).write.parquet(path := str(tmp_path / name))
        paths.append(readers.files(spark, path, df.schema))
    first = processors.live_join(paths[0], paths[1], ["account"], ["id"], ["seq"], mode="append")
    both = processors.live_join(first, paths[2], ["issuer"], ["id"], ["seq"], mode="append")
    sinks.to_batches(both, str(tmp_path / "out"), str(tmp_path / "c"), mode="append").awaitTermination()
    assert [(r.id, r.account, r.strategy, r.name, r.op) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "A", "fund", "ten", "+I")]
