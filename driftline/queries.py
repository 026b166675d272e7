"""Queries over the driver's tables, and the SQL each of them must match.

Suppliers stand for issuers, customers for accounts, orders for positions, an order's line items for a batch of risk;
events are a changelog by user in which an error deletes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import utilization
from .operators import aggregates, changelog, joins
from .sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LINE_ORDER = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
MONEY = "decimal(18,2)"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def events_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "-D").otherwise("+U").alias("op"), "event_type", "value")


EVENTS = "SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN '-D' ELSE '+U' END AS op, event_type, value FROM events"
NORMAL = f"""e AS ({EVENTS}), b AS (SELECT *, lag(op) OVER k AS p_op, lag(event_type) OVER k AS p_type, lag(value) OVER k AS p_value FROM e WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT user_id, ts, event_id, '-U' AS op, p_type AS event_type, p_value AS value FROM b WHERE op = '+U' AND p_op = '+U'
      UNION ALL SELECT user_id, ts, event_id, CASE WHEN p_op = '+U' THEN '+U' ELSE '+I' END, event_type, value FROM b WHERE op = '+U'
      UNION ALL SELECT user_id, ts, event_id, '-D', p_type, p_value FROM b WHERE op = '-D' AND p_op = '+U')"""


def events_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.to_changelog(events_changes(spark, sf_dir), ["user_id"], ["ts", "event_id"])


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as risk lines: signed exposures by issuer."""
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    price, discount = F.col("l_extendedprice").cast(MONEY), F.col("l_discount").cast(MONEY)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("issuer"), (price * discount * sign).alias("cr01"), (price * sign).alias("jtd"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").cast("int").alias("days"), "l_returnflag", "l_linestatus")


RISK = """risk AS (SELECT l_orderkey AS uid, l_linenumber AS line, l_suppkey AS issuer, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS cr01,
    CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS jtd, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS INT) AS days, l_returnflag, l_linestatus FROM lineitem)"""


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.alias("issuer"), F.col("s_name").alias("issuer_name"), joins.default_parent(F.when(s >= 5, s % 5), s).alias("parent"))


ISSUERS = """iss AS (SELECT s_suppkey AS issuer, s_name AS issuer_name, coalesce(CASE WHEN s_suppkey >= 5 THEN s_suppkey % 5 END, s_suppkey) AS parent FROM supplier),
    dim AS (SELECT i.issuer, i.issuer_name, i.parent, p.issuer_name AS parent_name FROM iss i JOIN iss p ON i.parent = p.issuer AND p.issuer = p.parent WHERE i.issuer IN (SELECT l_suppkey FROM lineitem))"""


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = issuers(spark, sf_dir)
    parents = all_.filter(F.col("issuer") == F.col("parent")).select("parent", F.col("issuer_name").alias("parent_name"))
    return joins.many_to_one(joins.gate(all_, table(spark, sf_dir, "lineitem"), "issuer", "l_suppkey"), parents, ["parent"])


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("product"))
    return joins.many_to_one(o, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.col("c_mktsegment").alias("strategy")), ["account"])


POSITIONS = "pos AS (SELECT o_orderkey AS uid, o_custkey AS account, o_orderpriority AS product, c_mktsegment AS strategy FROM orders JOIN customer ON o_custkey = c_custkey)"
LINES = f"{RISK}, {ISSUERS}, {POSITIONS}, lines AS (SELECT * FROM risk JOIN pos USING (uid) JOIN dim USING (issuer))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = joins.small(positions(spark, sf_dir), bound=table(spark, sf_dir, "orders"))
    return joins.many_to_one(joins.many_to_one(risk(spark, sf_dir), held, ["uid"]), joins.small(dimension(spark, sf_dir), bound=table(spark, sf_dir, "supplier")), ["issuer"])


@query("SELECT s_suppkey AS issuer_id, s_name AS issuer_name, s_acctbal AS balance FROM supplier")
def project_rename(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("issuer_id"), F.col("s_name").alias("issuer_name"), F.col("s_acctbal").alias("balance"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def filter_where(spark, sf_dir):
    orders = changelog.from_rows(table(spark, sf_dir, "orders")).where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
    return orders.df.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT *, concat(c_mktsegment, ':', c_custkey) AS c_uid, abs(c_acctbal) AS c_size FROM customer")
def select_star_computed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("*", F.concat_ws(":", "c_mktsegment", "c_custkey").alias("c_uid"), F.abs("c_acctbal").alias("c_size"))


@query(f"WITH {NORMAL} SELECT * FROM n")
def changelog_normalize(spark, sf_dir):
    return events_changelog(spark, sf_dir).select("user_id", "ts", "event_id", "op", "event_type", "value")


@query(f"WITH {NORMAL} SELECT user_id, ts, event_id, '+I' AS op, event_type, value FROM n WHERE op IN ('+I', '+U')")
def append_mode(spark, sf_dir):
    return changelog.to_append(events_changelog(spark, sf_dir))


@query(f"WITH {NORMAL} SELECT user_id, ts, event_id, CASE op WHEN '+I' THEN '+U' ELSE op END AS op, event_type, value FROM n WHERE op <> '-U'")
def keyed_mode(spark, sf_dir):
    return changelog.to_keyed(events_changelog(spark, sf_dir))


@query(f"WITH e AS ({EVENTS}) SELECT user_id, ts, event_id, event_type, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND op = '+U'")
def materialize_latest(spark, sf_dir):
    return changelog.materialize(events_changes(spark, sf_dir), ["user_id"], ["ts", "event_id"])


LATEST_LINE = f"last AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER)}) = 1)"


@query(f"WITH {LATEST_LINE} SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM last")
def latest_by_trade(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE_ORDER)
    return changelog.latest(rows, ["l_orderkey", "l_linenumber"], LINE_ORDER).select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")


@query(f"WITH {LATEST_LINE} SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, s_name, s_nationkey FROM last JOIN supplier ON l_suppkey = s_suppkey")
def live_join_many_to_one(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE_ORDER)
    right = joins.small(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey"))
    return joins.many_to_one(left, right, ["l_suppkey"], ["l_orderkey", "l_linenumber"], LINE_ORDER).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "s_name", "s_nationkey")


@query(f"WITH e AS ({EVENTS}), v AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_type, value, c_name FROM v JOIN customer ON user_id = c_custkey WHERE op = '+U'")
def live_join_one_to_one(spark, sf_dir):
    left = changelog.materialize(events_changes(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    right = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "user_id")
    return joins.one_to_one(left, right, ["user_id"]).select("user_id", "event_type", "value", "c_name")


@query(f"""WITH {RISK}, r AS (SELECT uid, CAST(sum(jtd) AS DOUBLE) AS jtd, count(*) AS n_lines FROM risk GROUP BY uid), v AS (SELECT user_id AS uid, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT o_orderkey AS uid, o_orderpriority AS product, jtd, n_lines, value FROM orders LEFT JOIN r ON o_orderkey = r.uid LEFT JOIN v ON o_orderkey = v.uid""")
def multi_left_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("product"))
    sums = risk(spark, sf_dir).groupBy("uid").agg(F.sum("jtd").cast("double").alias("jtd"), F.count(F.lit(1)).alias("n_lines"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("uid"), "ts", "event_id", "value")
    return joins.multi_left(o, [sums, e], ["uid"], [(), ["ts", "event_id"]]).select("uid", "product", "jtd", "n_lines", "value")


@query("SELECT user_id, ts, event_id, event_type FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER k = 1 OR lag(event_type) OVER k IS DISTINCT FROM event_type")
def change_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return changelog.changed(e, ["user_id"], ["ts", "event_id"], ["event_type"])


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def gate_semi_join(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    return joins.gate(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), ids, "p_partkey", "l_partkey")


@query(f"WITH {LINES} SELECT uid, line, issuer, product, strategy, parent_name, CAST(cr01 AS DOUBLE) AS cr01, CAST(jtd AS DOUBLE) AS jtd FROM lines")
def risk_join_lines(spark, sf_dir):
    """The nested form: a batch of lines for each position, exploded and joined with the issuers."""
    line = F.struct("issuer", "line", F.col("cr01").cast("double").alias("cr01"), F.col("jtd").cast("double").alias("jtd"))
    batches = risk(spark, sf_dir).groupBy("uid").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    nested = batches.withColumn("lines", F.transform("lines", lambda e: F.struct(e["issuer"].alias("issuer"), e["line"].alias("line_number"), e["cr01"].alias("cr01"), e["jtd"].alias("jtd"))))
    out = joins.risk_lines(nested, positions(spark, sf_dir), dimension(spark, sf_dir), ["uid"], "issuer", "lines", "issuer", issuer_bound=table(spark, sf_dir, "supplier"))
    return out.select("uid", F.col("line_number").alias("line"), "issuer", "product", "strategy", "parent_name", "cr01", "jtd")


@query(f"""WITH {RISK}, o AS (SELECT uid, issuer, CAST(sum(jtd) AS DOUBLE) AS jtd FROM risk WHERE line % 2 = 1 GROUP BY ALL), n AS (SELECT uid, issuer, CAST(sum(jtd) AS DOUBLE) AS jtd FROM risk WHERE line % 2 = 0 GROUP BY ALL)
    SELECT uid, issuer, '-D' AS op, o.jtd FROM o ANTI JOIN n USING (uid, issuer) UNION ALL SELECT uid, issuer, '+I', n.jtd FROM n ANTI JOIN o USING (uid, issuer)
    UNION ALL SELECT o.uid, o.issuer, '-U', o.jtd FROM o JOIN n USING (uid, issuer) WHERE o.jtd <> n.jtd UNION ALL SELECT o.uid, o.issuer, '+U', n.jtd FROM o JOIN n USING (uid, issuer) WHERE o.jtd <> n.jtd""")
def risk_join_changelog(spark, sf_dir):
    version = lambda odd: risk(spark, sf_dir).filter(F.col("line") % 2 == odd).groupBy("uid", "issuer").agg(F.sum("jtd").cast("double").alias("jtd"))
    return changelog.diff(version(1), version(0), ["uid", "issuer"]).select("uid", "issuer", "op", "jtd")


@query(f"""WITH {LINES} SELECT parent, issuer, product, CAST(sum(cr01) AS DOUBLE) AS cr01, CAST(sum(jtd) AS DOUBLE) AS jtd, arg_max(l_linestatus, (day, uid, line, l_linestatus)) AS last_status FROM lines GROUP BY ALL""")
def agg_sum_last(spark, sf_dir):
    aggs = {"cr01": ("cr01", aggregates.Sum(4)), "jtd": ("jtd", aggregates.Sum(4)), "last_status": ("l_linestatus", aggregates.Last("day", "uid", "line", "l_linestatus"))}
    return aggregates.aggregate(lines(spark, sf_dir), ["parent", "issuer", "product"], aggs)


@query(f"""WITH {NORMAL} SELECT event_type, CAST(sum(CASE WHEN op IN ('-U', '-D') THEN -1 ELSE 1 END * CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM n GROUP BY event_type HAVING sum(CASE WHEN op IN ('-U', '-D') THEN -1 ELSE 1 END) > 0""")
def agg_retract(spark, sf_dir):
    return aggregates.aggregate_sums(events_changelog(spark, sf_dir), ["event_type"], ["value"], digits=4)


@query(f"WITH {LINES}, a AS (SELECT parent, issuer, product, sum(cr01) AS cr01, sum(jtd) AS jtd FROM lines GROUP BY ALL) SELECT parent, CAST(sum(cr01) AS DOUBLE) AS cr01, CAST(sum(jtd) AS DOUBLE) AS jtd FROM a GROUP BY parent")
def agg_two_level(spark, sf_dir):
    one = aggregates.aggregate_sums(lines(spark, sf_dir), ["parent", "issuer", "product"], ["cr01", "jtd"], digits=4)
    return aggregates.aggregate_sums(one, ["parent"], ["cr01", "jtd"], digits=4)


STEPS = "d AS (SELECT issuer, day AS date, jtd * w AS delta FROM x UNION ALL SELECT issuer, day + days, -jtd * w FROM x), s AS (SELECT issuer, date, sum(delta) AS delta FROM d GROUP BY ALL) SELECT issuer, date, CAST(sum(delta) OVER (PARTITION BY issuer ORDER BY date) AS DOUBLE) AS jtd FROM s"


def rolldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    jtd = F.col("jtd").cast("double")
    steps = F.array(F.struct(F.col("day").alias("Date"), jtd.alias("JTD")), F.struct(F.date_add("day", F.col("days")).alias("Date"), F.lit(0.0).alias("JTD")))
    return risk(spark, sf_dir).select("issuer", "line", steps.alias("rolldown"))


@query(f"WITH {RISK}, x AS (SELECT *, 1 AS w FROM risk), {STEPS}")
def rolldown_sum(spark, sf_dir):
    return aggregates.rolldown_sum(aggregates.rolldown_deltas(rolldowns(spark, sf_dir), "rolldown"), ["issuer"])


@query(f"WITH {RISK}, x AS (SELECT *, CASE WHEN line = 1 THEN -1 ELSE 1 END AS w FROM risk), {STEPS}")
def rolldown_retract(spark, sf_dir):
    w = F.when(F.col("line") == 1, -1).otherwise(1)
    return aggregates.rolldown_sum(aggregates.rolldown_deltas(rolldowns(spark, sf_dir), "rolldown", w), ["issuer"])


SUMS = "CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(*) AS n"


def cube_sums():
    return [F.sum(F.col("l_quantity").cast(MONEY)).cast("double").alias("quantity"), F.count(F.lit(1)).alias("n")]


@query(f"SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS gset, {SUMS} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))")
def grouping_sets(spark, sf_dir):
    return aggregates.grouping_sets(table(spark, sf_dir, "lineitem"), [["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"]], ["l_returnflag", "l_linestatus"], cube_sums())


@query(f"SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS gset, {SUMS} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("gset"), *cube_sums())


@query(f"SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS gset, {SUMS} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("gset"), *cube_sums())


@query(f"""WITH {NORMAL}, g AS (SELECT *, CASE WHEN op IN ('-U', '-D') THEN -1 ELSE 1 END AS w FROM n)
    SELECT event_type, parity, grouping(event_type, parity) AS gset, CAST(sum(w * CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM (SELECT *, user_id % 2 AS parity FROM g) GROUP BY GROUPING SETS ((event_type), (parity), (event_type, parity)) HAVING sum(w) > 0""")
def grouping_sets_retract(spark, sf_dir):
    changes = events_changelog(spark, sf_dir).withColumn("parity", F.col("user_id") % 2)
    return aggregates.grouping_sets_of_changes(changes, [["event_type"], ["parity"], ["event_type", "parity"]], ["event_type", "parity"], {"value": ("value", aggregates.Sum(4))})


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def throttled_agg(spark, sf_dir):
    return aggregates.throttled(table(spark, sf_dir, "events"), ["user_id"], "ts", ["ts", "event_id"], "1 hour").select("user_id", "bucket", "value")


@query(f"""WITH {LINES}, e AS (SELECT parent, parent_name, sum(cr01) AS cr01, sum(jtd) AS jtd FROM lines GROUP BY ALL), t AS (SELECT parent, CAST(cr01 AS DOUBLE) AS cr01, CAST(jtd AS DOUBLE) AS jtd, parent_name, 25000.0::DOUBLE * (1 + parent % 4) AS cr01_threshold, 25000000.0::DOUBLE * (1 + parent % 4) AS jtd_threshold FROM e)
    SELECT *, 100 * abs(cr01 / cr01_threshold) AS cr01_utilization, 100 * abs(jtd / jtd_threshold) AS jtd_utilization FROM t""")
def threshold_utilization(spark, sf_dir):
    """The whole flow: exposure by ultimate parent against its limits."""
    by_parent = aggregates.aggregate_sums(lines(spark, sf_dir), ["parent", "parent_name"], ["cr01", "jtd"], digits=4)
    known = issuers(spark, sf_dir).filter(F.col("issuer") == F.col("parent"))
    limit = lambda size: F.lit(size) * (1 + F.col("parent") % 4)
    thresholds = known.select("parent", F.lit("Issuer").alias("factor"), F.create_map(F.lit("CR01"), limit(25e3), F.lit("JTD"), limit(25e6)).alias("limits"))
    limits = thresholds.filter(F.col("factor") == "Issuer").select("parent", F.col("limits")["CR01"].alias("cr01_threshold"), F.col("limits")["JTD"].alias("jtd_threshold"))
    joined = joins.one_to_one(by_parent, limits, ["parent"])
    return joined.select("parent", "parent_name", "cr01", "jtd", "cr01_threshold", "jtd_threshold", *[utilization(F.col(m), F.col(f"{m}_threshold")).alias(f"{m}_utilization") for m in ("cr01", "jtd")])


@query("SELECT 'customer' AS tag, c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, NULL, s_acctbal FROM supplier")
def union_tagged(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return changelog.tagged_union(customer=c, supplier=s)


@query(f"WITH {ISSUERS} SELECT * FROM dim")
def parent_hierarchy(spark, sf_dir):
    return dimension(spark, sf_dir)


@query("SELECT o_orderkey, o_custkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def two_dimension_join(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.two_dimensions(facts, c, n, "o_custkey", "c_nationkey").select("o_orderkey", "o_custkey", "c_name", "n_name")


@query("SELECT p_type, count(*) AS n_parts, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM part GROUP BY p_type")
def aggregate_passthrough(spark, sf_dir):
    return aggregates.aggregate(table(spark, sf_dir, "part"), ["p_type"], [F.count(F.lit(1)).alias("n_parts"), F.sum(F.col("p_retailprice").cast(MONEY)).cast("double").alias("price")])


@query("SELECT user_id, 0 AS seq, min(event_id) AS id FROM events WHERE event_type = 'signup' GROUP BY user_id UNION ALL SELECT user_id, 1, max(event_id) FROM events WHERE event_type <> 'signup' GROUP BY user_id")
def concatenated_sources(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("id"))
    return changelog.concatenated(first, e.filter("event_type <> 'signup'").groupBy("user_id").agg(F.max("event_id").alias("id"))).select("user_id", "seq", "id")


@query("SELECT user_id, 0 AS seq, event_id FROM events WHERE event_type = 'signup' UNION ALL SELECT user_id, 1, event_id FROM events WHERE event_type <> 'signup'")
def concatenated_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    first, later = e.filter("event_type = 'signup'"), e.filter("event_type <> 'signup'")
    return changelog.concatenated(first.drop("event_type"), later.drop("event_type")).select("user_id", "seq", "event_id")
