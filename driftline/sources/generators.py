"""Deterministic generators of the issuer-risk domain, by hashes instead of random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from ..schemas import PRODUCT_TYPES, ROLLDOWN

#: Lines of an index's batch; they cover the issuers from 0.
INDEX_LINES = 125
#: Thresholds, strategies. Fixed values.
JTD_LIMITS = (25e6, 50e6, 100e6, 200e6)
CR01_LIMITS = (25e3, 50e3, 100e3)
STRATEGIES = ("001", "002", "097", "78E", "78F")


def pick(values: tuple, *parts: Column, seed: int) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.floor(uniform(*parts, seed=seed) * len(values)).cast("int")]


def uid_type(i: Column, limit: int) -> Column:
    return F.when(i < limit // 5, "UIPID").otherwise("UITID")


def is_index(i: Column, limit: int) -> Column:
    return (uid_type(i, limit) == "UITID") & (i % 4 == 0)


def measure(i: Column, size: float, seed: int) -> Column:
    return (uniform(i, seed=seed) * 2 - 1) * size


def issuer_of(i: Column, issuers: int) -> Column:
    return F.when(i % 2 == 0, i % max(1, issuers // 10)).otherwise(i % issuers).cast("string")


def rolldown(i: Column, jtd: Column, today: str) -> Column:
    """The whole jtd today, nothing later."""
    day = F.lit(today).cast("date")
    return F.array(F.struct(day.alias("Date"), jtd.alias("JTD")), F.struct(F.date_add(day, (97 * i % 20).cast("int")).alias("Date"), F.lit(0.0).alias("JTD")))


def numbers(spark: SparkSession, limit: int, audit: int = 0, per_second: int | None = None) -> DataFrame:
    """id from 0 below limit and audit; with per_second an endless stream that begins again after limit, audit being its count."""
    if per_second is None:
        return spark.range(limit).withColumn("audit", F.lit(audit).cast("long"))
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.select((F.col("value") % limit).alias("id"), (F.col("value") + audit).alias("audit"))


def issuer_risk(spark: SparkSession, limit: int, issuers: int, today: str = "2020-01-01", audit: int = 0, per_second: int | None = None) -> DataFrame:
    i = F.col("id")
    return numbers(spark, limit, audit, per_second).select(
        uid_type(i, limit).alias("UIDType"), i.cast("string").alias("UID"), issuer_of(i, issuers).alias("SMCI"), F.lit(today.replace("-", "")).alias("BusinessDate"),
        measure(i, 1e3, 1).alias("CR01"), measure(i, 1e6, 2).alias("JTD"), F.array().cast(ROLLDOWN).alias("JTDRolldown"), F.col("audit").alias("AuditDateTimeUTC"),
    )


def batch_risk(spark: SparkSession, limit: int, issuers: int, today: str = "2020-01-01", audit: int = 0, per_second: int | None = None) -> DataFrame:
    """One batch a position: of an index so many lines, else one."""
    i = F.col("id")

    def line(issuer: Column, n: Column) -> Column:
        salted = i * INDEX_LINES + n
        jtd = measure(salted, 1e6, 4)
        return F.struct(issuer.alias("SMCI"), measure(salted, 1e3, 3).alias("CR01"), jtd.alias("JTD"), rolldown(i, jtd, today).alias("JTDRolldown"))

    index = F.transform(F.sequence(F.lit(0), F.lit(INDEX_LINES - 1)), lambda n: line(n.cast("string"), n))
    single = F.array(line(issuer_of(i, issuers), F.lit(0)))
    return numbers(spark, limit, audit, per_second).select(
        uid_type(i, limit).alias("UIDType"), i.cast("string").alias("UID"), F.lit(today.replace("-", "")).alias("BusinessDate"), F.col("audit").alias("AuditDateTimeUTC"),
        F.when(is_index(i, limit), index).otherwise(single).alias("risk"),
    )


def positions(spark: SparkSession, limit: int, accounts: int, audit: int = 0) -> DataFrame:
    i = F.col("id")
    account = F.floor(uniform(i, seed=5) * uniform(i, seed=6) * accounts)
    return spark.range(limit).select(
        uid_type(i, limit).alias("UIDType"), i.cast("string").alias("UID"), F.format_string("ACC%06d", account).alias("FirmAccountMnemonic"), pick(PRODUCT_TYPES, i, seed=7).alias("ProductType"), F.lit(audit).cast("long").alias("AuditDateTimeUTC")
    )


def issuers(spark: SparkSession, n: int, ultimates: int) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(i.cast("string").alias("SMCI"), F.concat(F.lit("Issuer "), i).alias("Name"), F.when(i >= ultimates, (i % ultimates).cast("string")).alias("UltimateParentSMCI"))


def thresholds(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    limits = F.create_map(F.lit("JTD"), pick(JTD_LIMITS, i, seed=8), F.lit("CR01"), pick(CR01_LIMITS, i, seed=9))
    return spark.range(n).select(F.lit("Issuer").alias("RiskFactorType"), i.cast("string").alias("RiskFactor"), limits.alias("Thresholds"))


def accounts(spark: SparkSession, n: int, audit: int = 0) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(F.format_string("ACC%06d", i).alias("Mnemonic"), pick(STRATEGIES, i, seed=10).alias("StrategyCode"), F.lit(audit).cast("long").alias("AuditDateTimeUTC"))
