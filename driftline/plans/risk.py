"""The issuer-risk flow: positions, accounts, issuers and risk to exposures and utilisation of limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import threshold_of, utilization
from ..operators.aggregates import Last, Sum, aggregate, grouping_sets, rolldown_deltas, rolldown_sum
from ..operators.joins import default_parent, gate, many_to_one, one_to_one, risk_lines


@dataclass(frozen=True)
class Flow:
    lines: DataFrame
    by_issuer: DataFrame
    by_set: DataFrame
    by_parent: DataFrame
    rolldown: DataFrame
    utilization: DataFrame


def issuers_with_parent(issuers: DataFrame, used: DataFrame) -> DataFrame:
    """Used issuers (id, name, parent) with their ultimate parent's id and name."""
    named = issuers.select(F.col("SMCI").alias("issuer_id"), F.col("Name").alias("issuer_name"), default_parent("UltimateParentSMCI", "SMCI").alias("parent_id"))
    parents = named.filter(F.col("issuer_id") == F.col("parent_id")).select("parent_id", F.col("issuer_name").alias("parent_name"))
    return many_to_one(gate(named, used, "issuer_id", "issuer_id"), parents, ["parent_id"])


def issuer_risk_flow(issuers: DataFrame, accounts: DataFrame, positions: DataFrame, batches: DataFrame, thresholds: DataFrame) -> Flow:
    """Inputs as in schemas; of each key the row with the latest audit time counts."""
    uid = ["UIDType", "UID"]
    used = batches.select(F.explode("risk.SMCI").alias("issuer_id")).distinct()
    dimension = issuers_with_parent(issuers, used)
    held = many_to_one(positions.withColumnRenamed("FirmAccountMnemonic", "Mnemonic"), accounts.select("Mnemonic", "StrategyCode"), ["Mnemonic"])
    lines = risk_lines(batches, held.drop("AuditDateTimeUTC"), dimension, uid, "SMCI", "risk", "issuer_id", ["AuditDateTimeUTC"])
    dims = ["parent_id", "SMCI", "ProductType"]
    by_issuer = aggregate(lines, dims, {"CR01": ("CR01", Sum(4)), "JTD": ("JTD", Sum(4)), "issuer_name": ("issuer_name", Last("issuer_name")), "parent_name": ("parent_name", Last("parent_name"))})
    sums = [F.sum(F.col(c).cast("decimal(18,4)")).cast("double").alias(c) for c in ("CR01", "JTD")]
    by_set = grouping_sets(by_issuer, [["parent_id", "SMCI"], ["parent_id", "ProductType"]], dims, sums)
    by_parent = aggregate(by_issuer, ["parent_id"], {"CR01": ("CR01", Sum(4)), "JTD": ("JTD", Sum(4)), "parent_name": ("parent_name", Last("parent_name"))})
    rolldown = rolldown_sum(rolldown_deltas(lines.select(*dims, "JTDRolldown"), "JTDRolldown"), dims, digits=4)
    limits = thresholds.filter(F.col("RiskFactorType") == "Issuer").select(F.col("RiskFactor").alias("parent_id"), threshold_of(F.col("Thresholds"), "CR01").alias("CR01_threshold"), threshold_of(F.col("Thresholds"), "JTD").alias("JTD_threshold"))
    used_limits = one_to_one(by_parent, limits, ["parent_id"]).select("*", *[utilization(F.col(m), F.col(f"{m}_threshold")).alias(f"{m}_utilization") for m in ("CR01", "JTD")])
    return Flow(lines, by_issuer, by_set, by_parent, rolldown, used_limits)
