"""Schemas of the issuer-risk domain, and the column names that changelogs use."""

OP, WEIGHT = "op", "w"
INSERT, BEFORE, AFTER, DELETE = "+I", "-U", "+U", "-D"

UID_TYPES = ("UIPID", "UITID")
PRODUCT_TYPES = ("Bond", "CDS", "CDX", "Other")
RISK_FACTOR_TYPES = ("Issuer",)
RISK_MEASURES = ("CR01", "JTD")

ROLLDOWN = "array<struct<Date:date,JTD:double>>"
FIRM_ACCOUNT = "Mnemonic string not null, StrategyCode string not null, AuditDateTimeUTC bigint not null"
ISSUER = "SMCI string not null, Name string not null, UltimateParentSMCI string"
RISK_THRESHOLD = "RiskFactorType string not null, RiskFactor string not null, Thresholds map<string,double> not null"
RISK_THRESHOLD_UTILIZATION = "RiskFactorType string, RiskFactor string, Utilization map<string,struct<Threshold:double,Exposure:double,Utilization:double>>"
RISK_POSITION = "UIDType string, UID string, FirmAccountMnemonic string, ProductType string, AuditDateTimeUTC bigint"
ISSUER_RISK = f"UIDType string, UID string, SMCI string, BusinessDate string, CR01 double, JTD double, JTDRolldown {ROLLDOWN}, AuditDateTimeUTC bigint"
ISSUER_RISK_BATCH = f"UIDType string, UID string, BusinessDate string, AuditDateTimeUTC bigint, risk array<struct<SMCI:string,CR01:double,JTD:double,JTDRolldown:{ROLLDOWN}>>"


def column_name(namespace: str, name: str) -> str:
    """The physical name of a namespaced field."""
    return f"{namespace}_{name}".replace("-", "_").replace(".", "_")
