"""Inputs of the queries, derived from the tables by expressions that read alike in Spark SQL and in other dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str, exprs: list[str]) -> DataFrame:
    """SELECT exprs FROM name."""
    return table(spark, sf_dir, name).selectExpr(*exprs)


def select(name: str, exprs: list[str]) -> str:
    return f"SELECT {', '.join(exprs)} FROM {name}"


MONTH = "CASE month({0}) " + " ".join(f"WHEN {k + 1} THEN '{m}'" for k, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())) + " END"
T = lambda x: f"CAST({x} AS string)"
MDY = "CAST(month({0}) AS string) || '/' || CAST(day({0}) AS string) || '/' || CAST(year({0}) AS string)"
ORDER_DATES = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS date) AS string) END AS src",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN CAST(CAST(o_orderdate + INTERVAL 1 DAY AS date) AS string) ELSE '13/45/2000' END AS available",
    f"CASE o_orderkey % 6 WHEN 0 THEN {MDY.format('o_orderdate')} WHEN 1 THEN lpad({T('month(o_orderdate)')}, 2, '0') || '/' || lpad({T('day(o_orderdate)')}, 2, '0') || '/' || lpad({T('year(o_orderdate) % 100')}, 2, '0')"
    f" WHEN 2 THEN '  ' WHEN 3 THEN CAST(CAST(o_orderdate + INTERVAL 1 DAY AS date) AS string) WHEN 4 THEN '2/30/' || {T('year(o_orderdate)')} ELSE {MONTH.format('o_orderdate')} || ' ' || {T('day(o_orderdate)')} || ', ' || {T('year(o_orderdate)')} END AS ent",
]
BIRTH_DATES = ["o_orderkey", f"CASE WHEN o_orderkey % 3 = 0 THEN {MDY.format('o_orderdate')} ELSE CAST(month(o_orderdate) AS string) || '/' || CAST(day(o_orderdate) AS string) || '/' || lpad(CAST(o_orderkey * 7 % 100 AS string), 2, '0') END AS born"]
LINE_QUANTITIES = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "CASE WHEN l_partkey % 13 = 0 THEN '' ELSE CAST(CAST(l_quantity AS int) AS string) END AS src",
    "CASE l_suppkey % 5 WHEN 0 THEN CAST(CAST(l_quantity AS int) AS string) WHEN 1 THEN CAST(CAST(l_quantity AS int) * 3 AS string) WHEN 2 THEN 'some' WHEN 3 THEN CAST(CAST(l_quantity AS int) AS string) || '.0' ELSE CAST(CAST(l_quantity AS int) + 1 AS string) END AS ent",
    "CASE l_linenumber % 4 WHEN 0 THEN 'Tablets' WHEN 1 THEN 'EA' WHEN 2 THEN NULL ELSE 'mL' END AS src_unit",
    "CASE l_partkey % 4 WHEN 0 THEN 'tab' WHEN 1 THEN 'Each' WHEN 2 THEN 'capsule' ELSE 'ml' END AS ent_unit",
    "CASE l_partkey % 3 WHEN 0 THEN 2.0D WHEN 1 THEN 1.0D END AS per_day",
]
CONTACTS = [
    "c_custkey",
    "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE '(' || CAST(200 + c_custkey % 700 AS string) || ') ' || lpad(CAST(c_custkey % 1000 AS string), 3, '0') || '-' || lpad(CAST(c_custkey * 7 % 10000 AS string), 4, '0') END AS src",
    "CASE c_custkey % 4 WHEN 0 THEN '1' ELSE '' END || CAST(CASE c_custkey % 5 WHEN 1 THEN 100 ELSE 200 END + (c_custkey + CASE c_custkey % 5 WHEN 2 THEN 1 ELSE 0 END) % 700 AS string) || lpad(CAST(c_custkey % 1000 AS string), 3, '0') || lpad(CAST((c_custkey * 7 + CASE c_custkey % 5 WHEN 3 THEN 1 ELSE 0 END) % 10000 AS string), 4, '0') AS ent",
    "lpad(CAST(c_custkey * 37 % 1000000 AS string), 10, '1') AS npi_src",
    "CASE c_custkey % 3 WHEN 0 THEN lpad(CAST(c_custkey * 37 % 1000000 AS string), 10, '1') WHEN 1 THEN ' ' ELSE lpad(CAST(c_custkey * 41 % 1000000 AS string), 10, '1') END AS npi_ent",
    "CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS not_allowed",
    "CASE c_custkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS as_written",
    "CASE c_custkey % 4 WHEN 3 THEN 'x' ELSE CAST(1 + c_custkey % 5 AS string) END AS refills_src",
    "CASE c_custkey % 7 WHEN 6 THEN '' ELSE CAST(c_custkey % 5 AS string) END AS refills_ent",
    "CASE c_custkey % 2 WHEN 0 THEN TRUE END AS total_fills",
]
CODES = [
    "p_partkey",
    "CASE p_partkey % 6 WHEN 0 THEN lpad(CAST(p_partkey AS string), 4, '0') || '-' || lpad(CAST(p_size AS string), 4, '0') || '-01' WHEN 1 THEN lpad(CAST(p_partkey AS string), 5, '0') || '-' || lpad(CAST(p_size AS string), 3, '0') || '-02'"
    " WHEN 2 THEN lpad(CAST(p_partkey AS string), 5, '0') || '-' || lpad(CAST(p_size AS string), 4, '0') || '-3' WHEN 3 THEN lpad(CAST(p_partkey AS string), 11, '0') WHEN 4 THEN lpad(CAST(p_partkey AS string), 10, '0') ELSE p_name END AS code",
]
GIVEN = ["William", "Bill", "Robert", "Mary-Jane", "Mary", "Dr. Alex", "Liz", "Elizabeth"]
FAMILY = ["Smith", "Smith-Jones", "SmithJones", "Garcia Lopez", "Lopez", "O'Neil", "Smith Jr"]
_PICK = lambda k, v: f"CASE {k} % {len(v)} " + " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(v)) + " END"
NAMES = [
    "c_custkey",
    f"{_PICK('c_custkey', GIVEN)} || ' ' || {_PICK('c_custkey', FAMILY)} AS src",
    f"CASE WHEN c_custkey % 23 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN {_PICK('(c_custkey + c_custkey % 3)', FAMILY)} || ', ' || {_PICK('(c_custkey + c_custkey % 2)', GIVEN)} ELSE {_PICK('(c_custkey + c_custkey % 5)', GIVEN)} || ' ' || {_PICK('c_custkey', FAMILY)} END AS ent",
]
