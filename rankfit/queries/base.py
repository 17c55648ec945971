"""Query registry and the tables that the queries derive from the given ones.

A role is portable SQL text: Spark runs it over the given tables, and the reference SQL of a query uses the same text
as a common table expression, so both sides start from the same derived rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROLES: dict[str, str] = {}
ONCE: set[str] = set()


def role(name: str, sql: str, once: bool = False) -> None:
    """`once`: a condensed table that a query reads many times is materialised instead of being derived at every use."""
    ROLES[name] = sql
    if once:
        ONCE.add(name)


class Tables:
    """The given tables and the roles over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def folder(self) -> str:
        return self.dir

    def of(self, **rows: DataFrame) -> Tables:
        """The same tables with others in the place of some; roles are derived from those."""
        out = Tables(self.spark, self.dir)
        out._made |= rows
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in ROLES:
                text = ROLES[name]
                used = {n: getattr(self, n) for n in re.findall(r"\{([a-z_]\w*)\}", text)}
                made = self.spark.sql(text, **used)
                self._made[name] = cut_lineage(made) if name in ONCE else made
            else:
                self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._made[name]


def _needed(sql: str, seen: list[str]) -> list[str]:
    for n in re.findall(r"\{([a-z_]\w*)\}", sql):
        if n in ROLES and n not in seen:
            _needed(ROLES[n], seen)
            seen.append(n)
    return seen


def expand(sql: str) -> str:
    """Reference SQL with its roles as common table expressions."""
    ctes = [f"{n} AS ({_plain(ROLES[n])})" for n in _needed(sql, [])]
    body = _plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _plain(sql: str) -> str:
    return re.sub(r"\{([a-z_]\w*)\}", r"\1", sql)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(expr: str, digits: int) -> str:
    return f"(floor(({expr}) * 1e{digits} + 0.5) / 1e{digits})"


# ---- roles -----------------------------------------------------------------------------------------------

# times as text in the shapes the parsers must tell apart
role("time_text", """
SELECT o_orderkey AS k, o_totalprice AS v, CASE o_orderkey % 8
  WHEN 0 THEN mm || ':' || ss || '.' || hh WHEN 1 THEN ss || '.' || hh WHEN 2 THEN 'DQ'
  WHEN 3 THEN '1:' || ss || ':' || hh WHEN 4 THEN ' ' || mm || ':' || ss || '.' || hh || ' '
  WHEN 5 THEN ss || 'd' WHEN 6 THEN '' ELSE mm || ':' || ss || '.' || hh || '# NCAA B' END AS t
FROM (SELECT o_orderkey, o_totalprice, CAST(CAST(floor(c / 6000) AS BIGINT) % 20 AS STRING) AS mm,
    lpad(CAST(CAST(floor(c / 100) AS BIGINT) % 60 AS STRING), 2, '0') AS ss, lpad(CAST(c % 100 AS STRING), 2, '0') AS hh
  FROM (SELECT o_orderkey, o_totalprice, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c FROM {orders}) x) y
""")

# (region, line status, brand) as (conference, gender, event); a price band is a place, its lowest price the time
role("places", """
SELECT r_name AS conference, CASE WHEN l_linestatus = 'O' THEN 'men' ELSE 'women' END AS gender, p_brand AS event,
  1 + CAST(floor(l_extendedprice / 5000) AS INT) AS place, min(l_extendedprice) AS sec
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
  JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
GROUP BY 1, 2, 3, 4
""")

# results ranked within (return flag, part)
role("ranked_places", """
SELECT * FROM (SELECT l_returnflag AS conference, CAST(l_partkey AS STRING) AS event, l_extendedprice AS sec,
    CAST(row_number() OVER (PARTITION BY l_returnflag, l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS INT) AS place
  FROM {lineitem}) x
""")

# price bands per part: gaps and short fields occur
role("sparse_places", """
SELECT l_partkey AS grp, 1 + CAST(floor(l_extendedprice / 4000) AS INT) AS place, min(l_extendedprice) AS sec
FROM {lineitem} GROUP BY 1, 2
""")

# a customer's best price per brand
role("times", """
SELECT o_custkey AS swimmer, p_brand AS event, min(l_extendedprice) AS sec
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2
""")

# nations as schools with derived metadata
role("schools", """
SELECT r_name AS conference, n_name AS school, n_name AS raw_name, CAST(70 + 5 * (n_nationkey % 9) AS DOUBLE) / 100 AS psf,
  n_nationkey % 11 <> 10 AS has_swim, n_nationkey % 7 <> 6 AS has_meta,
  CASE WHEN n_nationkey % 13 = 12 THEN CAST(NULL AS INT) ELSE 5 + (n_nationkey * 37) % 80 END AS accept,
  CASE WHEN n_nationkey % 6 = 5 THEN CAST(NULL AS INT) ELSE 1150 + (n_nationkey * 53) % 420 END AS sat_median,
  CASE WHEN n_nationkey % 4 = 0 THEN 1100 + (n_nationkey * 53) % 420 END AS sat25,
  CASE WHEN n_nationkey % 4 = 0 THEN 1220 + (n_nationkey * 53) % 420 END AS sat75,
  CASE WHEN n_nationkey % 5 <> 3 THEN CAST(30 + n_nationkey % 10 AS DOUBLE) / 10 END AS gpa_mean,
  n_nationkey % 8 = 1 AS hidden_ivy, n_nationkey % 9 = 4 AS ivy_league, n_nationkey % 3 = 0 AS stem, n_nationkey % 12 = 7 AS moonshot,
  CASE n_nationkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'none' ELSE '' END AS merit,
  CASE n_nationkey % 5 WHEN 0 THEN 'Los Angeles, CA' WHEN 1 THEN 'Boston, MA' WHEN 2 THEN 'Austin, TX' WHEN 3 THEN 'Chicago, IL' ELSE '' END AS location,
  CASE n_nationkey % 6 WHEN 0 THEN '1A' WHEN 1 THEN '1B' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '4' ELSE '' END AS tier_short,
  CASE n_nationkey % 3 WHEN 0 THEN 'D1' WHEN 1 THEN 'D2' ELSE 'D3' END AS division,
  n_nationkey % 10 AS finish, n_nationkey AS pos
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
""")

role("swimmers", """
SELECT c_custkey AS swimmer, CAST(CASE WHEN c_custkey % 17 = 3 THEN 0 ELSE 900 + (c_custkey * 7919) % 700 END AS INT) AS sat,
  CAST(CASE WHEN c_custkey % 19 = 5 THEN 0 ELSE 18 + (c_custkey * 104729) % 23 END AS DOUBLE) / 10 AS gpa
FROM {customer}
""")

# applicants for the decision rules: one per customer with every input of the rule
role("applicants", """
SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 17 = 3 THEN 0 ELSE 900 + (c_custkey * 7919) % 700 END AS INT) AS sat,
  CAST(CASE WHEN c_custkey % 19 = 5 THEN 0 ELSE 18 + (c_custkey * 104729) % 23 END AS DOUBLE) / 10 AS gpa,
  CASE WHEN c_custkey % 13 = 12 THEN CAST(NULL AS INT) ELSE CAST(3 + (c_custkey * 37) % 90 AS INT) END AS accept,
  CASE WHEN c_custkey % 11 = 5 THEN CAST(NULL AS INT) ELSE CAST(1100 + (c_custkey * 53) % 480 AS INT) END AS sat_median,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(1040 + (c_custkey * 53) % 480 AS INT) END AS sat25,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(1170 + (c_custkey * 53) % 480 AS INT) END AS sat75,
  CASE WHEN c_custkey % 5 <> 3 THEN CAST(30 + c_custkey % 10 AS DOUBLE) / 10 END AS gpa_mean,
  c_custkey % 8 = 1 AS hidden_ivy, c_custkey % 23 = 7 AS moonshot, c_custkey % 29 <> 28 AS has_meta,
  CASE c_custkey % 7 WHEN 0 THEN 'Not Competitive' WHEN 1 THEN 'Below Roster Level' WHEN 2 THEN 'Recruitable'
    WHEN 3 THEN 'Priority Recruit' WHEN 4 THEN 'Top Recruit' WHEN 5 THEN 'Conference Star' ELSE 'High-Point Contender' END AS adj_tier,
  CAST(70 + 5 * (c_custkey % 9) AS DOUBLE) / 100 AS psf,
  CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' ELSE 'none' END AS merit,
  CAST(10 + c_custkey % 27 AS INT) AS act
FROM {customer}
""")

# supplier revenue per nation and return flag as score tables, kept as text like a scanned file
role("score_text", """
SELECT n_name AS bundle_id, r_name AS conference, CASE l_returnflag WHEN 'A' THEN 'men' WHEN 'N' THEN 'women' ELSE 'combined' END AS gender,
  CASE WHEN s_suppkey % 9 = 8 THEN '' ELSE CAST(1 + s_suppkey % 5 AS STRING) END AS rank,
  CASE WHEN s_suppkey % 6 = 5 THEN '  ' || s_name || ' ' ELSE s_name END AS team,
  CASE WHEN s_suppkey % 31 = 30 THEN 'n/a' WHEN s_suppkey % 37 = 36 THEN '-5' WHEN l_returnflag = 'R' AND n_nationkey % 5 = 0 THEN '0'
    ELSE CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS STRING) END AS score,
  s_suppkey AS pos
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
GROUP BY n_name, r_name, l_returnflag, s_suppkey, s_name, n_nationkey
""")

# anchor pairs per customer and order class for the profiles
role("pairs", """
SELECT bundle, gender, event, sw, deep FROM (
  SELECT o_custkey AS bundle, CASE WHEN o_orderstatus = 'F' THEN 'men' ELSE 'women' END AS gender,
    CASE o_orderpriority WHEN '1-URGENT' THEN '50 Free' WHEN '2-HIGH' THEN '100 Free' WHEN '3-MEDIUM' THEN '200 Back'
      WHEN '4-NOT SPECIFIED' THEN '400 IM' ELSE '200 Fly' END AS event,
    min(o_totalprice) / 1000 AS sw, max(o_totalprice) / 1000 AS deep
  FROM {orders} GROUP BY 1, 2, 3) x
""")
