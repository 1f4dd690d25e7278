"""Queries by name, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


#: The tables of sources/adapters.py, in DuckDB's SQL.
FILES = """
bare AS (SELECT p_brand||'/'||p_type||'/'||p_partkey||' '||p_name||'.mkv' AS key, p_partkey||' '||p_name||'.mkv' AS name, p_brand||'/'||p_type AS parent, p_partkey AS n,
  CAST(p_size AS BIGINT) AS size, p_retailprice AS "durationSec", CAST(p_partkey % 4 AS INT) AS "characterCount",
  CASE WHEN p_partkey % 10 = 3 THEN 'decoder error at 0x'||format('{:x}', p_partkey*7919)||' in '||p_brand||'/'||p_type||'/'||p_partkey||' '||p_name||'.mkv after '||(p_partkey*13)||' ms' WHEN p_partkey % 10 = 4 THEN '' END AS "extractionError",
  CASE WHEN p_partkey % 5 = 0 THEN 6 ELSE 7 END AS "metadataVersion", CASE WHEN p_partkey % 3 = 0 THEN 7 WHEN p_partkey % 3 = 1 THEN 6 END AS "keyframesVersion",
  CAST(p_partkey % 9 AS INT) AS "facesVersion", p_partkey % 11 = 0 AS "scanBlacklisted", CASE WHEN p_partkey % 17 = 0 THEN p_partkey END AS "scanPriority" FROM part),
changed AS (SELECT l_partkey AS n, epoch_us(max(l_shipdate)) // 1000 AS m FROM lineitem GROUP BY 1),
played AS (SELECT user_id AS u, epoch_us(max(ts)) // 1000 AS t, max(value) AS v FROM events GROUP BY 1),
files AS (SELECT bare.*, m AS "fileModifiedAt", m + 3600000 * (bare.n % 48) AS "addedAt", t AS "positionUpdatedAt", v AS "positionSec" FROM bare LEFT JOIN changed ON changed.n = bare.n LEFT JOIN played ON u = bare.n % 1000),
up AS (SELECT parent FROM bare GROUP BY 1 HAVING count(*) = 1),
foldered AS (SELECT files.*, CASE WHEN up.parent IS NULL THEN files.parent ELSE split_part(files.parent, '/', 1) END AS folder FROM files LEFT JOIN up USING (parent))
"""

CHARACTERS = """
chars AS (SELECT 'show#'||label AS "fileKey", CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS "characterIdx", CAST(embedding AS DOUBLE[]) AS e, CAST(1 + vec_id % 20 AS INT) AS "memberCount", (vec_id * 37 % 101) / 100.0 AS "bestFaceScore", vec_id FROM embeddings),
characters AS (SELECT *, "fileKey"||'#'||CASE WHEN "characterIdx" < 10 THEN '0' ELSE '' END||"characterIdx" AS key FROM chars)
"""

MEMBERS = """
members AS (SELECT o_orderpriority AS "listKey", o_custkey AS "itemKey", epoch_us(max(o_orderdate)) // 1000 AS "addedAt", min(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey END) AS rank FROM orders GROUP BY 1, 2)
"""

DETECTIONS = """
det AS (SELECT user_id AS file, event_type AS grp, epoch_us(ts) // 1000 AS t, event_id, value FROM events)
"""

#: Distance of unit vectors a and b.
L2 = "sqrt(greatest(0.0, 2.0 - 2.0 * list_inner_product({a}, {b})))"
