"""Registration of queries and the SQL building blocks they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(column: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, negative zero made plain."""
    out = F.round(column, 6) + F.lit(0.0)
    return out.alias(name or column)


def with_ctes(select: str, *ctes: str) -> str:
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + select


ELEMENTS = """el AS MATERIALIZED (
  SELECT l_orderkey AS sample_id, l_partkey, l_linenumber, l_suppkey, l_discount, l_tax,
         CAST(row_number() OVER (PARTITION BY l_orderkey
              ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS pos
  FROM lineitem)"""
RAW_POINTS = """raw_points AS MATERIALIZED (
  SELECT sample_id, pos, l_linenumber AS id, CAST((l_partkey * 37) % 256 AS DOUBLE) AS x,
         CAST((l_suppkey * 53) % 256 AS DOUBLE) AS y, 1 - l_discount AS score FROM el)"""
RAW_EDGES = """raw_edges AS MATERIALIZED (
  SELECT sample_id, pos, l_linenumber AS src, CAST(l_partkey % 9 AS INTEGER) AS dst FROM el)"""
RAW_PRED = """raw_pred AS MATERIALIZED (
  SELECT sample_id, pos, l_linenumber AS src, CAST(l_suppkey % 8 AS INTEGER) AS dst, 1 - l_tax AS score FROM el)"""
FOLD = """fold AS (
  SELECT sample_id, pos, id AS raw_id, id AS given, [id] AS used, greatest(id + 1, 0) AS nxt FROM raw_points WHERE pos = 0
  UNION ALL
  SELECT p.sample_id, p.pos, p.id, CASE WHEN list_contains(f.used, p.id) THEN f.nxt ELSE p.id END,
         list_append(f.used, CASE WHEN list_contains(f.used, p.id) THEN f.nxt ELSE p.id END),
         greatest(f.nxt, CASE WHEN list_contains(f.used, p.id) THEN f.nxt ELSE p.id END + 1)
  FROM fold f JOIN raw_points p ON p.sample_id = f.sample_id AND p.pos = f.pos + 1),
given AS MATERIALIZED (
  SELECT sample_id, pos, raw_id, given,
         CAST(row_number() OVER (PARTITION BY sample_id ORDER BY given) - 1 AS INTEGER) AS new_id FROM fold)"""
NORM_POINTS = """pts AS MATERIALIZED (
  SELECT g.sample_id, g.pos, g.new_id AS id, p.x, p.y, p.score FROM given g JOIN raw_points p USING (sample_id, pos))"""
NORM_EDGES = """marked AS MATERIALIZED (
  SELECT e.sample_id, e.pos, e.src AS raw_src, e.dst AS raw_dst, least(a.new_id, b.new_id) AS u, greatest(a.new_id, b.new_id) AS v,
         CASE WHEN a.new_id IS NULL OR b.new_id IS NULL THEN 'EDGE_DANGLING'
              WHEN a.new_id = b.new_id THEN 'EDGE_SELF_LOOP' END AS code
  FROM raw_edges e LEFT JOIN given a ON a.sample_id = e.sample_id AND a.given = e.src
                   LEFT JOIN given b ON b.sample_id = e.sample_id AND b.given = e.dst),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY sample_id, u, v ORDER BY pos) AS nth FROM marked WHERE code IS NULL),
eds AS MATERIALIZED (
  SELECT sample_id, pos, u, v,
         format('edge_{:04d}', row_number() OVER (PARTITION BY sample_id ORDER BY pos)) AS edge_id FROM ranked WHERE nth = 1)"""
BASE = (ELEMENTS, RAW_POINTS, RAW_EDGES)
NORMALIZED = (*BASE, FOLD, NORM_POINTS, NORM_EDGES)
ISSUES = """issues AS MATERIALIZED (
  SELECT sample_id, 1 AS part, pos, 'POINT_ID_DUP' AS code FROM given WHERE given <> raw_id
  UNION ALL SELECT sample_id, 2, pos, code FROM marked WHERE code IS NOT NULL
  UNION ALL SELECT sample_id, 2, pos, 'EDGE_DUP' FROM ranked WHERE nth > 1)"""
