"""The test tables as index relations: one SQL text per relation, valid in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from symgrid.schema import Index

RELATIONS = {
    "files": "SELECT 'd' || CAST(doc_id AS STRING) AS file_id, source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path, text AS content, source AS project_id FROM {documents}",
    "symbols": """
      SELECT 'T:Shop.IRegion.' || r_name AS symbol_id, 'T:Shop.IRegion.' || r_name AS fqname, 'Interface' AS kind, 'd' || CAST(r_regionkey AS STRING) AS file_id,
             1 AS span_start, 3 AS span_end, 'interface ' || r_name AS signature, 'World region' AS documentation, 'Shop.IRegion' AS namespace, CAST(NULL AS STRING) AS containing_type,
             'Public' AS visibility, 'High' AS confidence, 'sym_r' || CAST(r_regionkey AS STRING) AS stable_id, 0 AS is_decompiled, 'Core' AS project_name FROM {region}
      UNION ALL
      SELECT 'T:Shop.Nations.' || n_name, 'T:Shop.Nations.' || n_name, 'Class', 'd' || CAST(n_nationkey AS STRING), 2, 5, 'class ' || n_name, NULL, 'Shop.Nations', NULL,
             'Public', 'High', 'sym_n' || CAST(n_nationkey AS STRING), 0, 'Core' FROM {nation}
      UNION ALL
      SELECT 'M:Shop.Customers.C' || CAST(c_custkey AS STRING), 'M:Shop.Customers.' || replace(c_name, '#', '') || '(Order)', 'Method', 'd' || CAST(c_custkey % 200 AS STRING),
             CAST(c_custkey % 20 + 1 AS INT), CAST(c_custkey % 20 + 1 + c_custkey % 7 AS INT), 'void Serve' || c_mktsegment || 'Order(Order o)', NULL, 'Shop.Customers', 'T:Shop.Customers',
             CASE WHEN c_custkey % 3 = 0 THEN 'Private' ELSE 'Public' END, CASE WHEN c_custkey % 5 = 0 THEN 'Low' ELSE 'High' END,
             CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'sym_c' || CAST(c_custkey AS STRING) END, 0, c_mktsegment FROM {customer}
      UNION ALL
      SELECT 'M:Shop.Suppliers.S' || CAST(s_suppkey AS STRING), 'M:Shop.Suppliers.' || replace(s_name, '#', '') || '(Order)', 'Method', 'd' || CAST(s_suppkey % 200 AS STRING),
             CAST(s_suppkey % 30 + 1 AS INT), CAST(s_suppkey % 30 + 4 AS INT), 'int Supply2Http(OrderLine l)', 'Ships an order line', 'Shop.Suppliers', 'T:Shop.Suppliers',
             'Internal', 'Medium', 'sym_s' || CAST(s_suppkey AS STRING), 0, 'Supply' FROM {supplier}
      UNION ALL
      SELECT 'P:Parts.P' || CAST(p_partkey AS STRING), 'P:Parts.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '') || CAST(p_partkey AS STRING), 'Property', 'd' || CAST(p_partkey % 200 AS STRING),
             CAST(p_partkey % 10 + 1 AS INT), CAST(p_partkey % 10 + 2 AS INT), p_type || ' ' || p_name, NULL, 'Parts.' || replace(p_brand, '#', ''), 'T:Parts.' || replace(p_brand, '#', ''),
             'Public', 'High', 'sym_p' || CAST(p_partkey AS STRING), CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END, replace(p_brand, '#', '') FROM {part}""",
    "refs": """
      SELECT 'M:Shop.Customers.C' || CAST(o_custkey AS STRING) AS from_symbol_id, 'M:Shop.Suppliers.S' || CAST(l_suppkey AS STRING) AS to_symbol_id,
             CASE l_returnflag WHEN 'A' THEN 'Call' WHEN 'R' THEN 'Read' ELSE 'Write' END AS ref_kind, 'd' || CAST(o_orderkey % 200 AS STRING) AS file_id,
             CAST(l_linenumber AS INT) AS loc_start, CAST(l_partkey AS INT) AS loc_end, CASE l_linestatus WHEN 'F' THEN 'Resolved' ELSE 'Unresolved' END AS resolution_state,
             'Supplier' || lpad(CAST(l_suppkey AS STRING), 9, '0') AS to_name, 'Suppliers' AS to_container_hint
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "calls": """
      SELECT DISTINCT 'P:Parts.P' || CAST(l_partkey AS STRING) AS from_symbol_id, 'P:Parts.P' || CAST(nxt AS STRING) AS to_symbol_id,
             CASE l_returnflag WHEN 'A' THEN 'Call' WHEN 'R' THEN 'Read' ELSE 'Write' END AS ref_kind, 'd' || CAST(l_partkey % 200 AS STRING) AS file_id, CAST(l_partkey % 97 AS INT) AS loc_start, CAST(nxt AS INT) AS loc_end, 'Resolved' AS resolution_state
      FROM (SELECT l_partkey, l_returnflag, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nxt FROM {lineitem}) s
      WHERE nxt IS NOT NULL""",
    "type_relations": """
      SELECT 'T:Shop.Nations.' || n_name AS type_symbol_id, 'T:Shop.IRegion.' || r_name AS related_symbol_id, 'Interface' AS relation_kind, r_name AS display_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
      UNION ALL
      SELECT 'M:Shop.Customers.C' || CAST(c_custkey AS STRING), 'T:Shop.Nations.' || n_name, 'BaseType', n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
      UNION ALL
      SELECT 'M:Shop.Suppliers.S' || CAST(s_suppkey AS STRING), 'T:Shop.Nations.' || n_name, 'BaseType', n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "facts": """
      SELECT 'M:Shop.Customers.C' || CAST(user_id AS STRING) AS symbol_id,
             CASE event_type WHEN 'click' THEN 'Route' WHEN 'view' THEN 'Route' WHEN 'signup' THEN 'Config' WHEN 'purchase' THEN 'DbTable' ELSE 'Exception' END AS fact_kind,
             CASE event_type WHEN 'click' THEN 'POST /u/' || CAST(user_id AS STRING) WHEN 'view' THEN 'GET /u/' || CAST(user_id AS STRING) || '/' || regexp_replace(props, '[^0-9]', '{g}')
                  WHEN 'signup' THEN 'user' || CAST(user_id % 9 AS STRING) || ':' || regexp_replace(props, '[^0-9]', '{g}') || CASE WHEN event_id % 4 = 0 THEN '' ELSE '|GetValue|x' END
                  WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'dbo.T' ELSE 'dbo.t' END || CAST(user_id % 50 AS STRING) || CASE WHEN event_id % 2 = 0 THEN '|DbSet<T>' ELSE '|raw sql' END
                  ELSE 'E' || regexp_replace(props, '[^0-9]', '{g}') || '|throw new' END AS value,
             'd' || CAST(event_id % 200 AS STRING) AS file_id, CAST(event_id AS INT) AS loc_start, CAST(event_id + 1 AS INT) AS loc_end,
             CASE WHEN event_id % 7 = 0 THEN 'Low' WHEN event_id % 5 = 0 THEN 'Medium' ELSE 'High' END AS confidence, event_id, ts
      FROM {events}""",
    "log": """
      SELECT 'w' || CAST(user_id % 3 AS STRING) AS workspace_id, CAST(event_id AS INT) AS revision, 1 AS op_ord, CASE event_type WHEN 'error' THEN 'Tombstone' ELSE 'Symbol' END AS op,
             'k' || CAST(user_id AS STRING) AS key, event_type || ':' || CAST(value AS STRING) AS payload FROM {events} WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'""",
    "before": """
      SELECT CASE WHEN o_orderstatus = 'P' THEN 'M:O.P' || CAST(o_orderkey AS STRING) ELSE 'M:O.N' || CAST(o_orderkey AS STRING) END AS symbol_id,
             CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'sym_o' || CAST(o_orderkey AS STRING) END AS stable_id, CASE WHEN o_custkey % 2 = 0 THEN 'Method' ELSE 'Class' END AS kind, o_orderpriority AS signature, o_orderstatus AS visibility
      FROM {orders} WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00'""",
    "after": """
      SELECT 'M:O.N' || CAST(o_orderkey AS STRING) AS symbol_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'sym_o' || CAST(o_orderkey AS STRING) END AS stable_id, CASE WHEN o_custkey % 2 = 0 THEN 'Method' ELSE 'Class' END AS kind,
             CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority || '!' ELSE o_orderpriority END AS signature, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS visibility
      FROM {orders} WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'""",
    "baselines": """
      SELECT 'sln' || CAST(o_custkey AS STRING) AS solution_id, 'c' || CAST(o_orderkey AS STRING) AS commit_sha, o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderstatus FROM {orders}""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql(name: str, tables: dict[str, str], g: str) -> str:
    return RELATIONS[name].format(**tables, g=g)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bridged relation, or a plain test table, as a DataFrame."""
    if name not in RELATIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(sql(name, {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}, ""))


def index(spark: SparkSession, sf_dir: str) -> Index:
    return Index(*[frame(spark, sf_dir, n) for n in ("files", "symbols", "refs", "facts", "type_relations")])


def oracle(text: str) -> str:
    """DuckDB SQL with the relations that it names as leading WITH parts."""
    used = [n for n in RELATIONS if re.search(rf"\b{n}\b", text)]
    body = text.strip()
    head = ",\n".join(f"{n} AS ({_duck(n)})" for n in used)
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    body = re.sub(r"^WITH\s+(RECURSIVE\s+)?", ", ", body) if re.match(r"WITH\b", body) else "\n" + body
    return f"WITH {recursive}{head}{body}" if head else text


def _duck(name: str) -> str:
    own = RELATIONS[name].replace("'{g}')", "'', 'g')")
    return own.format(**{t: t for t in TABLES}, g="")
