"""Queries and their DuckDB SQL by inventory key, and the views over the driver's tables that both are written on."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

#: Stand-ins for the listing tables, in SQL that Spark and DuckDB both read.
VIEWS = {
    "instr": f"""SELECT l_orderkey AS func, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) - 1 AS BIGINT) AS idx,
        CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'jmp' ELSE lower(concat(l_returnflag, l_linestatus)) END AS mnemonic,
        concat(CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'jmp' ELSE lower(concat(l_returnflag, l_linestatus)) END, ':', CAST(CAST(l_quantity AS INT) % 8 AS STRING)) AS sig,
        CAST(l_quantity AS INT) % 8 AS kind, l_partkey AS callee, l_suppkey AS data_ref, CAST(floor(l_extendedprice) AS BIGINT) % 200000 - 100000 AS disp FROM lineitem""",
    "func": """SELECT o.o_orderkey AS func, o.o_orderkey * 1024 AS start_ea, o.o_orderkey * 1024 + 16 * l.n AS end_ea, concat('sub_', lower(hex(o.o_orderkey + 4096))) AS name
        FROM orders o JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "lib": "SELECT p_partkey AS pos, p_partkey AS id, CAST(round(p_retailprice * 100) AS BIGINT) AS rva FROM part",
    "pairs": """SELECT CAST(floor(o_orderkey / 2) AS INT) AS row_no, concat('pair', CAST(o_orderkey AS STRING)) AS name, o_orderkey AS og_rva, CASE WHEN o_orderkey % 10 <> 4 THEN o_custkey END AS og_id,
        o_orderkey + 1 AS ae_rva, CASE WHEN o_orderkey % 14 <> 6 THEN o_custkey + 100000 END AS ae_id FROM orders WHERE o_orderkey % 2 = 0""",
    "src": """SELECT concat('f', CAST(o_custkey % 50 AS STRING), '.cpp') AS file, o_orderkey AS line,
        concat('auto a = REL::ID( ', CAST(o_custkey AS STRING), ' );', CASE WHEN o_orderkey % 3 = 0 THEN concat(' func_t b{ REL::ID(', CAST(o_orderkey % 2500 AS STRING), ') };') ELSE '' END) AS text FROM orders""",
    "uses": """SELECT o_custkey AS og_id, concat('f', CAST(o_custkey % 50 AS STRING), '.cpp') AS file, o_orderkey AS line, CASE WHEN o_orderkey % 3 = 0 THEN 'function' ELSE 'data_or_global' END AS kind FROM orders
        UNION ALL SELECT o_orderkey % 2500, concat('f', CAST(o_custkey % 50 AS STRING), '.cpp'), o_orderkey, 'function' FROM orders WHERE o_orderkey % 3 = 0""",
    "cmp": """SELECT o_orderkey AS csv_row, o_custkey AS og_id, o_custkey + 100000 AS ae_id,
        CASE o_orderkey % 5 WHEN 0 THEN 'exact_semantics' WHEN 1 THEN 'strong' WHEN 2 THEN 'likely' WHEN 3 THEN 'review' ELSE 'suspect' END AS classification, (o_orderkey * 37 % 1000) / 1e3 AS score
        FROM orders WHERE o_orderkey % 16 = 0""",
    "names": "SELECT c_custkey * 16 AS ea, concat(lower(c_mktsegment), '_', CAST(c_custkey AS STRING)) AS raw_name, c_name AS demangled FROM customer",
    "segs": "SELECT n_name AS name, CAST(n_nationkey * 700 AS BIGINT) AS start_ea, CAST(n_nationkey * 700 + 350 AS BIGINT) AS end_ea FROM nation",
    "words": "SELECT o_orderkey * 8 AS ea, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey * 8 END AS qword FROM orders",
    "links": """SELECT 1 AS lver, c_custkey AS lrva, 2 AS rver, c_custkey - c_custkey % 3 AS rrva FROM customer WHERE c_nationkey < 20
        UNION ALL SELECT 2, c_custkey - c_custkey % 3, 3, (c_custkey - c_custkey % 3) - (c_custkey - c_custkey % 3) % 7 FROM customer WHERE c_nationkey < 10""",
    "votesrc": """SELECT o_orderkey AS xref, o_custkey % 400 AS og_id, CAST(o_orderkey % 17 AS INT) AS pair_row, o_custkey % 5 AS candidate, (o_orderkey * 7919 % 1000) / 1e3 AS score FROM orders
        UNION ALL SELECT o_orderkey, o_custkey % 400, CAST(o_orderkey % 17 AS INT), (o_custkey + 1) % 5, (o_orderkey * 7907 % 1000) / 1e3 FROM orders WHERE o_orderkey % 4 = 0""",
    "cand": """SELECT o_custkey AS og_id, o_orderkey AS candidate, CAST(o_orderkey * 7919 % 97 AS INT) AS m, CAST(o_orderkey % 4 AS INT) AS n, (o_orderkey * 6007 % 1001) / 1e3 AS s, o_orderkey % 11 = 0 AS flag FROM orders""",
}


def view(spark: SparkSession, sf_dir: str, name: str, dealt: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """A stand-in, or a table of the driver; dealt: tables that are first partitioned into a number of parts by a column, which a window by it keeps."""
    sql = VIEWS.get(name, f"SELECT * FROM {name}")
    for table in TABLES:
        if re.search(rf"\b{table}\b", sql):
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            (rows.repartition(*dealt[table]) if dealt and table in dealt else rows).createOrReplaceTempView(table)
    return spark.sql(sql)


def query(key: str, sql: str | None = None, *views: str):
    """Registers a query; sql is its DuckDB form, on the views given."""

    def add(f):
        QUERIES[key] = f
        if sql:
            ORACLES[key] = (f"WITH {', '.join(f'{v} AS ({VIEWS[v]})' for v in views)} " if views else "") + sql
        return f

    return add
