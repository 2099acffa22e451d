"""Registration of queries, and tables that several of them stand on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows if there is any."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


class Tables:
    """Tables of a folder, read by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


#: Rows that one task gets of a table dealt by a key.
TASK_ROWS = 150_000


def dealt(df: DataFrame, rows: int, key: str, least: int = 16) -> DataFrame:
    """df by a key in as many partitions as its number of rows asks for; small tables are left to Spark.

    What a task sorts and counts then stays the same however large the table
    is: Spark would put partitions together by their compressed bytes, which
    tell little about the memory that such narrow rows take.
    """
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, key) if parts > least else df


def candidates(t: Tables) -> DataFrame:
    """Lines of an order as candidates of a sample: canonical key, score, index, run, penalty and family; an order's few lines stay together."""
    lines = t.lineitem
    return dealt(lines, lines.count(), "l_orderkey").select(
        F.col("l_orderkey").alias("id"),
        F.when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd").alias("run"),
        F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 7).cast("string")).alias("canonical"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_linenumber").cast("int").alias("candidate_index"),
        (F.col("l_partkey") % 11).cast("int").alias("penalty"),
        F.col("l_returnflag").alias("family"),
    )


def truth(t: Tables) -> DataFrame:
    """A right key for each order."""
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("o_custkey") % n + 1).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat(pick("ANR", 3), pick("FO", 2), (F.col("o_custkey") % 7).cast("string")).alias("truth"), F.col("o_orderpriority").alias("panel"))


#: The same two tables in SQL.
CANDIDATES = """
cands as (
  select l_orderkey as id, case when l_linenumber % 2 = 0 then 'even' else 'odd' end as run,
    l_returnflag || l_linestatus || cast(l_partkey % 7 as varchar) as canonical, l_extendedprice as score,
    cast(l_linenumber as int) as candidate_index, cast(l_partkey % 11 as int) as penalty, l_returnflag as family
  from lineitem),
truth as (
  select o_orderkey as id, ['A','N','R'][o_custkey % 3 + 1] || ['F','O'][o_custkey % 2 + 1] || cast(o_custkey % 7 as varchar) as truth,
    o_orderpriority as panel
  from orders),
agg as (
  select id, canonical, count(*) as votes, max(score) as max_score, avg(score) as mean_score, min(candidate_index) as min_index,
    count(distinct run) as n_runs
  from cands group by 1, 2)"""
