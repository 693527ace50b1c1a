"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Like these, over small fixed tables alone: run by the tests, not registered
#: as queries.
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CASE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(sql: str):
    """Register a function of ``t`` as a case of the tests."""
    return _kept(sql, CASES, CASE_SQL)


def query(sql: str | None):
    """Register a function of ``t``, which reads a table by name; ``t.spark``
    is the session."""
    return _kept(sql, QUERIES, SQL)


def _kept(sql: str | None, queries: dict, sqls: dict):

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def t(name: str) -> DataFrame:
                return table(spark, sf_dir, name)

            t.spark = spark
            return f(t)

        queries[f.__name__] = run
        if sql:
            sqls[f.__name__] = sql
        return f

    return keep


def _sql(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(_sql, value))}]" if value else "[]::varchar[]"
    return repr(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


class Literal:
    """A small fixed table: a DataFrame, and the same rows in SQL."""

    def __init__(self, schema: str, *rows: tuple):
        self.schema, self.rows = schema, rows
        self.names = [c.split()[0] for c in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def __str__(self) -> str:
        kinds = {"string": "varchar", "long": "bigint", "bigint": "bigint", "int": "integer", "double": "double", "boolean": "boolean", "array<string>": "varchar[]"}
        typed = ", ".join(f"cast({n} as {kinds[c.split()[1]]}) as {n}" for n, c in zip(self.names, self.schema.split(", "), strict=True))
        body = ", ".join(f"({', '.join(map(_sql, r))})" for r in self.rows)
        return f"(select {typed} from (values {body}) as v({', '.join(self.names)}))"

    def over(self, table_name: str, key: str, **mixed: str | tuple[str, str]) -> Spread:
        """Its rows as cases of a table: see ``Spread``."""
        return Spread(self, table_name, key, mixed)


class Spread:
    """Every row of a table as one of the cases of a fixed table whose first
    column is ``id``: the case by the key's remainder, ``id`` the key, and
    columns made of the case (v) and the row (k), in SQL of both engines, or
    of Spark and DuckDB."""

    def __init__(self, cases: Literal, table_name: str, key: str, mixed: dict[str, str | tuple[str, str]]):
        self.cases, self.table_name, self.key, self.mixed = cases, table_name, key, mixed

    def _columns(self, engine: int) -> str:
        made = {n: m if isinstance(m, str) else m[engine] for n, m in self.mixed.items()}
        return ", ".join([f"k.{self.key} as id"] + [f"{made.get(n, f'v.{n}')} as {n}" for n in self.cases.names[1:]])

    def of(self, t) -> DataFrame:
        n = len(self.cases.rows)
        cases = F.broadcast(self.cases.df(t.spark).withColumn("_place", F.pmod("id", F.lit(n))).alias("v"))
        rows = t(self.table_name).alias("k").join(cases, F.expr(f"pmod(k.{self.key}, {n}) = v._place"))
        return rows.selectExpr(*_split(self._columns(0)))

    def __str__(self) -> str:
        n = len(self.cases.rows)
        return f"(select {self._columns(1)} from {self.table_name} k join {self.cases} v on k.{self.key} % {n} = v.id % {n})"


def _split(columns: str) -> list[str]:
    """At commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in columns:
        quoted ^= c == "'"
        depth += 0 if quoted else (c in "([") - (c in ")]")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out
