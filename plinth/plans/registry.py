"""Registry of named queries: a Spark callable plus the SQL text that checks it.

Inputs that the given tables do not hold (datasets, slides, plans, jobs) are derived from them by
SQL kept in ``inputs.py``. Names in braces are tables: given ones are read from Parquet, derived ones
are expanded (as sub-plans in Spark, as common table expressions in the checking SQL).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.session import set_down

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_NAME = re.compile(r"\{([a-z_]+)\}")
_LIST = re.compile(r"@LIST\((.*?)\)@", re.S)

#: Rows of a given table in a task, where a derived table is dealt over a key.
TASK_ROWS = 250_000

INPUTS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    if name in INPUTS:
        raise ValueError(f"input {name} is defined twice")
    INPUTS[name] = sql.strip()


class Tables:
    """Looks tables up by name for one session and data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._seen = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in GIVEN:
                self._seen[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._seen[name] = self.sql(INPUTS[name])
        return self._seen[name]

    def stored(self, name: str) -> DataFrame:
        """A derived table written out once, as the table an operator would be given."""
        key = f"stored {name}"
        if key not in self._seen:
            self._seen[key] = set_down(self(name))
        return self._seen[key]

    def dealt(self, name: str, rows_of: str, **keys: str) -> DataFrame:
        """A derived table, the given tables in ``keys`` dealt over an expression, with a number of tasks that follows the rows of
        ``rows_of``. Steps by that key then need no further shuffle, and what a task holds does not grow with the input."""
        tasks = max(1, -(-self(rows_of).count() // TASK_ROWS))
        needed = {table: self(table) for table in set(_NAME.findall(INPUTS[name]))}
        needed |= {table: needed[table].repartition(tasks, F.expr(key)) for table, key in keys.items()}
        return self.spark.sql(spark_text(INPUTS[name]), **needed)

    def dealing(self, rows_of: str, **keys: str) -> tuple[Tables, int]:
        """These tables with the given ones in ``keys`` dealt over an expression, wherever a derived table reads them, and the
        number of tasks, which follows the rows of ``rows_of``."""
        tasks = max(1, -(-self(rows_of).count() // TASK_ROWS))
        other = Tables(self.spark, self.sf_dir)
        other._seen = {table: self(table).repartition(tasks, F.expr(key)) for table, key in keys.items()}
        return other, tasks

    def sql(self, text: str) -> DataFrame:
        needed = {name: self(name) for name in set(_NAME.findall(text))}
        return self.spark.sql(spark_text(text), **needed)


def spark_text(text: str) -> str:
    """``@LIST(a; b)@`` yields one row per listed expression as ``item_ix, item``."""
    return _LIST.sub(lambda m: f"posexplode(array({', '.join(_items(m))})) AS (item_ix, item)", text)


def check_text(text: str) -> str:
    def one(m: re.Match[str]) -> str:
        items = _items(m)
        return f"unnest([{', '.join(map(str, range(len(items))))}]) AS item_ix, unnest([{', '.join(items)}]) AS item"

    return _NAME.sub(r"\1", _LIST.sub(one, text))


def _items(match: re.Match[str]) -> list[str]:
    return [part.strip() for part in match.group(1).split(";")]


def expand(sql: str) -> str:
    """Checking SQL with every derived table it needs as a common table expression."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in INPUTS and name not in ordered:
                visit(INPUTS[name])
                ordered.append(name)

    visit(sql)
    body = check_text(sql.strip())
    if not ordered:
        return body
    parts = ",\n".join(f"{name} AS (\n{check_text(INPUTS[name])}\n)" for name in ordered)
    own = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
    return f"WITH RECURSIVE {parts}{',' if own != body else ''}\n{own}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
