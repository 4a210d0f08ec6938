"""The registry of plans, filled by the modules beside this one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plan(sql: str | None = None):
    """Registers a plan under its function's name, with its SQL if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def statement(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a statement over the tables; oracle where another engine spells it differently."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    text = sql
    for t in used:
        text = re.sub(rf"\b(from|join|,)(\s+){t}\b", rf"\1\2{{{t}}} as {t}", text, flags=re.I)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used if f"{{{t}}}" in text})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or sql
