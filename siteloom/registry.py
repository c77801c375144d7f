"""Named queries: a dictionary for the driver, and a dispatcher with parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.plans import fold_queries as _fold
from siteloom.plans import read_queries as _reads
from siteloom.plans import rule_queries as _rules
from siteloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "query", "with_user_text"]

#: Modules that register queries as they are imported.
REGISTERED = (_fold, _reads, _rules)


def query(spark: SparkSession, sf_dir: str, name: str, **params) -> DataFrame:
    """Run a query by name; unknown and private names are errors."""
    if name.startswith("_") or name not in QUERIES:
        raise KeyError(f"no query {name!r}; there are: {', '.join(sorted(QUERIES))}")
    return QUERIES[name](spark, sf_dir, **params)


def with_user_text(prompts: DataFrame, prompt: str, fallback: str, write: Callable[[str], str]) -> DataFrame:
    """Prompt rows with ``text`` by the caller's function; where it fails, ``fallback``, and in ``failure`` why."""

    def one(given):
        try:
            return write(given), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, failures = zip(*map(one, rows[prompt]), strict=True) if len(rows) else ((), ())
            told = pd.Series(texts, rows.index, object).where([x is None for x in failures], rows[fallback])
            yield rows.assign(text=told, failure=pd.Series(failures, rows.index, object))

    return prompts.mapInPandas(run, prompts.withColumn("text", prompts[fallback].cast("string")).withColumn("failure", F.lit(None).cast("string")).schema)
