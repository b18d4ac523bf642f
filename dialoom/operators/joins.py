"""Join strategies for narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Parts of a plan whose number of rows Spark can't estimate: generators and Python functions.
UNSIZED = ("Generate ", "MapIn", "FlatMap", "EvalPython", "PythonUDF", "CoGroup")


def sized(df: DataFrame) -> DataFrame:
    """A narrow table to be joined: left to Spark's own choice where its size estimate can be relied on, else merged by sorted keys.

    Filters, projections, joins and aggregates of files or of given rows are estimated from their
    sizes, and are broadcast below the session's threshold.  Nothing runs for this.
    """
    plan = df._jdf.queryExecution().analyzed().toString()
    return df.hint("merge") if any(part in plan for part in UNSIZED) else df
