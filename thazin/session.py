"""Session helpers shared by all operators."""

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is what ``spark.checkpoint.dir`` names on the cluster; only a
    local master without that setting (tests) gets one of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="thazin-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(df: DataFrame, most: int) -> list:
    """The rows of a table that must be small; ValueError if it holds more."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table holds more than {most} rows")
    return rows


def mapped(fn: Callable, kind: str, *cols: Column, nulls: bool = False) -> Column:
    """A column of ``fn`` over the values of ``cols``, in Arrow batches.

    Unless ``nulls``, a null in the first column gives null.  The planner is
    told not to repeat it, as it would for the filter an explode implies.
    """

    def run(batches):
        for batch in batches:
            batch = (batch,) if isinstance(batch, pd.Series) else batch
            yield pd.Series([None if v[0] is None and not nulls else fn(*v) for v in zip(*batch)], dtype=object)

    return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER).asNondeterministic()(*cols)


def shared(spark: SparkSession, value):
    """A broadcast with a key, for :func:`built`."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, value))


_BUILT: dict = {}


def built(handle, make: Callable):
    """What ``make`` makes of a shared value, once for a Python worker; a few are kept."""
    key, value = handle.value
    name = (make.__module__, make.__qualname__, key)
    if name not in _BUILT:
        if len(_BUILT) >= 4:
            _BUILT.clear()
        _BUILT[name] = make(value)
    return _BUILT[name]


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Partitioned by columns into at least two tasks a core, for work that costs more than its bytes tell.

    The number follows ``spark.sql.shuffle.partitions``, which is set to the
    size of the data; a fixed number isn't coalesced at run time.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)
