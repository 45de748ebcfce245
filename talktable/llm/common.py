"""Helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talktable.storage import materialize


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: bytes of an Arrow batch of texts while a table is written; by rows alone, 10,000 whole texts would be one
BATCH_BYTES = 1 << 21


def written(df: DataFrame) -> DataFrame:
    """``materialize``, after which the shuffle files behind the table go at once; batches for Python are bounded in bytes.

    Otherwise the files stay until the driver happens to collect its garbage, and fill the executors' disks in a chain of
    large shuffles. A later loss of an executor does not need them: the table is in the shared folder. A batch is held by the JVM and
    by the Python worker at once, outside Spark's memory; where the session has set a bound of its own, that holds.
    """
    conf = df.sparkSession.conf
    before, own = conf.get(_CLEANUP, None), conf.get(_BATCH, None)
    conf.set(_CLEANUP, "true")
    if own is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    try:
        return materialize(df)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        if own is None:
            conf.unset(_BATCH)


def with_column(df: DataFrame, source: str, out: str, kind: T.DataType, make: Callable[[pa.Array], pa.Array], rows: int = 1024) -> DataFrame:
    """``df`` with ``out`` made from ``source`` in Arrow batches of at most ``rows`` rows; a column ``out`` is replaced.

    The other columns go through the Python worker and not, as with a UDF, through a queue on the executor's disk.
    """
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                columns = [part.column(part.schema.get_field_index(c)) for c in names]
                made = make(part.column(part.schema.get_field_index(source)))
                yield pa.RecordBatch.from_arrays([*columns, made], [*names, out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, kind)]))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b: long): one row (node, root) per linked node.

    Each round hooks every node to the neighbour of the smallest hashed id and contracts the links, so the
    number of nodes falls by a constant share per round whatever the order of the ids. Tables are written
    between rounds; only whether links are left comes to the driver.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    links = materialize(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    )
    maps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(
            both.groupBy("a").agg(F.min(order("b")).alias("low"))
            .select(F.col("a").alias("node"), F.when(F.col("low") < order("a"), F.col("low.n")).otherwise(F.col("a")).alias("root"))
        )
        maps.append(hooks)
        left = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = materialize(
            links.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1]
    for hooks in reversed(maps[:-1]):
        later = roots.select(F.col("node").alias("via"), F.col("root").alias("last"))
        roots = materialize(
            hooks.join(later, hooks["root"] == later["via"], "left")
            .select("node", F.coalesce("last", "root").alias("root"))
        )
    return roots


def smallest_linked(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``ids`` the smallest id reached by the links between positions ``i`` and ``j``."""
    order = np.argsort(ids, kind="stable")
    low = np.empty(len(ids), np.int64)
    low[order] = np.arange(len(ids))
    while True:
        before = low.copy()
        np.minimum.at(low, i, before[j])
        np.minimum.at(low, j, before[i])
        low = np.minimum(low, low[order[low]])
        if (low == before).all():
            return ids[order[low]]
