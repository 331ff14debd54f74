"""Running sums over a whole table, without a window that holds a whole group or table in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from wayline.plans.storage import materialize


def running_sum(df: DataFrame, order: list[str], value: str, within: str | None = None, out: str = "before") -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in ``order`` (of the same ``within``, if given).

    ``within`` is the first column of ``order`` and holds no nulls.  Rows are dealt by ranges, summed in each
    part and written; what came before a part is a row per part at most, so it is broadcast.
    ``order`` should be unique, or rows that tie take their places in any order.
    """
    names = df.columns
    v, g = names.index(value), names.index(within) if within else None

    def run(batches):
        part, total, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            x = b.column(v).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(x) - x
            if g is None:
                local = before + total
                total += int(x.sum())
            else:
                key = b.column(g)
                new = np.concatenate(([key[0].as_py() != last], np.asarray(pa.compute.not_equal(key[1:], key[:-1])))) if len(x) else np.zeros(0, bool)
                at = np.maximum.accumulate(np.where(new, np.arange(len(x)), -1))
                local = before - np.where(at >= 0, before[np.maximum(at, 0)], -total)
                if len(x):
                    total, last = int(local[-1] + x[-1]), key[-1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(x), pa.int32()), pa.array(local, pa.int64())], names=[*names, "_part", "_local"])

    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "running")
    keys = ["_part"] + ([within] if within else [])
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    earlier = (Window.partitionBy(within) if within else Window.partitionBy()).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Of the groups of a part only the first can have begun in an earlier part.
    offsets = sums.select(*keys, F.sum("_sum").over(earlier).alias("_earlier")).where("_earlier > 0")
    return rows.join(F.broadcast(offsets), keys, "left").select(*names, (F.col("_local") + F.coalesce("_earlier", F.lit(0))).alias(out))
