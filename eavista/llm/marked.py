"""Keeping rows that cannot be meant out of a shuffle, by a bitmap of fixed size.

The bitmap has ``PLACES`` bits whatever the input: a key sets the bit at its hash. A row
whose bit is not set has none of the keys, for certain. A row whose bit is set may have
one, so it still goes through the exact step. The more keys, the fewer rows are spared;
with many more keys than places all rows go through the exact step, which is the plan
there would be without the bitmap.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from eavista.llm.shared import free_names

PLACES = 1 << 24


def bitmap(hashes: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test on hashes: false for those surely not in ``hashes[column]``. At most 2 MB reach the driver."""
    spark = hashes.sparkSession
    place = hashes.select(F.pmod(F.col(column), F.lit(PLACES)).cast("int").alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits")
    )
    table = np.zeros(PLACES // 64, np.int64)
    for word, bits in words.collect():
        table[word] = bits
    shared = spark.sparkContext.broadcast(table)

    def test(values: pd.Series) -> pd.Series:
        at = np.mod(values.to_numpy(np.int64), PLACES)
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return F.pandas_udf(test, BooleanType())


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose ``key`` is none of ``gone.key`` (null is a key like others); only rows that may be meant move."""
    mark, absent = free_names(rows, "_maybe", "_gone")
    gone = gone.select(F.col("key").alias(absent))
    maybe = bitmap(gone.select(F.xxhash64(absent).alias("h")), "h")
    hashed = rows.withColumn(mark, maybe(F.xxhash64(F.col(key).cast("long"))))
    spared = hashed.filter(~F.col(mark)).drop(mark)
    asked = hashed.filter(F.col(mark)).drop(mark)
    return spared.union(asked.join(gone, asked[key].cast("long").eqNullSafe(F.col(absent)), "left_anti"))
