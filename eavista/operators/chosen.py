"""Rows of chosen projects alone, held back before they are aggregated.

A report that is filtered keeps few projects; their values, milestones and links need not be
sorted and shuffled with those of all others. The chosen ids are counted: where they fit a
broadcast they sift the rows exactly. Beyond, a bitmap of their hashes does, which lets
through some rows of others; those find no project later on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from eavista.sources.shared import broadcast_limit, written

# Bytes of an id in a broadcast, bits per id in a bitmap, and bits of the largest bitmap.
ID_BYTES = 32
BITS_PER_ID = 16
MOST_BITS = 1 << 29
# Bits of one row of the bitmap: what Spark's bitmap aggregate makes.
ROW_SHIFT = 15
ROW_BITS = 1 << ROW_SHIFT


@dataclass(frozen=True)
class Chosen:
    """``sift`` is the table that rows meet: ids, or rows of a bitmap of ``bits`` bits."""

    sift: DataFrame
    count: int
    bits: int = 0

    def rows(self, frame: DataFrame, key: str) -> DataFrame:
        """The rows of ``frame`` whose ``key`` is chosen; with a bitmap, a few others too."""
        if not self.bits:
            return frame.join(self.sift.withColumnRenamed("id", key), key, "left_semi")
        # A semi join, so that Spark can hold rows back before they are exploded or computed.
        place = _place(F.col(key), self.bits)
        position = place.bitwiseAND(F.lit(ROW_BITS - 1))
        number = F.get(F.col("mapa"), F.shiftright(position, 6).cast("int"))
        bit = F.call_function("shiftright", number, position.bitwiseAND(F.lit(63)).bitwiseXOR(F.lit(56)).cast("int"))
        same_row = F.shiftright(place, ROW_SHIFT) == F.col("fila_mapa")
        return frame.join(self.sift, same_row & (bit.bitwiseAND(F.lit(1)) == 1), "left_semi")


def choose(ids: DataFrame, limit: int | None = None) -> Chosen:
    """Of a frame with a column ``id``: its ids, computed and counted once."""
    ids = written(ids.select("id").filter("id is not null"))
    count = ids.count()
    if count * ID_BYTES <= (broadcast_limit(ids.sparkSession) if limit is None else limit):
        return Chosen(F.broadcast(ids), count)
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (count * BITS_PER_ID - 1).bit_length()))
    place = _place(F.col("id"), bits)
    rows = ids.groupBy(F.shiftright(place, ROW_SHIFT).alias("fila_mapa")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit(ROW_BITS - 1))).alias("mapa")
    )
    # As numbers of 64 bits, the first of eight bytes highest: a row's test reads one number.
    each = F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1))
    rows = rows.select("fila_mapa", F.transform(each, lambda i: _number("mapa", i)).alias("mapa"))
    # At most MOST_BITS / 8 bytes.
    return Chosen(F.broadcast(written(rows)), count, bits)


def _number(column: str, i: Column) -> Column:
    return F.conv(F.hex(F.substring(column, 8 * i + 1, F.lit(8))), 16, -10).cast("bigint")


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(bits))
