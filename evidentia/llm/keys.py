"""What the operators share on rows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a one-column id table that may be sent to every task (16 MB of longs).
BROADCAST_ROWS = 2_000_000


#: Rows of an Arrow batch of texts; a batch is held whole on both sides, and texts may be very long.
BATCH_ROWS = 500


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches have ``BATCH_ROWS`` rows at most."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id, text`` and what else is named, with a partition-wise unique ``row_key`` that no null or repeat upsets."""
    return docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def smallest_first(column: str = "doc_id") -> Column:
    """A document id for comparisons: null ids come last."""
    return F.coalesce(F.col(column).cast("long"), F.lit((1 << 63) - 1))


def maybe_broadcast(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow table for broadcast if it has ``most`` rows at most; else leave the join to shuffle."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


#: Bits of the sketch in :func:`maybe_in`: 16 MB, whatever the input.
SKETCH_BITS = 1 << 27


def maybe_in(rows: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The rows whose long ``column`` may be among ``values``' one column: none that is goes, few others stay.

    A bitmap of ``SKETCH_BITS`` bits, one for each value's remainder, is sent to every task, 4096 pieces of 4 KB at
    most. It only spares a join's shuffle; the join itself must follow. The fuller the bitmap the less it spares.
    """
    place = F.pmod(F.col(column), F.lit(SKETCH_BITS))
    marks = values.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    piece = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    marks = F.broadcast(marks.select("bucket", piece.alias("piece")))
    bit = F.bitmap_bit_position(place)
    inner = (7 - F.floor(bit / 8) % 8) * 8 + bit % 8
    own = rows.withColumns({"bucket": F.bitmap_bucket_number(place), "_bit": bit, "_inner": inner.cast("int")}).join(marks, "bucket")
    hit = F.expr("bit_get(piece[cast(_bit div 64 as int)], _inner)") == 1
    return own.filter(hit).drop("bucket", "piece", "_bit", "_inner")


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
