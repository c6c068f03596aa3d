"""Live chains of close entries: a table of cells of time that every batch adds to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.timeexpr import micros, parse_window
from ..functions.timestamps import epoch_cell
from ..operators.correlate import cells_of, chained, fold_cells, groups_of
from .deltas import COMPACT, keep_batch, read_folded, run_batches

CELLS = T.StructType(
    [
        T.StructField("cell", T.LongType()),
        T.StructField("service", T.StringType()),
        T.StructField("first_ts", T.TimestampType()),
        T.StructField("last_ts", T.TimestampType()),
        T.StructField("entries", T.LongType()),
        T.StructField("alarms", T.LongType()),
    ]
)


def _place(path: str, gap: int) -> str:
    return f"{path.rstrip('/')}/gap-{gap}"


def _merge(rows: DataFrame) -> DataFrame:
    return fold_cells(rows, "service")


def follow_cells(stream: DataFrame, path: str, window: str = "5m", compact: int = COMPACT, **trigger) -> StreamingQuery:
    """Starts folding the entries of a stream of logs into cells as wide as the window, by service.

    There is no watermark: a late entry falls into its cell like any other, and may join two chains or extend one.
    Entries without a time are left out. A batch adds one row per cell and service it touches, whatever its entries.
    """
    gap = parse_window(window)
    place = _place(path, micros(gap))

    def keep(logs: DataFrame, batch: int) -> None:
        near = logs.where(F.col("ts").isNotNull())
        cells = cells_of(near, epoch_cell(F.col("ts"), gap), "service").select(*CELLS.names)
        keep_batch(cells, place, batch, _merge, compact)

    return run_batches(stream, place, keep, **trigger)


def live_chains(spark: SparkSession, path: str, window: str = "5m", service: str | None = None) -> DataFrame:
    """The chains of all entries so far, as `correlate_time` gives them for the same entries in one table.

    `path` and `window` are those of `follow_cells`; with a service only its entries form chains.
    """
    gap = micros(parse_window(window))
    cells = read_folded(spark, _place(path, gap), CELLS, _merge)
    if service is not None:
        cells = cells.where(F.col("service") == service)
    return groups_of(chained(fold_cells(cells), gap))
