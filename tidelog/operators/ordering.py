"""Order, limits and paging.

`seq` is unique within a source, so (time, seq, source) orders any set of entries totally and no
page depends on the run.
"""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.timeexpr import TimeRange, UTC
from .predicates import in_time_range, search

# Values of `seq` per block of a page's counts.
SEQ_BLOCK = 1 << 16

# Input tasks whose first rows are merged before the last round.
FAN_IN = 1024


def latest(logs: DataFrame, limit: int) -> DataFrame:
    """Newest first, at most `limit`; entries without a time come last."""
    newest = [F.col("ts").desc_nulls_last(), F.col("seq").desc(), F.col("source").desc()]
    return logs.orderBy(*newest).limit(limit)


def newest_days(table: DataFrame, limit: int) -> DataFrame:
    """The newest days of the log table that together have `limit` entries, and those without a time.

    Made for the table as it was written: its entries per day are counted without reading a column, and only the
    folders of the chosen days are opened afterwards. A table with fewer entries stays whole.
    """
    days = table.where(F.col("dt").isNotNull()).groupBy("dt").agg(F.count("*").alias("n"))
    # One row per day.
    newer = F.sum("n").over(W.orderBy(F.col("dt").desc()))
    enough = days.withColumn("newer", newer).where(F.col("newer") >= limit).agg(F.max("dt").alias("dt"))
    return table.where(F.col("dt").isNull() | (F.col("dt") >= F.coalesce(enough.scalar(), F.lit("0001-01-01").cast("date"))))


def first_matches(logs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Ingest order, `offset` rows skipped, at most `limit` taken.

    Matches are counted per block of `seq` values, and only the rows of blocks that overlap the page are ranked, so
    the page costs the same at any depth. Entries without `seq` come first, in an order of their
    content's hash, which deals them to blocks of their own.
    """
    seq = F.col("seq")
    mixed = F.when(seq.isNull(), F.xxhash64("source", "ts", "message", "raw") if "raw" in logs.columns else F.xxhash64("source", "ts", "message"))
    block = F.coalesce(F.call_function("div", seq, F.lit(SEQ_BLOCK)), F.shiftright(mixed, 48) - (1 << 16))
    blocked = logs.withColumns({"page_hash": mixed, "page_block": block})
    counts = blocked.groupBy("page_block").agg(F.count("*").alias("n"))
    # One row per occupied block, never one per entry.
    before = F.sum("n").over(W.orderBy("page_block").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    wanted = counts.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    order = ["seq", "page_hash", "source", "ts", "message"]
    rank = F.row_number().over(W.partitionBy("page_block").orderBy(*order)) + F.col("before")
    page = blocked.join(wanted.drop("n"), "page_block").withColumn("page_rank", rank)
    page = page.where((F.col("page_rank") > offset) & (F.col("page_rank") <= offset + limit))
    return page.orderBy("page_rank").limit(limit).drop("page_hash", "page_block", "before", "page_rank")


def next_offset(limit: int, offset: int, returned: int) -> int | None:
    """Offset of the next page, None once a page came back short."""
    return offset + limit if returned >= limit else None


def encode_cursor(ts: datetime | None, seq: int, source: str = "") -> str:
    """Token of the last entry of a page; the source matters where several are paged together."""
    stamp = ts.replace(tzinfo=ts.tzinfo or UTC).isoformat() if ts else None
    return base64.urlsafe_b64encode(json.dumps([stamp, seq, source]).encode()).decode()


def decode_cursor(token: str) -> tuple[datetime | None, int, str]:
    stamp, seq, source = json.loads(base64.urlsafe_b64decode(token))
    return (datetime.fromisoformat(stamp) if stamp else None), seq, source


def page_after(logs: DataFrame, cursor: str | None, limit: int) -> DataFrame:
    """The page after the token, newest first. Costs the same however deep the page is."""
    if cursor:
        last_ts, last_seq, last_source = decode_cursor(cursor)
        ts, seq = F.col("ts"), F.col("seq")
        older = (seq < last_seq) | ((seq == last_seq) & (F.col("source") < last_source))
        if last_ts is None:
            logs = logs.where(ts.isNull() & older)
        else:
            at = F.lit(last_ts)
            logs = logs.where(ts.isNull() | (ts < at) | ((ts == at) & older))
            if "dt" in logs.columns:
                logs = logs.where(F.col("dt").isNull() | (F.col("dt") <= F.lit(last_ts.astimezone(UTC).date())))
    return latest(logs, limit)


def tail(logs: DataFrame, lines: int = 50, query: str | None = None) -> DataFrame:
    """The last `lines` entries in ingest order, oldest of them first, after an optional search."""
    found = search(logs, query) if query else logs
    last = found.orderBy(F.col("seq").desc(), F.col("source").desc()).limit(lines)
    return last.orderBy("seq", "source")


def top_n(buckets: DataFrame, n: int, count: str = "count") -> DataFrame:
    """Highest counts first, ties by the other columns ascending."""
    keys = [c for c in buckets.columns if c not in (count, "value")]
    return buckets.orderBy(F.col(count).desc(), *keys).limit(n)


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first `n` rows of each group in a total order.

    Every input task first cuts each group to its first `n` rows, which Spark does by itself up to the
    limit in `session.SETTINGS`. What is left is merged over FAN_IN salts and
    then per group, so the last round sees at most FAN_IN * n rows of a group whatever its size.
    The salt is the number of the input task; any salt gives the same rows.
    """

    def cut(rows, by):
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        return rows.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")

    salted = df.withColumn("salt", F.spark_partition_id())
    salted = cut(salted.withColumn("salt", F.col("salt") % FAN_IN), [*keys, "salt"])
    return cut(salted.drop("salt"), keys)


def top_per_source(logs: DataFrame, n: int) -> DataFrame:
    """The first `n` entries of each source by time."""
    return top_per_group(logs, ["source"], [F.col("ts").asc_nulls_last(), "seq"], n)


def timeline(logs: DataFrame, tr: TimeRange | None = None) -> DataFrame:
    """Entries oldest first, those without a time at the end."""
    return (
        in_time_range(logs, tr)
        .orderBy(F.col("ts").asc_nulls_last(), "source", "seq")
        .select("ts", "source", "level", "service", "message")
    )
