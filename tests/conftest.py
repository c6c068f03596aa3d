import json
from datetime import datetime, timezone

import pytest

from tests.oracle import local_session
from tidelog import sources as src
from tidelog.functions.timestamps import parse_ts
from tidelog.schema import conform


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def lines(spark):
    """Lines as `read_log_lines` gives them, from Python strings or objects."""

    def make(values, source="app"):
        rows = [
            (source, "f", 0, i, v if isinstance(v, str) else json.dumps(v))
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(
            rows, "source string, file_path string, block_start bigint, line_pos bigint, value string"
        )

    return make


@pytest.fixture
def entries(lines):
    """Entries parsed from JSON objects."""

    def make(values, source="app", **options):
        return src.parse_lines(lines(values, source), opts=src.LineOptions(**options))

    return make


@pytest.fixture
def made(spark):
    """Entries given column by column, times as ISO text."""

    def make(*rows):
        names = ["ts_raw", "level", "message", "service", "source", "trace_id"]
        full = [(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)]
        schema = "seq bigint, " + ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame(full, schema)
        return conform(df.withColumn("ts", parse_ts(df.ts_raw)))

    return make


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def utc(value):
    """Collected timestamps are local naive times of this process."""
    return value.astimezone(timezone.utc) if value else None
