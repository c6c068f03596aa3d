"""Live tables: repeated and interrupted batches, late rows, several sources; compared with the batch forms."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.operators import correlate
from tidelog.plans.events import logs
from tidelog.schema import LOG_SCHEMA
from tidelog.session import shared_dir
from tidelog.sources import lines as line_source
from tidelog.streaming import cells, deltas, files, follow, windows

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(str(v) for v in r) for r in df.collect())


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.writelines(line + "\n" for line in lines)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def numbered(table):
    return [(r.seq, r.message) for r in table.orderBy("seq").collect()]


def test_files_over_runs_and_failures(spark, tmp_path, monkeypatch):
    given, out = str(tmp_path / "in"), str(tmp_path / "table")

    def run(**more):
        files.follow_files(spark, f"{given}/**/*.log", "app", out, pattern=r"(?P<level>\w+): (?P<message>.*)", **more).awaitTermination()

    assert files.read_live_table(spark, out).count() == 0
    put(f"{given}/a", "1.log", ["INFO: m0", "", "ERROR: m1"])
    run()
    assert numbered(files.read_live_table(spark, out)) == [(0, "m0"), (2, "m1")]  # blank lines have numbers too
    put(f"{given}/b", "2.log", ["WARN: m2", "plain"])
    put(f"{given}/a", "skipped.txt", ["INFO: no"])

    # The run ends after the batch's rows are written and before the batch is done; what it wrote is not seen.
    kept = files.folder_of

    def broken(*given):
        raise RuntimeError("lost")

    monkeypatch.setattr(files, "folder_of", lambda spark, path: broken() if "staging" in path else kept(spark, path))
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(files, "folder_of", kept)
    assert os.path.exists(f"{out}/source=app/batch=1")
    assert len(numbered(files.read_live_table(spark, out))) == 2
    put(f"{given}/0", "3.log", ["INFO: m4"])  # comes between the failure and the next run
    run()
    assert numbered(files.read_live_table(spark, out)) == [(0, "m0"), (2, "m1"), (3, "m2"), (4, "plain"), (5, "m4")]
    run()  # nothing new
    assert files.read_live_table(spark, out).count() == 5


def test_sources_share_a_table(spark, tmp_path):
    out = str(tmp_path / "table")
    for source in ("a", "b"):
        for i in range(3):
            put(str(tmp_path / source), f"{i}.log", [f'{{"timestamp": "2024-01-0{i + 1}T00:00:00Z", "message": "{source}{i}-{j}"}}' for j in range(3)])
            os.utime(tmp_path / source / f"{i}.log", (1_700_000_000 + i, 1_700_000_000 + i))
        files.follow_files(spark, str(tmp_path / source), source, out, files_per_batch=1).awaitTermination()
    found = files.read_live_table(spark, out)
    assert found.schema.names == [*LOG_SCHEMA.names, "dt"]
    for source in ("a", "b"):
        own = found.where(F.col("source") == source)
        assert sorted(r.seq for r in own.collect()) == list(range(9))
        # Files are taken in the order of their times, one per batch.
        assert [r.message[1] for r in own.orderBy("seq").collect()] == list("000111222")
    assert [str(r.dt) for r in found.select("dt").distinct().orderBy("dt").collect()] == ["2024-01-01", "2024-01-02", "2024-01-03"]


@pytest.fixture(scope="module")
def scrambled(spark):
    """The log view as four files that each span the whole time."""
    path = shared_dir(spark, "scrambled")
    for part in range(4):
        logs(spark, SF_DIR).where(F.col("seq") % 4 == part).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("window, service, compact", [("10m", None, 2), ("1h", "svc1", 50)])
def test_chains_of_late_entries(spark, scrambled, window, service, compact):
    out = shared_dir(spark, "cells")
    cells.follow_cells(stream(spark, scrambled), out, window, compact).awaitTermination()
    assert rows(cells.live_chains(spark, out, window, service)) == rows(correlate.correlate_time(logs(spark, SF_DIR), window, service))
    folder = f"{out}/{os.listdir(out)[0]}"
    assert ("sums" in os.listdir(folder)) == (compact == 2)
    if compact == 2:  # what the sum before the last one covers is gone
        assert sorted(n for n in os.listdir(f"{folder}/batches") if n.startswith("batch")) == ["batch=2", "batch=3"]


def test_a_repeated_batch_adds_nothing(spark, scrambled):
    """Every batch is written once, its try is lost, and written again."""
    out = shared_dir(spark, "cells")
    stream_of = stream(spark, scrambled)
    for _ in range(4):
        tries = []

        def lose(rows, batch):
            tries.append(batch)
            deltas.keep_batch(rows.groupBy("level").count(), out, batch, merge, 3)
            raise RuntimeError("lost")

        def merge(rows):
            return rows.groupBy("level").agg(F.sum("count").alias("count"))

        with pytest.raises(Exception, match="lost"):
            deltas.run_batches(stream_of, out, lose).awaitTermination()
        before = deltas.done(spark, out)

        def keep(rows, batch):
            if batch > before + 1:
                raise RuntimeError("enough")
            deltas.keep_batch(rows.groupBy("level").count(), out, batch, merge, 3)

        try:
            deltas.run_batches(stream_of, out, keep).awaitTermination()
        except Exception as end:
            assert "enough" in str(end)
    schema = logs(spark, SF_DIR).groupBy("level").count().schema
    assert rows(deltas.read_folded(spark, out, schema, merge)) == rows(logs(spark, SF_DIR).groupBy("level").count())


def test_open_windows_in_their_last_version(spark):
    given, out = shared_dir(spark, "given"), shared_dir(spark, "windows")
    keys = ["timestamp_bucket", "level"]
    for part in range(4):
        week = logs(spark, SF_DIR).where((F.dayofmonth("ts") - 1).between(part * 8, part * 8 + 7))
        week.coalesce(1).write.mode("append").parquet(given)
        live = follow.follow_aggregate(stream(spark, given), ["level"], "1h", "10m")
        got = deltas.run_to_latest(live, out, keys, compact=3)
    want = follow.follow_aggregate(logs(spark, SF_DIR), ["level"], "1h")
    assert rows(got) == rows(want) and got.count() == want.count() > 0


def test_late_entries_equal_a_plain_count(spark, scrambled):
    out = shared_dir(spark, "windows")
    windows.follow_windows(stream(spark, scrambled), out, ["level"], "1h", "10d", "value", compact=2).awaitTermination()
    found = {r.batch: r for r in windows.late_entries(spark, out).collect()}
    parts = [[r for r in logs(spark, SF_DIR).select("seq", "ts", "level", F.col("fields")["value"].cast("double").alias("value")).collect()
              if r.seq % 4 == part] for part in range(4)]
    newest, on_time = None, []
    for batch, part in enumerate(parts):
        late = 0
        for r in part:
            end = int(r.ts.timestamp()) // 3600 * 3600 + 3600
            if newest is not None and end <= newest - 10 * 86400:
                late += 1
            else:
                on_time.append((end - 3600, r.level, r.value))
        assert (found[batch].entries, found[batch].late) == (len(part), late)
        newest = max([newest or 0, *(r.ts.timestamp() for r in part)])
    assert sum(r.late for r in found.values()) > 0
    for metric, fold in (("sum", sum), ("min", min), ("max", max), ("avg", lambda v: sum(v) / len(v))):
        groups = {}
        for start, level, value in on_time:
            groups.setdefault((start, level), []).append(value)
        got = windows.live_windows(spark, out, ["level"], metric).collect()
        assert {(int(r.timestamp_bucket.timestamp()), r.level): (round(r.value, 6), r["count"]) for r in got} == {
            k: (round(fold(v), 6), len(v)) for k, v in groups.items()
        }


def test_patterns_of_paths(spark, tmp_path):
    for name in ("mnt/logs/app.log", "x/y/a1.log", "x/y/a b.log", "x/z/a+c%.log", "x/top.log", "x/y/n/deep.log"):
        put(str(tmp_path / os.path.dirname(name)), os.path.basename(name), [name])
    root = str(tmp_path)
    cases = {
        ("/logs/app.log", f"{root}/mnt/logs/app.log"): ["mnt/logs/app.log"],
        (f"{root}/x/**/a[0-9].log",): ["x/y/a1.log"],
        (f"{root}/x/*/a[!b ]*.log",): ["x/y/a1.log", "x/z/a+c%.log"],
        (f"{root}/x/**/a b.log",): ["x/y/a b.log"],
        (f"{root}/x/**/a+c%.log",): ["x/z/a+c%.log"],
        (f"{root}/x/**/{{top,deep}}.log",): ["x/top.log", "x/y/n/deep.log"],
        (f"{root}/x/y", f"{root}/x/**"): ["x/top.log", "x/y/a b.log", "x/y/a1.log", "x/y/n/deep.log", "x/z/a+c%.log"],
    }
    for paths, want in cases.items():
        found = line_source.read_log_lines(spark, list(paths), "s")
        assert sorted(r.value for r in found.collect()) == want, paths
        listed = line_source.log_files(spark, list(paths), "s")
        assert listed.count() == len(want) and listed.where("readable").count() == len(want)


def test_letters_of_all_scripts(spark, lines):
    found = line_source.parse_regex_lines(lines(["ERROR café: hi", "WARN 日本 x: ٣ days"]), r"(?P<level>\w+)\s(?P<service>[\w\s]+): (?P<message>.*)")
    assert [(r.level, r.service, r.message) for r in found.collect()] == [("ERROR", "café", "hi"), ("WARN", "日本 x", "٣ days")]
    digits = line_source.parse_regex_lines(lines(["٣ x"]), r"(?P<n>\d) (?P<message>[[x&&]+)")
    assert digits.count() == 1
    for refused in (r"(a)(?(1)b|c)", r"(?a)\w", r"a(?#x)"):
        with pytest.raises(ValueError):
            line_source.compile_pattern(refused)
