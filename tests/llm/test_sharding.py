"""Rendezvous sharding against a plain version, and its moves when weights or shards change."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog.llm import queries, sharding
from tidelog.llm.common import prepare
from tidelog.session import shared_dir

SF = "/root/testdata/sf0.001"


def plain_shard(key, weights):
    def least(i):
        number = int(hashlib.md5(f"{'' if key is None else key}:{i}".encode()).hexdigest()[:13], 16)
        return -math.log((number + 0.5) / 16**13) / weights[i]

    return min((i for i, w in enumerate(weights) if w), key=least)


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    shards = defaultdict(list)
    for key, text in rows:
        raw = (text or "").encode()
        shards[plain_shard(key, [1.0] * 8)].append((key, zlib.crc32(raw), len(raw) + 1))
    want = {(k, size, crc, "key", s, slot, plain_shard(k, [1.0] * 9))
            for s, own in shards.items() for slot, (k, crc, size) in enumerate(sorted(own))}
    found = [tuple(r) for r in queries.op12_sharding(spark, SF).collect()]
    assert set(found) == want and len(found) == len(rows)


def test_weights_and_growth(spark):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 0.0, 1.0]
    found = keys.select("doc_id", sharding.shard_of(F.col("doc_id"), weights).alias("a"), sharding.shard_of(F.col("doc_id"), [*weights, 4.0]).alias("b"),
                        sharding.shard_of(F.col("doc_id"), [1.0, 3.0, 0.0, 1.0]).alias("c")).collect()
    assert all(r.a == plain_shard(r.doc_id, weights) for r in found[:2000])
    share = Counter(r.a for r in found)
    assert share[2] == 0 and abs(share[1] - 10000) < 400 and abs(share[0] - 5000) < 400
    assert all(r.b in (r.a, 4) for r in found) and abs(sum(r.b == 4 for r in found) - 10000) < 400
    assert all(r.c in (r.a, 1) for r in found)
    for bad in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.col("doc_id"), bad)


def test_odd_rows_keep_their_columns(spark):
    prepare(spark)
    schema = "doc_id bigint, text string, shard string, slot int, file string, first int, _x int"
    rows = [(1, None, "s", 1, "f", 1, 1), (1, "", "s", 1, "f", 1, 1), (None, "x" * 200_000, "s", 1, "f", 1, 1)] + [(None, "a", "s", 1, "f", 1, 1)] * 50
    rows += [(i, f"t{i}", "s", 1, "f", 1, 1) for i in range(300)]
    docs = spark.createDataFrame(rows, schema).repartition(5)
    path = shared_dir(spark, "sharding")
    sharding.write_shards(docs, path, order=("text",))
    found = sharding.read_shards(spark, path, docs.schema).collect()
    assert Counter((r.doc_id, r.text, r.file, r.first, r._x) for r in found) == Counter((r[0], r[1], r[4], r[5], r[6]) for r in rows)
    assert len({r.shard for r in found if r.doc_id is None}) == 1
    for shard in {r.shard for r in found}:
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0, r.text or "") for r in found if r.shard == shard)
        assert [o[0] for o in own] == list(range(len(own))) and [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    path = shared_dir(spark, "sharding")
    sharding.write_shards(docs, path)
    assert sharding.read_shards(spark, path, docs.schema).count() == 0
