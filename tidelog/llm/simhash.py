"""SimHash near-duplicates by anchor-point covering.

Words are runs without ASCII white space, A-Z lower-cased. A fingerprint bit is 1 if over half of the XXH64
hashes (seed 42) of the three-word shingles, repeats included, have it. Fingerprints within two bits are linked.

Anchors are the words of a perfect covering code. A fingerprint is sent to every anchor within the covering radius
plus the threshold; two fingerprints within the threshold then share the anchor nearest to either. On all 64 bits
such a code costs hundreds of copies per fingerprint, so the code covers halves: of two fingerprints within two
bits, the upper halves differ by at most one bit or the lower halves do not differ at all. With the Hamming code of
length 31 and one free bit (covering radius 1, 2^27 anchors of 32 bits) that makes about 16.5 copies for the upper
half (radius 2) and one for the lower (radius 1).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import components, extend, staged, unused

SHINGLE = 3
THRESHOLD = 2
SEED = 42
RADIUS = 1  # of the covering code


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint as a signed long; zero for a text without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fingerprint", drop: tuple[str, ...] = ()) -> DataFrame:
    """Documents with the fingerprint of their whole text as a long; a column of that name is replaced."""
    return extend(docs, [text], lambda: lambda texts: [[fingerprint(t) for t in texts]], f"{column} bigint", drop)


def syndrome(halves: np.ndarray) -> np.ndarray:
    """Of the Hamming code over bits 1 to 31: the bit to flip for the nearest code word, 0 for none. Bit 0 is free."""
    out = np.zeros(len(halves), np.uint32)
    for bit in range(1, 32):
        out ^= ((halves >> np.uint32(bit)) & np.uint32(1)) * np.uint32(bit)
    return out


def anchors_within(halves: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every code word within `radius` (1 or 2) bits of each 32-bit half."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    flips = [0, *bits.tolist()]
    if radius == 2:
        flips += [int(bits[i] | bits[j]) for i in range(32) for j in range(i)]
    flips = np.array(flips, np.uint32)
    # A flip of some bits leads to a code word just where its own syndrome is that of the half.
    by = syndrome(flips)
    rows, found = [], []
    own = syndrome(halves)
    for s in np.unique(own):
        at = np.flatnonzero(own == s)
        fit = flips[by == s]
        rows.append(np.repeat(at, len(fit)))
        found.append((halves[at][:, None] ^ fit[None, :]).ravel())
    empty = np.empty(0, np.int64), np.empty(0, np.uint32)
    return (np.concatenate(rows), np.concatenate(found)) if rows else empty


def replicas(batches):
    """(anchor, fingerprint) rows; the halves' anchors are kept apart by the top bit."""
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        upper, lower = (prints >> np.uint64(32)).astype(np.uint32), prints.astype(np.uint32)
        # Upper halves within one bit, or else equal lower halves.
        for side, (half, near) in enumerate(((upper, THRESHOLD - 1), (lower, 0))):
            rows, anchor = anchors_within(half, RADIUS + near)
            keys = anchor.astype(np.int64) | (side << 32)
            for at in range(0, len(keys), 65536):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at : at + 65536]), pa.array(prints[rows[at : at + 65536]].view(np.int64))],
                    names=["anchor", "fingerprint"],
                )


NEIGHBOURS = np.array(
    [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i in range(64) for j in range(i))], np.uint64
)


def links_of(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all fingerprints of one anchor that are within the threshold, at most one per fingerprint.

    Of each fingerprint its 2,081 possible neighbours are looked up in the sorted group, so that the work per
    fingerprint is bounded whatever the group's size.
    """
    prints = np.unique(prints)
    parent = np.arange(len(prints))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, own in enumerate(prints):
        wanted = own ^ NEIGHBOURS
        place = np.minimum(np.searchsorted(prints, wanted), len(prints) - 1)
        near = place[prints[place] == wanted]
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return [(prints[i], prints[j]) for i, j in out]


def compare(batches):
    """Links among the fingerprints of each anchor. Rows come sorted by anchor."""
    held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)

    def groups(keys, prints):
        edges = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        big = np.flatnonzero(np.diff(edges) > 1)
        found = [pair for g in big.tolist() for pair in links_of(prints[edges[g] : edges[g + 1]])]
        if found:
            pairs = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate((held_keys, batch.column(0).to_numpy()))
        prints = np.concatenate((held, batch.column(1).to_numpy().view(np.uint64)))
        cut = int(np.searchsorted(keys, keys[-1]))
        yield from groups(keys[:cut], prints[:cut])
        held_keys, held = keys[cut:], prints[cut:]
    yield from groups(held_keys, held)


def near_components(prints: DataFrame) -> DataFrame:
    """(node, component) for the fingerprints that have a link; both are fingerprints."""
    placed = prints.select("fingerprint").distinct().mapInArrow(replicas, "anchor bigint, fingerprint bigint")
    found = placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a bigint, b bigint")
    return components(found.distinct(), "simhash")


def text_keys(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows as (id, k1, k2, text), k1 and k2 a 128-bit hash of the text."""
    body = F.col(text)
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(body).alias("k1"), F.xxhash64(body, F.lit(1)).alias("k2"), body.alias("text")
    )


def first_rows(nodes: DataFrame, linked: DataFrame, node: str) -> DataFrame:
    """(component, node, component_id, first) of nodes with their least id and first row, and components of those
    with a link."""
    named = nodes.join(linked.withColumnRenamed("node", node), node, "left")
    named = named.withColumn("component", F.coalesce("component", node))
    firsts = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    return named.select(node, "component").join(firsts, "component")


def grouped(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows as (id, k1, k2, fingerprint), k1 and k2 a 128-bit hash of the text, and per fingerprint its component
    with the smallest id and the first row (smallest id, then hash; null ids last)."""
    prints = staged(fingerprints(text_keys(docs, id_col, text), drop=("text",)), "fingerprints")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")
    nodes = prints.groupBy("fingerprint").agg(F.min("id").alias("least"), F.min(first).alias("first"))
    return prints, first_rows(nodes, near_components(prints), "fingerprint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row: component_id is the smallest id reachable by links.

    Null and empty texts have no words and fingerprint zero, linked like any other; a null id never names a
    component unless all its ids are null; every row of a repeated id gets a row. Rows of equal fingerprints are one
    node, so copies make no links among themselves.
    """
    prints, named = grouped(docs, id_col, text)
    found = prints.join(named, "fingerprint")
    return found.select(F.col("id").alias(id_col), "fingerprint", "component_id")


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of every group of near-duplicates, with all its columns: the one with the smallest id, and of
    rows that share this id the one with the smallest hash of its text. Rows equal in both stay once."""
    _, named = grouped(docs, id_col, text)
    return only_firsts(docs, named, id_col, text)


def only_firsts(docs: DataFrame, named: DataFrame, id_col: str, text: str) -> DataFrame:
    """The documents that are a `first` row of a component; rows equal in id and text stay once."""
    prefix = unused(docs)
    keys = [f"{prefix}{k}" for k in ("id", "k1", "k2")]
    first = named.select(*[F.col(f"first.{k}").alias(f"{prefix}{k}_") for k in ("id", "k1", "k2")]).distinct()
    body = F.col(text)
    rows = docs.withColumns(dict(zip(keys, (F.col(id_col), F.xxhash64(body), F.xxhash64(body, F.lit(1))), strict=True)))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return rows.join(first, same, "left_semi").dropDuplicates(keys).drop(*keys)
