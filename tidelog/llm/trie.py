"""The prefix trie of conversations, by a skeleton of splitters.

A conversation is a path: the MD5 of role and text of each turn, with the turn's number of words, one element after the
other as bytes. In the order of (path, conversation) the members of a trie node lie next to each other. Paths are cut into
shards at splitters from a sample; a node lies in one shard whole unless it is a prefix of a splitter. These prefixes, the
skeleton, form a trie of bounded size that is broadcast. A task runs through its sorted shard with the current path's nodes
on a stack and finishes every node off the skeleton; for skeleton nodes it hands on what its shard adds, which is summed
over shards, and the skeleton is finished from these sums. Where a splitter ends inside a group of equal paths, the group
is cut by conversation, so equal paths in any number spread over shards.

The sample moves only the cuts, never the result. A task holds one path, the stack, and the rows that wait for their parent
to end, all within its shard; member lists are hashed as they pass.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import extend, staged

ELEMENT = 20  # bytes: 16 of the MD5, 4 of the number of words
#: Bytes of paths in a shard, as long as there are fewer than SHARDS of them.
SHARD_BYTES = 1 << 20
SHARDS = 10_000
#: Bytes of all splitters: longer ones are cut, which is a cut at another place.
SPLITTER_BYTES = 4 << 20
#: Paths in the sample for every shard.
SAMPLED = 20
#: Conversations in one piece of a skeleton node's list.
PIECE = 4096
LAST = 2**63 - 1
NO_ENDS = hashlib.sha256().hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

FOUND = (
    "skeleton int, parent_skeleton int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, words bigint, ends string"
)
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def paths_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation in the order of its turns, null turns first.

    Null roles and texts count as empty. Turns of one number are ordered by the MD5 of role and text. Rows without a
    conversation are left out; repeated rows are turns like any other. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.unhex(F.lpad(F.hex(F.regexp_count(text, F.lit(WORD))), 8, "0"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.concat(digest, words).alias("element")
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "element"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(0).to_numpy()
            raw = b"".join(batch.column(1).to_pylist())
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            done: list[tuple[int, bytes]] = []
            for a, b in zip(edges, edges[1:]):
                if ids[a] != own:
                    if parts:
                        done.append((own, b"".join(parts)))
                    own, parts = int(ids[a]), []
                parts.append(raw[a * ELEMENT : b * ELEMENT])
            yield pairs(done)
        if parts:
            yield pairs([(own, b"".join(parts))])

    def pairs(done):
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.binary())], names=["conv_id", "path"]
        )

    sorted_turns = turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "element")
    return sorted_turns.mapInArrow(joined, "conv_id bigint, path binary")


def grafted(paths: DataFrame, every: int = 20, turns: int = 4) -> DataFrame:
    """Paths that begin with turns of another conversation: the first h of conversation c - c % every (all if it has fewer,
    none if it is absent), then the own ones after the first h; h is the CRC-32 of the decimal c, modulo `turns`."""
    own = F.col("conv_id")
    h = (F.crc32(own.cast("string")) % turns).cast("int") * ELEMENT
    heads = paths.where(own % every == 0).select(own.alias("from"), F.substring("path", 1, (turns - 1) * ELEMENT).alias("head"))
    joint = paths.withColumn("from", own - own % every).join(heads, "from", "left").withColumn("h", h)
    head = F.coalesce(F.expr("substring(head, 1, h)"), F.lit(b""))
    return joint.select("conv_id", F.concat(head, F.expr("substring(path, h + 1)")).alias("path"))


def alike(a: bytes, b: bytes) -> int:
    """The number of elements that two paths begin with alike."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // ELEMENT
    differ = np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size)
    return int(differ.argmax()) // ELEMENT


class Skeleton:
    """The trie of the splitter paths. Node 0 is the root; a node's number is above its parent's."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.parent, self.depth, self.words = [-1], [0], [0]
        self.nodes: list[list[int]] = []  # of every splitter, from the root on
        before, own = b"", [0]
        for path, _ in splitters:
            own = own[: alike(before, path) + 1]
            while len(own) <= len(path) // ELEMENT:
                self.parent.append(own[-1])
                self.depth.append(len(own))
                self.words.append(int.from_bytes(path[len(own) * ELEMENT - 4 : len(own) * ELEMENT]))
                own.append(len(self.parent) - 1)
            self.nodes.append(own)
            before = path

    def shard(self, path: bytes, conversation: int) -> int:
        return bisect_right(self.splitters, (path, conversation))

    def edges(self, shard: int) -> list[tuple[bytes, list[int]]]:
        """The paths that a shard lies between, with their nodes."""
        sides = [(self.splitters[i][0], self.nodes[i]) for i in (shard - 1, shard) if 0 <= i < len(self.splitters)]
        return sides or [(b"", [0])]

    def finished(self, sums: dict[int, tuple]) -> list[tuple]:
        """(skeleton, NODES but the last) of all nodes, from what the shards add: (n, least, children, leaves, saved)."""
        size = len(self.parent)
        n, low, kids, leaves, saved = ([0] * size, [LAST] * size, [0] * size, [0] * size, [0] * size)
        for i, own in sums.items():
            n[i], low[i], kids[i], leaves[i], saved[i] = own
        for i in range(size - 1, -1, -1):
            leaves[i] += kids[i] == 0
            saved[i] += (n[i] - 1) * self.words[i]
            if i:
                up = self.parent[i]
                n[up] += n[i]
                low[up] = min(low[up], low[i])
                kids[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
        parents = [None if up < 0 else low[up] for up in self.parent]
        return list(zip(range(size), low, self.depth, parents, n, kids, leaves, saved, strict=True))


def skeleton_of(paths: DataFrame, shard_bytes: int = SHARD_BYTES) -> Skeleton:
    """Splitters that cut the paths (conv_id, path) into shards of about equal bytes."""
    weight = F.octet_length("path") + 2 * ELEMENT
    n, size = paths.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    shards = min(1 + size // shard_bytes, SHARDS)
    if shards == 1:
        return Skeleton([])
    longest = max(1, SPLITTER_BYTES // shards // ELEMENT) * ELEMENT
    share = min(1.0, SAMPLED * shards / n)
    sample = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = sample.select(F.substring("path", 1, longest), F.octet_length("path"), "conv_id").collect()
    # A splitter that was cut stands before all paths that begin like it.
    keys = sorted((bytes(path), conv_id if length <= longest else -(2**63), length) for path, length, conv_id in rows)
    total = np.cumsum([length + 2 * ELEMENT for _, _, length in keys])
    wanted = np.arange(1, shards) * (total[-1] / shards) if len(keys) else []
    places = np.unique(np.searchsorted(total, wanted))
    return Skeleton(sorted({keys[i][:2] for i in places.tolist()}))


class Run:
    """One pass over a sorted shard: the nodes of the current path on a stack, of which the first are skeleton nodes."""

    def __init__(self, sides: list[tuple[bytes, list[int]]]):
        self.sides, self.path, self.stack = sides, b"", [0]  # stack: numbers of the skeleton nodes on the path
        self.columns = np.zeros((6, 64), np.int64)
        self.n, self.low, self.kids, self.leaves, self.saved, self.words = self.columns
        self.low[0] = LAST
        self.waiting: dict[int, list[tuple]] = {}  # rows by the depth of their parent, where that is no skeleton node
        self.digests: dict[int, str] = {}
        self.digest, self.ends, self.first = None, [], True
        self.out: list[tuple] = []

    def add(self, path: bytes, conversation: int) -> None:
        if self.first or path != self.path:
            self.first = False
            self.end()
            self.turn(path)
        at = len(path) // ELEMENT
        self.n[at] += 1
        self.low[at] = min(self.low[at], conversation)
        if at < len(self.stack):
            self.ends.append(conversation)
            if len(self.ends) == PIECE:
                self.piece()
        elif self.digest is None:
            self.digest = hashlib.sha256(str(conversation).encode())
        else:
            self.digest.update(f",{conversation}".encode())

    def piece(self) -> None:
        if self.ends:
            node, text = self.stack[len(self.path) // ELEMENT], ",".join(map(str, self.ends))
            self.out.append((node, None, self.ends[0], *[None] * 8, text))
            self.ends = []

    def end(self) -> None:
        """The current path has no more conversations."""
        self.piece()
        if self.digest is not None:
            self.digests[len(self.path) // ELEMENT] = self.digest.hexdigest()
            self.digest = None

    def turn(self, path: bytes) -> None:
        """Leaves the nodes that are not on the new path and enters its own."""
        kept, size = alike(self.path, path), len(path) // ELEMENT
        self.close(kept)
        if size >= self.columns.shape[1]:
            wider = np.zeros((6, 2 * size), np.int64)
            wider[:, : self.columns.shape[1]] = self.columns
            self.columns = wider
            self.n, self.low, self.kids, self.leaves, self.saved, self.words = wider
        new = slice(kept + 1, size + 1)
        self.columns[:, new] = 0
        self.low[new] = LAST
        if size > kept:
            raw = np.frombuffer(path, np.uint8).reshape(-1, ELEMENT)[kept:, 16:]
            self.words[new] = np.ascontiguousarray(raw).view(">u4").ravel()
        both = [(alike(path, side), nodes) for side, nodes in self.sides]
        reach, nodes = max(both, key=lambda b: b[0])
        self.stack = self.stack[: kept + 1]
        self.stack += nodes[len(self.stack) : reach + 1]
        # Children that are skeleton nodes are counted once, in the skeleton.
        self.kids[max(kept, reach) : size] += 1
        self.path = path

    def close(self, kept: int) -> None:
        """Finishes the nodes deeper than `kept`."""
        deepest, known = len(self.path) // ELEMENT, len(self.stack) - 1
        up = max(kept, known)
        if deepest > up:
            own = slice(up + 1, deepest + 1)
            n = self.n[own][::-1].cumsum()[::-1]
            low = np.minimum.accumulate(self.low[own][::-1])[::-1]
            self.leaves[deepest] += self.kids[deepest] == 0
            leaves = self.leaves[own][::-1].cumsum()[::-1]
            saved = (self.saved[own] + (n - 1) * self.words[own])[::-1].cumsum()[::-1]
            lows = low.tolist()
            for i, row in enumerate(zip(lows, n.tolist(), self.kids[own].tolist(), leaves.tolist(), saved.tolist())):
                depth = up + 1 + i
                digest = self.digests.pop(depth, NO_ENDS)
                node = (row[0], depth, *row[1:], digest)
                if i:
                    self.emit(node, lows[i - 1])
                elif up == known:
                    self.emit(node, None, self.stack[up])
                else:
                    self.waiting.setdefault(up, []).append(node)
                for child in self.waiting.pop(depth, ()):
                    self.emit(child, row[0])
            self.n[up] += n[0]
            self.low[up] = min(self.low[up], low[0])
            self.leaves[up] += leaves[0]
            self.saved[up] += saved[0]
        for d in range(kept + 1, min(deepest, known) + 1):
            n, low, kids, leaves, saved = (int(c[d]) for c in self.columns[:5])
            self.out.append((self.stack[d], None, low, d, None, n, kids, leaves, saved, None, 0, None))

    def emit(self, node: tuple, parent: int | None, skeleton: int | None = None) -> None:
        low, depth, n, kids, leaves, saved, digest = node
        self.out.append((None, skeleton, low, depth, parent, n, kids, leaves, saved, digest, None, None))

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def prefix_trie(paths: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The trie's nodes (NODES) of paths (conv_id, path); conversations are not repeated.

    conv_id is a node's smallest member, n_convs counts its members, n_leaves the childless nodes in its subtree;
    saved_tokens sums over its subtree (n_convs - 1) times the words of each node's last turn; ends_sha256 is the SHA-256
    of the ascending decimal ids, joined by commas, of the conversations that end there. The root has depth 0 and no
    parent. Without conversations there is no node. Equal texts under different roles are different turns.
    """
    spark = paths.sparkSession
    paths = staged(paths.select("conv_id", "path"), "paths")
    skeleton = skeleton_of(paths, shard_bytes)
    sent = spark.sparkContext.broadcast(skeleton)

    def start():
        own = sent.value
        return lambda path, ids: [[own.shard(p, i) for p, i in zip(path, ids)]]

    schema = T._parse_datatype_string(FOUND)
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64()
             for f in schema.fields]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=schema.names)

        run, shard = None, None
        for batch in batches:
            for path, conversation, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if own != shard:
                    if run is not None:
                        run.end()
                        run.close(-1)
                        yield rows(run.taken())
                    run, shard = Run(sent.value.edges(own)), own
                run.add(path, conversation)
                if len(run.out) >= 4096:
                    yield rows(run.taken())
        if run is not None:
            run.end()
            run.close(-1)
            yield rows(run.taken())

    dealt = extend(paths, ["path", "conv_id"], start, "shard int").repartitionById(len(skeleton.splitters) + 1, F.col("shard"))
    found = staged(dealt.sortWithinPartitions("shard", "path", "conv_id").select("path", "conv_id", "shard").mapInArrow(finish, schema), "nodes")
    # The skeleton has at most SPLITTER_BYTES / ELEMENT nodes and the root; its sums are one row each.
    added = found.where("skeleton is not null and ends is null").groupBy("skeleton")
    sums = added.agg(F.sum("n_convs"), F.min("conv_id"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens")).collect()
    top = skeleton.finished({own: tuple(rest) for own, *rest in sums}) if sums else []
    whole = staged(spark.createDataFrame(top, f"skeleton int, {', '.join(f'{c} bigint' for c in NODES[:-1])}"), "skeleton")
    ends = found.where("ends is not null").select("skeleton", "conv_id", "ends").repartition("skeleton")
    ends = ends.sortWithinPartitions("skeleton", "conv_id").select("skeleton", "ends").mapInArrow(digests, "skeleton int, ends_sha256 string")
    top = whole.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    above = F.broadcast(whole.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("above")))
    rest = found.where("skeleton is null").drop("skeleton", "words", "ends").join(above, "parent_skeleton", "left")
    rest = rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return top.select(*NODES).unionByName(rest.select(*NODES))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each skeleton node's pieces of ids, which come in their order."""
    own, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([digest.hexdigest()])], names=["skeleton", "ends_sha256"])

    for batch in batches:
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node != own:
                if digest is not None:
                    yield row()
                own, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
    if digest is not None:
        yield row()
