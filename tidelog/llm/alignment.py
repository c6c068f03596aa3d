"""Alignment of two tokenizers' tokens by merging their ends.

Both tokenizers cut the same bytes. The places where a token of either ends are two rising lists; merging them gives the
places where both end, and these cut the text into groups: the smallest stretches that both spell with whole tokens. The
merge of a document is divided into independent pieces of equal work: a binary search on each diagonal of the two lists
tells how many ends of either lie before it, whatever the tokens look like. A piece finishes the groups within it; what
lies before its first common end and after its last one is stitched to the neighbouring pieces in a second step, in which a
document's pieces pass in order. Most documents are one piece and need no second step.

Tokens are linked when they share a group. A group's links are counted over its different ids, so a long group of few ids
costs its ids, not its pairs of tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tidelog.llm.common import staged

#: Token ends in a piece.
PIECE = 65_536
#: White space in a row from which on A is encoded by its own library.
SPACES = 100_000
#: Pairs of different ids that are spread out at once.
SPREAD = 1 << 22
#: Up to so many pairs of ids the counts are broadcast (24 bytes each); more are joined by shuffling.
BROADCAST_PAIRS = 2_000_000
# Fixed value: the pattern that the byte-level vocabulary cuts texts with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: itself where it can be printed, else the next free one."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A byte-level BPE from its JSON file (A) and a SentencePiece model (B), with the bytes of their tokens."""

    def __init__(self, byte_level: bytes, model: bytes):
        self.byte_level, self.model = byte_level, model
        self.prepare()

    def prepare(self) -> None:
        own = json.loads(self.byte_level)["model"]
        letters, ids = byte_letters(), own["vocab"]
        self.bytes_a = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        ranks = {t: i for i, t in enumerate(self.bytes_a) if t}
        # Merging by rank is merging in the order of the list where the list's results have rising ids.
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in own["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:])):
            raise ValueError("the merges of the vocabulary are not in the order of its ids")
        if not {bytes([b]) for b in range(256)} <= ranks.keys():
            raise ValueError("the vocabulary does not have all bytes")
        self.a = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.sizes_a, self.sizes_b = (np.array([*map(len, t)], np.int64) for t in (self.bytes_a, self.bytes_b))
        # Every id as text, with what follows it: a comma, or the end of its half of a group.
        self.texts = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"]
        self.texts += [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]

    def __getstate__(self):
        return self.byte_level, self.model

    def __setstate__(self, state):
        self.__init__(*state)

    def slow(self):
        """A by its own library, which has no bound on white space."""
        found = tokenizers.Tokenizer.from_str(self.byte_level.decode())
        found.encode_special_tokens = True
        return found

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none where the text is null or empty, or where either does not spell a space and the text."""
        if text:
            if len(text) > SPACES and re.search(rf"\s{{{SPACES}}}", text):  # more than the pattern of A can search
                a = self.slow().encode(f" {text}", add_special_tokens=False).ids
            else:
                a = self.a.encode_to_numpy(f" {text}", disallowed_special=())
            b = self.b.encode(text)
            # A has all bytes and spells everything; B may not have some letters.
            if b"".join(map(self.bytes_b.__getitem__, b)) == f" {text}".encode():
                return np.array(a, np.int64), np.array(b, np.int64)
        return np.empty(0, np.int64), np.empty(0, np.int64)


def read_tokenizers(byte_level: str, model: str) -> Tokenizers:
    with open(byte_level, "rb") as a, open(model, "rb") as b:
        return Tokenizers(a.read(), b.read())


def divided(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(i, j) after every `size` ends of the merged lists: so many ends of A and of B lie before. Equal ends stay together."""
    n, m = len(ends_a), len(ends_b)
    diagonals = np.arange(size, n + m, size)
    low, high = np.maximum(0, diagonals - m), np.minimum(diagonals, n)
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        before = ends_a[np.minimum(middle, n - 1)] <= ends_b[np.clip(diagonals - 1 - middle, 0, m - 1)]
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
    i, j = low, diagonals - low
    j = j + ((i > 0) & (j < m) & (ends_a[i - 1] == ends_b[np.minimum(j, m - 1)]))
    return list(zip(i.tolist(), j.tolist()))


class Groups:
    """The groups of some tokens and their ends, both ends counted from the same place; the last group may be open."""

    def __init__(self, own: Tokenizers, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
        self.own, self.a, self.b = own, a, b
        base = min([int(e[0]) for e in (ends_a, ends_b) if len(e)], default=0)
        size = max([int(e[-1]) for e in (ends_a, ends_b) if len(e)], default=0) - base + 1
        marks = np.zeros((2, size), bool)
        marks[0, ends_a - base] = marks[1, ends_b - base] = True
        last_a, last_b = marks[1, ends_a - base], marks[0, ends_b - base]
        self.of_a, self.of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        self.n = int(last_a.sum())
        self.ends_a, self.ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # tokens up to each group's end
        # The closed groups as codes of `texts`: a token of A stands behind all tokens of earlier groups, one of B also
        # behind those of A in its own group.
        m, k = (int(e[-1]) if self.n else 0 for e in (self.ends_a, self.ends_b))
        self.codes = np.empty(m + k, np.int64)
        before = np.concatenate(([0], self.ends_b))
        self.codes[np.arange(m) + before[self.of_a[:m]]] = 2 * a[:m] + last_a[:m]
        self.codes[np.arange(k) + self.ends_a[self.of_b[:k]]] = 2 * (len(own.bytes_a) + b[:k]) + last_b[:k]
        self.edges = np.concatenate(([0], self.ends_a + self.ends_b))

    def text(self, first: int, last: int) -> str:
        """The groups from `first` to before `last` as text."""
        codes = self.codes[self.edges[first] : self.edges[last]] if first < last else self.codes[:0]
        return "".join(map(self.own.texts.__getitem__, codes.tolist()))[:-1]

    def links(self) -> np.ndarray:
        """The number of links of every closed group."""
        return np.diff(self.ends_a, prepend=0) * np.diff(self.ends_b, prepend=0)

    def pairs(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, links) of the different pairs of ids, for every part that `of` puts a closed group in (-1: none); key is
        (part * ids of A + id of A) * ids of B + id of B, rising."""
        size_a, size_b = len(self.own.bytes_a), len(self.own.bytes_b)
        sides = []
        for ids, groups, size in ((self.a, self.of_a, size_a), (self.b, self.of_b, size_b)):
            closed = groups < self.n
            keys, counts = np.unique(groups[closed] * size + ids[closed], return_counts=True)
            sides.append((keys // size, keys % size, counts))
        (ga, a, na), (gb, b, nb) = sides
        used = of[ga] >= 0
        ga, a, na = ga[used], a[used], na[used]
        each = np.bincount(gb, minlength=self.n)
        first, width = (np.cumsum(each) - each)[ga], each[ga]
        ends = np.cumsum(width)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        at = 0
        while at < len(ga):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPREAD, "right")))
            w = width[at:to]
            other = np.repeat(first[at:to] - np.cumsum(w) + w, w) + np.arange(w.sum())
            keys = np.repeat((of[ga[at:to]] * size_a + a[at:to]) * size_b, w) + b[other]
            found.append(combined(keys, np.repeat(na[at:to], w) * nb[other]))
            at = to
        return combined(*(np.concatenate(c) for c in zip(*found))) if len(found) > 2 else found[-1]


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts summed by key, keys rising."""
    found, place = np.unique(keys, return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, place, counts)
    return found, out


LONG, INTS, LONGS = pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())
RECORD = pa.schema({"row": LONG, "n_a": LONG, "n_b": LONG, "n_groups": LONG, "n_links": LONG, "groups_sha256": pa.string(), "pairs": LONGS, "links": LONGS})
# A piece that is still to be aligned has the ids and the bytes before them.
PART = pa.schema([*RECORD, *pa.schema({"piece": pa.int32(), "at_a": LONG, "at_b": LONG, "a": INTS, "b": INTS})])
FRAGMENT = pa.schema({
    "row": LONG, "piece": pa.int32(), "n_a": LONG, "n_b": LONG, "closed": pa.bool_(), "head_a": INTS, "head_b": INTS, "text": pa.string(),
    "n_groups": LONG, "n_links": LONG, "pairs": LONGS, "links": LONGS, "tail_a": INTS, "tail_b": INTS,
})


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types)], schema=schema)


def tokens(batches: Iterator[pa.RecordBatch], own: Tokenizers, piece: int) -> Iterator[pa.RecordBatch]:
    """Records of the documents (row, text) that are one piece, and the pieces of all others."""
    schema = PART
    for batch in batches:
        out, docs = [], []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = own.encode(text)
            if len(a) + len(b) <= piece:
                docs.append((row, a, b))
                continue
            ends_a, ends_b = own.sizes_a[a].cumsum(), own.sizes_b[b].cumsum()
            i = j = 0
            for number, (k, m) in enumerate([*divided(ends_a, ends_b, piece), (len(a), len(b))]):
                at = (int(ends_a[i - 1]) if i else 0, int(ends_b[j - 1]) if j else 0)
                out.append((row, *[None] * 7, number, *at, a[i:k], b[j:m]))
                if len(out) >= 64:
                    yield batch_of(out, schema)
                    out = []
                i, j = k, m
        out += [(*record, *[None] * 5) for record in records(own, docs)]
        yield batch_of(out, schema)


def records(own: Tokenizers, docs: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple]:
    """Records of whole documents (row, ids of A, ids of B), worked out all at once: their texts follow one another."""
    if not docs:
        return []
    a, b = (np.concatenate([d[k] for d in docs]) for k in (1, 2))
    found = Groups(own, a, b, own.sizes_a[a].cumsum(), own.sizes_b[b].cumsum())
    up_to = np.cumsum([len(d[1]) for d in docs])
    edge = np.concatenate(([0], np.searchsorted(found.ends_a, up_to, "right")))  # groups up to each document's end
    of = np.repeat(np.arange(len(docs)), np.diff(edge))
    keys, links = found.pairs(of)
    size = len(own.bytes_a) * len(own.bytes_b)
    place = np.searchsorted(keys, np.arange(len(docs) + 1) * size)
    total = np.concatenate(([0], np.cumsum(found.links())))
    out = []
    for i, (row, x, y) in enumerate(docs):
        p, q, g, h = place[i], place[i + 1], edge[i], edge[i + 1]
        text = found.text(g, h)
        digest = hashlib.sha256(text.encode()).hexdigest() if len(x) else ""
        out.append((row, len(x), len(y), int(h - g), int(total[h] - total[g]), digest, keys[p:q] - i * size, links[p:q]))
    return out


def fragments(batches: Iterator[pa.RecordBatch], own: Tokenizers) -> Iterator[pa.RecordBatch]:
    """What every piece (row, piece, at_a, at_b, a, b) holds: a head up to the first common end, whole groups, and a tail."""
    schema = FRAGMENT
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for k, (row, piece, at_a, at_b) in enumerate(zip(*columns)):
            a, b = (np.asarray(batch.column(i)[k].values, np.int64) for i in (4, 5))
            found = Groups(own, a, b, at_a + own.sizes_a[a].cumsum(), at_b + own.sizes_b[b].cumsum())
            n, ends_a, ends_b = found.n, found.ends_a, found.ends_b
            of = np.zeros(n, np.int64)
            of[:1] = -1
            keys, links = found.pairs(of)
            head = (a[: ends_a[0]], b[: ends_b[0]]) if n else ((), ())
            tail = (a[ends_a[-1] :], b[ends_b[-1] :]) if n else (a, b)
            yield batch_of([(row, piece, len(a), len(b), n > 0, *head, found.text(1, n), max(n - 1, 0), int(found.links()[1:].sum()), keys, links, *tail)], schema)


class Stitch:
    """A document put together from its fragments, which come in order."""

    def __init__(self, own: Tokenizers, row: int):
        self.own, self.row = own, row
        self.n_a = self.n_b = self.n_groups = self.n_links = self.waiting = 0
        self.digest, self.open = hashlib.sha256(), ([], [])
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]

    def say(self, text: str) -> None:
        if text:
            self.digest.update(f"{';' if self.n_groups else ''}{text}".encode())

    def keep(self, keys, links) -> None:
        self.found.append((np.asarray(keys, np.int64), np.asarray(links, np.int64)))
        self.waiting += len(keys)
        if self.waiting > SPREAD:
            self.found, self.waiting = [combined(*(np.concatenate(c) for c in zip(*self.found)))], 0

    def add(self, n_a, n_b, closed, head_a, head_b, text, n_groups, n_links, pairs, links, tail_a, tail_b) -> None:
        self.n_a, self.n_b = self.n_a + n_a, self.n_b + n_b
        if closed:
            self.open[0].append(head_a), self.open[1].append(head_b)
            a, b = (np.concatenate([np.asarray(p, np.int64) for p in side]) for side in self.open)
            # One group: A's tokens end in even places, B's in odd ones, and the last of both in the same.
            ends_a, ends_b = 2 * np.arange(len(a)), 2 * np.arange(len(b)) + 1
            ends_a[-1] = ends_b[-1] = 2 * (len(a) + len(b))
            group = Groups(self.own, a, b, ends_a, ends_b)
            self.say(group.text(0, 1))
            self.n_groups, self.n_links = self.n_groups + 1, self.n_links + len(a) * len(b)
            self.keep(*group.pairs(np.zeros(1, np.int64)))
            self.open = ([], [])
            self.say(text)
            self.n_groups, self.n_links = self.n_groups + n_groups, self.n_links + n_links
            self.keep(pairs, links)
        self.open[0].append(tail_a), self.open[1].append(tail_b)

    def record(self) -> tuple:
        keys, links = combined(*(np.concatenate(c) for c in zip(*self.found)))
        return self.row, self.n_a, self.n_b, self.n_groups, self.n_links, self.digest.hexdigest(), keys, links


def stitched(batches: Iterator[pa.RecordBatch], own: Tokenizers) -> Iterator[pa.RecordBatch]:
    """Records of documents from their fragments, sorted by (row, piece)."""
    schema, doc = RECORD, None
    for batch in batches:
        for row, _, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if doc is None or row != doc.row:
                if doc is not None:
                    yield batch_of([doc.record()], schema)
                doc = Stitch(own, row)
            doc.add(*rest)
    if doc is not None:
        yield batch_of([doc.record()], schema)


def align(docs: DataFrame, own: Tokenizers, id_col: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links) of every document, each row one.

    `pairs` are the different linked pairs of ids, as id of A * ids of B + id of B, and `links` how many of the
    document's links each has. groups_sha256 is of the groups as text, ids of A and B separated by a bar, groups by
    semicolons. Null and empty texts, and those that either tokenizer does not spell as a space and the text, have no
    tokens, no pairs and an empty digest. Ids may be null or repeat; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(own)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = batch.column(1), {r: i for i, r in enumerate(batch.column(0).to_pylist())}
            for out in tokens(iter([batch.select([0, 2])]), sent.value, piece):
                same = ids.take(pa.array([numbers[r] for r in out.column(0).to_pylist()], pa.int64()))
                yield pa.RecordBatch.from_arrays([same, *out.columns], names=["id", *out.schema.names])

    parts = staged(rows.mapInArrow(first, T.StructType([kind, *from_arrow_schema(PART).fields])), "tokens")
    names = RECORD.names
    long = parts.where("piece is not null")
    # The pieces of a document are dealt to many tasks, and meet again in the order of their text.
    held = long.repartition("row", "piece").select("row", "piece", "at_a", "at_b", "a", "b")
    held = held.mapInArrow(lambda batches: fragments(batches, sent.value), from_arrow_schema(FRAGMENT))
    joined = held.repartition("row").sortWithinPartitions("row", "piece").mapInArrow(lambda batches: stitched(batches, sent.value), from_arrow_schema(RECORD))
    joined = joined.join(long.where("piece = 0").select("row", "id"), "row")
    every = parts.where("piece is null").select("id", *names).unionByName(joined.select("id", *names))
    return every.withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame, ids_b: int) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its id of A is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = staged(counts.withColumn("a", F.expr(f"pair div {ids_b}")), "pairs")
    most = counts.groupBy(F.col("a").alias("of")).agg(F.max("n").alias("most"))
    return staged(counts.join(most, F.col("a") == F.col("of")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def align_and_count(docs: DataFrame, own: Tokenizers, id_col: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """Documents as `align` gives them, with n_best, the links whose pair is in most documents among those of its id of A,
    and count_sum, the numbers of documents of all links' pairs, in place of the pairs."""
    aligned = staged(align(docs, own, id_col, text, piece), "aligned")
    counts = pair_counts(aligned, len(own.bytes_b))
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    keys = ["row", id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    each = aligned.select(*keys, F.explode_outer(F.arrays_zip("pairs", "links")).alias("each"))
    each = each.select(*keys, F.col("each.pairs").alias("pair"), F.col("each.links").alias("n_each"))
    best, total = F.col("n_each") * F.col("best").cast("bigint"), F.col("n_each") * F.col("n")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((best, "n_best"), (total, "count_sum"))]
    return each.join(counts, "pair", "left").groupBy(*keys).agg(*sums).drop("row")
