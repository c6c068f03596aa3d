"""Substring dedup with suffix automata of reference shards, words as letters.

`remove_reference` is the plain form: automata of shards of a reference, each of bounded size, are broadcast one after
the other, and documents stream through them for matching statistics: the longest match that ends at each word. Spans of
matches of `window` words or more are cut out.

`remove_repeats` takes the whole corpus as its own reference. Broadcasting that would not be bounded, and each
document would meet every shard; so the reference is sharded by content, and only the stretches that can match a shard are
sent to it. The key of a window is its minimizer: the word k-gram of it with the least hash. Equal windows have
equal minimizers. Consecutive windows with one minimizer form a stretch; stretches whose minimizer is rare need no look.
For the others, the distinct stretches of a minimizer, each with its number of occurrences, make a suffix automaton whose
states count occurrences, and each stretch streams through it: a window is repeated where the longest match that occurs
twice or more covers it. Copies are folded into one stretch with a count before any text moves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import extend, staged, unused

WINDOW = 35
#: Words of a minimizer, at most; a window has at least half as many places for one.
GRAM = 12
#: Words of one broadcast reference shard.
SHARD_WORDS = 200_000
REMEMBERED = 300_000
PLACE_BITS = np.uint64(28)


def words_of(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").split()


class Automaton:
    """A suffix automaton of several word sequences, each with a number of occurrences."""

    def __init__(self, sequences: list[tuple[tuple[bytes, ...], int]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for words, n in sequences:
            state = 0
            for word in words:
                state = self.add(state, word)
                self.count[state] += n
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def add(self, last: int, word: bytes) -> int:
        following = self.next[last].get(word)
        if following is not None and self.length[following] == self.length[last] + 1:
            return following
        if following is not None:
            return self.split(last, following, word)
        own = self.new({}, self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = own
            state = self.link[state]
        if state >= 0:
            following = self.next[state][word]
            near = self.length[following] == self.length[state] + 1
            self.link[own] = following if near else self.split(state, following, word)
        else:
            self.link[own] = 0
        return own

    def new(self, edges: dict[bytes, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def split(self, state: int, following: int, word: bytes) -> int:
        copy = self.new(dict(self.next[following]), self.length[state] + 1)
        self.link[copy], self.link[following] = self.link[following], copy
        while state >= 0 and self.next[state].get(word) == following:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def matches(self, words, least: int = 1) -> Iterator[int]:
        """For each word, the length of the longest match that ends there and occurs `least` times or more."""
        state = size = 0
        for word in words:
            while state > 0 and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            state = self.next[state].get(word, 0)
            size = size + 1 if state else 0
            found, long = state, size
            while found > 0 and self.count[found] < least:
                found = self.link[found]
                long = self.length[found]
            yield long


def spans(lengths, window: int) -> list[tuple[int, int]]:
    """Maximal ranges of words covered by matches of `window` words or more."""
    out: list[tuple[int, int]] = []
    for end, size in enumerate(lengths, 1):
        if size >= window:
            start = end - size
            if out and start <= out[-1][1]:
                out[-1] = (min(start, out[-1][0]), end)
            else:
                out.append((start, end))
    return out


def common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def shared(parts: list[tuple]) -> list[int]:
    """For each sequence, the longest beginning that another one has too."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    most = [0] * len(parts)
    for a, b in zip(order, order[1:]):
        n = common(parts[a], parts[b])
        most[a], most[b] = max(most[a], n), max(most[b], n)
    return most


def repeated_in(stretches: list[tuple[list[bytes], int, int]], window: int) -> list[list[tuple[int, int]]]:
    """For each distinct stretch (words, occurrences, place of the minimizer) the ranges of words in repeated windows.

    A stretch that occurs twice is repeated as a whole. Of others only the part around the minimizer that some other
    stretch has as well can be, so the automaton holds those parts, equal ones once with their occurrences added.
    """
    if len(stretches) == 1:
        return [[(0, len(stretches[0][0]))] if stretches[0][1] > 1 else []]
    left = shared([tuple(words[:at][::-1]) for words, _, at in stretches])
    right = shared([tuple(words[at:]) for words, _, at in stretches])
    parts: dict[tuple[bytes, ...], int] = defaultdict(int)
    cut = []
    for (words, n, at), a, b in zip(stretches, left, right, strict=True):
        part = tuple(words[at - a : at + b]) if a + b >= window else ()
        cut.append((part, at - a))
        if part:
            parts[part] += n
    automaton = Automaton(list(parts.items()))
    found: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
    out = []
    for (words, n, _), (part, start) in zip(stretches, cut, strict=True):
        if n > 1:
            out.append([(0, len(words))])
            continue
        if part and part not in found:
            found[part] = spans(automaton.matches(part, 2), window)
        out.append([(a + start, b + start) for a, b in found.get(part, ())])
    return out


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Stretches:
    """Cuts documents into stretches of windows with one minimizer."""

    def __init__(self, window: int):
        self.window, self.gram = window, max(1, min(GRAM, window // 2))
        self.hashes = Hashes()
        self.factors = np.array([xxhash.xxh64_intdigest(bytes([j])) | 1 for j in range(self.gram)], np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, self.base))))
            self.inverses = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, self.inverse))))

    def of(self, words: list[bytes]) -> tuple[np.ndarray, ...] | None:
        """Minimizer, content hash, first word, number of words and minimizer's place of each stretch."""
        n, places = len(words) - self.window + 1, self.window - self.gram + 1
        if n < 1:
            return None
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        grams = len(words) - self.gram + 1
        g = h[:grams] * self.factors[0]
        for j in range(1, self.gram):
            g += h[j : j + grams] * self.factors[j]
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        # Least hash of each window, the leftmost of equal ones: the place fills the low bits.
        least, width = (g >> PLACE_BITS << PLACE_BITS) | np.arange(grams, dtype=np.uint64), 1
        while 2 * width <= places:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < places:
            least = np.minimum(least[: width - places or None], least[places - width :])
        at = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        end = np.concatenate((first[1:], [n])) + self.window - 1
        place = at[first] - first
        self.grow(len(words) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(h * self.powers[: len(h)])))
        content = (sums[end] - sums[first]) * self.inverses[first] + place.astype(np.uint64) * self.factors[0]
        content = (content ^ (content >> np.uint64(31))) + (end - first).astype(np.uint64)
        return g[at[first]].view(np.int64), content.view(np.int64), first, end - first, place


ROW = "m bigint, s bigint, id bigint, k bigint, start int, n_words int, place int"


def stretches_of(docs: DataFrame, window: int) -> DataFrame:
    """A row for every stretch of documents (id, k, text)."""

    def run(batches):
        cutter = Stretches(window)
        for batch in batches:
            found, ids, keys = [], [], []
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                if (own := cutter.of(words_of(text))) is not None:
                    found.append(own)
                    ids += [doc] * len(own[0])
                    keys += [key] * len(own[0])
            if found:
                m, s, start, n, place = (np.concatenate(c) for c in zip(*found))
                columns = [m, s, pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), *(x.astype(np.int32) for x in (start, n, place))]
                table = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in ROW.split(", ")])
                for at in range(0, len(table), 16384):
                    yield table.slice(at, 16384)

    return docs.mapInArrow(run, ROW)


def packed(docs: DataFrame) -> DataFrame:
    """Documents (id, k, text) with compressed texts, for joins that move whole texts."""

    def start():
        press = zstandard.ZstdCompressor(3)
        return lambda texts: [[None if t is None else press.compress(t.encode()) for t in texts]]

    return extend(docs, ["text"], start, "body binary", drop=("text",))


def unpacked(body: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body) if body else b""


def texts_of(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(m, s, n, place, body): the words of one occurrence of each distinct stretch."""
    wanted = reps.groupBy("id", "k").agg(F.collect_list(F.struct("m", "s", "n", "start", "n_words", "place")).alias("wanted"))
    same = F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.k") == F.col("w.k"))
    joined = packed(docs).alias("d").join(wanted.alias("w"), same).select("body", "wanted")

    def run(batches):
        for batch in batches:
            for body, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = unpacked(body).split()
                rows = [(w["m"], w["s"], w["n"], w["place"], b" ".join(words[w["start"] : w["start"] + w["n_words"]])) for w in wanted]
                for at in range(0, len(rows), 4096):
                    some = zip(*rows[at : at + 4096])
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(some, kinds)], names=["m", "s", "n", "place", "body"])

    return joined.mapInArrow(run, "m bigint, s bigint, n bigint, place int, body binary")


def judged(texts: DataFrame, window: int) -> DataFrame:
    """(m, s, ranges) of the distinct stretches with repeated windows: one automaton per minimizer."""

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def sent(rows):
        m, s, ranges = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(m, pa.int64()), pa.array(s, pa.int64()), pa.array(ranges, kind)], names=["m", "s", "ranges"]
        )

    def run(batches):
        key, held, waiting = None, {}, []

        def close():
            found = repeated_in(list(held.values()), window)
            return [(key, s, [{"a": a, "b": b} for a, b in r]) for s, r in zip(held, found, strict=True) if r]

        for batch in batches:
            for m, s, n, place, body in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if m != key and held:
                    waiting += close()
                    held = {}
                    while len(waiting) >= 4096:
                        yield sent(waiting[:4096])
                        waiting = waiting[4096:]
                key = m
                held[s] = (body.split(), n, place)
        if held:
            waiting += close()
        for at in range(0, len(waiting), 4096):
            yield sent(waiting[at : at + 4096])

    rows = texts.repartition("m").sortWithinPartitions("m")
    return rows.mapInArrow(run, "m bigint, s bigint, ranges array<struct<a:int,b:int>>")


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """(id, k, ranges): the repeated words of documents (id, k, text), k a hash of the text."""
    every = staged(stretches_of(docs, window), "stretches")
    often = every.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m")
    often = staged(often, "minimizers")  # a side of its own, so that a hot minimizer's join is split
    some = staged(every.join(often, "m", "left_semi"), "candidates")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k", "start")).alias("first")
    distinct = some.groupBy("m", "s").agg(F.count("*").alias("n"), F.max("n_words").alias("n_words"), F.max("place").alias("place"), first)
    reps = distinct.select("m", "s", "n", "n_words", "place", "first.id", "first.k", "first.start")
    found = judged(texts_of(reps, docs), window)
    hit = some.join(found, ["m", "s"]).select("id", "k", F.explode("ranges").alias("r"), "start")
    return hit.groupBy("id", "k").agg(
        F.collect_set(F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b"))).alias("ranges")
    )


def joined(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(words: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    kept, at = [], 0
    for a, b in ranges:
        kept += words[at:a]
        at = b
    return kept + words[at:]


def find_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): every document's whole text without the words in repeated windows.

    A window is `window` consecutive words of one document; it is repeated if its words also start anywhere else, in the
    same document included; windows are judged on the input. `kept` has the other words joined by single spaces. Null
    and empty texts and those shorter than a window keep all they have (null: no words, empty text). Every row gets a
    row; rows that share an id are told apart by their texts. Other columns are ignored.
    """
    k = F.xxhash64(F.col(text)).alias("k")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), k, F.col(text).alias("text"))
    found = repeats(rows, window)
    same = F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.k") == F.col("f.k"))
    joint = packed(rows).alias("d").join(found.alias("f"), same, "left").select("d.id", "body", "ranges")

    def start():
        def work(bodies, ranges):
            out = []
            for body, own in zip(bodies, ranges):
                words = unpacked(body).split()
                kept = without(words, joined(own))
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            return [[row[i] for row in out] for i in range(3)]

        return work

    results = extend(joint, ["body", "ranges"], start, "n_words bigint, n_removed bigint, kept string", drop=("body", "ranges"))
    return results.withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with their texts replaced by what `find_repeats` keeps; rows alike in id and text stay each."""
    prefix = unused(docs)
    found = find_repeats(docs.withColumn(f"{prefix}row", F.xxhash64(id_col, text)), window, f"{prefix}row", text)
    kept = found.select(f"{prefix}row", "kept").distinct()
    return docs.withColumn(f"{prefix}row", F.xxhash64(id_col, text)).join(
        kept.withColumnRenamed("kept", f"{prefix}kept"), f"{prefix}row"
    ).withColumn(text, F.col(f"{prefix}kept")).select(*docs.columns)


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """Documents without the spans of `window` words or more that a reference text has as well.

    Reference texts (column text) are read in shards of at most SHARD_WORDS words, a longer text in pieces that overlap
    by a window; each shard's automaton is broadcast and all documents stream through it. Null texts stay null;
    documents without such spans stay as they are, others have their words joined by single spaces.
    """
    out, shard, size = docs, [], 0
    prefix = unused(docs)

    def through(rows: DataFrame, sequences) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(Automaton(sequences))

        def work(texts, earlier):
            found = [spans(sent.value.matches(words_of(t)), window) for t in texts]
            both = [[*({"a": a, "b": b} for a, b in f), *(e or ())] for f, e in zip(found, earlier)]
            return [both]

        return extend(rows, [text, f"{prefix}r"], lambda: work, f"{prefix}r array<struct<a:int,b:int>>")

    out = out.withColumn(f"{prefix}r", F.lit(None).cast("array<struct<a:int,b:int>>"))
    for row in reference.where(F.col("text").isNotNull()).select("text").toLocalIterator():
        words = tuple(words_of(row.text))
        for at in range(0, max(1, len(words)), SHARD_WORDS):
            part = words[at : at + SHARD_WORDS + window - 1]
            if size + len(part) > SHARD_WORDS and shard:
                out, shard, size = through(out, shard), [], 0
            shard.append((part, 1))
            size += len(part)
    if shard:
        out = through(out, shard)
    cut = lambda texts, ranges: [[b" ".join(without(words_of(t), joined(r))).decode() if r else t for t, r in zip(texts, ranges)]]
    return extend(out, [text, f"{prefix}r"], lambda: cut, f"{text} string").select(*docs.columns)
