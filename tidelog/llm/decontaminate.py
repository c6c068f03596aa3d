"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over training windows.

Words are runs of ASCII letters and digits, A-Z lower-cased, and of characters beyond ASCII. An item gives all
its windows of `n` words; an item of fewer words is one window. A document word is hit when it lies in a
place where a window occurs. Documents are looked up by ids of the benchmark's own words first: only where
that many benchmark words stand in a row is a window compared, and compared whole.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import extend, unused

N = 13
#: Text bytes of benchmark in one broadcast set; more is scanned in several blocks of this size.
BLOCK_BYTES = 16 << 20
#: A document is contaminated from one hit word in so many on.
ONE_IN = 20

# All ASCII but letters and digits separates words; A-Z becomes a-z.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
WORD = re.compile(rb"[^ ]+")
RESULTS = "{0}n_words bigint, {0}hits array<struct<start:bigint,end:bigint>>, {0}items array<bigint>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Grams:
    """The windows of a block of benchmark items, by length, over ids of their words."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.ids: dict[bytes, int] = {}
        windows: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], np.int32)
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                windows[size][ids[i : i + size].tobytes()].add(item)
        self.windows = {size: {k: sorted(v) for k, v in found.items()} for size, found in sorted(windows.items())}
        self.first = {
            size: np.isin(np.arange(len(self.ids) + 1), [np.frombuffer(k, np.int32)[0] for k in found])
            for size, found in self.windows.items()
        }

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """Ranges of hit words, and the items found."""
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        strange = np.concatenate(([0], np.cumsum(ids == 0)))
        edge, items = np.zeros(len(ids) + 1, np.int32), set()
        for size, found in self.windows.items():
            if size > len(ids):
                continue
            alike = (strange[size:] == strange[:-size]) & self.first[size][ids[: len(ids) - size + 1]]
            for i in np.flatnonzero(alike).tolist():
                if hit := found.get(ids[i : i + size].tobytes()):
                    items.update(hit)
                    edge[i] += 1
                    edge[i + size] -= 1
        if not items:
            return [], []
        inside = np.concatenate(([0], np.cumsum(edge[:-1]) > 0, [0])).astype(np.int8)
        turns = np.flatnonzero(np.diff(inside)).tolist()
        return list(zip(turns[::2], turns[1::2])), sorted(items)


def without(text: str, ranges: list[dict]) -> str:
    """The text without the given ranges of words; what stands between other words stays."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    at, out = 0, []
    for r in ranges:
        out.append(raw[at : places[r["start"]][0]])
        at = places[r["end"] - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", drop: tuple[str, ...] = (), prefix: str = ""
) -> DataFrame:
    """Documents with n_words, `hits` (ranges of hit words, end exclusive) and `items` (ids found, sorted).

    The benchmark has item_id and text. Items without id or words take no part, repeated items count once. Null
    and empty texts have no words. Input columns of these names are replaced, unless a `prefix` keeps them apart. The benchmark's size is read first:
    it is broadcast in blocks of at most BLOCK_BYTES of text, so a larger one costs a further pass per block,
    not memory. Documents are not shuffled.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + size // BLOCK_BYTES
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = docs
    for block in range(blocks):
        grams = docs.sparkSession.sparkContext.broadcast(
            Grams([tuple(r) for r in items.where(part == block).toLocalIterator()], n)
        )

        def start(grams=grams):
            def work(texts, *earlier):
                table, out = grams.value, []
                for i, t in enumerate(texts):
                    words = words_of(t)
                    ranges, ids = table.scan(words)
                    if earlier:
                        ranges = joined(ranges + [(r["start"], r["end"]) for r in earlier[0][i]])
                        ids = sorted({*ids, *earlier[1][i]})
                    out.append((len(words), [{"start": a, "end": b} for a, b in ranges], ids))
                return [[row[k] for row in out] for k in range(3)]

            return work

        last = block == blocks - 1
        found = extend(found, [text, *([f"{prefix}hits", f"{prefix}items"] if block else [])], start, RESULTS.format(prefix), drop if last else ())
    return found


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hit_words(hits) -> F.Column:
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda total, r: total + r.end - r.start)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, mode: str = "documents", text: str = "text") -> DataFrame:
    """Documents without contamination: mode "documents" drops those with one word in ONE_IN or more hit;
    mode "spans" keeps all documents and cuts the hit words out of their texts."""
    prefix = unused(docs)
    found = find_contamination(docs, benchmark, n, text, prefix=prefix)
    if mode == "documents":
        hit = hit_words(F.col(f"{prefix}hits"))
        return found.where(~((hit > 0) & (hit * ONE_IN >= F.col(f"{prefix}n_words")))).select(*docs.columns)
    cut = lambda texts, hits: [[without(t, r) if r else t for t, r in zip(texts, hits)]]
    return extend(found, [text, f"{prefix}hits"], lambda: cut, f"{text} string").select(*docs.columns)
