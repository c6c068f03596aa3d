"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice has a position per character and keeps, for each, the best piece that ends there. For a unigram model
that is the piece with the highest sum of scores. For a BPE model it is the one piece that a merge in order of scores
would leave last: a piece may follow another just where merging the two pieces' joint text gives these two again,
and of all pieces that end at a position exactly one may follow the last piece of its own start. So the ids are those of
merging, found from left to right.

New pieces start within the longest piece's length of the current position. Ids are committed as soon as the paths back
from all those starts meet on one boundary; what lies before it is dropped. No piece reaches over the start of a new
word, so words are such boundaries as well, and the ids of frequent words are remembered.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import extend

MARK = "▁"
#: Words and pairs of pieces that a task remembers.
REMEMBERED = 500_000
# Fixed values of the model format: kinds of pieces and of models.
UNKNOWN, CONTROL, UNUSED, BYTE = 2, 3, 5, 6
UNIGRAM, BPE = 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of one protocol-buffer message: numbers and raw values."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class Pieces:
    """A vocabulary of a .model file, without normalisation beyond marks for spaces."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model, self.prefix = UNIGRAM, True
        for number, value in fields(model):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, 1))
            elif number == 2:
                self.model = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(fields(value))
                self.prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("only models that keep texts as they are can be decoded exactly")
        self.prepare()

    def prepare(self) -> None:
        whole = [(p, i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k not in (UNKNOWN, CONTROL, UNUSED, BYTE)]
        self.ids = dict(whole)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.values = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode()
                       for p, k in zip(self.pieces, self.kinds)]
        self.longest = max((len(p) for p, _ in whole), default=1)
        self.letters = {c for p, _ in whole for c in p}
        # Every beginning of a piece, with the piece's id where it is one (0 is the unknown piece, never a text).
        self.begun = {p[:n]: 0 for p, _ in whole for n in range(1, len(p) + 1)} | self.ids
        self.least = min((self.scores[i] for _, i in whole), default=0.0) - 10
        # A chunk is a run of spaces with the word behind it, or a line feed that no piece has, unless some piece reaches
        # over a new word's start.
        reaching = any(MARK in p.lstrip(MARK) for p, _ in whole)
        line = "" if "\n" in self.letters else "\n"
        self.chunk = re.compile(r"(?s).+" if reaching else rf" +[^ {line}]*|[^ {line}]+|[ {line}]")
        self.known = Known(self)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("pieces", "scores", "kinds", "model", "prefix")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.prepare()

    def merged(self, text: str) -> list[str]:
        """Merging in order of scores, leftmost first: for short texts, to see which pieces may be neighbours."""
        parts = list(text)
        while True:
            best, place = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, place = self.scores[found], i
            if place < 0:
                return parts
            parts[place : place + 2] = [parts[place] + parts[place + 1]]

    def fit(self, left: str, right: str) -> bool:
        """Whether a BPE encoding may have these neighbours; left is empty at the start."""
        if self.n_pairs > REMEMBERED:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        found = self.merged(left + right) == ([left, right] if left else [right])
        self.pairs.setdefault(left, {})[right] = found
        return found

    def run(self, text: str) -> Iterator[str]:
        """The pieces of a run of known letters, yielded as soon as they are certain.

        From each position the pieces that start there are followed while some piece begins like that.
        """
        size, most, bpe = len(text), self.longest, self.model == BPE
        window = 8 * most
        start, room = 0, min(size, window + most) + 1
        last: list[str | None] = [""] + [None] * room  # last[i]: the piece that ends at start + i, once known
        best = [0.0] * len(last)
        begun, scores, none = self.begun.get, self.scores, {}
        for at in range(size):
            here = at - start
            left, there = last[here], here + 1
            known = self.pairs.get(left, none)
            end, piece = at + 1, text[at]
            number = begun(piece)
            while True:
                if number or there == here + 1:
                    if not bpe:
                        score = best[here] + (scores[number] if number else self.least)
                        if last[there] is None or score > best[there]:
                            last[there], best[there] = piece, score
                    elif last[there] is None:
                        fits = known.get(piece)
                        if fits or fits is None and self.fit(left, piece):
                            last[there] = piece
                end += 1
                there += 1
                if end > size:
                    break
                piece = text[at:end]
                number = begun(piece)
                if number is None:
                    break
            if here == window:
                # Later pieces start at the positions that have been reached beyond this one.
                live = {p for p in range(here + 1, len(last)) if last[p] is not None}
                while len(live) > 1 and (furthest := max(live)) > 0:
                    live.discard(furthest)
                    live.add(furthest - len(last[furthest]))
                boundary = live.pop() if len(live) == 1 else 0
                yield from self.path(last, boundary)
                last, best = last[boundary:] + [None] * boundary, best[boundary:] + [0.0] * boundary
                start += boundary
                if not boundary:  # the paths have not met yet: look again a window later
                    last, best = last + [None] * window, best + [0.0] * window
                    window += 8 * most
                else:
                    window = 8 * most
        yield from self.path(last, size - start)

    @staticmethod
    def path(last: list[str], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def spell(self, text: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in text.encode()] if self.bytes else [self.unknown]

    def encode_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        held: list[str] = []

        def close():
            for piece in self.run("".join(held)):
                number = self.ids.get(piece)
                out.extend(self.spell(piece) if number is None else (number,))
            held.clear()

        for c in chunk:
            c = MARK if c == " " else "" if c == MARK else c
            if c in self.letters:
                held.append(c)
            else:  # no piece has it, or it is the mark itself: spelt in bytes
                close()
                out.extend(self.spell(c or MARK))
        close()
        return out

    def encode(self, text: str | None) -> np.ndarray | None:
        """The ids of a text."""
        if text is None:
            return None
        self.known.trim()
        chunks = self.chunk.findall(f" {text}" if self.prefix and text else text)
        return np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), np.int32)

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        text = b"".join(map(self.values.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Known(dict):
    """Ids of words as bytes, worked out when first met. When there are too many, those met since the last time are
    kept on; very long words are never kept."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.old = pieces, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.pop(chunk, None)
        if found is None:
            found = np.array(self.pieces.encode_chunk(chunk), np.int32).tobytes()
        if len(chunk) <= 64:
            self[chunk] = found
        return found

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


def listed(rows: list[np.ndarray | None]) -> pa.ListArray:
    """Id arrays as one Arrow column."""
    ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.int32), *(r for r in rows if r is not None)])
    return pa.ListArray.from_arrays(ends, values, mask=pa.array([r is None for r in rows], pa.bool_()))


def read_pieces(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", column: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """Documents with the ids of their whole texts as array<int>.

    A null text has null ids, an empty one none. Letters that no piece has, and the mark for spaces itself, are
    spelt in bytes, so that decoding gives every text back. A column of that name is replaced. No shuffle; the
    vocabulary is broadcast, its size is that of the model.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    work = lambda: lambda texts: [listed([sent.value.encode(t) for t in texts])]
    return extend(docs, [text], work, f"{column} array<int>", drop)


def decode(tokens: DataFrame, pieces: Pieces, ids: str = "ids", column: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the text of their ids: the exact text that was encoded. Null ids give null."""
    sent = tokens.sparkSession.sparkContext.broadcast(pieces)
    work = lambda: lambda rows: [[sent.value.decode(r) for r in rows]]
    return extend(tokens, [ids], work, f"{column} string", drop)


def encode_and_check(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, n_ids, text_sha256): the ids, and the digest of the text decoded from them."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def start():
        own = sent.value

        def work(texts):
            found = [own.encode(t) for t in texts]
            return [listed(found), [own.decode(f) for f in found]]

        return work

    rows = docs.select(F.col(id_col), F.col(text).alias("text"))
    both = extend(rows, ["text"], start, "ids array<int>, text string")
    return both.select(
        id_col, "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_ids"),
        F.sha2("text", 256).alias("text_sha256"),
    )
