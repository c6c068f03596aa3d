"""Language identification, word first: a known word scores by its log frequency in each language, an unseen word
by its longest known character n-grams.

Training counts words and, over the distinct words, n-grams of four letters down to one, with word ends marked. A
prediction sums log frequencies over the words; an unseen word is cut into n-grams of the longest length of which
one is known, and so on down to single letters.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import extend, staged, unused

#: Bound of the model: labelled documents that are read (expected number). All their words and n-grams are kept.
TRAINING_ROWS = 20_000
LONGEST = 4
#: Words that a task remembers between documents.
REMEMBERED = 200_000
UNKNOWN = "und"
#: Documents whose words support the prediction less than this are rejected.
LEAST_SCORE = 0.5

# Words are runs of letters. The first pattern takes some numerals too, such as fractions, which only few words hold.
WORD, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
# The same words in Spark's expressions.
WORD_SQL = r"\p{L}+"


def words_of(text: str) -> Counter[str]:
    found = Counter(WORD.findall(text.lower()))
    for mixed in [w for w in found if not w.isalpha()]:
        n = found.pop(mixed)
        for word in LETTERS.findall(mixed):
            found[word] += n
    return found


class Model:
    """Log frequencies by language: `places[n]` tells the row of an entry in `values[n]`; 0 has words, n the n-grams."""

    def __init__(self, counts: dict[int, dict[str, dict[str, int]]]):
        """counts[0] has words, counts[n] n-grams: language -> entry -> count."""
        self.langs = sorted({lang for table in counts.values() for lang in table})
        self.places: dict[int, dict[str, int]] = {}
        self.values: dict[int, np.ndarray] = {}
        for size in range(LONGEST + 1):
            self.add(size, counts.get(size, {}))
        self.seen: dict[str, np.ndarray | None] = {}

    def add(self, size: int, table: dict[str, dict[str, int]]) -> None:
        entries = sorted({e for of in table.values() for e in of})
        values = np.array([[table.get(lang, {}).get(e, 0) for lang in self.langs] for e in entries], float)
        self.places[size] = {e: i for i, e in enumerate(entries)}
        self.values[size] = np.log((values + 0.5) / (values.sum(0) + 0.5 * len(entries))) if entries else values

    def word(self, word: str) -> np.ndarray | None:
        """Log frequencies of a word, by backing off to ever shorter n-grams; None if not one letter is known."""
        if (known := self.places[0].get(word)) is not None:
            return self.values[0][known]
        marked = f" {word} "
        for size in range(LONGEST, 0, -1):
            places = self.places[size]
            found = [x for i in range(len(marked) - size + 1) if (x := places.get(marked[i : i + size])) is not None]
            if found:
                return self.values[size][found].mean(axis=0) * 2
        return None

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the share of the words' evidence that speaks for it; of equal languages the first by name."""
        words = words_of(text) if text else {}
        if not words:
            return UNKNOWN, 0.0
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        rows, weights = [], []
        for word, n in words.items():
            if word not in self.seen:
                self.seen[word] = self.word(word)
            if (row := self.seen[word]) is not None:
                rows.append(row)
                weights.append(n)
        if not rows:
            return (self.langs[0], 0.0) if self.langs else (UNKNOWN, 0.0)
        table, weight = np.array(rows), np.array(weights, float)
        best = int(np.argmax(weight @ table))
        share = np.exp(table - table.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        return self.langs[best], float(min(1.0, weight @ share[:, best] / weight.sum()))


def grams_of(marked, size: int) -> F.Column:
    last = F.greatest(F.lit(1), F.length(marked) + 1 - size)
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(marked, i, F.lit(size)))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAINING_ROWS, id_col: str = "doc_id") -> Model:
    """A model from labelled documents.

    Of the usable rows a sample of expected size `rows` is read, the only sample here: those whose hash of id and text
    lies below the share rows / number of usable rows, the same ones in every run. Rows without text or language are left
    out; no rows give a model without languages.
    """
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    chosen = usable.select(F.xxhash64(id_col, text).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    share = min(1.0, rows / max(1, usable.count()))
    chosen = staged(chosen.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).drop("h"), "labelled")
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_SQL), 0)).alias("entry")
    words = staged(chosen.select("lang", word).groupBy("lang", "entry").agg(F.count("*").alias("n")), "words")
    grams = None
    for size in range(1, LONGEST + 1):
        cut = F.explode(grams_of(F.concat(F.lit(" "), "entry", F.lit(" ")), size)).alias("entry")
        one = words.select("lang", F.lit(size).alias("size"), cut).groupBy("lang", "size", "entry").agg(F.count("*").alias("n"))
        grams = one if grams is None else grams.unionByName(one)
    # Bounded by the sample: some hundred thousand entries, which come as columns.
    entries = words.select("lang", F.lit(0).alias("size"), "entry", "n").unionByName(grams).toArrow()
    counts: dict[int, dict[str, dict[str, int]]] = {}
    for size, lang, entry, n in zip(*(entries.column(c).to_pylist() for c in ("size", "lang", "entry", "n"))):
        counts.setdefault(size, {}).setdefault(lang, {})[entry] = n
    return Model(counts)


def predict(
    docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score"), drop: tuple[str, ...] = ()
) -> DataFrame:
    """Documents with the predicted language and a score from 0 to 1, from their whole texts alone.

    Null texts and texts without a letter are `und` with score 0; so is everything if the model has no language.
    Columns of the results' names are replaced. Repeated rows and very long texts are predicted like any other. No
    shuffle; the model is broadcast, its size is bounded by the sample it was trained on.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known = sent.value

        def work(texts):
            found = [known.predict(t) for t in texts]
            return [[f[0] for f in found], [f[1] for f in found]]

        return work

    return extend(docs, [text], start, f"{names[0]} string, {names[1]} double", drop)


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the fifth of the documents that training leaves out; false where there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def for_training(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 0, F.lit(False))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Documents in one of the learned languages; those without letters (null and empty texts among them), or whose
    words do not speak clearly enough for any one language, go. Where no document has a language nothing is learned, and
    all documents with letters stay. All columns stay as they are; ids may be null or repeat, rows are judged one by one.
    """
    prefix = unused(docs)
    model = train(docs.where(for_training(id_col)), text, lang, id_col=id_col)
    if not model.langs:
        return docs.where(F.col(text).rlike(WORD_SQL))
    found = predict(docs, model, text, (f"{prefix}lang", f"{prefix}score"))
    clear = (F.col(f"{prefix}lang") != UNKNOWN) & (F.col(f"{prefix}score") >= LEAST_SCORE)
    return found.where(clear).select(*docs.columns)
