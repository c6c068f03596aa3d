"""Fuzzy line dedup by MinHash, in built-in functions.

A line's signature is over all its shingles of SHINGLE characters: BANDS * ROWS minima, one aggregate each over the
exploded shingles, which are cut from fixed-width code points by position. Lines with one equal band meet in a bucket, 96% of
those with a similarity of 0.8 and 99.5% of those with 0.87.

Each line is first compared with the least line of all its buckets, one pair a line. Then lines are linked in rounds, each
of which compares every line with one line of its bucket that is in another component, the centre, a different one every
time from the bucket's largest component. Pairs that a few bits of their minima tell apart go before texts are joined. So copies and near copies of one
line, in any number, make a row a line. Lines that are in different components of one bucket after ROUNDS rounds are all
compared with one another inside a join, by a few bits of their minima and then by their sets of 32-bit shingle hashes: only
pairs as similar as asked for leave it. All pairs, of rounds and of this join, are verified by their exact Jaccard
similarity. Unlike lines of one template thus cost the square of their number in comparisons, but make no rows.

Every component keeps its first line. Lines are named by a 64-bit hash.
"""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import components, discard, staged, unused

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 5
#: Bits kept of each minimum in a sketch, and the longs that hold those of the bands.
BITS = 4
FEW = -(-BANDS * ROWS * BITS // 64)
ROUNDS = 2
#: How far below the similarity the one told by the bands' minima or by sets of 32-bit hashes may be: over four standard
#: deviations, and more than a few equal hashes of unlike shingles make.
SLACK_FEW, SLACK = 0.3, 0.01
BLANK = " \t\n\x0b\x0c\r"


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, k, o, pos, line, h) for the lines of documents (id, k, o, text) that are not blank."""
    rows = docs.select("id", "k", "o", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.btrim("line", F.lit(BLANK)) != "").withColumn("h", F.xxhash64("line"))


def starts(code: Column) -> Column:
    """Where the shingles of a line begin, in bytes of its code points; a shorter line is its own shingle."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(code) - (4 * SHINGLE - 1), F.lit(1)), F.lit(4))


def shingle(code: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(code, start, F.lit(4 * SHINGLE)))


def hashes(code: Column) -> Column:
    """The different shingles of a line, given as a column of UTF-32, as hashes."""
    return F.array_distinct(F.transform(starts(code), lambda p: shingle(code, p)))


def shingles(line: Column) -> Column:
    """The shingles of a line, repeats included, as texts. Time grows with the line, unlike that of functions of arrays by
    position, which copy the code points for each."""
    # No shingle begins within a pair of surrogates.
    every = F.regexp_extract_all(line, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{SHINGLE}}}))"), F.lit(1))
    return F.when(F.char_length(line) < SHINGLE, F.array(line)).otherwise(every)


def minima(lines: DataFrame, count: int) -> tuple[DataFrame, list[str]]:
    """All columns of lines (line, ...) but the line, with `count` minima over its shingles, and these columns' names.

    Each permutation orders one of ROWS hashes by its distance from a point of its own, so that minima of one band are
    of different hashes. Grouping by what names a line needs no shuffle behind one by a part of these columns.
    """
    prefix = unused(lines)
    names = [f"{prefix}m{j}" for j in range(count)]
    keys = [c for c in lines.columns if c not in ("line", "size")]
    sizes = [F.max("size").alias("size")] if "size" in lines.columns else []
    coded = lines.withColumn(f"{prefix}code", F.encode("line", "UTF-32")).withColumn(f"{prefix}check", F.xxhash64("line", F.lit(1)))
    rows = coded.withColumn(f"{prefix}start", F.explode(starts(F.col(f"{prefix}code"))))
    rows = rows.withColumn(f"{prefix}0", shingle(F.col(f"{prefix}code"), F.col(f"{prefix}start")))
    rows = rows.withColumns({f"{prefix}{r}": F.xxhash64(f"{prefix}0", F.lit(r)) for r in range(1, ROWS)})
    point = lambda j: xxhash.xxh64_intdigest(b"%d" % j, 1) - 2**63
    every = [F.min(F.col(f"{prefix}{j % ROWS}").bitwiseXOR(F.lit(point(j)))).alias(f"{prefix}m{j}") for j in range(count)]
    return rows.groupBy(*keys, f"{prefix}check").agg(*sizes, *every).drop(f"{prefix}check"), names


def packed(names: list[str]) -> list[Column]:
    """The lowest BITS bits of minima, many in a long."""
    field = lambda j, name: F.shiftleft(F.col(name).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * j)
    groups = [names[i : i + 64 // BITS] for i in range(0, len(names), 64 // BITS)]
    return [reduce(Column.bitwiseOR, [field(j, name) for j, name in enumerate(group)]) for group in groups]


def unlike(x: list[Column], y: list[Column]) -> Column:
    """How many of their packed minima differ."""
    lowest = F.lit(sum(1 << j for j in range(0, 64, BITS)))
    bits = [[F.shiftrightunsigned(a.bitwiseXOR(b), by) if by else a.bitwiseXOR(b) for by in range(BITS)] for a, b in zip(x, y, strict=True)]
    return reduce(Column.__add__, [F.bit_count(reduce(Column.bitwiseOR, every).bitwiseAND(lowest)) for every in bits])


def allowed(similarity: float, count: int) -> int:
    """How many of so many packed minima differ at this similarity; unlike minima have equal bits by chance."""
    return round((1 - similarity) * (1 - 2**-BITS) * count)


def close(x: str, y: str, similarity: float) -> Column:
    """Whether the lines of two sketches may be similar: sketches tell the similarity but for chance."""
    sides = [[F.get(c, F.lit(i)) for i in range(FEW)] for c in (x, y)]
    return unlike(*sides) <= allowed(similarity - SLACK_FEW, BANDS * ROWS)


def signed(lines: DataFrame) -> DataFrame:
    """Lines (h, line, ...) without their text, with the `keys` of their bands, a `sketch` of their minima, and `size`, the
    number of their different shingles, which is worked out only where it is read. Equal rows become one."""
    sized = lines.withColumn("code", F.encode("line", "UTF-32")).withColumn("size", F.size(hashes(F.col("code")))).drop("code")
    found, names = minima(sized, BANDS * ROWS)
    bands = [F.xxhash64(F.lit(b), *names[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)]
    return found.withColumns({"keys": F.array(*bands), "sketch": F.array(*packed(names))}).drop(*names)


def buckets(lines: DataFrame) -> DataFrame:
    """(key, h) of lines in buckets with other lines. The join's one row per bucket lets a hot bucket be split."""
    keys = lines.select("h", F.explode("keys").alias("key"))
    shared = staged(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    met = staged(keys.join(shared, "key"), "buckets")
    discard(shared)
    return met


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of lines (h, line) whose exact Jaccard similarity reaches the threshold."""
    a = texts.select(F.col("h").alias("a"), F.col("line").alias("x"))
    b = texts.select(F.col("h").alias("b"), F.col("line").alias("y"))
    joint = pairs.join(a, "a").join(b, "b")
    # A generator's rows are made once; a condition on plain columns would work the sets out again for each use.
    sets = F.struct(*[F.array_distinct(F.transform(shingles(F.col(c)), lambda s: F.xxhash64(s))).alias(c) for c in "xy"])
    counts = joint.select("a", "b", F.inline(F.array(sets)))
    both = F.size(F.array_intersect("x", "y"))
    return counts.where((1000 + round(1000 * similarity)) * both >= round(1000 * similarity) * (F.size("x") + F.size("y"))).select("a", "b")


def placed(met: DataFrame, named: DataFrame) -> DataFrame:
    """(key, h, sketch, c) of the buckets (key, h, sketch) that hold lines of several components c."""
    every = met.join(named.withColumnRenamed("node", "h"), "h", "left").select(*met.columns, F.coalesce("component", "h").alias("c"))
    split = every.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    return every.join(split, "key")


def links(met: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the similar lines of buckets (key, h, sketch); `texts` has (h, line) of all of them."""
    # Lines alike meet in several buckets. One pair a line first, with the least of its buckets' lines, links most of them.
    least = met.groupBy("key").agg(F.min(F.struct(F.xxhash64("h", F.lit(ROUNDS)), "h", "sketch")).alias("least"))
    nearest = met.join(least, "key").groupBy("h", "sketch").agg(F.min("least").alias("least"))
    pairs = nearest.where((F.col("least.h") != F.col("h")) & close("least.sketch", "sketch", similarity))
    pairs = pairs.select(F.col("least.h").alias("a"), F.col("h").alias("b"))
    named = staged(components(verified(pairs, texts, similarity), "lines"), "named")
    rest = staged(placed(met, named), "placed")
    for turn in range(ROUNDS):
        line = F.struct(F.xxhash64("h", F.lit(turn)), "h", "sketch")
        some = rest.groupBy("key", "c").agg(F.count("*").alias("n"), F.min(line).alias("least"))
        centre = some.groupBy("key").agg(F.max(F.struct("n", "least", "c")).alias("centre"))
        other = (F.col("centre.c") != F.col("c")) & close("centre.least.sketch", "sketch", similarity)
        pairs = rest.join(centre, "key").where(other).select(F.col("centre.least.h").alias("a"), F.col("h").alias("b")).distinct()
        # Lines stay linked to the one that names their component.
        more = verified(pairs, texts, similarity).unionByName(named.select(F.col("node").alias("a"), F.col("component").alias("b")))
        before = named, rest
        named = staged(components(more, "lines"), "named")
        rest = staged(placed(met, named), "placed")
        for df in before:
            discard(df)
    few = [F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(FEW)]
    held = texts.join(rest.select("h").distinct(), "h", "left_semi")
    sets = held.select("h", F.inline(F.array(F.struct(F.array_distinct(F.transform(shingles(F.col("line")), lambda s: F.hash(s))).alias("set")))))
    # Both sides of the join read one shuffle of the sets, which are written nowhere else.
    whole = rest.select("key", "h", "c", *few).join(sets, "h").withColumn("size", F.size("set"))
    x, y = whole.alias("x"), whole.alias("y")
    other = (F.col("x.key") == F.col("y.key")) & (F.col("x.h") < F.col("y.h")) & (F.col("x.c") != F.col("y.c"))
    m, n = F.col("x.size"), F.col("y.size")
    least = round(1000 * (similarity - SLACK))
    apart = unlike(*[[F.col(f"{side}.s{i}") for i in range(FEW)] for side in "xy"]) <= allowed(similarity - SLACK_FEW, BANDS * ROWS)
    both = F.size(F.array_intersect("x.set", "y.set"))
    fits = (F.least(m, n) * 1000 >= F.greatest(m, n) * least) & apart & (both * (1000 + least) >= (m + n) * least)
    pairs = x.join(y, other & fits).select(F.col("x.h").alias("a"), F.col("y.h").alias("b")).distinct()
    last = verified(pairs, texts, similarity).unionByName(named.select(F.col("node").alias("a"), F.col("component").alias("b")))
    found = components(last, "lines")
    for df in (named, rest):
        discard(df)
    return found


def repeated_lines(docs: DataFrame, similarity: float) -> DataFrame:
    """(id, k, o, gone): the positions of the lines to remove from documents (id, k, o, text)."""
    lines = lines_of(docs)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "k", "o", "pos")
    whole = lines.groupBy("h", F.xxhash64("line", F.lit(2)).alias("again")).agg(
        F.first("line").alias("line"), F.count("*").alias("n"), F.min(place).alias("first")
    )
    whole = whole.select("h", "again", "line", "n", "first.*")
    # One shuffle of the texts: signatures are grouped where their lines already are.
    distinct = staged(signed(whole).select("h", "n", F.struct("no_id", "id", "k", "o", "pos").alias("first"), "keys", "sketch"), "distinct")
    met = buckets(distinct)
    sketched = staged(met.join(distinct.select("h", "sketch"), "h"), "sketched")
    texts = lines.select("h", "line").join(met.select("h").distinct(), "h", "left_semi")
    texts = staged(texts.groupBy("h").agg(F.first("line").alias("line")), "lines")
    linked = links(sketched, texts, similarity).withColumnRenamed("node", "h")
    # The first line of each component; a line that only repeats is a component of its own.
    own = distinct.select("h", "n", "first").join(linked, "h", "left").where("n > 1 or component is not null")
    own = staged(own.select("h", "first", F.coalesce("component", "h").alias("component")), "own")
    firsts = own.groupBy("component").agg(F.min("first").alias("least"))
    kept = staged(own.join(firsts, "component").select("h", "least"), "firsts")
    rest = lines.join(kept, "h").where(place != F.col("least"))
    gone = rest.groupBy("id", "k", "o").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    for df in (distinct, met, sketched, texts, own):
        discard(df)
    return gone


def dedupe_lines(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = None
) -> DataFrame:
    """Documents with every line removed that equals or nearly equals another one, but for one line per component: the
    first by id (null ids last), text and position. All documents and columns stay; `counts` names two more columns for
    the numbers of lines and of removed lines, which replace columns of these names.

    Lines end with a line feed. Lines of ASCII white space alone stay, null and empty texts stay as they are, a text may
    end up empty. Rows that share an id are told apart by their texts and other columns; of rows alike in all of them one
    keeps its first lines, and all lines of the others repeat those. A line and its shingles are held at once in memory.
    """
    prefix = unused(docs)
    key, other = F.xxhash64(F.col(text)), F.xxhash64(*[F.col(c) for c in docs.columns])
    rows = docs.select(F.col(id_col).alias("id"), key.alias("k"), other.alias("o"), F.col(text).alias("text"))
    found = repeated_lines(rows, similarity)
    again = rows.groupBy("id", "k", "o").agg(F.count("*").alias("n")).where("n > 1").drop("n").withColumn("again", F.lit(True))
    keys = ["id", "k", "o"]
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in keys]
    marked = found.alias("x").join(again.alias("y"), same, "full").select(
        *[F.coalesce(f"x.{c}", f"y.{c}").alias(f"{prefix}{c}") for c in keys],
        F.coalesce("gone", F.array().cast("array<int>")).alias(f"{prefix}gone"),
        F.coalesce("again", F.lit(False)).alias(f"{prefix}again"),
    )
    marked = staged(marked, "gone")
    hit = F.col(id_col).eqNullSafe(F.col(f"{prefix}id")) & (key == F.col(f"{prefix}k")) & (other == F.col(f"{prefix}o"))
    joint = docs.join(marked, hit, "left")
    once = joint.where(F.coalesce(F.col(f"{prefix}again"), F.lit(False)) == F.lit(False)).select(*docs.columns, F.col(f"{prefix}gone"))
    # Rows alike in everything, of which one stays as it is left, are the same row: one of them and their number.
    whole = F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{prefix}gone"))).alias(f"{prefix}row")
    groups = joint.where(F.col(f"{prefix}again")).groupBy(*[f"{prefix}{c}" for c in keys]).agg(whole, F.count("*").alias(f"{prefix}n"))
    copies = groups.select(f"{prefix}row.*", F.explode(F.sequence(F.lit(1), F.col(f"{prefix}n").cast("int"))).alias(f"{prefix}copy"))
    lines = F.split(text, "\n")
    filled = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.btrim(F.get(lines, i), F.lit(BLANK)) != "")
    gone = F.when(F.col(f"{prefix}copy") > 1, filled).otherwise(F.col(f"{prefix}gone"))
    every = once.unionByName(copies.withColumn(f"{prefix}gone", gone).drop(f"{prefix}copy"))

    def left(lines, gone):
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    gone = F.col(f"{prefix}gone")
    body = F.when(gone.isNull() | (F.size(gone) == 0), F.col(text)).otherwise(left(lines, gone))
    more = {} if counts is None else {
        counts[0]: F.coalesce(F.size(lines), F.lit(0)).cast("bigint"),
        counts[1]: F.coalesce(F.size(gone), F.lit(0)).cast("bigint"),
    }
    new = {n.lower() for n in more}
    columns = [body.alias(c) if c == text else F.col(c) for c in docs.columns if c.lower() not in new]
    return every.select(*columns, *[c.alias(n) for n, c in more.items()])
