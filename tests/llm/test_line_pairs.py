"""Line dedup against brute force: recall of its buckets, and whole families of templated lines."""

import random
import time

from pyspark.sql import functions as F

from tidelog.llm import lines
from tidelog.llm.common import CLEANUP, prepare, staged


def grams(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def alike(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def test_signatures_bring_similar_lines_together(spark):
    r = random.Random(21)
    word = lambda n=0: "".join(r.choice("abcdefghijklmnop") for _ in range(n or r.randrange(3, 9)))
    pairs = []
    for _ in range(1500):
        few = [word() for _ in range(r.randrange(5, 14))]
        typo = list(few)
        typo[r.randrange(len(few))] = word()
        one = word(40)
        pairs += [(" ".join(few), " ".join(typo)), (" ".join(few), " ".join(few) + "."), (one, one[:20] + "Z" + one[21:])]
        pairs += [(one[:24], one[:24] + "!"), ("漢字" + one, "漢字" + one + "。")]
    pairs = [p for p in pairs if alike(*map(grams, p))]
    rows = spark.createDataFrame([(i, t) for i, p in enumerate(pairs) for t in p], "h int, line string").coalesce(4)
    keys = {}
    for r in lines.signed(rows).collect():
        keys.setdefault(r.h, []).append(r["keys"])
    met = sum(any(x == y for x, y in zip(*both)) for both in keys.values()) / len(pairs)
    print(f"{met:.4f} of {len(pairs)} similar pairs share a band")
    assert len(pairs) > 4000 and met > 0.98
    odd = lines.signed(spark.createDataFrame([(0, "ab"), (1, "ab"), (2, "x" * 30), (3, "漢字仮名交")], "h int, line string")).collect()
    assert all(len(r["keys"]) == 8 for r in odd) and [r.size for r in odd] == [1, 1, 1, 1] and odd[0]["keys"] == odd[1]["keys"]


def test_repeated_rows_blank_lines_and_clashing_names(spark):
    prepare(spark)
    text = "first line of the text\r\n\t\r\nsecond line of the text\r\n \r"
    rows = [(1, text, 5, "x")] * 3 + [(1, text, 6, "x"), (None, text, 5, "x"), (2, "\t\n\x0b\n", 5, "x"), (3, "z" * 100_000 + "\nzz", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int, _x string").repartition(3)
    got = lines.dedupe_lines(docs, counts=("n", "gone")).collect()
    assert len(got) == len(rows) and [c for c in got[0].asDict()] == ["doc_id", "text", "_x", "n", "gone"]
    whole = [r for r in got if r.text == text]
    assert len(whole) == 1 and whole[0].doc_id == 1  # one keeps its lines, the others only their blank ones
    rest = [r for r in got if r.doc_id in (1, None) and r.text != text]
    assert len(rest) == 4 and {(r.text, r.n, r.gone) for r in rest} == {("\t\r\n \r", 4, 2)}
    assert {r.text for r in got if r.doc_id in (2, 3)} == {"\t\n\x0b\n", "z" * 100_000 + "\nzz"}


def test_a_templated_family(spark):
    prepare(spark)
    r = random.Random(22)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    base, family = [word() for _ in range(20)], []
    for _ in range(700):
        w = list(base)
        for at in r.sample(range(20), 2):
            w[at] = word()
        near = list(w)
        near[r.randrange(20)] = word()
        family += [" ".join(w), " ".join(near)]
    docs = spark.createDataFrame(list(enumerate(family)), "doc_id bigint, text string")
    got = lines.dedupe_lines(docs, counts=("n", "gone")).agg({"gone": "sum"}).first()[0]
    sets, name = [grams(t) for t in family], list(range(len(family)))

    def root(i):
        while name[i] != i:
            name[i] = name[name[i]]
            i = name[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if root(i) != root(j) and alike(sets[i], sets[j]):
                name[root(i)] = root(j)
    want = len(sets) - len({root(i) for i in range(len(sets))})
    assert want > 500 and 0.97 * want <= got <= want, (got, want)


def test_signatures_and_checks_are_built_in(spark, capsys):
    rows = spark.createDataFrame([(1, "one line of text"), (2, "one line of texts")], "h bigint, line string")
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    found = lines.signed(rows)
    texts = rows.join(found.select("h", "sketch"), "h")
    for df in (found, lines.verified(pairs, texts, 0.8)):
        df.explain()
        assert not any(word in capsys.readouterr().out for word in ("Arrow", "Python", "Pandas"))
    # 12 shingles and 13, of which 12 are shared.
    assert lines.verified(pairs, texts, 0.92).count() == 1 and lines.verified(pairs, texts, 0.93).count() == 0


def test_staged_tables_leave_no_shuffle_files(spark, tmp_path):
    prepare(spark)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {n for n in files.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    before = held()
    made = staged(spark.range(5000).repartition(3, "id"), "cleaned")
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and made.count() == 5000
    assert spark.conf.get(CLEANUP) == "false"


def test_shingles_are_of_code_points(spark):
    rows = ["", "ab", "abcde", "a𝒳b𝒴cd", "𝒳𝒴𝒳𝒴𝒳𝒴", "a\r\nb c"]
    found = spark.createDataFrame([(t,) for t in rows], "line string").select("line", lines.shingles(F.col("line")).alias("all")).collect()
    assert all(r.all == ([r.line[i : i + 5] for i in range(len(r.line) - 4)] or [r.line]) for r in found)
