"""Language model, URL tree and pipeline stages against plain versions in Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import langid, urls
from tidelog.llm.common import prepare

SF = "/root/testdata/sf0.001"
ODD = ["½", "²x", "x½y", "①", "ⅷ", "ªb", "ʰ", "٣", "漢字", "ét", "İstanbul", "", None, "123 _ -", "ß"]


def plain_model(rows):
    """Log frequencies by size and entry, from (text, language)."""
    words = defaultdict(Counter)
    for text, lang in rows:
        words[lang].update(regex.findall(r"\p{L}+", text.lower()))
    langs = sorted(lang for lang in words if words[lang])
    tables = []
    for size in range(5):
        counts = {lang: Counter() for lang in langs}
        for lang in langs:
            for word, n in words[lang].items():
                if not size:
                    counts[lang][word] += n
                else:
                    marked = f" {word} "
                    counts[lang].update(marked[i : i + size] for i in range(max(1, len(marked) - size + 1)))
        entries = {e for c in counts.values() for e in c}
        total = [sum(counts[lang].values()) + 0.5 * len(entries) for lang in langs]
        tables.append({e: [math.log((counts[lang][e] + 0.5) / t) for lang, t in zip(langs, total)] for e in entries})
    return langs, tables


def plain_language(text, langs, tables):
    found = regex.findall(r"\p{L}+", (text or "").lower())
    if not found:
        return "und", 0.0
    sums, shares, n = np.zeros(len(langs)), np.zeros(len(langs)), 0
    for word in found:
        row = tables[0].get(word)
        for size in (4, 3, 2, 1):
            if row is None:
                marked = f" {word} "
                known = [tables[size][g] for i in range(len(marked) - size + 1) if (g := marked[i : i + size]) in tables[size]]
                row = list(2 * np.mean(known, axis=0)) if known else None
        if row is not None:
            sums, n = sums + row, n + 1
            shares += np.exp(np.array(row) - max(row)) / np.exp(np.array(row) - max(row)).sum()
    if not n:
        return langs[0], 0.0
    best = int(np.argmax(sums))
    return langs[best], shares[best] / n


def test_languages_equal_a_plain_model(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.where(langid.for_training() & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()
    langs, tables = plain_model([(r.text, r.lang) for r in rows])
    model = langid.train(docs.where(langid.for_training()))
    assert model.langs == langs
    more = spark.createDataFrame([(None, t, "q") for t in ODD], "doc_id bigint, text string, lang string")
    found = langid.predict(docs.unionByName(more), model).collect()
    assert len(found) == docs.count() + len(ODD)
    for r in found:
        lang, score = plain_language(r.text, langs, tables)
        assert r.lang_pred == lang and abs(r.score - min(1.0, score)) < 1e-6, r.text


def test_letters_are_the_same_on_both_sides(spark):
    rows = spark.createDataFrame([(t,) for t in ODD if t], "text string")
    cut = rows.select("text", F.regexp_extract_all(F.lower("text"), F.lit(langid.WORD_SQL), 0).alias("words")).collect()
    assert all(Counter(r.words) == langid.words_of(r.text) for r in cut)
    assert not langid.words_of("½ ② ²") and langid.Model({}).predict("½") == ("und", 0.0)


def test_nothing_learned_keeps_documents_with_letters(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "some words", None), (2, "123", None), (3, None, None), (1, "x", None)], "doc_id bigint, text string, lang string")
    assert sorted(r.text for r in langid.keep_known(docs).collect()) == ["some words", "x"]
    assert langid.keep_known(docs.limit(0)).count() == 0


def plain_verdicts(pages, labelled):
    """Verdicts of (url) from labelled (url, bad), where no rule fits."""

    def cut(url):
        rest = url.split("://", 1)[1]
        host = regex.split(r"[/?#]", rest)[0]
        path = regex.split(r"[?#]", rest[len(host) :])[0]
        parts = [regex.sub(r"\p{L}*[0-9][\p{L}0-9_-]*", "*", p) for p in path.split("/") if p]
        return [host, *("*" if len(p) > 40 else p for p in parts)]

    counts = defaultdict(lambda: [0, 0])
    for url, bad in labelled:
        parts = cut(url)
        for d in range(len(parts)):
            own = counts[tuple(parts[: d + 1])]
            own[0] += 1
            own[1] += bad

    def alike(n, bad, n_all, bad_all):
        mean = bad_all / n_all
        return abs(bad / n - mean) <= urls.ERRORS * math.sqrt((mean * (1 - mean) + 0.25 / n_all) / n)

    family = defaultdict(lambda: [0, 0])
    for t, (n, bad) in counts.items():
        family[t[:-1]][0] += n
        family[t[:-1]][1] += bad
    side, branch = {}, defaultdict(lambda: [0, 0])
    for t, (n, bad) in counts.items():
        if len(t) > 1:
            n_all, bad_all = family[t[:-1]]
            side[t] = 0 if alike(n, bad, n_all, bad_all) else 1 if bad / n > bad_all / n_all else -1
            branch[t[:-1], side[t]][0] += n
            branch[t[:-1], side[t]][1] += bad
    merged = {t: tuple(branch[t[:-1], side[t]]) if len(t) > 1 and alike(*own, *branch[t[:-1], side[t]]) else tuple(own) for t, own in counts.items()}
    hosts = [own for t, own in counts.items() if len(t) == 1]
    overall = (sum(b for _, b in hosts) + 1) / (sum(n for n, _ in hosts) + 2)
    out = []
    for url in pages:
        share, known, parts = overall, False, cut(url)
        for d in range(len(parts)):
            if (own := merged.get(tuple(parts[: d + 1]))) is None:
                break
            share, known = (own[1] + urls.PRIOR * share) / (own[0] + urls.PRIOR), True
        out.append("block" if known and share > urls.LIMIT else "allow")
    return out


def test_url_tree_equals_a_plain_tree(spark):
    prepare(spark)
    r = random.Random(4)
    labelled = []
    for _ in range(3000):
        host = r.choice(["a.net", "b.net", "c.net"])
        parts = [r.choice(["blog", "shop", "x1"]), r.choice(["u", "v"]), r.choice(["p", "q"]), r.choice(["m", "n"]), r.choice(["deep", "fine", "odd", "w" * 50])]
        parts = parts[: r.randrange(6)]
        bad = r.random() < (0.95 if parts[4:] == ["deep"] and parts[0] == "blog" else 0.6 if parts[1:2] == ["v"] and host == "b.net" else 0.1)
        labelled.append((f"http://{host}/{'/'.join(parts)}", bad))
    labelled += [(f"http://d.net/blog/u/p/m/{last}", last == "deep") for last in ("deep", "fine") for _ in range(100)]
    pages = sorted({u for u, _ in labelled}) + ["http://d.net/blog/u/p/m/deep/further/9", "http://new.net/blog", "https://B.net/shop?x=/v"]
    rows = spark.createDataFrame(list(enumerate(pages)) + [(-1, None), (-2, "none"), (-3, pages[0])], "page_id bigint, url string")
    found = {x.page_id: x for x in urls.judge(rows, spark.createDataFrame(labelled + [(None, True), ("http://a.net", None)], "url string, bad boolean"), rules=()).collect()}
    want = plain_verdicts([u.replace("B.net", "b.net") for u in pages], labelled)
    assert [found[i].verdict for i in range(len(pages))] == want
    assert {"block", "allow"} == set(want) and found[pages.index("http://d.net/blog/u/p/m/deep/further/9")].verdict == "block"
    assert found[pages.index("http://d.net/blog/u/p/m/fine")].verdict == "allow"  # only the fifth segment differs
    assert (found[-1].host, found[-1].path, found[-1].verdict) == ("", "", "allow") and found[-2].host == ""
    assert urls.judge(rows.limit(0), spark.createDataFrame([], "url string, bad boolean")).count() == 0


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_of_odd_documents(spark, stage):
    """Nulls, empty and repeated rows, no rows, further columns: every stage ends, and clean documents stay."""
    name, run = stage
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("hits", F.lit(1)).withColumn("gone", F.lit("x"))
    odd = spark.createDataFrame([(None, None, None, None, None, 1, "x"), (900_001, "", "en", "s", 0, 1, "x"), (900_002, "½", "en", "s", 1, 1, "x")], docs.schema)
    whole = docs.unionByName(odd).unionByName(odd)
    after = run(spark, whole, SF)
    assert after.columns == docs.columns or name == "tokens"
    assert 0 < after.count() <= whole.count()
    assert run(spark, whole.limit(0), SF).count() == 0
