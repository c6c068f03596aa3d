"""Each corpus operator against a plain version, over odd rows: nulls, empty and long texts, repeated rows, clashing columns."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, langid, lines, pieces, pii, shards, simhash, substrings, topk, urls
from tidelog.llm.common import components, prepare
from tidelog.llm.queries import END_ID, PATTERN, TOKENIZERS
from tidelog.session import shared_dir

SCHEMA = "doc_id bigint, text string, lang string, ids int, hits int, pii int, kept int, u int, fingerprint int, k int"


@pytest.fixture
def docs(spark):
    prepare(spark)

    def make(*texts):
        rows = [(None if i == 99 else i, t, "en", 1, 2, 3, 4, 5, 6, 7) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


def words(n, seed, size=2000):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def test_pii_spans():
    text = "x a.b@c.de 1.2.3.400 1.2.3.40 4111 1111 1111 1111 call +1 (555) 123-4567 iban DE89370400440532013000 q"
    found = [(s["kind"], text[s["start"] : s["end"]], s["base"]) for s in pii.spans_of(text)]
    assert ("email", "a.b@c.de", True) in found and ("ip", "1.2.3.40", True) in found
    assert ("phone", "+1 (555) 123-4567", True) in found and ("iban", "DE89370400440532013000", False) in found
    assert not any(kind == "ip" and t == "1.2.3.400" for kind, t, _ in found)
    assert not pii.spans_of(None) and not pii.spans_of("") and not pii.spans_of("9" * 200_000)


def test_pii_base_equals_plain_patterns():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, t):
        d = pii.digits_of(t)
        return {"email": True, "ip": all(int(p) <= 255 for p in t.split(".")) if kind == "ip" else 0,
                "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice("ab1234567890..@@--++  ()é") for _ in range(r.randrange(60)))
        expected = [(k, *m.span()) for k, p in plain.items() for m in re.finditer(p, text) if good(k, m[0])]
        assert list(pii.base_spans(text)) == expected, text


def test_pii_rows(docs):
    rows = pii.redact_pii(docs("mail a@b.cd now", None, "", "mail a@b.cd now")).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["mail [EMAIL] now", None, "", "mail [EMAIL] now"] and rows[0].pii == 3
    assert pii.find_pii(docs()).count() == 0


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs):
    base = words(300, 1)
    texts = [" ".join(base[:i] + ["X"] + base[i + 1 :]) for i in range(40)] + [None, "", " ", "Ab c", "aB c", " ".join(words(80, 9))]
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(*texts)).collect()}
    prints = [plain_print(t) for t in texts]
    assert [found[i].fingerprint % 2**64 for i in range(len(texts))] == prints
    name = list(range(len(texts)))
    for _ in texts:
        name = [min(name[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(texts))]
    assert [found[i].component_id for i in range(len(texts))] == name
    kept = simhash.keep_firsts(docs(*texts).unionByName(docs(*texts)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(name)) and kept.columns[-1] == "k"
    assert simhash.near_duplicates(docs()).count() == 0


def test_simhash_groups_equal_all_pairs():
    r = random.Random(5)
    centre = r.getrandbits(64)
    for size in (2, 40, 1200):
        prints = np.array([centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for _ in range(size)], np.uint64)
        links = [(int(a), int(b)) for a, b in simhash.links_of(prints)]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        every = sorted({int(p) for p in prints})
        near = [(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if (a ^ b).bit_count() <= 2]

        def named(pairs):
            name = {p: p for p in every}
            for _ in range(40):
                for a, b in pairs:
                    name[a] = name[b] = min(name[a], name[b])
            return name

        assert named(links) == named(near)


def test_every_close_half_shares_an_anchor():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**32, 200, dtype=np.uint32)
    b = a ^ (np.uint32(1) << r.integers(0, 32, 200).astype(np.uint32))
    ra, aa = simhash.anchors_within(a, 2)
    rb, ab = simhash.anchors_within(b, 2)
    assert all(set(aa[ra == i].tolist()) & set(ab[rb == i].tolist()) for i in range(200))
    assert (simhash.syndrome(aa) == 0).all()


def test_lines(docs):
    long = " ".join(words(40, 2))
    texts = [f"{long}\nown line one here\n\n", f"{long} extra\nother", None, "", f"x\n{long}", long]
    rows = {r.doc_id: r for r in lines.dedupe_lines(docs(*texts), counts=("n", "gone")).collect()}
    assert [rows[i].text for i in range(6)] == [texts[0], "other", None, "", "x", ""]
    assert [rows[i].gone for i in range(6)] == [0, 1, 0, 0, 1, 1] and rows[0].kept == 4
    assert lines.dedupe_lines(docs()).count() == 0


def test_lines_of_the_same_runs_in_other_orders(docs):
    w = words(12, 6)
    p, q, near = " ".join(w), " ".join(w[::-1]), " ".join([*w[::-1], "z"])
    rows = lines.dedupe_lines(docs(p, q, q, p, near)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [p, q, "", "", ""]


def test_components(spark):
    prepare(spark)
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200), (None, 5)]
    found = dict(components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_substrings(docs):
    r, base = random.Random(4), words(300, 3)
    texts = [" ".join(words(20, i, 50) + base[a : a + r.randrange(30, 60)] + words(20, i + 50, 50)) for i, a in enumerate([5] * 6 + [20] * 5)]
    texts += [None, "", "a b", texts[0], " ".join(["z"] * 90), " ".join(["z"] * 36), " ".join(base[:60] * 2)]
    found = {x.doc_id: x for x in substrings.find_repeats(docs(*texts)).collect()}
    cut = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in cut for i in range(len(w) - 34))
    for i, w in enumerate(cut):
        gone = {j + d for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for d in range(35)}
        assert found[i].kept == " ".join(x for j, x in enumerate(w) if j not in gone), i
        assert (found[i].n_words, found[i].n_removed) == (len(w), len(gone))
    assert substrings.find_repeats(docs()).count() == 0


def test_remove_reference(docs, spark):
    base = words(100, 8)
    ref = spark.createDataFrame([(" ".join(base),), (None,)], "text string")
    rows = substrings.remove_reference(docs("a " + " ".join(base[10:60]) + " b", "a  c", None), ref).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["a b", "a  c", None]


def test_language(docs, spark):
    de, en = "der hund und die katze ist nicht", "the dog and the cat is not"
    rows = [(i, de if i % 2 else en, "de" if i % 2 else "en") for i in range(40)] + [(50, None, "en"), (51, "x", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.langs == ["de", "en"] and model.predict("Die Hundekatze")[0] == "de" and model.predict("12 !")[0] == "und"
    found = langid.predict(docs("the dog", None, "", "…"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found] == ["en", "und", "und", "und"] and all(0 <= r.score <= 1 for r in found)
    none = langid.train(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert none.predict("the dog") == ("und", 0.0)


def test_top_k(spark):
    prepare(spark)
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, 1.5]) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [1.0]), (None, [1.0] * 4), rows[5]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(x) for x in topk.top_k(table.where("vec_id % 50 = 0"), table).orderBy("query_id", "rank").collect()]
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows[:300]}
    expected = []
    for q in range(0, 300, 50):
        near = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:10]
        expected += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    assert got == expected and topk.top_k(table.limit(0), table).count() == 0


def test_decontaminate(docs, spark):
    item, short = words(20, 1), ["q1", "q2"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Q1-q2"), (None, "x y"), (3, None), (4, "")], "item_id bigint, text string")
    texts = ["a " + " ".join(item[:13]).upper() + " b", "q1, q2 " + "z " * 60, " ".join(item[:12]), None, ""]
    rows = decontaminate.find_contamination(docs(*texts), bench, drop=("text",)).orderBy("doc_id").collect()
    assert [[tuple(h) for h in r.hits] for r in rows] == [[(1, 14)], [(0, 2)], [], [], []]
    assert [r["items"] for r in rows] == [[1], [2], [], [], []]
    kept = decontaminate.decontaminate(docs(*texts), bench).orderBy("doc_id").collect()
    assert [r.doc_id for r in kept] == [1, 2, 3, 4] and kept[0].hits == 2 and short
    cut = decontaminate.decontaminate(docs(*texts), bench, mode="spans").orderBy("doc_id").collect()
    assert cut[0].text == "a  b" and cut[3].text is None
    size, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 30
    try:
        blocks = decontaminate.find_contamination(docs(*texts), bench, drop=("text",)).orderBy("doc_id").collect()
    finally:
        decontaminate.BLOCK_BYTES = size
    assert blocks == rows


def test_urls(spark):
    prepare(spark)
    given = [(1, "http://A.example.org/es/1"), (2, "https://example.org/en/12?x"), (3, "http://x.com/fr/#a"), (4, "http://com/de/"),
             (5, None), (6, "no scheme"), (7, "http://xcom/fr/a"), (8, "http://bad.net/p/7.html"), (9, "http://x.org")]
    pages = spark.createDataFrame(given, "page_id bigint, url string")
    known = spark.createDataFrame([(f"http://bad.net/p/{i}.html", True) for i in range(30)] + [(None, True)], "url string, bad boolean")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(pages, known).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3] == ("x.com", "/fr/", "com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][2] is None and got[8][2:] == (None, "block")
    assert got[9][:3] == ("x.org", "", None)
    assert urls.judge(pages.limit(0), known.limit(0)).count() == 0


def test_pieces_equal_the_library_and_round_trip(docs):
    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    own, library = pieces.read_pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    texts = ["".join(r.choice("aabbc  éΩ漢\n\t.01theandion") for _ in range(r.randrange(80))) for _ in range(400)] + ["ab" * 3000, "  lead", "a▁b"]
    for t in texts:
        assert own.decode(own.encode(t)) == t
        assert "▁" in t or own.encode(t).tolist() == library.encode(t)
    rows = pieces.decode(pieces.encode(docs(*texts[:20], None), own, column="n"), own, "n", "back").orderBy("doc_id").collect()
    assert [x.back for x in rows] == [*texts[:20], None]


def test_shards_round_trip(docs, spark):
    vocabulary = shards.read_vocabulary(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", PATTERN, END_ID)
    texts = [" ".join(words(r, r)) for r in range(0, 120, 3)] + [None, ""]
    rows = docs(*texts).unionByName(docs(*texts[:3])).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    path = shared_dir(spark, "shards")
    shards.write_shards(rows, vocabulary, path, length=16, key=5, shard_bytes=3000)
    got = shards.read_shards(spark, path, length=16).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and len({r.shard for r in got}) > 3
    coder = vocabulary.encoder()
    whole = Counter(tuple([*coder.encode_ordinary(t or ""), END_ID]) for t in texts + texts[:3])
    joint = {}
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.part)):
        joint.setdefault(r.doc_id, []).extend(r.ids)
    assert sum(map(len, joint.values())) == sum(len(k) * n for k, n in whole.items()) and tuple(joint[11]) in whole
    some = shards.read_shards(spark, path, length=16, start=10, count=25).orderBy("slot").collect()
    assert some == sorted(got, key=lambda r: r.slot)[10:35]


@pytest.mark.parametrize("size", [1, 2, 3, 100, 4097])
def test_permutation(size):
    assert sorted(shards.permuted(np.arange(size, dtype=np.uint64), size, 9).tolist()) == list(range(size))
