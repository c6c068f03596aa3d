"""Token alignment against a plain version, whole and in pieces."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidelog.llm import alignment
from tidelog.llm.common import prepare
from tidelog.llm.queries import TOKENIZERS, op11_alignment

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    return alignment.read_tokenizers(A, B)


def plain(texts):
    """Rows of the query for some texts, by the libraries themselves."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()
    docs = []
    for text in texts:
        groups = []
        if text:
            x, y = a.encode(f" {text}", add_special_tokens=False), b.encode(text)
            xs = [bytes(letters[c] for c in t) for t in x.tokens]
            names = [b.id_to_piece(i) for i in y]
            ys = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(y, names)]
            if b"".join(xs) == b"".join(ys) == f" {text}".encode():
                i = j = at = to = 0
                p, q = [], []
                while i < len(xs) or j < len(ys):
                    if at <= to and i < len(xs):
                        p.append(x.ids[i]); at += len(xs[i]); i += 1  # noqa: E702
                    else:
                        q.append(y[j]); to += len(ys[j]); j += 1  # noqa: E702
                    if at == to:
                        groups.append((p, q))
                        p, q = [], []
        docs.append(groups)
    n = Counter()
    for groups in docs:
        n.update({(i, j) for p, q in groups for i in p for j in q})
    most = defaultdict(int)
    for (i, _), k in n.items():
        most[i] = max(most[i], k)
    out = []
    for groups in docs:
        links = [(i, j) for p, q in groups for i in p for j in q]
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links),
                    sum(n[e] == most[e[0]] for e in links), sum(n[e] for e in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def made(seed):
    r = random.Random(seed)
    words = ["the", "Über", "naïve", "日本語テキスト", "🙂🙂", "don't", "<|endoftext|>", "<s>", "x" * 40, "3.1415926535", " ", "é", "\0", "pneumonoultramicroscopic"]
    texts = [None, "", " ", "  \n\t ", "a▁b", "<|endoftext|>", "é", "aaaa" * 300, "zqxj" * 900]
    for _ in range(40):
        texts.append(r.choice(["", " "]).join(r.choice(words) + r.choice(["", " ", "\n", "  "]) for _ in range(r.randrange(1, 120))))
    return texts + texts[-3:]


@pytest.mark.parametrize("piece, broadcast", [(alignment.PIECE, 0), (50, 10**6), (7, 10**6)])
def test_equals_plain_version(spark, own, monkeypatch, piece, broadcast):
    prepare(spark)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    texts = made(piece)
    rows = [(i if i % 4 else None, t, 1, 2, "p") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row int, n_a int, pairs string").repartition(3)
    found = alignment.align_and_count(docs, own, piece=piece).collect()
    want = Counter((row[0], *p) for row, p in zip(rows, plain(texts)))
    assert Counter((r.doc_id, *[r[n] for n in NAMES]) for r in found) == want


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: tuple(r[n] for n in NAMES) for r in op11_alignment(spark, SF).collect()}
    assert found == {d.doc_id: p for d, p in zip(docs, plain([d.text for d in docs]))}


def test_no_rows(spark, own):
    prepare(spark)
    assert alignment.align_and_count(spark.createDataFrame([], "doc_id bigint, text string"), own).count() == 0


def test_diagonals_are_of_equal_work():
    r = np.random.default_rng(5)
    for n, m in ((1000, 900), (5, 3000), (3000, 1), (64, 64)):
        a, b = (np.sort(r.choice(10_000, k, replace=False)) for k in (n, m))
        cuts = [(0, 0), *alignment.divided(a, b, 64), (n, m)]
        for (i, j), (k, l) in zip(cuts, cuts[1:]):
            assert 0 <= k - i and 0 <= l - j and k - i + l - j <= 65
            if (k, l) != (n, m):
                # What lies before a cut ends no later than what lies behind it, and equal ends stay together.
                assert max([*a[i:k], *b[j:l]]) < min([*a[k : k + 1], *b[l : l + 1]])


def test_very_long_texts(own):
    for text in ("ab " * 400_000, " " * 1_500_000, "é" * 300_000):
        a, b = own.encode(text)
        raw = f" {text}".encode()
        assert b"".join(own.bytes_a[i] for i in a) == raw == b"".join(own.bytes_b[i] for i in b)
