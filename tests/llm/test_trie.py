"""The conversation trie against a plain version, in one shard and in many."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidelog.llm import trie
from tidelog.llm.common import prepare

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, shard string, `from` int"


def plain_trie(paths):
    """Nodes by prefix of paths {conversation: [(role, text)]}."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own) - 1) * words
    return Counter(
        (min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, own in members.items()
    )


def rebuilt(rows):
    """Turns by conversation as the rule of the query makes them, ties by the MD5 of role and text."""

    def digest(role, text):
        return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()

    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    return out


def made(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        same = c % 3 == 0  # a third of all conversations are alike
        for turn in range(4 if same else r.randrange(1, 7)):
            text = f"hello  {turn}\tx" if same or r.random() < 0.6 else f"t{r.randrange(3)} é b"
            rows.append((c, turn, "user" if turn % 2 == 0 else "bot", text, "p", "s", 1))
    return rows


def check(spark, rows, shard_bytes):
    prepare(spark)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    paths = trie.grafted(trie.paths_of(turns))
    found = trie.prefix_trie(paths, shard_bytes)
    assert found.columns == list(trie.NODES)
    assert Counter(tuple(r) for r in found.collect()) == plain_trie(rebuilt(rows))


@pytest.mark.parametrize("shard_bytes", [1 << 20, 900])
def test_equals_plain_version(spark, shard_bytes):
    check(spark, made(1, 150), shard_bytes)


@pytest.mark.parametrize("budget", [20])
def test_splitters_that_are_cut(spark, monkeypatch, budget):
    monkeypatch.setattr(trie, "SPLITTER_BYTES", budget * 20)
    check(spark, made(2, 150), 1500)


def test_odd_rows(spark):
    tail = ("p", "s", 1)
    rows = [(None, 1, "user", "no conversation", *tail), (3, None, "user", "null turn first", *tail), (3, 1, None, None, *tail),
            (3, 1, None, None, *tail), (3, 1, "a", "tie", *tail), (7, 0, "user", "x" * 100_000, *tail), (7, 1, "user", "", *tail),
            (20, 5, "a", "b", *tail), (21, 5, "a", "b", *tail), (22, 5, "ab", "", *tail), (-20, 1, "n", "m", *tail), (-20, 2, "n", "m", *tail)]
    rows += [(41, i, "user", f"long {i % 7}", *tail) for i in range(150)]
    check(spark, rows, 1 << 20)
    check(spark, rows, 600)


def test_turnless_and_no_conversations(spark):
    prepare(spark)
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    check(spark, [(c, 0, "user", "a", "p", "s", 1)], 1 << 20)
    assert trie.prefix_trie(trie.grafted(trie.paths_of(spark.createDataFrame([], SCHEMA)))).count() == 0
