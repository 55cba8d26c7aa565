"""Prefix trie against a plain trie in Python."""

import hashlib
import random
import re
import zlib

import pytest

from riskspark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def brute(rows, grafted=True):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if grafted else 0
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = set()
    for p, ids in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[:-1] == q for x in below)]
        saved = sum((len(members[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0) for q in below)
        ends = sorted(c for c in ids if len(built[c]) == len(p))
        out.add((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out, len(members)


def run(spark, rows, block_rows, grafted=True):
    convs = trie.conversations(spark.createDataFrame(rows, SCHEMA))
    found = trie.prefix_trie(trie.graft(convs) if grafted else convs, block_rows)
    return [tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


def rows_of(seed, n=60, words=("a", "a b", "", None), most=7):
    rng = random.Random(seed)
    ids = rng.sample(range(-40, 400), n)
    return [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice(words), 1) for c in ids for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("seed,block_rows,grafted", [(1, 1000, True), (2, 3, True), (3, 7, False), (4, 1, False)])
def test_random_conversations(spark, seed, block_rows, grafted):
    rows = rows_of(seed)
    want, n = brute(rows, grafted)
    got = run(spark, rows, block_rows, grafted)
    assert len(got) == n and set(got) == want


def test_hot_conversation_over_many_blocks(spark):
    """A third of all conversations are equal, another third share a long prefix; a run crosses several blocks."""
    same = [(c, t, "user", f"w{t} x", 0) for c in range(40) for t in range(3)]
    long = [(c, t, "user", f"w{t} x" if t < 5 else f"own {c} {t}", 0) for c in range(40, 80) for t in range(7)]
    rest = [(c, 0, "user", f"other {c % 3}", 0) for c in range(80, 120)]
    rows = same + long + rest
    want, n = brute(rows, False)
    got = run(spark, rows, 8, False)
    assert len(got) == n and set(got) == want


def test_edges(spark):
    rows = [(None, 0, "user", "lost", 0), (7, 0, "u", "a", 0), (7, 0, "u", "a", 0), (8, None, None, None, 0), (9, 1, "u:", "x", 0), (9, 1, "u", ":x", 0)]
    want, n = brute(rows)
    got = run(spark, rows, 2)
    assert len(got) == n and set(got) == want
    only = run(spark, [(3, 0, "user", "gone", 0)], 10)  # its own turn is cut, its family has no first member
    assert only == [(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())] or zlib.crc32(b"3") % 4 == 0
    assert run(spark, [], 10) == []


def test_sparse_table_searches_match_plain_search():
    rng = random.Random(5)
    for n in (1, 2, 3, 8, 37):
        a = trie.np.array([rng.randint(-1, 4) for _ in range(n)])
        t = trie.SparseTable(a)
        for s in range(n):
            for d in range(-1, 6):
                assert t.first_below(trie.np.array([s]), trie.np.array([d]))[0] == next((j for j in range(s, n) if a[j] < d), n)
                assert t.last_below(trie.np.array([s]), trie.np.array([d]))[0] == next((j for j in range(s, -1, -1) if a[j] < d), -1)
            for e in range(s, n):
                assert t.minimum(trie.np.array([s]), trie.np.array([e]))[0] == a[s:e + 1].min()
