"""The prefix trie and its contraction against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from brinelog.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, own in built.items():
        for d in range(len(own) + 1):
            nodes[tuple(own[:d])].append(c)
    kids, leaves, saves = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saves[path[:d]] += (len(members) - 1) * (len(path[-1][1].encode()) if path else 0)
    ends = lambda path: ",".join(str(c) for c in sorted(nodes[path]) if len(built[c]) == len(path))
    return [(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saves[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in nodes.items()]


def trie(frame):
    found = prefix_trie.prefix_trie(*prefix_trie.spliced(prefix_trie.ordered_turns(frame)))
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("chunk", [64, 2])
def test_trie_is_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    random.seed(chunk)
    rows = [(c, random.choice([None, *range(6)]), random.choice(["user", "assistant", None]), random.choice(["é", "b", "", None, "long " * 500])) for c in [None, -7, -5, *range(40)] for _ in range(random.randrange(12))]
    rows += [(40, k, "user", "same") for k in range(30)] + [(c, k, "user", "same") for c in range(50, 75) for k in range(3)]
    rows += [(45, 1, "a", "tie"), (45, 1, "a", "tie"), (46, 0, "x", "alone"), (10**18, 1, "u", "t"), (101, 0, "u", "short")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, bytes int, name string").repartition(4)
    assert trie(frame) == sorted(brute(rows), key=repr)


def test_no_conversation_has_no_node(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert trie(spark.createDataFrame([], kind)) == [] == trie(spark.createDataFrame([(None, 1, "a", "b")], kind))


def test_a_long_conversation_in_chunks_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    rows = [(c, k, "u", f"t{k % 7}" if k != 300 or c else "other") for c in (0, 2) for k in range(600)]
    assert trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("shape", ["path", "star", "random", "comb", "forest"])
def test_totals_of_subtrees(spark, shape):
    random.seed(shape)
    n = 150
    parent = {"path": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: random.randrange(i), "comb": lambda i: i - 1 if i % 2 else max(0, i - 2), "forest": lambda i: None if i % 10 == 0 else random.randrange(i)}[shape]
    parents = [None] + [parent(i) for i in range(1, n)]
    worth = [random.randrange(100) for _ in range(n)]
    want = list(worth)
    for i in range(n - 1, 0, -1):
        if parents[i] is not None:
            want[parents[i]] += want[i]
    frame = spark.createDataFrame([(i, parents[i], worth[i], 1) for i in range(n)], "id long, parent long, a long, b long")
    got = {r.id: r.a for r in prefix_trie.subtree_totals(frame, ["a", "b"]).collect()}
    assert got == dict(enumerate(want))
