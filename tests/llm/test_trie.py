import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tallyweave.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, without=()):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {c: tuple((r, t) for _, _, r, t in sorted(turns)) for c, turns in convs.items()} | {c: () for c in without}
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[c] for c in children[node]]
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        totals[node] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + own)
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), len(children[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(spark, rows, **limits):
    pieces = trie.ordered_pieces(spark.createDataFrame(rows, SCHEMA) if isinstance(rows, list) else rows)
    found = trie.with_digests(*trie.prefix_trie(pieces, **limits)).select(*COLUMNS)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def conversations(seed=3, n=80, longest=12, turns=3):
    draw = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for k in range(int(draw.integers(1, longest))):
            # few different turns, so that many beginnings are shared
            rows.append((c * 3, k, "user" if k % 2 else "assistant", f"turn {'é' * int(draw.integers(0, turns))}"))
    return rows


@pytest.mark.parametrize("limits", [{}, {"container_rows": 4}, {"container_rows": 1, "block": 3}, {"block": 1}])
def test_equals_brute_force(spark, limits):
    rows = conversations()
    assert nodes(spark, rows, **limits) == brute(rows)


def test_copies_and_a_long_conversation(spark):
    """Many copies of one conversation, and one with most of all rows that others begin like."""
    rows = [(c, k, "user", f"t{k}") for c in range(200) for k in range(3)]
    rows += [(1_000, k, "user", f"t{k}") for k in range(6_000)] + [(1_001, k, "user", f"t{k}" if k < 5_000 else "x") for k in range(5_001)]
    assert nodes(spark, rows, container_rows=2) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, "user", "second"), (1, 5, None, None), (2, None, "user", "first"), (2, 3, "", ""),
        (None, 0, "user", "no id"), (-4, 0, "user", None), (-4, 0, "user", None), (7, 1, "ab", "c"), (8, 1, "a", "bc"),
        (9, 0, "user", "long " * 50_000), (10, 0, "user", "long " * 50_000),
    ]
    assert nodes(spark, rows) == brute(rows)
    wider = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", n int, data string, cid string")
    assert nodes(spark, wider) == brute(rows)
    assert nodes(spark, spark.createDataFrame([], SCHEMA)) == []


def test_conversations_without_turns(spark):
    rows = conversations(4, 5)
    pieces = trie.ordered_pieces(spark.createDataFrame(rows, SCHEMA))
    empty = spark.createDataFrame([(500, 0, b""), (501, 0, b"")], "conv_id long, start long, data binary")
    for with_turns, want in ((pieces, brute(rows, (500, 501))), (pieces.limit(0), brute([], (500, 501)))):
        found = trie.with_digests(*trie.prefix_trie(with_turns.unionByName(empty))).select(*COLUMNS)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want


def test_lists_of_members_are_written_in_pieces(spark, monkeypatch):
    ends = spark.createDataFrame([("a" if c % 3 else "b", c) for c in range(5_000)], "end_id string, conv_id long")
    got = {r.end_id: r.ends_sha256 for r in trie.member_digests(ends).collect()}
    for name, rest in (("a", (1, 2)), ("b", (0,))):
        assert got[name] == hashlib.sha256(",".join(str(c) for c in range(5_000) if c % 3 in rest).encode()).hexdigest()
