import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm.conversation_trie import Shard, conversation_trie, with_texts

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, shard string, key long, depth string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    """The contract, over tuples of turns."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c // 100 * 100, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        saved = (len(nodes[path]) - 1) * len(path[-1][1]) if path else 0
        sums = [below(p) for p in children[path]]
        return saved + sum(s for s, _ in sums), sum(n for _, n in sums) or 1

    out = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))
        saved, leaves = below(path)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=240, texts=3, longest=9):
    """Few different turns, so that many conversations share beginnings; ids are sparse, some below zero; ties, nulls and repeated rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in sorted(rng.choice(np.arange(-300, 900), n, replace=False).tolist()):
        for k in range(int(rng.integers(1, longest))):
            text = [None, "", "é日😀", "ab", "ab c"][int(rng.integers(5))] if rng.random() < 0.3 else f"t{rng.integers(texts)}"
            rows.append((c, None if rng.random() < 0.1 else k // 2, [None, "user", "assistant"][int(rng.integers(3)) if rng.random() < 0.2 else k % 2 + 1], text, "x", 7, "y"))
    rows += rows[:5]  # repeated rows are turns of their own
    rows += [(None, 0, "user", "no conversation", "x", 7, "y")]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize(("seed", "width", "deep"), [(1, 500, 1024), (2, 100, 3), (3, 200, 1), (4, 1000, 5)])
def test_nodes_equal_brute_force(spark, rows, seed, width, deep):
    data = conversations(seed)
    got = rows(conversation_trie(spark.createDataFrame(data, SCHEMA).repartition(5), width=width, deep=deep).select(COLUMNS))
    assert got == brute(data)


def test_one_conversation_copied_into_every_shard(spark, rows):
    data = [(c, t, "user", f"turn {t}", None, None, None) for c in range(1700) for t in range(7)]
    got = rows(conversation_trie(spark.createDataFrame(data, SCHEMA), width=100).select(COLUMNS))
    assert got == brute(data)
    assert max(r[3] for r in got) == 1700


def test_one_very_long_conversation_streams(spark, rows):
    """A conversation of a third of all rows, longer than the index, beside one that shares its beginning and one that ends where the index does."""
    data = [(1, t, "user", str(t % 7), None, None, None) for t in range(900)] + [(2, t, "user", str(t % 7), None, None, None) for t in range(905)]
    data += [(3, t, "user", str(t % 7), None, None, None) for t in range(20)] + [(c, t, "a", "b", None, None, None) for c in range(4, 400) for t in range(2)]
    got = rows(conversation_trie(spark.createDataFrame(data, SCHEMA), deep=20).select(COLUMNS))

    import sys

    sys.setrecursionlimit(10_000)
    assert got == brute(data)


def test_index_holds_no_more_than_its_depth():
    shard = Shard(0, deep=4)
    out = [row for t in range(50) for row in shard.feed(100, bytes([t]) * 16, 1)]
    assert len(shard.paths[0]) == 4 and len(shard.postings) == 4
    assert len(out) == 44  # all but the first of the chain, which the walk gives, and the last, which may yet get a child
    assert len(list(shard.walk())) == 4 + 1 + 1 + 1


def test_turnless_and_empty(spark, rows):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(1, 99)}
    some = next(c for c, n in h.items() if n >= 2)
    data = [(some, 0, "user", "gone", None, None, None)]  # its base is absent and its only turn is replaced
    assert rows(conversation_trie(spark.createDataFrame(data, SCHEMA)).select(COLUMNS)) == brute(data) == [(some, 0, None, 1, 0, 1, 0, hashlib.sha256(str(some).encode()).hexdigest())]
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="multiple of 100"):
        conversation_trie(spark.createDataFrame(data, SCHEMA), width=250)


def test_texts_of_nodes(spark):
    data = [(100, 0, "user", "hello", None, None, None), (100, 1, None, None, None, None, None), (200, 0, "user", "hello", None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.depth, r.conv_id): (r.role, r.text, r.n_convs) for r in with_texts(conversation_trie(df), df).collect()}
    assert got == {(0, 100): (None, None, 2), (1, 100): ("user", "hello", 2), (2, 100): ("", "", 1)}
