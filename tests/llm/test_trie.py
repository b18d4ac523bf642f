"""The trie of conversations against dictionaries of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from dialoom.llm import prefixtrie
from dialoom.llm.queries import OP11_SQL, op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, part string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
DATA = "/root/testdata/sf0.001"


def nodes_of(sequences):
    """Brute force over {conv_id: [(role, text), ...]}."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def rebuilt(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    return {c: own.get(c - c % 5, [])[:h] + v[h:] for c, v in own.items() for h in [zlib.crc32(str(c).encode()) % 9]}


def found(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect())


def awkward_rows():
    rng = np.random.default_rng(4)
    long = "wort " * 40_000
    rows = [(7, 0, None, None, 1, "x"), (7, None, "user", "first", 1, "x"), (None, 1, "user", "no id", 1, "x"), (11, 0, "a", "", None, None), (12, 3, "user", long, 1, "x"), (13, 3, "user", long, 1, "x")]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}", 0, "y") for c in range(20, 60) for t in range(6)]  # copies
    rows += [(100, 0, "user", "again", 0, "y")] * 7 + [(101, t, "user", "again", 0, "y") for t in range(9)]
    rows += [(c, t, "r", f"v{rng.integers(0, 3)}", 0, "z") for c in range(200, 330) for t in range(rng.integers(0, 12))]
    rows += [(500, t, "r", f"w{t % 3}", 0, "z") for t in range(700)] + [(501, t, "r", f"w{t % 3}", 0, "z") for t in range(650)]
    return rows


@pytest.mark.parametrize("part_turns", [1, 40, 100_000])
def test_trie_of_awkward_conversations(spark, part_turns, monkeypatch):
    monkeypatch.setattr(prefixtrie, "ID_PIECE", 3)
    rows = awkward_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = prefixtrie.prefix_nodes(prefixtrie.rebuilt(prefixtrie.turn_sequences(df)), part_turns)
    assert got.columns == COLUMNS
    assert found(got) == nodes_of(rebuilt(rows))


def test_one_large_group_of_copies_is_split(spark):
    """A third of all conversations are equal: they lie in many parts and still are one chain."""
    rows = [(c, t, "user", f"same{t}", 0, "") for c in range(1, 900, 5) for t in range(3)] + [(c, 0, "user", f"own{c}", 0, "") for c in range(2, 900, 5)]
    sequences = prefixtrie.turn_sequences(spark.createDataFrame(rows, SCHEMA))
    parts = sequences.repartitionByRange(16, prefixtrie._order(sequences.turns), "conv_id")
    copies = parts.rdd.mapPartitions(lambda it: [sum(len(r.turns) == 3 for r in it)]).collect()
    assert sum(copies) == 180 and max(copies) < 90
    by = defaultdict(list)
    for c, _, role, text, *_ in rows:
        by[c].append((role, text))
    assert found(prefixtrie.prefix_nodes(sequences, 20)) == nodes_of(by)


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.conversation_trie(df).collect() == []
    # a conversation that only borrows turns that aren't there has none, and ends in the root
    only = spark.createDataFrame([(c, 0, "user", "x", 0, "") for c in (1, 2, 3, 4)], SCHEMA)
    assert found(prefixtrie.conversation_trie(only)) == nodes_of(rebuilt([(c, 0, "user", "x") for c in (1, 2, 3, 4)]))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP11_SQL})").fetchall()
    assert found(op11_prefix_trie(spark, DATA)) == sorted(tuple(-1 if v is None else v for v in r) for r in want)


def test_searches_of_the_sparse_table():
    rng = np.random.default_rng(0)
    values = rng.integers(-1, 5, 70)
    t = prefixtrie.SparseTable(values)
    for at in range(70):
        for depth in range(-1, 6):
            right = at
            while right + 1 < 70 and values[right + 1] >= depth:
                right += 1
            left = at
            while left > 0 and values[left] >= depth:
                left -= 1
            assert t.right(np.array([at]), np.array([depth]))[0] == right
            # the first entry stands for what comes before all, and is never reached over
            if values[0] < depth or left > 0:
                assert t.left(np.array([at]), np.array([depth]))[0] == left
        for hi in range(at + 1, 71):
            assert t.minimum(np.array([at]), np.array([hi]))[0] == values[at:hi].min()


def test_common_prefixes():
    codes = [[1, 2, 3], [1, 2, 3], [1, 2], [], [4], [4, 5]]
    flat = np.array([[x, -x] for c in codes for x in c], np.int64)
    at = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
    assert prefixtrie.common_prefixes(flat, at).tolist() == [-1, 3, 2, 0, 0, 1]
