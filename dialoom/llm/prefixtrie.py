"""The trie of conversation prefixes, from sorted conversations and their common prefixes.

Conversations are sequences of turn codes (128 bits of role and text, and the text's bytes).
They are sorted through the cluster into parts of bounded size; equal and neighbouring ones are
next to each other.  In a part, a sparse table over the common prefix lengths of neighbours
answers range minima, and each prefix finds the first and the last conversation that share it by
a binary search to the left and one to the right, each on its own.  Nodes that begin in no other
part are final there.  Only prefixes of a part's first and last conversation can reach into
another part; they are few, are known by a hash of their turns and are added up over parts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import map_batches, save

#: Turns that a part holds about; a longer conversation is a part of its own.
PART_TURNS = 200_000
#: Ids that are joined to one piece of text before it is hashed.
ID_PIECE = 1_024
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
TURN = "array<struct<a:bigint,b:bigint,n:bigint>>"

#: Kinds of rows that a part gives: finished nodes, nodes that other parts may share, ids that end in those.
CLOSED, OPEN, ENDS = 0, 1, 2
PIECES = (
    "kind int, part int, branch int, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, parent_branch int, parent_depth long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, n_bytes long, ends_sha256 string, piece long, ids string"
)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the codes of a conversation's turns in order of ``turn``, null first.

    Null roles and texts count as empty; equal turn numbers are ordered by their codes, so the
    order of the input doesn't matter.  Rows without a conv_id are left out.  A turn takes 24 bytes.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.struct(F.col("turn").cast("long").alias("t"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.octet_length(text).cast("long").alias("n"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), code.alias("c"))
    inside = F.transform(F.array_sort(F.collect_list("c")), lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), c["n"].alias("n")))
    return rows.groupBy("conv_id").agg(inside.alias("turns"))


def rebuilt(sequences: DataFrame, group: int = 5, most_head: int = 9) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % group in place of its own.

    h is crc32(decimal c) % most_head.  Of the other conversation only most_head - 1 turns travel.
    """
    heads = sequences.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most_head - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_head).cast("int")
    own = sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h)
    joined = own.join(heads.hint("merge"), "base", "left")
    head = F.coalesce(F.when(F.col("h") > 0, F.slice("head", 1, F.greatest("h", F.lit(1)))), F.array().cast(TURN))
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


class SparseTable:
    """Minima of all ranges of an array: level j holds the minima of 2**j entries from each place."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values, np.int64)]
        while 2 ** len(self.levels) <= len(values):
            half = self.levels[-1]
            step = 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(half[:-step], half[step:]))

    def minimum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of the ranges [lo, hi), none of them empty."""
        j = np.log2(np.maximum(hi - lo, 1)).astype(np.int64)
        out = np.empty(len(lo), np.int64)
        for level in np.unique(j):
            m = j == level
            t = self.levels[level]
            out[m] = np.minimum(t[lo[m]], t[hi[m] - 2**level])
        return out

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last place r with all entries (at, r] at least ``depth``, by halving steps."""
        at = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            t = self.levels[j]
            can = at + 1 + 2**j <= len(self.levels[0])
            can[can] = t[at[can] + 1] >= depth[can]
            at[can] += 2**j
        return at

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place l with all entries (l, at] at least ``depth``."""
        at = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            t = self.levels[j]
            can = at + 1 - 2**j >= 0
            can[can] = t[at[can] + 1 - 2**j] >= depth[can]
            at[can] -= 2**j
        return at


def common_prefixes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each sequence codes[at[i] : at[i + 1]] the length of its common prefix with the one before; -1 for the first."""
    size = np.diff(at)
    out = np.full(len(size), -1, np.int64)
    if len(size) < 2:
        return out
    short = np.minimum(size[1:], size[:-1])
    total = int(short.sum())
    stop = np.cumsum(short)
    inner = np.arange(total) - np.repeat(stop - short, short)
    same = (codes[np.repeat(at[1:-1], short) + inner] == codes[np.repeat(at[:-2], short) + inner]).all(1)
    differs = np.where(same, np.iinfo(np.int64).max, inner)
    least = np.full(len(short), np.iinfo(np.int64).max)
    full = np.flatnonzero(short)
    if len(full):
        least[full] = np.minimum.reduceat(differs, (stop - short)[full])
    out[1:] = np.minimum(least, short)
    return out


def _prefix_keys(codes: np.ndarray) -> list[bytes]:
    """A hash of each prefix of a sequence, the empty one first."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for row in np.ascontiguousarray(codes):
        h.update(row.tobytes())
        out.append(h.copy().digest())
    return out


def part_nodes(part: int, ids: np.ndarray, codes: np.ndarray, n_bytes: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """All that one part knows: ids and codes are sorted by sequence, then id.

    Nodes are numbered by the conversation that they first occur in and by depth; so a subtree is
    a range of numbers, and its sums are differences of running sums.
    """
    m, size = len(ids), np.diff(at)
    lcp = common_prefixes(codes, at)
    table, least_id = SparseTable(lcp), SparseTable(ids)
    new = size - lcp  # nodes that occur first at each conversation: depths lcp + 1 .. size
    stop = np.cumsum(new)
    node_at = np.repeat(np.arange(m), new)
    depth = np.arange(int(stop[-1])) - np.repeat(stop - new, new) + np.repeat(lcp + 1, new)
    first, last = table.left(node_at, depth), table.right(node_at, depth)
    n_convs = last - first + 1
    conv_id = least_id.minimum(first, last + 1)
    # a node's parent: the prefix one turn shorter, looked up where that first occurs
    parent_at = table.left(node_at, depth - 1)
    parent = np.where(depth > 0, stop[parent_at] - size[parent_at] + depth - 2, -1)
    n_children = np.bincount(parent[1:], minlength=len(depth)) if len(depth) > 1 else np.zeros(len(depth), np.int64)
    # conversations that end in a node stand first in its interval
    ending = np.zeros(len(depth), np.int64)
    own_end = stop[table.left(np.arange(m), size)] - 1
    np.add.at(ending, own_end, 1)
    last_bytes = np.zeros(len(depth), np.int64)
    turn = at[node_at] + depth - 1
    last_bytes[depth > 0] = n_bytes[turn[depth > 0]]

    is_open = (node_at == 0) | (last == m - 1)
    leaf = (n_children == 0) & ~is_open
    saved = np.where(is_open, 0, (n_convs - 1) * last_bytes)
    end_of = stop[last]  # one past the last node of the subtree
    below = lambda v: (lambda c: c[end_of] - c[np.arange(len(v))])(np.concatenate([[0], np.cumsum(v)]))
    n_leaves, saved_tokens = below(leaf.astype(np.int64)), below(saved)

    # open nodes: prefixes of both the first and the last conversation (0), of the first (1), of the last (2)
    branch = np.where(node_at == 0, np.where(last == m - 1, 0, 1), 2)
    first_keys, last_keys = _prefix_keys(codes[at[0] : at[1]]), _prefix_keys(codes[at[m - 1] : at[m]])
    closed_children = np.bincount(parent[1:][~is_open[1:]], minlength=len(depth)) if len(depth) > 1 else n_children

    rows: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
    texts = np.array([str(i) for i in ids.tolist()], object)

    def add(kind: int, where: np.ndarray, **values) -> None:
        given = {"kind": np.full(len(where), kind), "part": np.full(len(where), part), **values}
        for name, column in rows.items():
            column.extend(given[name] if name in given else [None] * len(where))

    closed = np.flatnonzero(~is_open)
    below_open = is_open[parent[closed]]
    names = [hashlib.sha256(",".join(texts[f : f + e]).encode()).hexdigest() if e else EMPTY_SHA for f, e in zip(first[closed].tolist(), ending[closed].tolist(), strict=True)]
    up = parent[closed]
    either = lambda v, keep: [x if k else None for x, k in zip(v.tolist(), keep.tolist(), strict=True)]
    add(
        CLOSED, closed, depth=depth[closed].tolist(), conv_id=conv_id[closed].tolist(), parent_conv_id=either(conv_id[up], ~below_open), parent_branch=either(branch[up], below_open),
        parent_depth=either(depth[up], below_open), n_convs=n_convs[closed].tolist(), n_children=n_children[closed].tolist(), n_leaves=n_leaves[closed].tolist(),
        saved_tokens=saved_tokens[closed].tolist(), ends_sha256=names,
    )
    opened = np.flatnonzero(is_open)
    keys = [(first_keys if node_at[i] == 0 else last_keys)[depth[i]] for i in opened]
    parents = [(first_keys if node_at[i] == 0 else last_keys)[depth[i] - 1] if depth[i] else None for i in opened]
    add(
        OPEN, opened, branch=branch[opened].tolist(), depth=depth[opened].tolist(), key=keys, parent_key=parents, conv_id=conv_id[opened].tolist(), n_convs=n_convs[opened].tolist(),
        n_children=closed_children[opened].tolist(), n_leaves=n_leaves[opened].tolist(), saved_tokens=saved_tokens[opened].tolist(), n_bytes=last_bytes[opened].tolist(),
    )
    for i, key in zip(opened.tolist(), keys, strict=True):
        f, e = int(first[i]), int(ending[i])
        cuts = np.arange(f, f + e, ID_PIECE)
        add(ENDS, cuts, key=[key] * len(cuts), piece=(cuts - f).tolist(), ids=[",".join(texts[c : min(c + ID_PIECE, f + e)]) for c in cuts.tolist()])
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(rows[c.split()[0]], kinds[c.split()[1]]) for c in PIECES.split(", ")], names=[c.split()[0] for c in PIECES.split(", ")])


def _run_parts(batches):
    """Rows (part, conv_id, turns) come sorted by part, sequence and id; a part is handled when it is whole."""
    held: dict[str, list] = {}
    current = None

    def finish():
        sizes = np.concatenate(held["sizes"])
        codes = np.concatenate(held["codes"])
        return part_nodes(current, np.concatenate(held["ids"]), codes[:, :2], codes[:, 2], np.concatenate([[0], np.cumsum(sizes)]))

    for batch in batches:
        parts = batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            if current is not None and parts[lo] != current:
                yield finish()
                held = {}
            current = int(parts[lo])
            some = batch.slice(lo, hi - lo)
            turns = some.column("turns")
            flat = turns.flatten()
            held.setdefault("ids", []).append(some.column("conv_id").to_numpy())
            held.setdefault("sizes", []).append(np.diff(turns.offsets.to_numpy()).astype(np.int64))
            held.setdefault("codes", []).append(np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)], 1).reshape(-1, 3))
    if held:
        yield finish()


def _stream_sha(batches):
    """(key, ends_sha256) of pieces that come sorted by key and place; one running hash is held."""
    key, h = None, None
    for batch in batches:
        keys, shas = [], []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k == key:
                h.update(b"," + ids.encode())
                continue
            if key is not None:
                keys.append(key)
                shas.append(h.hexdigest())
            key, h = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def _order(turns: Column) -> Column:
    """What sequences are sorted by: their codes without the sizes of texts."""
    return F.transform(turns, lambda c: F.struct(c["a"], c["b"]))


def prefix_nodes(sequences: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row for each distinct prefix of the ``turns`` of sequences (conv_id, turns), conv_id distinct.

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.  The root, of depth 0, has all sequences as members,
    empty ones too; an empty table has no node.  Equal sequences may be any share of the rows, as
    they are sorted by id among themselves and so fall into several parts; a sequence's codes
    are one cell.
    """
    spark = sequences.sparkSession
    seqs = save(sequences, "turn-sequences")
    total = seqs.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_turns))
    ordered = seqs.repartitionByRange(parts, _order(F.col("turns")), "conv_id").withColumn("part", F.spark_partition_id())
    ordered = ordered.sortWithinPartitions("part", _order(F.col("turns")), "conv_id")
    pieces = save(map_batches(ordered.select("part", "conv_id", "turns"), _run_parts, PIECES), "trie-parts")

    opened = pieces.where(F.col("kind") == OPEN).select("part", "branch", "depth", "key", "parent_key", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_bytes")
    # the same prefix in several parts becomes one node; the least part owns it
    merged = opened.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("n_bytes").alias("n_bytes"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.min("part").alias("owner"), F.sum("n_children").alias("closed_children"),
    )
    merged = save(merged, "open-nodes")
    children = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("open_children"))
    nodes = merged.join(children.hint("merge"), "key", "left").withColumn("n_children", F.col("closed_children") + F.coalesce("open_children", F.lit(0))).drop("closed_children", "open_children")
    up = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nodes = save(nodes.join(up.hint("merge"), "parent_key", "left"), "open-nodes")

    # an open node adds itself to its ancestors in the part that owns it: those are the nodes above it there
    whole = nodes.select("key", "owner", F.col("conv_id").alias("least"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own_saved"))
    here = opened.select("part", "branch", "depth", "key", "n_leaves", "saved_tokens").join(whole.hint("merge"), "key")
    mine = F.col("part") == F.col("owner")
    here = here.withColumn("leaf", F.when(mine, F.col("leaf")).otherwise(0)).withColumn("own_saved", F.when(mine, F.col("own_saved")).otherwise(0))
    deeper = Window.partitionBy("part", "branch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    beside = Window.partitionBy("part")

    def under(c: str) -> Column:
        forks = F.sum(F.when(F.col("branch") > 0, F.col(c)).otherwise(0)).over(beside)
        return F.sum(c).over(deeper) + F.when(F.col("branch") == 0, forks).otherwise(0)

    sums = here.select("part", "branch", "depth", "key", "least", (F.col("n_leaves") + under("leaf")).alias("n_leaves"), (F.col("saved_tokens") + under("own_saved")).alias("saved_tokens"))
    sums = save(sums, "open-sums")
    totals = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = pieces.where(F.col("kind") == ENDS).select("key", "part", "piece", "ids").repartition("key").sortWithinPartitions("key", "part", "piece")
    shas = map_batches(ends.select("key", "ids"), _stream_sha, "key binary, ends_sha256 string")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = nodes.join(totals.hint("merge"), "key").join(shas.hint("merge"), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))

    closed = pieces.where(F.col("kind") == CLOSED).select("part", "parent_branch", "parent_depth", *columns)
    inner = closed.where("parent_depth is null").select(columns)
    above = sums.select("part", F.col("branch").alias("parent_branch"), F.col("depth").alias("parent_depth"), "least")
    outer = closed.where("parent_depth is not null").drop("parent_conv_id").join(above.hint("merge"), ["part", "parent_branch", "parent_depth"]).withColumnRenamed("least", "parent_conv_id")
    return shared.select(columns).union(inner).union(outer.select(columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text).

    See ``turn_sequences``, ``rebuilt`` and ``prefix_nodes`` for nulls, ties, repeated rows (each is
    a turn) and empty tables.  Texts only travel as codes, however long; other columns are ignored.
    """
    return prefix_nodes(rebuilt(turn_sequences(conversations)))
