"""Near-duplicate detection: b-bit MinHash, banded candidates, exact confirmation.

1. Each text gets the set of its word shingles, ``k`` minima of it, the low ``BITS`` bits
   of every minimum packed into words, and one key for each band of ``rows`` minima.
2. Documents with equal sets are one class; only classes go on.
3. Classes that share a band key are candidates.  A bucket is cut into chunks of bounded
   rows and bytes and pairs of chunks are compared: mismatching low bits are counted on the
   packed words, and the collision-corrected similarity discards pairs that are clearly apart.
4. The remaining candidates are confirmed on their full shingle sets.  A block gives only
   the links of a spanning forest, never all pairs of a group of copies.
5. Connected components of the links give the groups.

Steps 3 to 5 run twice.  The first pass takes a few bands and compares the chunks of a large
bucket with themselves and with one member only, which joins most of a large group at a cost
that grows with its size.  The second pass takes the other bands, and the large buckets of
the first again; members that have the label most common in their bucket meet only those with
other labels, so what is compared in full is what isn't known to be joined.

The number of bands follows from the threshold: a pair at the threshold shares a band
with probability 1 - MISS at least.  The estimate discards at SIGMAS standard deviations
below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .components import connected_components
from .store import arrow_rows, map_batches, save, sized

BITS = 4
MISS = 1e-8
SIGMAS = 6.0
#: Classes, and bytes of their full sets, in a chunk on average.
CHUNK = 512
CHUNK_BYTES = 4 << 20
EARLY_BANDS = 6
#: Rows of an Arrow batch where rows are wide, and bytes of rows for a task.
BATCH_ROWS = 500
TASK_BYTES = 64 << 20


@dataclass(frozen=True)
class NearDup:
    """words: shingle length; a link needs 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    rows: int = 5

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def minima(self) -> int:
        return -(-self.bands * self.rows // 16) * 16  # whole 64-bit words of 4-bit values

    @property
    def most_mismatches(self) -> int:
        """Mismatching low-bit fields beyond which the corrected estimate is too low."""
        c = 2.0**-BITS
        p = c + (1 - c) * self.percent / 100
        return math.floor(self.minima * (1 - p) + SIGMAS * math.sqrt(self.minima * p * (1 - p))) + 1


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    for lo, hi, data, at in tk.slices(column):
        start, end, row = tk.words(data, at)
        pos, hashes = tk.windows(tk.word_hashes(data, start, end), row, hi - lo, words, short=True)
        cut = np.searchsorted(row[pos], np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield np.unique(hashes[cut[i] : cut[i + 1]])


def minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k minima (uint32) of each of the sets, none of which is empty."""
    rng = np.random.Generator(np.random.PCG64(7))
    factor = rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, k, dtype=np.uint32)
    flat = np.concatenate(sets)
    x = (flat >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), k), np.uint32)
    for j in range(k):
        out[:, j] = np.minimum.reduceat(x * factor[j] + add[j], first)
    return out


def pack(mins: np.ndarray) -> np.ndarray:
    """The low 4 bits of 16 minima in each 64-bit word."""
    low = (mins & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(mins), -1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def mismatches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fields that differ between packed signatures, by bit counts (broadcasting)."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1)


def band_keys(mins: np.ndarray, p: NearDup) -> np.ndarray:
    """One int64 key for each band."""
    out = np.zeros((len(mins), p.bands), np.uint64)
    for r in range(p.rows):
        out = tk.mix((out ^ mins[:, r : p.bands * p.rows : p.rows].astype(np.uint64)) + tk.WORD_BASES[r])
    return out.view(np.int64)


SIGNED = "doc_id long, n_shingles long, set_key binary, sig binary, bands binary"


def _sign(p: NearDup, id_col: str, text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column(id_col), []
            done = 0

            def flush(sets: list[np.ndarray], done: int) -> pa.RecordBatch:
                full = [s for s in sets if len(s)]
                sig, keys = iter(()), iter(())
                if full:
                    mins = minima(full, p.minima)
                    sig, keys = iter(pack(mins)), iter(band_keys(mins, p))
                cols = [[], [], []]
                for s in sets:
                    cols[0].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    cols[1].append(next(sig).tobytes() if len(s) else None)
                    cols[2].append(next(keys).tobytes() if len(s) else None)
                return pa.RecordBatch.from_arrays(
                    [ids.slice(done, len(sets)).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, pa.binary()) for c in cols)],
                    names=["doc_id", "n_shingles", "set_key", "sig", "bands"],
                )

            size = 0
            for s in shingle_sets(batch.column(text_col), p.words):
                held.append(s)
                size += len(s)
                if size > 60_000:
                    yield flush(held, done)
                    done, held, size = done + len(held), [], 0
            if held:
                yield flush(held, done)

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by their first ``keys`` columns."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        change = np.zeros(t.num_rows - 1, bool)
        for i in range(keys):
            v = t.column(i).to_numpy()
            change |= v[1:] != v[:-1]
        cut = np.flatnonzero(change)
        if len(cut):
            yield t.slice(0, int(cut[-1]) + 1)
            rest = t.slice(int(cut[-1]) + 1)
        else:
            rest = t
    if rest is not None and rest.num_rows:
        yield rest


def _bounds(t: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(max(0, t.num_rows - 1), bool)
    for i in range(keys):
        v = t.column(i).to_numpy()
        change |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])


def _fixed(col: pa.ChunkedArray, dtype) -> np.ndarray:
    """A matrix from a binary column whose values all have one length."""
    values = col.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32 if pa.types.is_binary(values.type) else np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(len(values), -1).view(dtype)


def _candidates(p: NearDup, band: int, ci: int, cj: int, chunk: np.ndarray, label: np.ndarray, sig: np.ndarray, keys: np.ndarray):
    """Pairs of a block that are new in this band, in different groups, and similar enough."""
    a = np.flatnonzero(chunk == ci)
    b = a if ci == cj else np.flatnonzero(chunk == cj)
    if not len(a) or not len(b):
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    ok = label[a][:, None] != label[b][None, :]
    if ci == cj:
        ok &= np.tri(len(a), k=-1, dtype=bool)
    for j in range(band):
        ok &= keys[a, j][:, None] != keys[b, j][None, :]
    x, y = np.nonzero(ok)
    if not len(x):
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    x, y = a[x], b[y]
    miss = np.concatenate([mismatches(sig[x[i : i + 65536]], sig[y[i : i + 65536]]) for i in range(0, len(x), 65536)])
    near = miss <= p.most_mismatches
    return np.stack([x[near], y[near]], 1), miss[near]


KEYS = ["band", "key", "ci", "cj"]


def _select(p: NearDup) -> Callable:
    """The members of each block that take part in a candidate pair."""

    def run(batches):
        for t in _groups(batches, 4):
            cut = _bounds(t, 4)
            band, ci, cj, chunk, label = (t.column(c).to_numpy() for c in ("band", "ci", "cj", "chunk", "label"))
            sig, keys = _fixed(t.column("sig"), np.uint64), _fixed(t.column("bands"), np.int64)
            keep = np.zeros(t.num_rows, bool)
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s > 1:
                    pairs, _ = _candidates(p, band[s], ci[s], cj[s], chunk[s:e], label[s:e], sig[s:e], keys[s:e])
                    keep[s:e][pairs.ravel()] = True
            yield from t.filter(pa.array(keep)).to_batches()

    return run


def _confirm(p: NearDup) -> Callable:
    """The links of each block on full sets: those that join what wasn't joined before."""

    def run(batches):
        for t in _groups(batches, 4):
            cut = _bounds(t, 4)
            band, ci, cj, chunk, label, rep = (t.column(c).to_numpy() for c in ("band", "ci", "cj", "chunk", "label", "rep"))
            sig, keys = _fixed(t.column("sig"), np.uint64), _fixed(t.column("bands"), np.int64)
            sets = t.column("shingles")
            a_out, b_out = [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s < 2:
                    continue
                pairs, miss = _candidates(p, band[s], ci[s], cj[s], chunk[s:e], label[s:e], sig[s:e], keys[s:e])
                full: dict[int, np.ndarray] = {}
                group = {int(x): int(x) for x in np.unique(label[s:e])}

                def root(x: int, group=group) -> int:
                    while group[x] != x:
                        x = group[x] = group[group[x]]
                    return x

                for i in np.argsort(miss, kind="stable"):
                    x, y = int(pairs[i, 0]) + s, int(pairs[i, 1]) + s
                    rx, ry = root(int(label[x])), root(int(label[y]))
                    if rx == ry:
                        continue
                    for z in (x, y):
                        if z not in full:
                            full[z] = np.frombuffer(sets[int(z)].as_py(), np.uint64)
                    if linked(full[x], full[y], p.percent):
                        group[max(rx, ry)] = min(rx, ry)
                        a_out.append(int(rep[x]))
                        b_out.append(int(rep[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on two sorted sets of hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _sets(words: int) -> Callable:
    def run(batches):
        for batch in batches:
            ids, done, held, size = batch.column("rep"), 0, [], 0

            def flush(held, done):
                return pa.RecordBatch.from_arrays([ids.slice(done, len(held)), pa.array(held, pa.binary())], names=["rep", "shingles"])

            for s in shingle_sets(batch.column("text"), words):
                held.append(s.tobytes())
                size += len(held[-1])
                if size > 1 << 22:
                    yield flush(held, done)
                    done, held, size = done + len(held), [], 0
            if held:
                yield flush(held, done)

    return run


def _parts(spark, size: int) -> int:
    """Partitions for so many bytes of rows."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def _members(node: DataFrame, lo: int, hi: int) -> DataFrame:
    """(rep, label, bytes, band, key) of each class and band from lo to hi - 1."""
    bands = F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("band")
    key = F.xxhash64(F.expr("substring(bands, band * 8 + 1, 8)")).alias("key")
    return node.select("rep", "label", "bytes", bands, "bands").select("rep", "label", "bytes", "band", key)


def _blocks(member: DataFrame, early: bool) -> tuple[DataFrame, DataFrame, int]:
    """(band, key, ci, cj, chunk, rep, label) for each pair of chunks that a member takes part in;
    (band, key) of the buckets of several chunks; and their number."""
    keys = ["band", "key"]

    def chunks(n, size):
        return F.greatest(F.ceil(F.col(n) / CHUNK), F.ceil(F.col(size) / CHUNK_BYTES), F.lit(1)).cast("int")

    hot = member.groupBy(keys).agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
    member = save(member.join(hot.select(*keys, chunks("n", "size").alias("chunks")).hint("merge"), keys), "members")
    names = [*keys, "ci", "cj", "chunk", "rep", "label"]
    zero = F.lit(0)
    whole = member.where("chunks = 1").select(*keys, zero.alias("ci"), zero.alias("cj"), zero.alias("chunk"), "rep", "label")
    inside = member.where("chunks > 1")
    counts = inside.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    major = F.max(F.struct("n", "label", "size"))
    large = counts.groupBy(keys).agg(major.alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    large = large.select(*keys, F.col("top.label").alias("major"), F.col("top.n").alias("n1"), F.col("top.size").alias("s1"), (F.col("n") - F.col("top.n")).alias("n2"), (F.col("size") - F.col("top.size")).alias("s2"))
    large = save(large.select(*keys, "major", chunks("n1", "s1").alias("c1"), chunks("n2", "s2").alias("c2")), "large")
    n_large = large.count()
    if not n_large:
        return whole, large.select(keys), 0
    spread = F.xxhash64("rep")
    inside = inside.join(sized(large, n_large), keys).withColumn("is_major", F.col("label") == F.col("major"))
    inside = inside.withColumn("chunk", F.when(F.col("is_major"), F.pmod(spread, F.col("c1"))).otherwise(F.col("c1") + F.pmod(spread, F.col("c2"))).cast("int"))
    last = F.col("c1") + F.col("c2") - 1
    if early:  # all labels differ: the major one is of one member, in chunk 0
        others = F.when(F.col("is_major"), F.sequence("c1", last)).otherwise(F.array(zero, "chunk"))
    else:
        others = F.when(F.col("is_major"), F.sequence("c1", last)).otherwise(F.sequence(zero, last))
    inside = inside.withColumn("other", F.explode(others))
    inside = inside.select(*keys, F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunk", "rep", "label")
    return save(whole.unionByName(inside).select(names), "blocks"), large.select(keys), n_large


def near_duplicates(docs: DataFrame, p: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  A text of fewer words than a
    shingle has its whole sequence as its only shingle.  Null, empty and blank texts have no
    shingles and are linked with nothing.  Rows with one id and several texts are one node:
    the links of each of its texts are its own.  A row without an id has a null component
    and isn't kept, and no link goes through it.  Ties: the least id stands for a group.
    Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = save(map_batches(src, _sign(p, "doc_id", "text"), SIGNED), "signed")
    named = signed.where("doc_id is not null and set_key is not null")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), (F.first("n_shingles") * 8).alias("bytes"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = save(classes, "classes")

    # ids that stand in several rows; those of several classes link these classes
    repeated = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("n > 1")
    repeated = save(repeated, "repeated")
    repeats = repeated.count() > 0
    edges = spark.createDataFrame([], "a long, b long")
    if repeats:
        several = named.join(repeated.where("lo <> hi").select("doc_id").hint("merge"), "doc_id")
        several = several.join(classes.select("set_key", "rep").hint("merge"), "set_key")
        edges = save(several.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b"), "links")

    labels = large = None
    for early in (True, False):
        node = classes.select("set_key", "rep", "bytes", "bands")
        if labels is None:
            node = node.withColumn("label", F.col("rep"))
        else:
            node = node.join(labels.select(F.col("node").alias("rep"), F.col("component").alias("label")).hint("merge"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        if early:
            member = _members(node, 0, min(EARLY_BANDS, p.bands))
        else:
            member = _members(node, EARLY_BANDS, p.bands) if p.bands > EARLY_BANDS else None
            if n_large:
                again = _members(node, 0, min(EARLY_BANDS, p.bands)).join(sized(large, n_large), ["band", "key"], "left_semi")
                member = again if member is None else member.unionByName(again)
            if member is None:
                break
        block, large, n_large = _blocks(member, early)
        wide = block.join(classes.select("rep", "sig", "bands").hint("merge"), "rep")
        columns = "band int, key long, ci int, cj int, chunk int, rep long, label long, sig binary, bands binary"
        names = [c.split()[0] for c in columns.split(", ")]
        n = block.count()
        width = 64 + p.minima // 2 + 8 * p.bands
        with arrow_rows(spark, 4 * BATCH_ROWS):
            needed = save(map_batches(wide.select(names).repartition(_parts(spark, n * width), *KEYS).sortWithinPartitions(*KEYS), _select(p), columns), "needed")
        n_needed = needed.count()
        if not n_needed:
            continue
        reps = save(needed.select("rep").distinct(), "reps")
        texts = src.join(sized(reps.withColumnRenamed("rep", "doc_id"), reps.count()), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")
        sets = map_batches(texts, _sets(p.words), "rep long, shingles binary")
        if repeats:  # the id of a class may have other rows
            sets = _of_class(sets, classes.select("rep", "set_key")).dropDuplicates(["rep"])
        with arrow_rows(spark, BATCH_ROWS):
            sets = save(sets, "sets")
            size = sets.agg(F.avg(F.octet_length("shingles"))).first()[0] or 0
            wide = needed.join(sets.hint("merge"), "rep").select(*names, "shingles")
            wide = wide.repartition(_parts(spark, int(n_needed * (size + width))), *KEYS).sortWithinPartitions(*KEYS)
            links = map_batches(wide, _confirm(p), "a long, b long")
            edges = save(edges.union(links).distinct(), "links")
        labels = save(connected_components(edges), "labels")

    if labels is None:
        labels = save(connected_components(edges), "labels")
    final = classes.select("set_key", "rep").join(labels.hint("merge"), classes.rep == labels.node, "left")
    final = final.select("set_key", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(final.hint("merge"), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _of_class(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets whose key is that of the class which the id stands for."""

    def key(batches):
        for b in batches:
            keys = [xxhash.xxh3_128_digest(x.as_py()) for x in b.column("shingles")]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("shingles"), pa.array(keys, pa.binary())], names=["rep", "shingles", "set_key"])

    keyed = map_batches(sets, key, "rep long, shingles binary, set_key binary")
    return keyed.join(ids.hint("merge"), ["rep", "set_key"], "left_semi").select("rep", "shingles")



def keep_one(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """The rows of ``docs`` with one document of each group; columns stay.

    Rows without an id belong to no group and stay.  Of rows with one id the first by text
    stays.
    """
    found = save(near_duplicates(docs, p).select("doc_id", "kept"), "kept")
    gone = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    out = docs.join(sized(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
    again = found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.limit(1).count():
        return out
    order = Window.partitionBy("doc_id").orderBy("text")
    # rows without an id take no part in the ranking, so they aren't gathered
    packed = out.where("doc_id is not null").select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = packed.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select("row.*").union(out.where("doc_id is null"))
