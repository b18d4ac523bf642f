"""Removal of repeated byte strings by distributed refinement of q-gram buckets, named by content.

A suffix array over all bytes of a corpus would shuffle each position several times.
Here the buckets are refined only where a repeat is still possible:

1. Initial q-gram buckets.  Of each ``length``-byte window the least q-gram (by hash) is
   picked; consecutive windows that pick the same one form a *run*.  Equal windows pick the
   same q-gram at the same offset, so a window can repeat only inside the bucket of its
   q-gram, and buckets of one position are dropped.
2. Refinement by later offsets.  The bucket of a run is refined by the identifier of the
   whole span that its windows cover.  Runs whose refined bucket has two members or more
   are repeated as a whole and are settled, one of them standing for all below.
3. The runs left over are cut at fixed offsets from their q-gram into shorter ones, whose
   buckets are refined by the bytes that all their windows share: single buckets are dropped,
   whole spans that repeat are settled, and the same step is applied to what is left with
   ever shorter runs (``WIDTHS``), at last single windows.

Counting is always aggregated before the shuffle, written and joined back, so Spark can split
the rows of a passage that a third of all documents share.  A bucket is named by a hash of its
bytes where the textbook form has a pointer into a sorted array, and a refinement groups by the
names of longer spans instead of sorting by pointers at later offsets: pointers for all byte
positions would have to be shuffled in each round, which the disk budget rules out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import map_batches, save

LENGTH = 200
GRAM = 32
#: Windows in a run at each step of refinement; each width divides the one before, so cuts nest.
WIDTHS = (52, 13, 1)
#: Ids by which texts are picked ahead of their shuffle are broadcast up to this number.
MOST_IDS = 4_000_000


def pieces(column: pa.Array, overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset in it, bytes, offsets): slices of rows, long texts in overlapping parts."""
    for lo, _hi, data, at in tk.slices(column):
        if len(data) <= 2 * tk.SLICE_BYTES:
            yield lo, 0, data, at
            continue
        for s in range(0, max(1, len(data) - overlap), tk.SLICE_BYTES):
            part = data[s : s + tk.SLICE_BYTES + overlap]
            yield lo, s, part, np.array([0, len(part)], np.int64)


def runs(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, q-gram hash, first window, last window, pick) of each run of windows with one pick."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none, none
    prefix = tk.prefix_hash(data)
    pos = np.arange(len(data) - gram + 1)
    h = tk.span_hash(prefix, pos, pos + gram)
    key = (h & ~np.uint64(0xFFFFFF)) | pos.astype(np.uint64)  # ties: the leftmost
    width = length - gram + 1
    least, size = key, 1
    while 2 * size <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(key) - width + 1], least[width - size : width - size + len(key) - width + 1])
    pick = (least[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
    start = np.arange(n)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    valid = start + length <= at[text + 1]
    new = valid.copy()
    new[1:] &= (pick[1:] != pick[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    first = np.flatnonzero(new)
    return text[first], h[pick[first]], first, np.flatnonzero(last), pick[first]


#: shape: windows behind the first (times 256) and bytes from the last window to the q-gram.
RUNS = "id long, tag int, gram long, core long, span long, lo int, shape int"


def _rows(batch, who, gram, core, span, lo, shape) -> pa.RecordBatch:
    who = pa.array(who)
    cols = [batch.column("id").take(who), batch.column("tag").take(who), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (gram, core, span))]
    return pa.RecordBatch.from_arrays([*cols, pa.array(lo.astype(np.int32)), pa.array(shape.astype(np.int32))], names=[c.split()[0] for c in RUNS.split(", ")])


def whole_runs(column: pa.Array, length: int, gram: int) -> Iterator[tuple]:
    """(first row, offset in it, bytes, offsets, ``runs``) of slices of rows.

    A run that straddles the cut of a long text is given once, as a whole: cut in two it
    would count as two places.
    """
    done = -1
    # a run has fewer than ``length`` windows, so the overlap holds the whole of each that starts before the cut
    for (row, shift, data, at), after in pairwise(chain(pieces(column, 2 * length), [None])):
        found = runs(data, at, length, gram)
        goes_on = after is not None and after[1] > 0
        if shift or goes_on:
            lo, hi = found[2] + shift, found[3] + shift
            keep = lo > (done if shift else -1)
            if goes_on:
                keep &= lo < after[1]
            done = int(hi[keep].max(initial=done if shift else -1))
            found = tuple(x[keep] for x in found)
        yield row, shift, data, at, found


def _runs(length: int, gram: int) -> Callable:
    def run(batches):
        for batch in batches:
            for row, shift, data, at, (text, h, lo, hi, pick) in whole_runs(batch.column("text"), length, gram):
                if not len(text):
                    continue
                raw = memoryview(np.ascontiguousarray(data))
                digest = xxhash.xxh3_64_intdigest
                span = np.fromiter((digest(raw[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)), np.uint64, len(lo))
                yield _rows(batch, text + row, h, np.zeros(len(lo), np.int64), span, lo - at[text] + shift, (hi - lo) << 8 | (pick - hi))

    return run


def shorter(text: np.ndarray, base: int, size: int, lo: np.ndarray, hi: np.ndarray, pick: np.ndarray, width: int, length: int):
    """Cut runs at multiples of ``width`` from their picks.

    ``text`` holds the bytes from ``base`` on of a text of ``size`` bytes.  Gives (run, first
    and last window, bucket of the shared bytes, identifier of the whole span).
    """
    first, last = (pick - hi) // width, (pick - lo) // width
    n = last - first + 1
    run = np.repeat(np.arange(len(lo)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)
    at = pick[run]
    near, far = at - k * width, at - k * width - (width - 1)
    prefix = tk.prefix_hash(text)
    core = tk.mix(tk.span_hash(prefix, near - base, far + length - base) + k.astype(np.uint64))
    s, e = np.maximum(far, 0), np.minimum(near + length, size)
    span = tk.mix(tk.span_hash(prefix, s - base, e - base) ^ tk.mix((near - s).astype(np.uint64) << np.uint64(32) | (e - near).astype(np.uint64)))
    return run, np.maximum(lo[run], far), np.minimum(hi[run], near), core, span


def _shorter(width: int, length: int) -> Callable:
    def run(batches):
        for batch in batches:
            raw, at = tk.buffers(batch.column("text"))
            spans = batch.column("spans")
            first = spans.offsets.to_numpy() - spans.offsets[0].as_py() if len(spans) else np.zeros(1, int)
            flat = spans.flatten()
            los, shapes, grams = (flat.field(k).to_numpy().astype(np.int64) for k in ("lo", "shape", "gram"))
            his = los + (shapes >> 8)
            picks = his + (shapes & 255)
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            held = 0
            for i in range(batch.num_rows):
                text = raw[at[i] : at[i + 1]]
                todo = np.arange(first[i], first[i + 1])
                for s in range(0, len(text), tk.SLICE_BYTES):
                    now = todo[(los[todo] >= s) & (los[todo] < s + tk.SLICE_BYTES)]
                    if not len(now):
                        continue
                    base = max(0, s - length)
                    part = text[base : s + tk.SLICE_BYTES + 3 * length]
                    r, lo, hi, core, span = shorter(part, base, len(text), los[now], his[now], picks[now], width, length)
                    for o, v in zip(out, (np.full(len(r), i), grams[now][r], core, span, lo, (hi - lo) << 8 | (picks[now][r] - hi)), strict=True):
                        o.append(v)
                    held += len(r)
                if held > 100_000:
                    yield _rows(batch, *(np.concatenate(o) for o in out))
                    out, held = [[] for _ in range(6)], 0
            if held:
                yield _rows(batch, *(np.concatenate(o) for o in out))

    return run


def removed_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _refine(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame | None]:
    """(id, tag, s, e) of the runs that are settled, and one run of each bucket that is open."""
    one = F.min(F.struct("id", "tag", "lo", "shape")).alias("one")
    refined = save(rows.groupBy("gram", "core", "span").agg(F.count("*").alias("n"), one), "refined")
    whole = refined.where("n > 1").select("gram", "core", "span")
    settled = rows.join(whole.hint("merge"), ["gram", "core", "span"])
    settled = settled.select("id", "tag", F.col("lo").alias("s"), (F.col("lo") + F.shiftright("shape", 8) + length).alias("e"))
    mixed = refined.groupBy("gram", "core").agg(F.count("*").alias("spans"), F.min("n").alias("least")).where("spans > 1 and least = 1")
    left = refined.join(save(mixed.select("gram", "core"), "mixed").hint("merge"), ["gram", "core"]).select("one.*", "gram")
    return settled, left


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the keys (_id, _tag), and (_id, _tag, spans) of the texts with repeats.

    The spans (start, end) of a text cover each byte of it that lies in a ``length``-byte
    string which starts anywhere else too, in another text or at another place of its own.
    """
    own = F.xxhash64(F.lit("text"), F.col("text"))
    # ids know their rows, unless one is null or stands in several rows
    n, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    tag = F.lit(0) if n == ids else F.hash(F.col("text").cast("string"))
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long") if n == ids else F.coalesce(F.col("doc_id").cast("long"), own)).withColumn("_tag", tag)
    src = keyed.where(F.octet_length("text") >= length).select(F.col("_id").alias("id"), F.col("_tag").alias("tag"), F.col("text").cast("string").alias("text"))

    everywhere = save(map_batches(src, _runs(length, gram), RUNS), "runs")
    # written first: a join with a plain table lets Spark split the partition of a hot q-gram
    often = save(everywhere.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    rows = save(everywhere.join(often.hint("merge"), "gram").select([c.split()[0] for c in RUNS.split(", ")]), "buckets")
    spans, left = _refine(rows, length)
    for width in WIDTHS:
        left = left if n == ids else left.distinct()
        opened = save(left.groupBy("id", "tag").agg(F.collect_list(F.struct("lo", "shape", "gram")).alias("spans")), "open")
        n_texts = opened.count()
        if not n_texts:
            break
        texts = _picked(src, opened, n_texts).join(opened.hint("merge"), ["id", "tag"]).select("id", "tag", "text", "spans")
        rows = save(map_batches(texts, _shorter(width, length), RUNS), "shorter")
        settled, left = _refine(rows, length)
        spans = spans.union(settled)
    if n != ids:
        spans = spans.distinct()  # equal rows have the same spans, and each gets them once
    spans = spans.groupBy("id", "tag").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return keyed, save(spans.select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), "spans"), "spans")


def _picked(src: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows of ``src`` whose id is one of the ``n`` in ``keys``, so that other texts aren't shuffled."""
    return src.join(F.broadcast(keys.select("id").distinct()), "id", "left_semi") if n <= MOST_IDS else src


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(text: np.ndarray, found: list | None) -> tuple[bytes, int]:
    """The remaining bytes of a text, and the number of its maximal removed runs."""
    out = removed_runs([(x["s"], x["e"]) for x in found]) if found else []
    edges = [0, *(x for pair in out for x in pair), len(text)]
    return b"".join(text[s:e].tobytes() for s, e in zip(edges[::2], edges[1::2], strict=True)), len(out)


def _digest(batches):
    for batch in batches:
        raw, at = tk.buffers(batch.column("text"))
        cols: list[list] = [[], [], [], []]
        for i, found in enumerate(batch.column("spans").to_pylist()):
            kept, n = _kept(raw[at[i] : at[i + 1]], found)
            size = int(at[i + 1] - at[i])
            for c, v in zip(cols, (size, size - len(kept), n, hashlib.sha256(kept).hexdigest()), strict=True):
                c.append(v)
        done = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *done], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(keyed: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with repeats and their spans, and the other rows."""
    n = spans.count()
    if n > MOST_IDS:
        wide = keyed.join(spans.hint("merge"), ["_id", "_tag"], "left")
        return wide.where("spans is not null"), wide.where("spans is null").drop("spans")
    ids = F.broadcast(spans.select(F.col("_id").alias("_i"), F.col("_tag").alias("_t")))
    same = (F.col("_id") == F.col("_i")) & (F.col("_tag").eqNullSafe(F.col("_t")))
    some = keyed.join(ids, same, "left_semi").join(spans.hint("merge"), ["_id", "_tag"])
    return some, keyed.join(ids, same, "left_anti")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs``.

    A null text counts as empty.  Texts shorter than ``length`` bytes lose nothing.  Rows that
    are equal in id and text are both removed as far as they reach.  A null id is allowed: its
    row is known by its text.  Other columns are not read.
    """
    some, rest = _with_spans(*repeated_spans(docs.select("doc_id", F.col("text").cast("string").alias("text")), length, gram))
    kind, none = dict(docs.dtypes)["doc_id"], F.lit(0).cast("long")
    text = F.coalesce("text", F.lit(""))
    whole = rest.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    return map_batches(some.select("doc_id", "text", "spans"), _digest, f"doc_id {kind}, {DIGEST}").union(whole)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``; a character that is cut in part goes.

    Columns and rows stay, whatever their names; ``n_chars``, where there is one, follows the
    text; texts without repeats, null ones included, stay as they are.
    """
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))

    def cut(batches):
        for batch in batches:
            raw, at = tk.buffers(batch.column("text"))
            cols = dict(zip(names, batch.column("row").flatten(), strict=True))
            text, chars = cols["text"].to_pylist(), cols["n_chars"].to_pylist() if "n_chars" in cols else None
            for i, found in enumerate(batch.column("spans").to_pylist()):
                if found:
                    text[i] = _kept(raw[at[i] : at[i + 1]], found)[0].decode("utf-8", "ignore")
                    if chars:
                        chars[i] = len(text[i])
            cols["text"] = pa.array(text, cols["text"].type)
            if chars:
                cols["n_chars"] = pa.array(chars, cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    some, rest = _with_spans(*repeated_spans(packed, length, gram))
    return map_batches(some.select("text", "row", "spans"), cut, docs.schema).union(rest.select("row.*"))
