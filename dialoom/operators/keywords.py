"""Keywords from a table, found through the grams of their bytes, and tool calls answered as a table.

A keyword of up to 8 bytes is one gram; a longer one is known by that of its 8-byte grams that lines have
least.  Tasks look the grams of their lines up in a small table of those of all keywords, from which a line gets
the list of its keywords; without room for these, grams become rows that meet the keywords by equality.  What is
found is verified.  Searches shuffle a line once, with its list, not once for each keyword.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..sources.shared import new_folder
from .context import read_range, render_range
from .scan import AT, RANGE

Q = 8
#: Keywords up to which their table is broadcast, at some 50 bytes each.
BROADCAST_KEYWORDS = 1_000_000
#: Different grams that tasks know exactly, at 8 bytes each; beyond it they know the slots alone, and what shares a slot is sorted out by the join.
EXACT_GRAMS = 2_000_000
#: Bytes of keywords that tasks know too.
KNOWN_BYTES = 1 << 25
#: Bits of a slot where grams are looked up first, and where they are counted.
LOOKED_UP, COUNTED = 22, 18
#: Bytes that are looked at at once.
STEP = 1 << 16
#: Hits of a range of lines that a task holds before it drops those beyond the limit.
HELD_HITS = 1 << 20
_ODD, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a column of texts begin, with the end of the last, and their bytes."""
    c = column.cast(pa.large_binary())
    _, at, data = c.buffers()
    offsets = np.frombuffer(at, np.int64)[c.offset : c.offset + len(c) + 1] if at else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _grams(offsets: np.ndarray, data: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, int]]:
    """(start, grams, q): a gram for each place from ``start`` on, a block at a time, those that reach over values included."""
    end = int(offsets[-1])
    for lo in range(int(offsets[0]), end, STEP):
        piece = data[lo : min(lo + STEP + Q - 1, end)].astype(np.uint64)
        key = piece
        for q in range(1, max(lengths, default=0) + 1):
            if q > 1:
                key = (key[:-1] << np.uint64(8)) | piece[q - 1 :]
            if not len(key):
                break
            if q in lengths:
                yield lo, key[:STEP] * _ODD + np.uint64(q) * _SALT, q


def _inside(offsets: np.ndarray, at: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The value that each place lies in, and whether the q bytes from there on do."""
    row = np.searchsorted(offsets, at, "right") - 1
    return row, at + q <= offsets[row + 1]


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def _lists(rows: np.ndarray, grams: np.ndarray, n: int, exact: np.ndarray | None = None, words: pa.Array | None = None) -> pa.Array:
    """For each of n values the different grams found in it, or the keywords that are known by these."""
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    rows, grams = rows[new], grams[new]
    values = pa.array(grams.view(np.int64))
    if words is not None:
        lo = np.searchsorted(exact, grams)
        sizes = np.searchsorted(exact, grams, "right") - lo
        rows = np.repeat(rows, sizes)
        values = words.take(pa.array(np.arange(len(rows)) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)))
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


Known = tuple[np.ndarray, np.ndarray | None, pa.Array | None]


def _with_grams(df: DataFrame, text: str, lengths: list[int], known: Known | None) -> DataFrame:
    """``df`` with ``grams``, those of its texts; with ``known``, slots, grams and keywords, only such as are known, or their keywords."""
    shared = None if known is None else df.sparkSession.sparkContext.broadcast(known)
    names, place = df.columns, df.columns.index(text)
    value = S.LongType() if known is None or known[2] is None else S.StringType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, exact, words = (None, None, None) if shared is None else shared.value
        for batch in batches:
            offsets, data = _bytes(batch.column(place))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for lo, grams, q in _grams(offsets, data, lengths):
                at = np.arange(len(grams)) if slots is None else np.flatnonzero(slots[_slots(grams, LOOKED_UP)])
                if exact is not None and len(at):
                    near = np.minimum(np.searchsorted(exact, grams[at]), len(exact) - 1)
                    at = at[exact[near] == grams[at]]
                row, whole = _inside(offsets, at + lo, q)
                found.append((row[whole], grams[at[whole]]))
            both = [np.concatenate(x) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(*both, len(batch), exact, words)], names=[*names, "grams"])

    return df.mapInArrow(run, S.StructType([*df.schema.fields, S.StructField("grams", S.ArrayType(value))]))


def _counts(lines: DataFrame, text: str) -> DataFrame:
    """(slot, n): how often grams of Q bytes that share a slot stand in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNTED, np.int64)
        for batch in batches:
            for _, grams, _ in _grams(*_bytes(batch.column(0)), [Q]):
                np.add.at(n, _slots(grams, COUNTED), 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(some), "n": pa.array(n[some])})

    return lines.select(text).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def _known(rarest: DataFrame, words: bool) -> Known:
    """The slots of the grams of keywords, the grams if they are few enough, and then, with ``words``, the keyword of each."""
    slot = F.shiftrightunsigned("gram", 64 - LOOKED_UP)
    slots = np.zeros(1 << LOOKED_UP, bool)
    if rarest.select("gram").distinct().count() <= EXACT_GRAMS:
        t = (rarest.select("gram", "keyword") if words else rarest.select("gram").distinct()).toArrow()
        exact = t.column(0).to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(exact)
        slots[_slots(exact, LOOKED_UP)] = True
        return slots, exact[order], t.column(1).combine_chunks().take(pa.array(order)) if words else None
    slots[rarest.select(slot.cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()] = True  # at most as many as there are slots
    return slots, None, None


def find_keywords(lines: DataFrame, keywords: DataFrame, text: str = "line") -> DataFrame:
    """``lines`` with ``keyword``, a row for each keyword that stands in ``text``.

    ``keywords`` (keyword) hold for all lines; with a column book_id too, for the lines of their book.
    Null keywords are left out, repeated ones count once; an empty one stands in every line.  The
    keywords are written, and grams of keywords of more than 8 bytes counted, when this is called.
    """
    return _found(lines, keywords, text).select(*[F.col(c) for c in lines.columns], F.explode("keywords").alias("keyword"))


def _found(lines: DataFrame, keywords: DataFrame, text: str = "line") -> DataFrame:
    """As ``find_keywords``, with ``keywords``: all of a line in one row if tasks know them, else a row for each; some rows have none."""
    spark = lines.sparkSession
    by = [c for c in ("book_id",) if c in keywords.columns]
    folder = new_folder(spark, "keywords")
    keywords.where("keyword is not null").select(*by, "keyword").distinct().withColumn("q", F.least(F.octet_length("keyword"), F.lit(Q))).write.parquet(folder)
    known = spark.read.parquet(folder)
    sizes = known.groupBy("q").agg(F.count("*").alias("n"), F.sum(F.octet_length("keyword")).alias("bytes")).collect()
    lengths = {r.q: r.n for r in sizes}
    columns = [F.col(c) for c in lines.columns]
    if not lengths:
        return lines.select(*columns, F.array(F.lit("")).alias("keywords")).where(F.lit(False))
    few = sum(lengths.values()) <= BROADCAST_KEYWORDS
    sized = F.broadcast if few else (lambda df: df.hint("merge"))
    texts = lines.where(F.col(text).isNotNull())
    parts = [_with_grams(known.where(F.col("q") == q), "keyword", [q], None) for q in sorted(lengths) if 0 < q < Q]
    if Q in lengths:
        candidates = _with_grams(known.where(F.col("q") == Q), "keyword", [Q], None).select(*by, "keyword", F.explode("grams").alias("gram"))
        counts = F.broadcast(_counts(texts, text))  # at most as many rows as there are slots
        met = candidates.withColumn("slot", F.shiftrightunsigned("gram", 64 - COUNTED)).join(counts, "slot", "left")
        long = met.groupBy(*by, "keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    tables = [p.select(*by, "keyword", F.col("grams")[0].alias("gram")) for p in parts] + ([long] if Q in lengths else [])
    found = []
    if tables:
        rarest = tables[0]
        for more in tables[1:]:
            rarest = rarest.union(more)
        path = new_folder(spark, "grams")
        rarest.write.parquet(path)
        rarest = spark.read.parquet(path)
        looked_up = _known(rarest, few and not by and sum(r.bytes for r in sizes) <= KNOWN_BYTES)
        some = _with_grams(texts, text, sorted(q for q in lengths if q), looked_up)
        if looked_up[2] is not None:
            verified = F.filter("grams", lambda k: F.contains(F.col(text), k))
            if 0 in lengths:
                return some.select(*columns, F.concat(F.array(F.lit("")), verified).alias("keywords"))
            return some.where(F.size("grams") > 0).select(*columns, verified.alias("keywords"))
        met = some.withColumn("gram", F.explode("grams")).drop("grams").join(sized(rarest), [*by, "gram"])
        found.append(met.where(F.contains(F.col(text), F.col("keyword"))).select(*columns, "keyword"))
    if 0 in lengths:  # the empty one
        every = known.where("q = 0").select(*by, "keyword")
        found.append((texts.join(sized(every), by) if by else texts.crossJoin(F.broadcast(every))).select(*columns, "keyword"))
    rows = found[0] if len(found) == 1 else found[0].union(found[1])
    return rows.select(*columns, F.array("keyword").alias("keywords"))


def search_table(lines: DataFrame, keywords: DataFrame, limit: int = 20, preview: int = 120, also: str | None = None, width: int = RANGE) -> DataFrame:
    """``context.keyword_search`` for a table of keywords: (keyword, book_id, line_no, line, total, truncated)."""
    first = _first_hits(_hits(lines, keywords, preview, also), lines, limit, width)
    return first.select("keyword", "book_id", "line_no", F.col("shown").alias("line"), "total", (F.col("total") > limit).alias("truncated"))


def _first_hits(hits: DataFrame, lines: DataFrame, limit: int, width: int) -> DataFrame:
    """The first ``limit`` hits of each keyword in each book, with ``total``, how many there are.

    Lines are dealt by ranges of ``width`` line numbers, where hits are counted.  Of books of more than one
    range, which are looked for when this is called, the first hits of each range and its counts are met again.
    """
    spark = lines.sparkSession
    place = F.coalesce(F.floor(F.col("line_no") / width), F.lit(-1)).cast("long").alias(AT)
    folder = new_folder(spark, "long")
    spans = lines.select("book_id", place).groupBy("book_id").agg(F.min(AT).alias("lo"), F.max(AT).alias("hi"))
    spans.where("lo < hi").select(F.col("book_id").alias("_long")).write.parquet(folder)
    long = F.broadcast(spark.read.parquet(folder))  # at most one row a range

    dealt = hits.select("book_id", place, "line_no", "shown", "keywords").repartition("book_id", AT).sortWithinPartitions("book_id", AT, "line_no")
    ranked = _ranked(dealt, limit).select("book_id", "line_no", "shown", F.inline("hits"))
    columns = ["keyword", "book_id", "line_no", "shown", "total"]
    if long.isEmpty():
        return ranked.select(*columns)
    is_long = F.col("book_id").eqNullSafe(F.col("_long"))
    w = Window.partitionBy("keyword", "book_id")
    met = ranked.join(long, is_long, "left_semi").withColumn("total", F.sum(F.when(F.col("rn") == 1, F.col("total"))).over(w)).withColumn("rn", F.row_number().over(w.orderBy("line_no")))
    return ranked.join(long, is_long, "left_anti").select(*columns).union(met.where(F.col("rn") <= limit).select(*columns))


def _differs(rows: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row has other values than the one above it; the first one has."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in columns:
        above, own = rows.column(c).slice(0, max(rows.num_rows - 1, 0)), rows.column(c).slice(1)
        same = pc.or_(pc.fill_null(pc.equal(above, own), False), pc.and_(pc.is_null(above), pc.is_null(own)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def _ranked(dealt: DataFrame, limit: int) -> DataFrame:
    """(book_id, line_no, shown, hits) from lines with their keywords, sorted by book, range and line.

    ``hits`` (keyword, rn, total) has the place among the hits of a keyword in the range, up to ``limit``, and their number.
    """
    group = ["book_id", AT]
    hit = S.StructType([S.StructField("keyword", S.StringType()), S.StructField("rn", S.LongType()), S.StructField("total", S.LongType())])

    def places(t: pa.Table, dropped: tuple[pa.Array, np.ndarray] | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The keywords of all rows, the row, the place and the number of each; ``dropped`` ones are of the first group."""
        words = pc.list_flatten(t.column("keywords")).combine_chunks()
        row = np.repeat(np.arange(t.num_rows), pc.list_value_length(t.column("keywords")).to_numpy())
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        of = (np.cumsum(_differs(t, group)) - 1)[row]
        order = np.argsort(of * len(coded.dictionary) + code, kind="stable")
        key = (of * len(coded.dictionary) + code)[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        sizes = np.diff(np.append(starts, len(key)))
        rank, total = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        rank[order] = np.arange(len(key)) - np.repeat(starts, sizes)
        total[order] = np.repeat(sizes, sizes)
        if dropped is not None:
            found = pc.index_in(coded.dictionary, value_set=dropped[0])
            more = np.where(found.is_valid().to_numpy(zero_copy_only=False), dropped[1][found.fill_null(0).to_numpy()], 0)
            total += np.where(of == 0, more[code], 0)
        return words, row, rank, total

    def lists(t: pa.Table, row: np.ndarray, values: pa.Array) -> tuple[pa.Table, pa.ListArray]:
        """The rows that have values, and these."""
        n = np.bincount(row, minlength=t.num_rows)
        return t.filter(pa.array(n > 0)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[n > 0])]).astype(np.int32)), values)

    def first(t: pa.Table, dropped: tuple[pa.Array, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        words, row, rank, total = places(t, dropped)
        some = rank < limit
        hits = pa.StructArray.from_arrays([words.filter(pa.array(some)), pa.array(rank[some] + 1), pa.array(total[some])], names=hit.names)
        t, hits = lists(t.select(["book_id", "line_no", "shown"]), row[some], hits)
        yield from t.append_column("hits", hits).combine_chunks().to_batches()

    def fewer(t: pa.Table, dropped: tuple[pa.Array, np.ndarray] | None) -> tuple[pa.Table, tuple[pa.Array, np.ndarray]]:
        """One group without what is beyond the limit, and the numbers of what was dropped."""
        words, row, rank, total = places(t, dropped)
        some = rank < limit
        last = words.filter(pa.array(rank == 0))
        left = total[rank == 0] - np.bincount(pc.index_in(words.filter(pa.array(some)), value_set=last).to_numpy(), minlength=len(last))
        t, kept = lists(t, row[some], words.filter(pa.array(some)))
        return t.set_column(t.schema.get_field_index("keywords"), "keywords", kept), (last, left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, dropped, held, most = None, None, 0, HELD_HITS
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            cut = int(np.flatnonzero(_differs(t, group))[-1])
            if cut:
                yield from first(t.slice(0, cut), dropped)
                dropped, most = None, HELD_HITS
            rest = t.slice(cut)
            held = pc.sum(pc.list_value_length(rest.column("keywords"))).as_py()
            if held > most:
                rest, dropped = fewer(rest, dropped)
                most = max(HELD_HITS, 2 * pc.sum(pc.list_value_length(rest.column("keywords"))).as_py())
        if rest is not None:
            yield from first(rest, dropped)

    fields = {f.name: f for f in dealt.schema.fields}
    return dealt.mapInArrow(run, S.StructType([*(fields[c] for c in ("book_id", "line_no", "shown")), S.StructField("hits", S.ArrayType(hit))]))


def _hits(lines: DataFrame, keywords: DataFrame, preview: int, also: str | None) -> DataFrame:
    """(book_id, line_no, shown, keywords); with ``also``, stripped lines that hold that too are searched."""
    shown = T.strip(F.col("line"))
    rows = lines.select("book_id", "line_no", (shown if also else F.col("line")).alias("line"), T.preview(shown, preview).alias("shown"))
    rows = rows.where(F.contains("line", F.lit(also))) if also else rows
    return _found(rows, keywords).select("book_id", "line_no", "shown", "keywords")


def mention_table(lines: DataFrame, names: DataFrame, limit: int = 50) -> DataFrame:
    """``context.mention_dialogues`` for a table (keyword) of names."""
    return search_table(lines, names, limit, also="「")


def locate_table(dialogues: DataFrame, needles: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """``context.locate_text`` for a table (keyword) of needles: (needle, book_id, ord, speaker, text, is_hit)."""
    first = find_keywords(dialogues.select("book_id", "ord", "text"), needles, "text").groupBy(F.col("keyword").alias("needle"), "book_id").agg(F.min("ord").alias("hit"))
    near = first.withColumn("ord", F.explode(F.sequence(F.col("hit") - before, F.col("hit") + after)))
    rows = near.join(dialogues.select("book_id", "ord", "speaker", "text").hint("merge"), ["book_id", "ord"])
    return rows.select("needle", "book_id", "ord", "speaker", "text", (F.col("ord") == F.col("hit")).alias("is_hit"))


#: The tools of the two labelling tasks.
GENDER_TOOLS = ("search_novel", "read_lines", "get_dialogues")
EMOTION_TOOLS = ("search_novel", "read_lines")


def answer_calls(calls: DataFrame, lines: DataFrame, tools: tuple[str, ...] = GENDER_TOOLS) -> DataFrame:
    """(book_id, call_id, output): one row for each tool call (book_id, call_id, name, arguments).

    ``arguments`` is a JSON object; broken ones count as empty.  search_novel takes a keyword and a limit
    (20), get_dialogues a character_name and a limit (20), read_lines start_line (1) and end_line (100 behind
    the start); numbers that can't be read are the default, and a limit below 1 shows one line.
    A name that is not in ``tools`` has the text for unknown ones.  ``call_id`` is unique in a book.
    """
    args = T.decode_arguments(F.col("arguments"))
    number = lambda name: args[name].try_cast("bigint")
    name = F.coalesce("name", F.lit(""))
    known = name.isin(*tools)
    limit = F.greatest(F.coalesce(number("limit"), F.lit(20)), F.lit(1))
    start = F.coalesce(number("start_line"), F.lit(1).cast("bigint"))
    of = lambda tool: calls.where(known & (name == tool))
    outputs = [calls.where(~known).select("book_id", "call_id", F.concat(F.lit("Unknown tool: "), name).alias("output"))]

    search = of("search_novel").select("book_id", "call_id", F.coalesce(args["keyword"], F.lit("")).alias("keyword"), limit.alias("limit"))
    body, total = F.concat(F.lit(":\n"), "body"), F.coalesce("total", F.lit(0))
    some = F.when(F.col("total") > F.col("shown"), F.format_string(" (showing %d of %d)", "shown", "total")).otherwise("")
    found = F.concat(F.format_string("Found %d matches", total), some, F.coalesce(body, F.lit("\nNo matches found")))
    outputs.append(_listed(search, lines, None).select("book_id", "call_id", found.alias("output")))

    if "get_dialogues" in tools:
        asked = of("get_dialogues").select("book_id", "call_id", F.coalesce(args["character_name"], F.lit("")).alias("keyword"), limit.alias("limit"))
        spoken = F.coalesce(F.concat(F.format_string("Found %d dialogues:\n", "shown"), "body"), F.format_string("No dialogues found for '%s'", "keyword"))
        outputs.append(_listed(asked, lines, "「").select("book_id", "call_id", spoken.alias("output")))

    ranges = of("read_lines").select("book_id", "call_id", start.alias("start"), F.coalesce(number("end_line"), start + 100).alias("end"))
    texts = render_range(read_range(lines, ranges.select("book_id", "start", "end").distinct()))
    outputs.append(ranges.join(texts.hint("merge"), ["book_id", "start", "end"]).select("book_id", "call_id", "output"))
    out = outputs[0]
    for more in outputs[1:]:
        out = out.union(more)
    return out


def _listed(asked: DataFrame, lines: DataFrame, also: str | None) -> DataFrame:
    """``asked`` (book_id, call_id, keyword, limit) with the body of the lines shown, their number and the total.

    A keyword is searched once in a book, however many calls ask for it, up to the largest limit among them.
    """
    most = asked.groupBy("book_id", "keyword").agg(F.max("limit").alias("most"))
    hits = _hits(lines, most.select("book_id", "keyword"), 120, also).select(F.explode("keywords").alias("keyword"), "book_id", "line_no", "shown")
    totals = hits.groupBy("book_id", "keyword").agg(F.count("*").alias("total"))
    joined = hits.join(most.hint("merge"), ["book_id", "keyword"])
    # no more lines than the largest limit are kept of a keyword
    rows = F.array_sort(F.collect_list(F.struct("line_no", "shown")))
    first = first_n_by(joined, ["book_id", "keyword"], "line_no", "most").groupBy("book_id", "keyword").agg(rows.alias("rows"))
    out = asked.join(first.hint("merge"), ["book_id", "keyword"], "left").join(totals.hint("merge"), ["book_id", "keyword"], "left")
    shown = F.slice("rows", 1, F.col("limit").cast("int"))
    body = F.array_join(F.transform(shown, lambda x: F.format_string("Line %d: %s", x["line_no"], x["shown"])), "\n")
    return out.select("book_id", "call_id", "keyword", body.alias("body"), F.size(shown).cast("long").alias("shown"), "total")


def first_n_by(df: DataFrame, keys: list[str], order: str, n: str) -> DataFrame:
    """The first rows of each key, as many as its column ``n`` says."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rn", place).where(F.col("_rn") <= F.col(n)).drop("_rn")
