"""Running columns through an ordered key (a book, a clip) that may be larger than a task.

The rows of a key are cut into ranges of their order column.  Each range is one task's work; a
small table of one row a range says what it passes on, is accumulated over the ranges of the
key, and is met by equality on (key, range), by which the rows are partitioned already.  No
window has all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a range, in units of the order column.
RANGE = 65_536
AT = "_range"


def in_ranges(rows: DataFrame, order: str, width: int = RANGE) -> DataFrame:
    return rows.withColumn(AT, F.floor(F.col(order) / width).cast("long"))


def scan(
    rows: DataFrame, key: str, order: list[str], *, sums: dict[str, Column] | None = None, latest: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, width: int = RANGE,
) -> DataFrame:
    """``rows`` with further columns, each computed in the order of ``order`` through its key.

    ``sums``: the total of a column up to and with the row, 0 before any value.  ``latest``: the
    last value that isn't null at or above the row.  ``before`` and ``after``: the value in the row
    above or below, null at the ends of a key.  ``order`` must tell the rows of a key apart; its
    first column is a number, of which at most ``width`` values fall into one range.  Rows
    without a key or without a place in the order are left out.
    """
    sums, latest, before, after = sums or {}, latest or {}, before or {}, after or {}
    kept = rows.columns
    given = {f"_{kind}_{name}": c for kind, part in (("s", sums), ("l", latest), ("b", before), ("a", after)) for name, c in part.items()}
    tagged = in_ranges(rows, order[0], width).where(F.col(key).isNotNull() & F.col(AT).isNotNull()).select(*kept, AT, *[c.alias(n) for n, c in given.items()])
    place = F.struct(*order)

    # what each range passes on, and that accumulated over the ranges of a key
    own = [F.coalesce(F.sum(f"_s_{n}"), F.lit(0)).alias(f"_s_{n}") for n in sums]
    own += [F.max(F.when(F.col(f"_l_{n}").isNotNull(), F.struct(place.alias("p"), F.col(f"_l_{n}").alias("v"))))["v"].alias(f"_l_{n}") for n in latest]
    own += [F.max_by(F.struct(F.col(f"_b_{n}").alias("v")), place).alias(f"_b_{n}") for n in before]
    own += [F.min_by(F.struct(F.col(f"_a_{n}").alias("v")), place).alias(f"_a_{n}") for n in after]
    ranges = Window.partitionBy(key).orderBy(AT)
    above = ranges.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"_s_{n}").over(above), F.lit(0)).alias(f"_cs_{n}") for n in sums]
    carried += [F.last(f"_l_{n}", ignorenulls=True).over(above).alias(f"_cl_{n}") for n in latest]
    carried += [F.lag(f"_b_{n}").over(ranges)["v"].alias(f"_cb_{n}") for n in before]
    carried += [F.lead(f"_a_{n}").over(ranges)["v"].alias(f"_ca_{n}") for n in after]
    passed = tagged.groupBy(key, AT).agg(*own).select(key, AT, *carried)

    inside = Window.partitionBy(key, AT).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_s_{n}": F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)) for n in sums}
    local |= {f"_l_{n}": F.last(f"_l_{n}", ignorenulls=True).over(upto) for n in latest}
    local |= {f"_b_{n}": F.lag(F.struct(F.col(f"_b_{n}").alias("v"))).over(inside) for n in before}
    local |= {f"_a_{n}": F.lead(F.struct(F.col(f"_a_{n}").alias("v"))).over(inside) for n in after}
    both = tagged.select(*kept, AT, *[c.alias(n) for n, c in local.items()]).join(passed.hint("merge"), [key, AT])
    found = [(F.col(f"_s_{n}") + F.col(f"_cs_{n}")).alias(n) for n in sums]
    found += [F.coalesce(f"_l_{n}", f"_cl_{n}").alias(n) for n in latest]
    found += [F.when(F.col(f"_b_{n}").isNull(), F.col(f"_cb_{n}")).otherwise(F.col(f"_b_{n}")["v"]).alias(n) for n in before]
    found += [F.when(F.col(f"_a_{n}").isNull(), F.col(f"_ca_{n}")).otherwise(F.col(f"_a_{n}")["v"]).alias(n) for n in after]
    return both.select(*[c for c in kept if c not in {*sums, *latest, *before, *after}], *found)


def number(rows: DataFrame, key: str, order: list[str], name: str, which: Column | None = None, width: int = RANGE) -> DataFrame:
    """``rows`` with their place among those of their key, from 0; with ``which``, among the rows for which it holds."""
    one = F.lit(1) if which is None else F.coalesce(which, F.lit(False)).cast("int")
    return scan(rows, key, order, sums={name: one}, width=width).withColumn(name, (F.col(name) - 1).cast("long"))


def with_neighbours(rows: DataFrame, order: str, reach: int, width: int = RANGE) -> DataFrame:
    """``rows`` in ranges, those near a border repeated in the range beside it, for windows of values within ``reach``.

    Adds ``_range`` and ``_own``, which is true in a row's own range only.  ``reach`` is at most ``width``.
    """
    if reach > width:
        raise ValueError("a window may reach into the next range, not beyond")
    at = F.col(order)
    near = F.array_distinct(F.array(*[F.floor((at + d) / width).cast("long") for d in (0, -reach, reach)]))
    spread = rows.withColumn(AT, F.explode(near))
    return spread.withColumn("_own", F.col(AT) == F.floor(at / width))
