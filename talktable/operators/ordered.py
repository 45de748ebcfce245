"""Running values over the ordered rows of a key, without putting a huge key into one task.

A plain ``Window.partitionBy(call)`` sends all rows of a call to one task and reads its input once. That is
right for keys of up to ``KEY_ROWS`` rows. ``cut_keys`` counts the rows of each key first; those of larger keys are cut into
consecutive blocks at sampled bounds, so that a block has at most ``KEY_ROWS`` rows wherever they lie. Values are computed inside the
blocks in parallel, one summary row per block is carried from block to block, and the carried value is joined
back on (key, block), which is how the rows are partitioned already. Rows with more equal positions
than that stay together. A block may also be given as a column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

BLOCK_ROWS = 4096
#: rows of a key, or of a block of a larger key, that one task takes
KEY_ROWS = 1_000_000

_BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` says which rows count, ``expr`` what is taken from them."""

    kind: str
    expr: Column
    offset: int = 1


def before(expr: Column) -> Running:
    """Last non-null value among strictly earlier rows."""
    return Running("before", expr)


def after(expr: Column) -> Running:
    """First non-null value among strictly later rows."""
    return Running("after", expr)


def previous(expr: Column, offset: int = 1) -> Running:
    """Value ``offset`` (1 or 2) rows earlier, null values included."""
    return Running("previous", expr, offset)


def following(expr: Column, offset: int = 1) -> Running:
    """Value ``offset`` (1 or 2) rows later, null values included."""
    return Running("following", expr, offset)


def running_sum(expr: Column) -> Running:
    """Sum up to and including the current row."""
    return Running("sum", expr)


def sum_before(expr: Column) -> Running:
    """Sum over strictly earlier rows, 0 for the first."""
    return Running("sum_before", expr)


def max_before(expr: Column) -> Running:
    """Maximum over strictly earlier rows, null for the first."""
    return Running("max_before", expr)


def key_sum(expr: Column) -> Running:
    return Running("key_sum", expr)


def key_max(expr: Column) -> Running:
    return Running("key_max", expr)


def key_min(expr: Column) -> Running:
    return Running("key_min", expr)


def row_block(index: str, rows: int = BLOCK_ROWS) -> Column:
    """Block of a dense row index: at most ``rows`` rows each."""
    return F.floor(F.col(index) / F.lit(float(rows))).cast("bigint")


@dataclass(frozen=True)
class Cut:
    """Blocks of the keys that are too large for one task: their ``position`` between the bounds of ``hot``, null without any."""

    position: Column
    hot: DataFrame | None


def cut_keys(df: DataFrame, keys: list[str], position: str | Column) -> Cut:
    """Count the rows of each key and choose bounds of ``position``, a number, for keys of more than ``KEY_ROWS``.

    The bounds are percentiles of a sketch, twice as many as blocks are needed, so that its error stays inside a block's limit.
    """
    position = F.col(position) if isinstance(position, str) else position
    rows = df.select(*keys, position.cast("double").alias("__position"))
    large = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > KEY_ROWS)
    largest = large.agg(F.max("__n")).first()[0]
    if largest is None:
        return Cut(position, None)
    parts = -(-2 * largest // KEY_ROWS)
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    large = materialize(large)
    of_large = rows.join(large.select(*[F.col(k).alias(f"__{k}") for k in keys]), _equal(keys), "left_semi")
    bounds = of_large.groupBy(*keys).agg(F.percentile_approx("__position", shares, max(10_000, 20 * parts)).alias("__bounds"))
    return Cut(position, materialize(bounds))


def _equal(keys: list[str]) -> Column:
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__{key}"))
    return same


def _columns(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def scan(
    df: DataFrame,
    keys: list[str],
    order: list,
    values: dict[str, Running],
    block: Column | Cut | None,
) -> DataFrame:
    """Add one column per entry of ``values``.

    ``order`` must be ascending columns that order a key completely, and ``block`` must never
    decrease along that order: a column, the cut of the keys by their first order column, or None for plain windows.
    """
    order = _columns(order)
    if isinstance(block, Cut) and block.hot is not None:
        return _scan_cut(df, keys, order, values, block)
    if block is None or isinstance(block, Cut):
        return _scan_whole(df, keys, order, values)
    return _scan_blocks(df, keys, order, values, block)


def _scan_cut(df, keys, order, values, cut):
    """Plain windows for ordinary keys, blocks for the others."""
    hot = cut.hot.select(*[F.col(k).alias(f"__{k}") for k in keys], "__bounds")
    cold = _scan_whole(df.join(hot, _equal(keys), "left_anti"), keys, order, values)
    rows = df.join(hot, _equal(keys)).withColumn(
        "__at", F.size(F.filter("__bounds", lambda b: b < cut.position.cast("double")))
    ).drop("__bounds", *[f"__{k}" for k in keys])
    blocks = _scan_blocks(rows, keys, order, values, F.col("__at")).drop("__at")
    return cold.unionByName(blocks.select(*cold.columns))


def _windows(keys: list[str], order: list[Column]):
    ahead = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return ahead, back


def _inside(run: Running, ahead, back, everything) -> Column:
    """The value as far as the rows of one window partition determine it."""
    earlier = ahead.rowsBetween(Window.unboundedPreceding, -1)
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    e = run.expr
    if run.kind == "before":
        return F.last(e, ignorenulls=True).over(earlier)
    if run.kind == "after":
        return F.last(e, ignorenulls=True).over(later)
    if run.kind == "previous":
        return F.lag(F.struct(e.alias("v")), run.offset).over(ahead)
    if run.kind == "following":
        return F.lag(F.struct(e.alias("v")), run.offset).over(back)
    if run.kind == "sum":
        return F.sum(e).over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    if run.kind == "sum_before":
        return F.coalesce(F.sum(e).over(earlier), F.lit(0))
    if run.kind == "max_before":
        return F.max(e).over(earlier)
    if run.kind == "key_sum":
        return F.sum(e).over(everything)
    if run.kind == "key_max":
        return F.max(e).over(everything)
    if run.kind == "key_min":
        return F.min(e).over(everything)
    raise ValueError(run.kind)


def _scan_whole(df, keys, order, values):
    ahead, back = _windows(keys, order)
    everything = Window.partitionBy(*keys)
    out = df
    for name, run in values.items():
        out = out.withColumn(name, _inside(run, ahead, back, everything))
        if run.kind in ("previous", "following"):
            out = out.withColumn(name, F.col(name)["v"])
    return out


def _scan_blocks(df, keys, order, values, block):
    rows = df.withColumn(_BLOCK, block)
    parts = keys + [_BLOCK]
    position = F.struct(*order)
    ahead, back = _windows(parts, order)
    block_ahead = Window.partitionBy(*keys).orderBy(_BLOCK)
    block_back = Window.partitionBy(*keys).orderBy(F.col(_BLOCK).desc())
    earlier = block_ahead.rowsBetween(Window.unboundedPreceding, -1)
    later = block_back.rowsBetween(Window.unboundedPreceding, -1)
    whole_key = Window.partitionBy(*keys)

    source, summary, carry = rows, [], []

    def second(run, tag):
        """The row next to the block's last (or first) one, for offsets of two."""
        window = ahead if run.kind == "previous" else back
        return F.lag(F.struct(run.expr.alias("v")), 1).over(window).alias(tag)

    extra = [
        second(run, f"__second_{name}")
        for name, run in values.items()
        if run.kind in ("previous", "following") and run.offset == 2
    ]
    if extra:
        source = rows.select("*", *extra)

    for name, run in values.items():
        e, tag = run.expr, f"__carry_{name}"
        if run.kind in ("before", "after"):
            pick = F.max_by if run.kind == "before" else F.min_by
            summary.append(pick(e, F.when(e.isNotNull(), position)).alias(tag))
            over = earlier if run.kind == "before" else later
            carry.append(F.last(tag, ignorenulls=True).over(over).alias(tag))
        elif run.kind in ("previous", "following"):
            pick = F.max_by if run.kind == "previous" else F.min_by
            over = block_ahead if run.kind == "previous" else block_back
            summary.append(pick(F.struct(e.alias("v")), position).alias(tag))
            carry.append(F.lag(tag, 1).over(over).alias(tag))
            if run.offset == 2:
                inner = f"__second_{name}"
                summary.append(pick(F.col(inner), position).alias(inner))
                carry.append(
                    F.coalesce(F.lag(inner, 1).over(over), F.lag(tag, 2).over(over)).alias(inner)
                )
        elif run.kind in ("sum", "sum_before"):
            summary.append(F.sum(e).alias(tag))
            carry.append(F.sum(tag).over(earlier).alias(tag))
        elif run.kind == "max_before":
            summary.append(F.max(e).alias(tag))
            carry.append(F.max(tag).over(earlier).alias(tag))
        else:
            agg = {"key_sum": F.sum, "key_max": F.max, "key_min": F.min}[run.kind]
            summary.append(agg(e).alias(tag))
            carry.append(agg(tag).over(whole_key).alias(tag))

    carried = source.groupBy(*parts).agg(*summary).select(*parts, *carry)

    inside, nth = {}, []
    for name, run in values.items():
        if not run.kind.startswith("key_"):
            inside[name] = _inside(run, ahead, back, None)
        if run.kind in ("previous", "following") and run.offset == 2:
            window = ahead if run.kind == "previous" else back
            nth.append(F.row_number().over(window).alias(f"__nth_{name}"))
    local = rows.select("*", *[c.alias(f"__in_{n}") for n, c in inside.items()], *nth)
    both = local.join(carried, parts, "left")

    final = []
    for name, run in values.items():
        here, there = F.col(f"__in_{name}"), F.col(f"__carry_{name}")
        if run.kind in ("before", "after"):
            value = F.coalesce(here, there)
        elif run.kind in ("previous", "following"):
            if run.offset == 2:
                first_row = F.col(f"__nth_{name}") == 1
                there = F.when(first_row, F.col(f"__second_{name}")).otherwise(there)
            value = F.coalesce(here, there)["v"]
        elif run.kind in ("sum", "sum_before"):
            value = F.coalesce(there, F.lit(0)) + here if run.kind == "sum_before" else (
                F.when(here.isNull(), there).otherwise(here + F.coalesce(there, F.lit(0)))
            )
        elif run.kind == "max_before":
            value = F.greatest(here, there)
        else:
            value = there
        final.append(value.alias(name))
    kept = [c for c in df.columns if c not in values]
    return both.select(*kept, *final)


def number_rows(df: DataFrame, keys: list[str], order: list, block: Column | Cut | None,
                name: str = "idx") -> DataFrame:
    """Dense 0-based position of every row within its key."""
    return scan(df, keys, order, {name: sum_before(F.lit(1).cast("bigint"))}, block)
