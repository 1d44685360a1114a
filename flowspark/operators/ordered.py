"""Ordered per-key work (previous values, running aggregates, positions) with one plan for keys of any size.

A key's rows are cut into chunks by its time: ``floor(order[0] / width)``. Chunks are a function of the row alone, so every
task and every retry sees the same ones. What a chunk adds to the state is one summary row, made with map-side combine;
what all earlier chunks of the key add up to is one carry row, from a window over the summaries. Carry rows join their
chunk as its first row, so one window over (key, chunk) gives results over the whole key: rows are shuffled once, and a task
sorts one chunk, not one key. The summaries of a key number its span of time over ``width``, whatever its rows.

Rows that are at most ``gap`` apart lie in one run. Chunks no wider than the gap hold no break inside, so runs follow from
the summaries alone (``runs``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Width of a chunk where ``order[0]`` counts microseconds: one minute.
WIDTH_US = 60_000_000
CHUNK, ROW = "_chunk", "_row"


def chunk_of(column: str | Column, width: float) -> Column:
    return F.floor((F.col(column) if isinstance(column, str) else column) / F.lit(width))


def earlier(keys: Sequence[str]):
    """All chunks of a key before this one."""
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows and the carry rows of their chunks, told apart by ``_row`` (0 for a carry row, which sorts first)."""
    return rows.withColumn(ROW, F.lit(1)).unionByName(carry.withColumn(ROW, F.lit(0)), allowMissingColumns=True)


class Ordered:
    """A DataFrame with a total order inside each key. Steps are collected; ``result`` makes one pass of all of them.

    Steps of one pass don't see each other's columns.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float = WIDTH_US):
        self.df, self.keys, self.order, self.width = df, list(keys), list(order), width
        self._values: dict[str, Column] = {}
        self._summaries: dict[str, Column] = {}
        self._carries: dict[str, Column] = {}
        self._outputs: dict[str, Column] = {}

    @property
    def parts(self) -> list[str]:
        return [*self.keys, CHUNK]

    def window(self):
        return Window.partitionBy(*self.parts).orderBy(ROW, *self.order)

    def _step(self, name: str, value: Column, summary, combine, output) -> None:
        """``output(value column)`` over the chunk's window, where a carry row holds the value of all rows before."""
        held = f"_v_{name}"
        self._values[held] = value
        self._summaries[held] = summary(F.col(held))
        self._carries[held] = combine(held).over(earlier(self.keys))
        self._outputs[name] = output(F.col(held))

    def prev(self, **cols: Column | str) -> Ordered:
        """Add the previous row's value of each expression (null on the first row)."""
        place = F.struct(*self.order)
        for name, c in cols.items():
            # wrapped, so that a null value isn't taken for no row
            value = F.struct((F.col(c) if isinstance(c, str) else c).alias("v"))
            self._step(name, value, lambda v: F.max_by(v, place), F.last, lambda v: F.lag(v).over(self.window())["v"])
        return self

    def running(self, inclusive: bool = True, **aggs: tuple[str, Column | str]) -> Ordered:
        """Add prefix sums or maxima: ``name=("sum" | "max", expression)``.

        ``inclusive=False`` leaves the current row out of its own prefix.
        """
        upto = self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        for name, (kind, c) in aggs.items():
            fn = {"sum": F.sum, "max": F.max}[kind]
            self._step(name, F.col(c) if isinstance(c, str) else c, fn, fn, lambda v, fn=fn: fn(v).over(upto))
        return self

    def number(self, name: str = "pos") -> Ordered:
        """Add the 0-based position inside the key."""
        upto = self.window().rowsBetween(Window.unboundedPreceding, 0)
        self._step(name, F.lit(1).cast("long"), F.sum, F.sum, lambda v: F.sum(v).over(upto) - 1)
        return self

    def result(self, source: DataFrame | None = None) -> DataFrame:
        """The rows with all columns asked for. ``source`` is a cheaper frame with the same keys, order and values, for the
        summaries."""
        rows = self.df.withColumn(CHUNK, chunk_of(self.order[0], self.width)).withColumns(self._values)
        brief = rows if source is None else source.withColumn(CHUNK, chunk_of(self.order[0], self.width)).withColumns(self._values)
        summary = brief.groupBy(*self.parts).agg(*[c.alias(n) for n, c in self._summaries.items()])
        carry = summary.select(*self.parts, *[c.alias(n) for n, c in self._carries.items()])
        done = with_carry(rows, carry).withColumns(self._outputs).filter(F.col(ROW) == 1)
        return done.drop(CHUNK, ROW, *self._values)


def run_width(gap: float | None, width: float | None) -> float:
    """The widest chunk that holds no break inside."""
    return max(min(w for w in (gap, width, float("inf")) if w is not None), 1) if gap is not None or width else WIDTH_US


def runs(df: DataFrame, keys: Sequence[str], at: str, gap: float | None, width: float | None = None, **extra: Column) -> DataFrame:
    """One row per (key, chunk): ``from_at``, ``to_at``, ``n``, ``extra`` aggregates, and

    - ``prev_at``: the last time of the chunks before (null for none),
    - ``is_new``: whether a run starts with this chunk's first row,
    - ``run_at``: the time at which its run started.

    A run goes on while each row is at most ``gap`` after the last (without a gap a key is one run). All of a chunk's rows
    belong to one run.
    """
    spans = df.withColumn(CHUNK, chunk_of(at, run_width(gap, width))).groupBy(*keys, CHUNK).agg(
        F.min(at).alias("from_at"), F.max(at).alias("to_at"), F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in extra.items()]
    )
    before = earlier(keys)
    upto = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("prev_at", F.last("to_at").over(before))
    apart = F.lit(False) if gap is None else F.col("from_at") - F.col("prev_at") > gap
    spans = spans.withColumn("is_new", F.col("prev_at").isNull() | apart)
    return spans.withColumn("run_at", F.max(F.when(F.col("is_new"), F.col("from_at"))).over(upto))


def in_runs(df: DataFrame, keys: Sequence[str], at: str, gap: float | None, width: float | None = None, keep: Sequence[str] = (), **extra: Column) -> DataFrame:
    """Rows with ``run_at`` and the columns ``keep`` of their chunk in ``runs``. No key is sorted, and no chunk need fit a task.

    Null keys match each other.
    """
    spans = runs(df, keys, at, gap, width, **extra)
    names = {k: f"_k{i}" for i, k in enumerate([*keys, CHUNK])}
    found = spans.select(*[F.col(k).alias(n) for k, n in names.items()], "run_at", *keep)
    rows = df.withColumn(CHUNK, chunk_of(at, run_width(gap, width)))
    same = F.lit(True)
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(found, same).drop(CHUNK, *names.values())
