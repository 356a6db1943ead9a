"""Order-dependent work on hot keys: a key with very many rows is split into time slices.

Rows are spread by (key, slice).  A key with few rows is one slice.  A hot key, which may hold a third
of all rows, has as many slices as its rows need; what a slice has to know of the slices before it is a
small summary per slice, and only these summaries are brought together, never rows.  Any split gives the
same results by the same plan: the rows of a key that is one slice merely have nothing to hand on.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import cut, work_path

WHOLE = -1  # slice number of a key that is one slice


@dataclass(frozen=True)
class Heat:
    """How many rows of one key a slice holds, about."""

    rows: int = 1_000_000


@dataclass(frozen=True)
class Laid:
    """Rows (us, id, slice, key)."""

    rows: DataFrame
    key: str

    def over(self, rows: DataFrame) -> Laid:
        return replace(self, rows=rows)

    def order(self):
        """Row order inside one slice of one key."""
        return Window.partitionBy(self.key, "slice").orderBy("us", "id")


def hot_keys(df: DataFrame, key: str, heat: Heat) -> DataFrame:
    """(key, hot_us, width) of every key with more than ``heat.rows`` rows, as a stored table.

    Counted with a map-side combine.  Stored, the table has a known size, so Spark decides by that whether
    to broadcast it.  The width follows from the key's density alone.
    """
    counts = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("hot_us"), F.max("us").alias("last_us")
    )
    share = (F.col("last_us") - F.col("hot_us") + 1).cast("decimal(38,0)") * F.lit(heat.rows) / F.col("n")
    hot = counts.filter(F.col("n") > heat.rows).select(
        key, "hot_us", F.greatest(F.lit(1), F.ceil(share)).cast("bigint").alias("width")
    )
    path = work_path(df.sparkSession, "hot-keys")
    hot.write.parquet(path)
    return df.sparkSession.read.schema(hot.schema).parquet(path)


def lay_out(df: DataFrame, key: str, heat: Heat = Heat()) -> Laid:
    """Give every row its slice.  ``df`` is read twice, so cut it first."""
    since = F.col("us") - F.col("hot_us")
    number = ((since - F.pmod(since, F.col("width"))) / F.col("width")).cast("bigint")
    rows = df.join(hot_keys(df, key, heat), key, "left").withColumn(
        "slice", F.coalesce(number, F.lit(WHOLE).cast("bigint"))
    )
    return Laid(rows.drop("hot_us", "width"), key)


def stored(laid: Laid) -> Laid:
    """Cut the rows."""
    return laid.over(cut(laid.rows))


def mark_gaps(laid: Laid, gap_us: int) -> Laid:
    """Add what can be known of gaps and runs inside a slice alone."""
    w = laid.order()
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = laid.rows.withColumns(
        {"slice_row": F.row_number().over(w), "slice_gap": F.col("us") - F.lag("us").over(w)}
    ).withColumn(
        "run_row",
        F.last(F.when(F.col("slice_gap") > gap_us, F.col("slice_row")), ignorenulls=True).over(so_far),
    )
    return laid.over(rows)


def run_positions(marked: Laid, gap_us: int) -> DataFrame:
    """Position of every row in its run, where a gap above ``gap_us`` starts a new run.

    ``marked`` comes from ``mark_gaps`` and is stored.  Adds ``position`` (1-based) and ``gap`` (microseconds
    since the key's previous row, null for its first).
    """
    rows, helpers = marked.rows, ["slice_row", "slice_gap", "run_row"]
    slices = _slice_starts(marked, gap_us)
    before = F.coalesce("before", F.lit(0))
    start = F.coalesce(before + F.col("run_row"), F.col("open_row"), F.lit(1))
    return (
        rows.join(slices, [marked.key, "slice"], "left")
        .withColumns(
            {
                "position": (before + F.col("slice_row") - start + 1).cast("bigint"),
                "gap": F.coalesce(F.col("slice_gap"), F.col("us") - F.col("prev_us")),
            }
        )
        .drop("before", "prev_us", "open_row", *helpers)
    )


def _slice_starts(marked: Laid, gap_us: int) -> DataFrame:
    """For every slice of a split key: rows before it, the last time before it, and the row
    number, over the whole key, at which the run it starts in began."""
    key = marked.key
    slices = (
        marked.rows.filter(F.col("slice") != WHOLE)
        .groupBy(key, "slice")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
            F.max("run_row").alias("run_row_max"),
        )
    )
    order = Window.partitionBy(key).orderBy("slice")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumns(
        {
            "prev_us": F.lag("last_us").over(order),
            "before": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
        }
    )
    opens = F.col("prev_us").isNull() | (F.col("first_us") - F.col("prev_us") > gap_us)
    newest = F.when(F.col("run_row_max").isNotNull(), F.col("before") + F.col("run_row_max")).when(
        opens, F.col("before") + 1
    )
    return (
        slices.withColumn("newest", newest)
        .withColumn("carried", F.last("newest", ignorenulls=True).over(earlier))
        .select(
            key, "slice", "before", "prev_us",
            F.when(opens, F.col("before") + 1).otherwise(F.col("carried")).alias("open_row"),
        )
    )
