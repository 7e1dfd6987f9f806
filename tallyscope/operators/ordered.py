"""Order-dependent operators that stay balanced when one key holds a large part of the rows.

A plain window puts every row of a key into one task. Here a key above ``hot_rows`` is cut into
consecutive stretches of its order column; each stretch is one window partition, and the rows at
the seams get their predecessor from a small table with the last row of every stretch. Keys below
the limit keep the plain single-shuffle window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


HOT_ROWS = 2_000_000


def order_number(df: DataFrame, order: str) -> Column:
    """The order column as a long: microseconds for instants, the value itself for ordinals."""
    if df.schema[order].dataType.typeName() == "timestamp":
        return F.unix_micros(F.col(order))
    return F.col(order).cast("bigint")


def hot_keys(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int) -> DataFrame:
    """Keys above the limit with the width of one stretch; at most rows / hot_rows keys exist.

    The width aims at an eighth of the limit per stretch, so an eightfold burst still fits.
    """
    at = order_number(df, order)
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(at).alias("_low"), F.max(at).alias("_high")
    )
    width = F.greatest(
        F.lit(1), F.floor((F.col("_high") - F.col("_low") + 1) * F.lit(hot_rows / 8.0) / F.col("_n"))
    )
    return stats.filter(F.col("_n") > hot_rows).select(
        *keys, "_low", width.cast("bigint").alias("_width")
    )


def find_hot(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int = HOT_ROWS) -> DataFrame | bool:
    """The table of hot keys, or False when there is none; pass it on to save repeated checks."""
    hot = hot_keys(df, keys, order, hot_rows)
    return False if hot.isEmpty() else hot


def add_stretch(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | bool | None = None,
) -> tuple[DataFrame, bool]:
    """Add the stretch number ``_part`` of each row, and tell whether any key had to be cut."""
    if hot is None:
        hot = find_hot(df, keys, order, hot_rows)
    if hot is False:
        return df.withColumn("_part", F.lit(0).cast("bigint")), False
    at = order_number(df, order)
    joined = df.join(hot, list(keys), "left")
    part = F.when(F.col("_low").isNotNull(), F.floor((at - F.col("_low")) / F.col("_width")))
    return joined.withColumn(
        "_part", F.coalesce(part, F.lit(0)).cast("bigint")
    ).drop("_low", "_width"), True


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    fields: Sequence[str],
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    name: str = "prev",
    flags: bool = False,
    hot: DataFrame | bool | None = None,
) -> DataFrame:
    """Add a struct column with the order, tie and ``fields`` columns of the previous row per key.

    The order together with ``tie`` must be total within a key. With ``flags`` the row's 1-based
    ``position`` in its key and ``is_last`` are added as well.
    """
    keys, tie = list(keys), list(tie)
    carried = F.struct(order, *tie, *[f for f in fields if f not in (order, *tie)])
    parted, cut = add_stretch(df, keys, order, hot_rows, hot)
    if not cut:
        window = Window.partitionBy(*keys).orderBy(order, *tie)
        out = df.withColumn(name, F.lag(carried).over(window))
        if flags:
            out = out.withColumn("position", F.row_number().over(window).cast("bigint")).withColumn(
                "is_last", F.lead(F.lit(1)).over(window).isNull()
            )
        return out
    inside = Window.partitionBy(*keys, "_part").orderBy(order, *tie)
    rows = parted.withColumn(name, F.lag(carried).over(inside)).withColumn(
        "_at", F.row_number().over(inside).cast("bigint")
    )
    # One row per stretch; the maximum is combined on the map side before it is shuffled.
    ends = parted.groupBy(*keys, "_part").agg(F.max(carried).alias("_end"), F.count(F.lit(1)).alias("_size"))
    seams = Window.partitionBy(*keys).orderBy("_part")
    carry = ends.select(
        *keys,
        "_part",
        F.lag("_end").over(seams).alias("_carry"),
        F.coalesce(F.sum("_size").over(seams.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        "_size",
        F.lead("_part").over(seams).isNull().alias("_final"),
    )
    out = rows.join(carry, [*keys, "_part"], "left").withColumn(
        name, F.when(F.col("_at") == 1, F.col("_carry")).otherwise(F.col(name))
    )
    if flags:
        out = out.withColumn("position", F.col("_at") + F.col("_before")).withColumn(
            "is_last", F.col("_final") & (F.col("_at") == F.col("_size"))
        )
    return out.drop("_part", "_at", "_carry", "_before", "_size", "_final")


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    fields: Sequence[str],
    forward: bool = False,
    hot_rows: int = HOT_ROWS,
    name: str = "match",
) -> DataFrame:
    """For every left row the nearest right row at or before its time (at or after if ``forward``).

    Both sides are stacked and ordered once, so no pairs are formed; the last right row is carried
    along the order, and across stretches for keys that had to be cut.
    """
    keys = list(keys)
    sign = F.lit(-1 if forward else 1)
    found = F.struct(F.col(right_time), *[F.col(f) for f in fields if f != right_time])
    kept = F.struct(*[F.col(c) for c in left.columns if c not in keys])
    rows = left.select(
        *keys, (F.unix_micros(left_time) * sign).alias("_t"), F.lit(1).alias("_k"), kept.alias("_l")
    ).unionByName(
        right.filter(F.col(right_time).isNotNull()).select(
            *keys, (F.unix_micros(right_time) * sign).alias("_t"), F.lit(0).alias("_k"), found.alias("_r")
        ),
        allowMissingColumns=True,
    )
    parted, cut = add_stretch(rows, keys, "_t", hot_rows)
    upto = Window.rowsBetween(Window.unboundedPreceding, 0)
    inside = upto.partitionBy(*keys, "_part").orderBy("_t", "_k", "_r")
    out = parted.withColumn(name, F.last("_r", ignorenulls=True).over(inside))
    if cut:
        ends = parted.groupBy(*keys, "_part").agg(
            F.max(F.when(F.col("_k") == 0, F.struct("_t", "_r"))).alias("_end")
        )
        earlier = (
            Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = ends.select(
            *keys, "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_carry")
        )
        out = out.join(carry, [*keys, "_part"], "left").withColumn(
            name, F.coalesce(F.col(name), F.col("_carry._r"))
        )
    return out.filter(F.col("_k") == 1).select(*keys, "_l.*", name)


def last_of(columns: Sequence[str], order: Sequence[str], name: str = "last") -> Column:
    """Aggregate: the ``columns`` of the row with the largest order, combined on the map side."""
    return F.max_by(F.struct(*columns), F.struct(*order)).alias(name)


def first_of(columns: Sequence[str], order: Sequence[str], name: str = "first") -> Column:
    return F.min_by(F.struct(*columns), F.struct(*order)).alias(name)


def running_position(
    df: DataFrame, keys: Sequence[str], bin_column: str, order: Sequence[str], weights: dict[str, str]
) -> DataFrame:
    """Exclusive running totals over a global order without a single-partition window.

    ``bin_column`` must be monotone in the order. Totals per bin are few; their running sums are
    the offsets of the bins, and the exact positions are summed inside each bin.
    ``weights`` maps an output name to the column that is summed.
    """
    keys = list(keys)
    totals = df.groupBy(*keys, bin_column).agg(
        *[F.sum(source).alias("_t_" + name) for name, source in weights.items()]
    )
    before = (
        Window.partitionBy(*keys).orderBy(bin_column).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys,
        bin_column,
        *[
            F.coalesce(F.sum("_t_" + name).over(before), F.lit(0)).alias("_o_" + name)
            for name in weights
        ],
    )
    inside = (
        Window.partitionBy(*keys, bin_column)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = df
    for name, source in weights.items():
        rows = rows.withColumn(name, F.coalesce(F.sum(source).over(inside), F.lit(0)))
    # Binned offsets and rows share the (key, bin) shuffle.
    joined = rows.join(offsets, [*keys, bin_column])
    for name in weights:
        joined = joined.withColumn(name, F.col(name) + F.col("_o_" + name)).drop("_o_" + name)
    return joined


BINS = 4096


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact interpolated quantiles per key at position (n - 1) q; keys may be null, and one without values has no row.

    Rank selection in at most two rounds. A sketch puts a bracket around the two ranks a position lies
    between; keys of at most ``accuracy`` rows have the whole line for a bracket. Rows under a bracket are
    counted and the values inside it ranked, which shows whether both ranks were inside. The keys where one
    was not are taken again with a bracket cut from a histogram of their own values, whose edges are values
    with known ranks.
    """
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    first = _ranked(present, _sketched(present, keys, quantiles, accuracy), keys)
    missed = first.filter("_missed")
    if not missed.isEmpty():
        again = _ranked(present, _histogram(present, missed, keys), keys)
        first = first.filter("NOT _missed").unionByName(again)
    first = first.withColumn("_q", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    flat = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_q"))
    return first.withColumn("_q", flat).groupBy(*keys).pivot("quantile", list(quantiles)).agg(F.first("_q"))


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join in which null keys are equal; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({k: "_right_" + k for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed["_right_" + k])
    return left.join(renamed, same).drop(*["_right_" + k for k in keys])


def _sketched(present: DataFrame, keys: Sequence[str], quantiles: dict[str, float], accuracy: int) -> DataFrame:
    """Brackets [low, high] per key and quantile, closed, a null edge being open; and both wanted ranks.

    The sketch is off by n / accuracy ranks, the bracket allows three times that: above ``accuracy`` rows
    this leaves two ranks for rounding.
    """
    slack = 3.0 / accuracy
    wide = present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            F.percentile_approx(
                "_v", F.array(F.lit(max(q - slack, 0.0)), F.lit(min(q + slack, 1.0))), F.lit(accuracy)
            ).alias("_e_" + name)
            for name, q in quantiles.items()
        ],
    )
    small = F.col("_n") <= accuracy
    edges = [
        F.struct(
            F.lit(name).alias("quantile"),
            F.floor((F.col("_n") - 1) * F.lit(float(q))).alias("_ra"),
            F.ceil((F.col("_n") - 1) * F.lit(float(q))).alias("_rb"),
            ((F.col("_n") - 1) * F.lit(float(q))).alias("_at"),
            F.when(~small & F.lit(q > slack), F.col("_e_" + name)[0]).alias("low"),
            F.when(~small & F.lit(q < 1 - slack), F.col("_e_" + name)[1]).alias("high"),
        )
        for name, q in quantiles.items()
    ]
    return wide.select(*keys, F.explode(F.array(*edges)).alias("_edge")).select(*keys, "_edge.*")


def _inside(present: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of every key beside each of its brackets."""
    # Without keys the brackets are one row per quantile.
    return _beside(present, brackets, keys) if keys else present.join(F.broadcast(brackets), F.lit(True))


def _ranked(present: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values at both ranks of every bracket, and whether the bracket missed one of them."""
    marked = _inside(present, brackets, keys).filter(F.col("high").isNull() | (F.col("_v") <= F.col("high")))
    below = F.coalesce(F.col("_v") < F.col("low"), F.lit(False))
    by = [*keys, "quantile", "_ra", "_rb", "_at"]
    counted = marked.groupBy(*by, below.alias("_under"), F.when(~below, F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    window = (
        Window.partitionBy(*keys, "quantile")
        .orderBy(F.col("_under").desc(), "_v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counted.withColumn("_upto", F.sum("_c").over(window))

    def at(rank: str) -> Column:
        return F.min(F.when(~F.col("_under") & (F.col("_upto") > F.col(rank)), F.col("_v")))

    held = F.coalesce(F.max(F.when(F.col("_under"), F.col("_upto"))), F.lit(0))
    picked = ranked.groupBy(*by).agg(at("_ra").alias("_a"), at("_rb").alias("_b"), held.alias("_held"), F.max("_upto").alias("_last"))
    missed = (F.col("_ra") < F.col("_held")) | (F.col("_rb") >= F.col("_last"))
    picked = picked.withColumns({"_missed": missed, "_f": F.col("_at") - F.col("_ra")}).drop("_held", "_last")
    # The misses are counted and the values read: keep the few rows instead of ranking twice.
    return cut_lineage(picked)


def _histogram(present: DataFrame, missed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brackets from equal bins over the finite values of a key; infinities and NaN have bins of their own."""
    wanted = missed.select(*keys, "quantile", "_ra", "_rb", "_at")
    finite = F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))
    span = _inside(present, wanted.select(*keys).distinct(), keys) if keys else present
    span = span.groupBy(*keys).agg((F.min(finite) / 2).alias("_s"), (F.max(finite) / 2).alias("_e"))
    rows = _beside(present, span, keys) if keys else present.join(F.broadcast(span), F.lit(True))
    width = F.greatest(F.col("_e") - F.col("_s"), F.lit(5e-324))
    cell = F.least(F.floor((F.col("_v") / 2 - F.col("_s")) / width * BINS), F.lit(BINS - 1))
    cell = (
        F.when(F.isnan("_v"), F.lit(BINS + 1))
        .when(F.col("_v") == float("inf"), F.lit(BINS))
        .when(F.col("_v") == float("-inf"), F.lit(-1))
        .otherwise(cell)
    )
    cells = rows.groupBy(*keys, cell.alias("_cell")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    order = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    upto = cells.withColumn("_upto", F.sum("_c").over(order))
    pairs = _inside(upto, wanted, keys)
    return pairs.groupBy(*keys, "quantile", "_ra", "_rb", "_at").agg(
        F.min(F.when(F.col("_upto") > F.col("_ra"), F.col("_lo"))).alias("low"),
        F.min(F.when(F.col("_upto") > F.col("_rb"), F.col("_hi"))).alias("high"),
    )
