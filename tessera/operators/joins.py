"""Joins that Spark has no operator for: as-of, by interval, and by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, most ranges that an order is cut to, and rows of a sample for each where quantiles can't be had.
BIN_ROWS, MOST_BINS, SAMPLED = 1 << 20, 4096, 32
_MEASURED = {"byte", "short", "integer", "long", "float", "double", "decimal", "date", "timestamp_ntz"}


def bins(df: DataFrame, column: str, n: int | None = None) -> Column | None:
    """The number of the range of a column's values that a row is in, smaller values in lower ranges, nulls in range 0; None if there is one range.

    There are about n ranges of like size (one for BIN_ROWS rows, if not given; MOST_BINS at most). Their bounds are approximate quantiles, or of a
    sample for text; they are all that the driver gets, and stand in the plan as constants: a task that runs again cuts alike.
    """
    if n == 1:
        return None
    own, name = F.col(f"`{column}`"), df.schema[column].dataType.typeName()
    own = F.unix_micros(own) if name == "timestamp" else own
    values = df.select(own.alias("v")).filter("v is not null" + (" and not isnan(v)" if name in ("float", "double") else ""))
    kind = values.schema["v"].dataType
    n = min(MOST_BINS, n or -(-values.count() // BIN_ROWS))
    if n < 2:
        return None
    if name in _MEASURED or name == "timestamp":
        shares = F.expr(f"array({', '.join(f'{i / n!r}D' for i in range(1, n))})")
        found = values.agg(F.percentile_approx("v", shares, 20_000).cast("array<string>")).first()[0] or []
    else:
        drawn = values.filter(F.rand(7) < F.lit(min(1.0, n * SAMPLED / max(values.count(), 1)))).orderBy("v").select(F.col("v").cast("string")).collect()
        found = [drawn[len(drawn) * i // n].v for i in range(1, n)] if drawn else []
    bounds = list(dict.fromkeys(found))
    if not bounds:
        return None
    width = max(1, int(len(bounds) ** 0.5))
    cuts = [F.lit(v).cast(kind) for v in bounds]

    def not_above(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= own))

    group = not_above(F.array(*cuts[::width]))
    return F.when(own.isNull() | (group == 0), 0).otherwise((group - 1) * width + not_above(F.slice(F.array(*cuts), (group - 1) * width + 1, width)))


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], columns: list[str], strict: bool = False, n_bins: int | None = None) -> DataFrame:
    """left with the columns of right's latest row of the same key whose `on` isn't later (is earlier, if strict).

    Both sides are stacked and cut to ranges of time, so that the rows of one key are spread over tasks however many there are;
    within a key's range each left row takes the last right value before it. Into each range goes one row more: the key's last
    right value of the ranges before, of which there is at most one for each key and range.

    Null keys meet null keys; a null `on` meets nothing, and its left row stays. Of right rows of the same key and time, the one with the greatest columns
    counts. A right column that left has too is named with _asof.
    """
    keys = [F.col(k) for k in by]
    rest = [c for c in left.columns if c not in by and c != on]
    value = F.struct(*[F.col(c) for c in columns])
    a = left.select(*keys, F.col(on).alias("__on"), F.lit(0 if strict else 1).alias("__side"), F.struct(*rest).alias("__left") if rest else F.struct(F.lit(True)).alias("__left"), F.lit(None).cast(right.select(value).schema.fields[0].dataType).alias("__right"))
    b = right.filter(F.col(on).isNotNull()).select(*keys, F.col(on).alias("__on"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), value.alias("__right"))
    both = a.union(b)
    cut = bins(both, "__on", n_bins)
    both = both.withColumn("__bin", F.lit(0) if cut is None else cut)
    latest = both.filter("__right is not null or __left is not null").groupBy(*by, "__bin").agg(F.max(F.when(F.col("__right").isNotNull(), F.struct("__on", "__right"))).alias("__own"))
    earlier = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    brought = latest.withColumn("__right", F.last("__own", ignorenulls=True).over(earlier)["__right"]).filter("__right is not null")
    brought = brought.select(*by, F.lit(None).cast(both.schema["__on"].dataType).alias("__on"), F.lit(-1).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), "__right", "__bin")
    w = Window.partitionBy(*by, "__bin").orderBy("__on", "__side", F.col("__right").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (both if cut is None else both.unionByName(brought)).withColumn("__last", F.last("__right", ignorenulls=True).over(w)).filter("__left is not null")
    return out.select(*by, F.col("__on").alias(on), *([F.col(f"__left.`{c}`").alias(c) for c in rest]), *[F.col(f"__last.`{c}`").alias(f"{c}_asof" if c in left.columns else c) for c in columns])


def interval_join(left: DataFrame, right: DataFrame, left_at: str, right_from: str, right_to: str, by: list[str], width: float) -> DataFrame:
    """Pairs with right_from <= left_at < right_to (numbers) of the same key.

    Both sides are cut to bins of a width, so the join is on key and bin; a right row stands in each bin that it touches.
    """
    a = left.withColumn("__bin", F.floor(F.col(left_at) / width))
    b = right.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(right_from) / width), F.floor(F.col(right_to) / width))))
    return a.join(b, [*by, "__bin"]).filter((F.col(right_from) <= F.col(left_at)) & (F.col(left_at) < F.col(right_to))).drop("__bin")


def positional_join(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides side by side, by their place in an order; the shorter side gives nulls.

    Places are counted within ranges of the order, and ranges are counted before: no single task sorts all rows.
    """
    return _placed(left, left_order).join(_placed(right, right_order), "__place", "full").drop("__place")


def _placed(df: DataFrame, order: str) -> DataFrame:
    cut = bins(df, order)
    ranged = df.withColumn("__bin", F.lit(0) if cut is None else cut)
    earlier = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = ranged.groupBy("__bin").agg(F.count("*").alias("n")).select("__bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__bin").orderBy(order))
    return ranged.withColumn("__within", within).join(F.broadcast(before), "__bin").withColumn("__place", F.col("__before") + F.col("__within")).drop("__bin", "__within", "__before")
