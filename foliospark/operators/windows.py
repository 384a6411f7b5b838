"""Variance windows, islands of like lines, impurity and step functions over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_variance(rows: DataFrame, key: str, order: list[str], value: str, size: int = 15) -> DataFrame:
    """Unbiased variance of the last `size` values over their number, from sums that integers keep exact."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(size - 1), 0)
    v = F.col(value)
    n, s, q = F.count(v).over(w), F.sum(v).over(w), F.sum(v * v).over(w)
    return rows.withColumn("running_variance", F.when(n > 1, (n * q - s * s) / (n * (n - 1)) / n).otherwise(0.0))


def sliding_variance(rows: DataFrame, key: str, order: list[str], value: str, size: int = 15) -> DataFrame:
    """Population variance of the `size` values from each row on, over `size`; the last full window is left out."""
    w = Window.partitionBy(key).orderBy(*order)
    ahead, v = w.rowsBetween(0, size - 1), F.col(value)
    n, s, q = F.count(v).over(ahead), F.sum(v).over(ahead), F.sum(v * v).over(ahead)
    out = rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return out.withColumn("sliding_variance", (n * q - s * s) / (n * n) / size).where(F.col("pos") < F.col("_n") - size).drop("_n")


def suffix_variance(rows: DataFrame, key: str, order: list[str], value: str, tail: int = 10) -> DataFrame:
    """Population variance of all values after each row, while at least `tail` follow."""
    # from the back, so that the frame grows row by row and nothing is summed again
    after = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value)
    n, s, q = F.count(v).over(after), F.sum(v).over(after), F.sum(v * v).over(after)
    out = rows.withColumn("_n", n).withColumn("suffix_variance", F.when(F.col("_n") > 0, (n * q - s * s) / (n * n)))
    return out.where(F.col("_n") >= tail).drop("_n")


def repetition_verdict(rows: DataFrame, key: str, value: str = "value", steps: str = "steps", limit: float = 0.045, windows: str | None = None, ended: str | None = None) -> DataFrame:
    """(key, repeats_from) from suffix variances by pos: where the tail of a series stops varying, or null.  Series of fewer
    than ten windows, and those that end by themselves, don't repeat."""
    low = F.col(value) < limit
    at_low = F.when(low, F.col("pos"))
    size = F.max(windows) if windows else F.lit(10)
    end = F.max(ended) if ended else F.lit(False)
    g = rows.groupBy(key).agg(F.count_if(low).alias("_k"), F.min(at_low).alias("_a"), F.max(at_low).alias("_b"), F.max(steps).alias("_steps"), size.alias("_windows"), end.alias("_ended"))
    at = F.least(F.greatest(F.col("_a"), F.lit(1)) * 1.08 + 120, F.lit(4095)).cast("int")
    ok = (F.col("_windows") >= 10) & ~F.col("_ended") & (F.col("_k") >= 2) & (F.col("_b") - F.col("_a") + 1 == F.col("_k")) & (at / F.col("_steps") <= 0.9)
    return g.select(key, F.when(ok, F.when(F.col("_a") < 30, 0).otherwise(at)).alias("repeats_from"))


def stopping_step(rows: DataFrame, key: str, order: str, value: str, limit: float = 0.015, window: int = 15, long: int = 200) -> DataFrame:
    """(key, stop_step, stop_index): the second of two consecutive steps, of those with `long` behind them, at which the variance of
    the last `long` running variances is below the limit, or null; the index is that at which generation is to end."""
    r = running_variance(rows, key, [order], value, window)
    w = Window.partitionBy(key).orderBy(order)
    far = w.rowsBetween(-(long - 1), 0)
    r = r.withColumn("_low", (F.row_number().over(w) >= long) & (F.var_samp("running_variance").over(far) / F.count("*").over(far) < limit))
    r = r.withColumn("_stop", F.col("_low") & F.lag("_low").over(w))
    found = r.groupBy(key).agg(F.min(F.when(F.col("_stop"), F.col(order))).alias("stop_step"))
    at = F.least(F.greatest(F.col("stop_step") - 1, F.lit(1)) * 1.15 + 150 + long, F.lit(4095)).cast("int")
    return found.withColumn("stop_index", F.when(F.col("stop_step").isNotNull(), at))


def line_islands(lines: DataFrame, key: str, pos: str, line: str, gap: int = 3, least: int = 15) -> DataFrame:
    """(key, first_line, end_line) of stretches of lines that equal the next non-empty one; islands break at gaps above `gap`."""
    follow = Window.partitionBy(key).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, -1)
    filled = F.when(F.col(line) != "", F.struct(F.col(pos).alias("p"), F.col(line).alias("l")))
    x = lines.withColumn("_next", F.last(filled, ignorenulls=True).over(follow))
    size = F.length(line)
    x = x.where((F.col("_next.l") == F.col(line)) & (size > 3) & (size < 200) & ~F.col(line).startswith("[MISSING_PAGE"))
    flagged = x.select(key, F.explode(F.sequence(F.col(pos), F.col("_next.p") - 1)).alias("_f")).distinct()
    w = Window.partitionBy(key).orderBy("_f")
    flagged = flagged.withColumn("_i", F.sum((F.coalesce(F.col("_f") - F.lag("_f").over(w), F.lit(0)) > gap).cast("int")).over(w))
    g = flagged.groupBy(key, "_i").agg(F.min("_f").alias("first_line"), (F.max("_f") + 2).alias("end_line"))
    return g.where(F.col("end_line") - F.col("first_line") > least).drop("_i")


def gini(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, gini): the number of rows less the sum of squared class sizes over it."""
    c = rows.groupBy(key, label).agg(F.count("*").alias("n"))
    return c.groupBy(key).agg((F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("gini"))


def class_median(rows: DataFrame, label: str, value: str, buckets: int = 1024) -> DataFrame:
    """(label, median) of each class, exact.  Values are counted in `buckets` stretches between the least and the greatest of their
    class; only the one or two stretches that hold the middle are sorted, so no task sees all values of a class."""
    x = rows.where(F.col(value).isNotNull()).select(label, F.col(value).cast("double").alias("_v"))
    ends = x.groupBy(label).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    x = x.join(ends, label).withColumn("_b", at)
    up_to = Window.partitionBy(label).orderBy("_b")
    sizes = x.groupBy(label, "_b").agg(F.count("*").alias("_k"), F.first("_n").alias("_n")).withColumn("_before", F.sum("_k").over(up_to) - F.col("_k"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = sizes.where((F.col("_before") <= high) & (F.col("_before") + F.col("_k") > low)).select(label, "_b", "_before")
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_v")) - 1 + F.col("_before")
    ranked = x.join(middle, [label, "_b"]).withColumn("_r", rank)
    return ranked.where((F.col("_r") == low) | (F.col("_r") == high)).groupBy(label).agg(F.avg("_v").alias("median"))


def class_spread(rows: DataFrame, label: str, value: str) -> DataFrame:
    """(label, median, mad): median and median absolute deviation of each class."""
    med = class_median(rows, label, value)
    away = rows.join(med, label).select(label, F.abs(F.col(value) - F.col("median")).alias("_away"))
    return med.join(class_median(away, label, "_away").withColumnRenamed("median", "mad"), label)


def staircase(x: Column, thresholds: Column) -> Column:
    """How many thresholds lie strictly below x, each rounded down."""
    return F.size(F.filter(thresholds, lambda t: x > F.floor(t)))


def last_break(ind: Column, breaks: Column) -> Column:
    """0-based index of the last breakpoint at or before ind; of equal ones the first."""
    ok = F.filter(breaks, lambda b: b <= ind)
    return F.when(F.size(ok) > 0, F.array_position(breaks, F.array_max(ok)) - 1)


def column_spec_mode(cells: DataFrame, table: str, column: str, spec: str, row: str) -> DataFrame:
    """The most frequent cell specification of every column; of equally frequent ones the first seen."""
    n = cells.groupBy(table, column, spec).agg(F.count("*").alias("_n"), F.min(row).alias("_first"))
    w = Window.partitionBy(table, column).orderBy(F.desc("_n"), "_first")
    return n.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(table, column, spec)


def row_width(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0), lambda a, c: a + c["colspan"])


def table_width(rows: Column) -> Column:
    """The greatest sum of column spans of a row."""
    return F.array_max(F.transform(rows, lambda r: row_width(r)))


def transposed(rows: Column) -> Column:
    """Columns of an array of rows; short rows are filled with nulls."""
    width = F.array_max(F.transform(rows, F.size))
    columns = F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda i: F.transform(rows, lambda r: F.get(r, i)))
    return F.when(width > 0, columns).otherwise(F.slice(columns, 1, 0))


def alignment(classes: Column) -> Column:
    """The letter of a cell's alignment, centred if no class says."""
    by = F.when(F.array_contains(classes, "ltx_align_left"), "l").when(F.array_contains(classes, "ltx_align_right"), "r")
    return by.when(F.array_contains(classes, "ltx_align_justify"), "p").otherwise("c")


def border_count(classes: Column, side: str) -> Column:
    """How many rules a cell has on a side (t, b, l, r)."""
    return F.coalesce(F.array_max(F.transform(classes, lambda c: F.length(F.regexp_extract(c, f"^ltx_border_({side}+)$", 1)))), F.lit(0))


def spec_text(left: Column, align: Column, right: Column) -> Column:
    return F.concat(F.repeat(F.lit("|"), left), align, F.repeat(F.lit("|"), right))


def rule_line(columns: Column, width: Column) -> Column:
    """The rules under a row of a table whose cells in `columns` (1-based, ascending) have one: one over the whole width, or one for each stretch."""
    part = lambda s: F.concat(F.lit("\\cline{"), s["a"].cast("string"), F.lit("-"), s["b"].cast("string"), F.lit("}"))
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def grow(out, c):
        last = F.element_at(out, -1)
        on = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["b"] == c - 1)
        longer = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), c.cast("int").alias("b"))))
        return F.when(on, longer).otherwise(F.concat(out, F.array(F.struct(c.cast("int").alias("a"), c.cast("int").alias("b")))))

    return F.when(F.size(columns) == width, F.lit("\\hline")).otherwise(F.aggregate(F.aggregate(columns, empty, grow), F.lit(""), lambda acc, s: F.concat(acc, part(s))))


def cumulative(rows: DataFrame, key: str, order: str, sums: dict[str, str]) -> DataFrame:
    """Running sums of columns along the order, each under a name of its own."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.sum(c).over(w) for c, name in sums.items()})


def threshold_gini(rows: DataFrame, key: str, x: str, label: str, thresholds: list[float], domain: int) -> DataFrame:
    """(key, class, gini): of the rows between two neighbouring thresholds (above the first, up to the second), how far their labels
    are from being all of that class; the outermost thresholds lie around the domain."""
    edges = [-0.5, *thresholds, domain + 0.5]
    inner = F.array(*(F.lit(float(t)) for t in edges[1:-1]))
    inside = rows.where((F.col(x) > edges[0]) & (F.col(x) <= edges[-1])).withColumn("class", F.size(F.filter(inner, lambda t: F.col(x) > t)))
    g = inside.groupBy(key, "class").agg(F.count("*").alias("_n"), F.count_if(F.col(label) == F.col("class")).alias("_s"))
    return g.select(key, "class", (F.col("_n") - F.col("_s") * F.col("_s") / F.col("_n")).alias("gini"))


def step_impurity(g: DataFrame, key: str) -> DataFrame:
    """With step: the impurity of each class and the next one together."""
    return g.withColumn("step", F.col("gini") + F.lead("gini").over(Window.partitionBy(key).orderBy("class")))


def reduced(g: DataFrame, key: str) -> DataFrame:
    """(key, total, mean) of the classes' impurities."""
    return g.groupBy(key).agg(F.sum("gini").alias("total"), F.avg("gini").alias("mean"))


def boundaries(thresholds: Column, domain: int) -> Column:
    """Half-way places within the domain for thresholds, each cut to an integer."""
    return F.greatest(F.lit(0), F.least(thresholds.cast("int"), F.lit(domain - 1))) + F.lit(0.5).cast("double")


def filled_spread(rows: DataFrame, label: str, value: str, classes: int) -> DataFrame:
    """(label, median, mad) of classes 0 to `classes` - 1; one without rows has the median of the class before, the first one 0."""
    every = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    known = class_spread(rows, label, value)
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, 0)  # a row for each class
    return every.join(known, label, "left").select(label, F.coalesce(F.last("median", ignorenulls=True).over(w), F.lit(0.0)).alias("median"), "mad")


def bitmap(pixels: Column, least: int = 200) -> Column:
    """Grey values below `least` become black."""
    return F.transform(pixels, lambda x: F.when(x < least, 0).otherwise(x))
