"""Series, windows, step functions, impurities and tables of cells, over the numeric tables; integers keep sums exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import windows

from .registry import query, table

CENTS = "e AS (SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE value IS NOT NULL)"


def cents(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("v"))


@query(f"""WITH {CENTS}, w AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS a, count(v) OVER x AS n, sum(v) OVER x AS s, sum(v * v) OVER x AS q FROM e WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING))
SELECT event_id, pos, round((n * q - s * s)::DOUBLE / (n * n) / 15, 4) AS variance FROM w WHERE pos < a - 15""")
def windows_of_fifteen(spark, sf_dir):
    w = windows.sliding_variance(cents(spark, sf_dir), "user_id", ["ts", "event_id"], "v")
    return w.select("event_id", F.col("pos").cast("bigint").alias("pos"), F.round("sliding_variance", 4).alias("variance"))


@query(f"""WITH {CENTS}, s AS (SELECT event_id % 100 AS page, row_number() OVER (PARTITION BY event_id % 100 ORDER BY ts, event_id) - 1 AS pos, v FROM e),
f AS (SELECT page, pos, CASE WHEN pos BETWEEN page % 50 AND page % 50 + 5 OR page % 7 = 0 AND pos = 70 THEN 100 ELSE 3000 + v % 5000 END < 2500 AS low FROM s WHERE page % 11 > 0 OR pos < 8),
g AS (SELECT page, count(*) FILTER (low) AS k, min(pos) FILTER (low) AS a, max(pos) FILTER (low) AS b, count(*) AS n FROM f GROUP BY page),
i AS (SELECT *, CAST(trunc(least(greatest(a, 1) * 1.08 + 120, 4095)) AS INT) AS idx, n + 30 + page AS steps FROM g)
SELECT page, CASE WHEN n >= 10 AND NOT (page % 3 = 0) AND k >= 2 AND b - a + 1 = k AND idx / steps <= 0.9 THEN CASE WHEN a < 30 THEN 0 ELSE idx END END AS repeats_from FROM i""")
def repetition_verdicts(spark, sf_dir):
    from pyspark.sql import Window

    page = Window.partitionBy("page")
    s = cents(spark, sf_dir).select((F.col("event_id") % 100).alias("page"), "event_id", "ts", "v").withColumn("pos", F.row_number().over(page.orderBy("ts", "event_id")) - 1)
    low = F.col("pos").between(F.col("page") % 50, F.col("page") % 50 + 5) | (F.col("page") % 7 == 0) & (F.col("pos") == 70)
    s = s.where("page % 11 > 0 or pos < 8").withColumn("value", F.when(low, 100).otherwise(3000 + F.col("v") % 5000)).withColumn("windows", F.count("*").over(page))
    s = s.withColumn("steps", F.col("windows") + 30 + F.col("page")).withColumn("ended", F.col("page") % 3 == 0)
    return windows.repetition_verdict(s, "page", limit=2500, windows="windows", ended="ended")


@query(f"""WITH {CENTS}, p AS (SELECT event_id % 40 AS page, row_number() OVER (PARTITION BY event_id % 40 ORDER BY ts, event_id) AS step, v % 7 AS v FROM e),
w AS (SELECT page, step, count(v) OVER x AS n, sum(v) OVER x AS s, sum(v * v) OVER x AS q FROM p WINDOW x AS (PARTITION BY page ORDER BY step ROWS 14 PRECEDING)),
r AS (SELECT page, step, CASE WHEN n > 1 THEN (n * q - s * s)::DOUBLE / (n * (n - 1)) / n ELSE 0.0 END AS r FROM w),
l AS (SELECT page, step, step >= 20 AND var_samp(r) OVER y / count(*) OVER y < 0.0012 AS low FROM r WINDOW y AS (PARTITION BY page ORDER BY step ROWS 19 PRECEDING)),
t AS (SELECT page, step, low, low AND lag(low) OVER (PARTITION BY page ORDER BY step) AS stop FROM l),
f AS (SELECT page, min(step) FILTER (stop) AS stop_step FROM t GROUP BY page)
SELECT page, stop_step, CASE WHEN stop_step IS NOT NULL THEN CAST(trunc(least((stop_step - 1) * 1.15 + 150 + 20, 4095)) AS INT) END AS stop_index FROM f""")
def stopping_steps(spark, sf_dir):
    from pyspark.sql import Window

    p = cents(spark, sf_dir).select((F.col("event_id") % 40).alias("page"), "event_id", "ts", (F.col("v") % 7).alias("v"))
    p = p.withColumn("step", F.row_number().over(Window.partitionBy("page").orderBy("ts", "event_id")).cast("bigint"))
    return windows.stopping_step(p, "page", "step", "v", limit=0.0012, long=20)


@query(r"""WITH l AS (SELECT doc_id, string_split(replace(text, '. ', chr(10)), chr(10)) AS a FROM documents), u AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM l)
SELECT doc_id, pos, CAST(sum(length(line)) OVER w AS BIGINT) AS chars, count(*) OVER w AS lines, CAST(sum(CASE WHEN line LIKE '%a' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS label FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def cumulative_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit("\n")), "\n", -1)).alias("pos", "line"))
    out = windows.cumulative(lines.withColumns({"size": F.length("line"), "one": F.lit(1), "flag": F.col("line").endswith("a").cast("int")}), "doc_id", "pos", {"size": "chars", "one": "lines", "flag": "label"})
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "chars", "lines", "label")


@query("""WITH d AS (SELECT l_returnflag AS k, l_orderkey % 60 AS x, CAST((l_orderkey % 60 + l_linenumber * 3) // 16 AS INT) AS y FROM lineitem), t AS (SELECT unnest([-0.5, 12.5, 30.5, 44.5]) AS a, unnest([12.5, 30.5, 44.5, 60.5]) AS b, unnest([0, 1, 2, 3]) AS c),
g AS (SELECT k, c, count(*) AS n, count(*) FILTER (y = c) AS s FROM d JOIN t ON x > a AND x <= b GROUP BY ALL), i AS (SELECT k, c, n - s * s / n AS gini FROM g)
SELECT k, c AS class, round(gini, 6) AS gini, round(gini + lead(gini) OVER w, 6) AS step, round(sum(gini) OVER (PARTITION BY k), 6) AS total, round(avg(gini) OVER (PARTITION BY k), 6) AS mean FROM i WINDOW w AS (PARTITION BY k ORDER BY c)""")
def step_impurities(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_orderkey") % 60).alias("x"), F.floor((F.col("l_orderkey") % 60 + F.col("l_linenumber") * 3) / 16).cast("int").alias("y"))
    g = windows.step_impurity(windows.threshold_gini(d, "k", "x", "y", [12.5, 30.5, 44.5], 60), "k")
    sums = windows.reduced(g, "k")
    return g.join(sums, "k").select("k", "class", F.round("gini", 6).alias("gini"), F.round("step", 6).alias("step"), F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(CAST(trunc(l_quantity) AS INT), 39)) + 0.5::DOUBLE AS boundary FROM lineitem")
def step_boundaries(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", windows.boundaries(F.col("l_quantity"), 40).alias("boundary"))


@query("""WITH c AS (SELECT k FROM range(14) r(k)), m AS (SELECT CAST(l_quantity AS INT) // 4 AS k, l_orderkey % 101 AS v FROM lineitem WHERE CAST(l_quantity AS INT) // 4 NOT IN (3, 4, 9)),
a AS (SELECT k, median(v) AS med FROM m GROUP BY k), d AS (SELECT k, median(abs(v - med)) AS mad FROM m JOIN a USING (k) GROUP BY k)
SELECT k::INT AS class, coalesce(med, last_value(med IGNORE NULLS) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS median, mad::DOUBLE AS mad FROM c LEFT JOIN a USING (k) LEFT JOIN d USING (k)""")
def class_spread_filled(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity").cast("int") / 4).cast("int").alias("class"), (F.col("l_orderkey") % 101).alias("v")).where("class not in (3, 4, 9)")
    return windows.filled_spread(m, "class", "v", 14)


_CELLS = "c AS (SELECT l_orderkey, l_linenumber, 1 + CAST(l_quantity AS INT) % 3 AS colspan, l_returnflag AS body, l_suppkey % 3 AS r FROM lineitem)"


def _grids(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("r"), F.struct("l_linenumber", (1 + F.col("l_quantity").cast("int") % 3).alias("colspan"), F.col("l_returnflag").alias("body")).alias("cell"))
    rows = cells.groupBy("l_orderkey", "r").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("r", "cells"))).alias("rows"))


@query(f"""WITH {_CELLS}, w AS (SELECT l_orderkey, r, sum(colspan) AS w FROM c GROUP BY ALL) SELECT l_orderkey, CAST(max(w) AS BIGINT) AS width, array_to_string(list(w ORDER BY r), ',') AS widths FROM w GROUP BY l_orderkey""")
def table_widths(spark, sf_dir):
    rows = F.transform("rows", lambda r: r["cells"])
    widths = F.transform(rows, lambda r: windows.row_width(r).cast("string"))
    return _grids(spark, sf_dir).select("l_orderkey", windows.table_width(rows).cast("bigint").alias("width"), F.array_join(widths, ",").alias("widths"))


@query(f"""WITH {_CELLS}, n AS (SELECT l_orderkey, r, body, row_number() OVER (PARTITION BY l_orderkey, r ORDER BY l_linenumber, colspan, body) - 1 AS i FROM c), k AS (SELECT l_orderkey, max(i) AS m FROM n GROUP BY l_orderkey),
g AS (SELECT k.l_orderkey, x.i, y.r FROM k, LATERAL (SELECT unnest(range(m + 1)) AS i) x, (SELECT DISTINCT l_orderkey, r FROM c) y WHERE y.l_orderkey = k.l_orderkey)
SELECT l_orderkey, i AS col, string_agg(coalesce(body, '-'), '' ORDER BY r) AS cells FROM g LEFT JOIN n USING (l_orderkey, r, i) GROUP BY ALL""")
def transposed_tables(spark, sf_dir):
    rows = F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["body"]))
    t = _grids(spark, sf_dir).select("l_orderkey", F.posexplode(windows.transposed(rows)).alias("col", "cells"))
    return t.select("l_orderkey", F.col("col").cast("bigint").alias("col"), F.array_join("cells", "", "-").alias("cells"))


@query("""SELECT l_orderkey, l_linenumber, repeat('|', CAST(l_quantity AS INT) % 3) || CASE l_returnflag WHEN 'A' THEN 'l' WHEN 'N' THEN 'r' ELSE 'c' END || repeat('|', l_suppkey % 2) AS spec, CAST(regexp_extract(CASE WHEN l_suppkey % 4 > 0 THEN 'x ltx_border_' || repeat('t', l_suppkey % 4) || ' y' ELSE '' END, 'ltx_border_(t+)', 1) AS VARCHAR) AS top FROM lineitem""")
def column_specs(spark, sf_dir):
    n = F.col("l_suppkey") % 4
    classes = F.split(F.when(n > 0, F.concat(F.lit("x ltx_border_"), F.repeat(F.lit("t"), n.cast("int")), F.lit(" y"))).otherwise(F.lit("")), " ")
    align = F.when(F.col("l_returnflag") == "A", F.array(F.lit("ltx_align_left"))).when(F.col("l_returnflag") == "N", F.array(F.lit("ltx_align_right"))).otherwise(F.array(F.lit("ltx_td")))
    spec = windows.spec_text((F.col("l_quantity").cast("int") % 3), windows.alignment(align), (F.col("l_suppkey") % 2).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", spec.alias("spec"), F.repeat(F.lit("t"), windows.border_count(classes, "t")).alias("top"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_suppkey % 3 AS r, l_linenumber AS c FROM lineitem WHERE l_linestatus = 'O'), i AS (SELECT *, c - row_number() OVER (PARTITION BY l_orderkey, r ORDER BY c) AS g FROM r), s AS (SELECT l_orderkey, r, min(c) AS a, max(c) AS b FROM i GROUP BY l_orderkey, r, g)
SELECT l_orderkey, r, CASE WHEN min(a) = 1 AND max(b) = 7 AND count(*) = 1 THEN '\\hline' ELSE string_agg('\\cline{' || a || '-' || b || '}', '' ORDER BY a) END AS rule FROM s GROUP BY l_orderkey, r""".replace("\\\\", "\\"))
def table_rule_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy("l_orderkey", (F.col("l_suppkey") % 3).alias("r")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("cols"))
    return lines.select("l_orderkey", "r", windows.rule_line(F.col("cols"), F.lit(7)).alias("rule"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CASE WHEN round(x * 200) + 128 < 128 THEN 0 ELSE CAST(round(x * 200) AS INT) + 128 END AS VARCHAR)), ',') AS pixels FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)")
def bitmaps(spark, sf_dir):
    px = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x * 200).cast("int") + 128)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(windows.bitmap(px, 128), lambda x: x.cast("string")), ",").alias("pixels"))
