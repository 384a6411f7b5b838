"""Every registered query of the library with, where SQL can express it, its equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import html, repetition, similarity, text
from foliospark.operators import metrics, pages, splitting, windows
from foliospark.plans import page_sets, series, text_rules  # noqa: F401  they register their queries
from foliospark.plans.registry import ORACLE_SQL, QUERIES, literal, query, replaced, table  # noqa: F401
from foliospark.sources import files

_PAIRS = r"""pairs AS (SELECT d.doc_id, d.lang, regexp_replace(d.text, '[^\x00-\x7F]', '?', 'g') AS pred, regexp_replace(b.text, '[^\x00-\x7F]', '?', 'g') AS truth
FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    size = items.agg(F.count("*").alias("items"))
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    d = docs.crossJoin(F.broadcast(size)).select("doc_id", "lang", (F.col("doc_id") % F.col("items")).alias("item_id"), plain("text").alias("pred"))
    return d.join(items.select("item_id", plain("text").alias("truth")), "item_id")


@query(rf"""WITH {_PAIRS}, m AS (SELECT lang, CASE WHEN length(pred) >= 4 AND length(truth) >= 4 THEN levenshtein(pred, truth) / greatest(length(pred), length(truth)) END AS e FROM pairs)
SELECT lang, count(*) AS n, round(avg(e), 6) AS edit_dist FROM m GROUP BY lang""")
def doc_edit_similarity(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("lang", similarity.edit_distance_share(F.col("pred"), F.col("truth")).alias("edit_dist"))
    return metrics.summarise(p, "lang")


@query(rf"""WITH {_PAIRS}, t AS (SELECT lang, length(pred) >= 4 AND length(truth) >= 4 AS ok, list_distinct(regexp_extract_all(pred, '\S+')) AS p, list_distinct(regexp_extract_all(truth, '\S+')) AS t FROM pairs),
s AS (SELECT lang, ok, CASE WHEN len(p) > 0 THEN len(list_intersect(p, t)) / len(p) END AS pr, CASE WHEN len(t) > 0 THEN len(list_intersect(p, t)) / len(t) END AS re FROM t)
SELECT lang, count(*) AS n, round(avg(CASE WHEN ok THEN pr END), 6) AS "precision", round(avg(CASE WHEN ok THEN re END), 6) AS recall,
round(avg(CASE WHEN ok THEN CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) WHEN pr + re = 0 THEN 0.0 END END), 6) AS f_measure FROM s GROUP BY lang""")
def token_set_prf(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    s = similarity.set_scores(F.col("pred"), F.col("truth"))
    return metrics.summarise(p.select("lang", s.alias("s")).select("lang", "s.*"), "lang")


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\n])\n([^\n\d*#\[])', '\1 \2', 'g'), '(^|[^\n])\n([^\n\d*#\[])', '\1 \2', 'g'), '^\s+', ''), '\s+$', '')) AS cleaned FROM documents""")
def linebreak_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.remove_pretty_linebreaks("text")).alias("cleaned"))


@query(f"SELECT doc_id, md5({replaced('text', text.LIGATURES.items())}) AS fixed FROM documents")
def ligature_fix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.replace_ligatures("text")).alias("fixed"))


@query(f"SELECT doc_id, lower({replaced('text', text.SPECIAL)}) AS plain FROM documents")
def strip_special_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_special_chars("text").alias("plain"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[0-9_]|\*\*', '', 'g'), '^\s+', ''), '\s+$', '') AS plain FROM documents")
def digits_removed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.remove_numbers("text").alias("plain"))


@query(f"SELECT doc_id, {replaced(replaced('text', text.SYNONYMS), text.STYLES)} AS tex FROM documents")
def latex_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.remove_styles(text.latex_synonyms("text")).alias("tex"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\n+\s+?([^\s])', chr(10) || chr(10) || '\1', 'g'), '^\s+', ''), '\s+$', '') AS ocr FROM documents")
def ocr_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.ocr_cleanup("text").alias("ocr"))


@query("SELECT doc_id, translate(text, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS raised, translate(text, '0123456789', '₀₁₂₃₄₅₆₇₈₉') AS lowered FROM documents")
def digit_scripts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.superscript("text").alias("raised"), text.subscript("text").alias("lowered"))


@query(r"SELECT page_id, list_aggregate(list_transform(string_split(url, ''), lambda c: coalesce(map {'&': '\&', '%': '\%', '$': '\$', '#': '\#', '_': '\_', '{': '\{', '}': '\}', '~': '\textasciitilde{}', '^': '\^{}', '\': '\textbackslash{}', '<': '\textless{}', '>': '\textgreater{}'}[c], c)), 'string_agg', '') AS escaped FROM pages")
def latex_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.latex_escape("url").alias("escaped"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), u AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM l)
SELECT doc_id, pos, line FROM u WHERE length(line) >= 3""")
def short_line_filter(spark, sf_dir):
    return pages.document_lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query(f"""WITH w AS (SELECT source, unnest(list_filter(string_split(lower(text), ' ')[1:10], lambda x: x <> '')) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT source, count(*) AS pages FROM documents GROUP BY source)
SELECT source, word, round(n / pages, 6) AS share FROM c JOIN s USING (source) WHERE word NOT IN ({', '.join(map(literal, pages.HEADER_STOP))}) AND NOT starts_with(word, chr(92)) AND n >= 0.02 * pages""")
def header_word_df(spark, sf_dir):
    return pages.header_words(table(spark, sf_dir, "documents"), "source", "text", share=0.02)


@query(r"""SELECT conv_id, regexp_replace(regexp_replace(regexp_replace(string_agg(text, '' ORDER BY turn, text), '^\s+', ''), '\s+$', ''), '\n{3,}', chr(10) || chr(10), 'g') AS document FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def doc_reassembly(spark, sf_dir):
    return pages.assemble(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("SELECT doc_id, CAST(sum(octet_length(encode(text)) + 1) OVER (ORDER BY doc_id) - octet_length(encode(text)) - 1 AS BIGINT) AS \"offset\" FROM documents")
def seek_map(spark, sf_dir):
    return files.seek_map(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 1) AS a FROM documents), u AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM l),
s AS (SELECT doc_id, CAST(1 + floor(600 * count(*) / sum(length(line))) AS BIGINT) AS per FROM u GROUP BY doc_id)
SELECT doc_id, CAST(floor(pos / per) AS BIGINT) AS chunk, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM u JOIN s USING (doc_id) GROUP BY ALL""")
def chunk_lines(spark, sf_dir):
    return pages.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH s AS (SELECT conv_id, turn, least(1.0, length(text) / 100.0)::DOUBLE AS score FROM conversations), p AS (SELECT *, (score + coalesce(lead(score) OVER (PARTITION BY conv_id ORDER BY turn), 1.0)) / 2 AS m FROM s)
SELECT conv_id, turn, round(m, 6) AS page_score FROM p WHERE m >= 0.9""")
def adjacent_page_score(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.least(F.lit(1.0), F.length("text") / 100.0).alias("score"))
    return pages.accepted_pages(c, "conv_id", "turn", "score").select("conv_id", "turn", "page_score")


_CENTS = "e AS (SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE value IS NOT NULL)"


def _cents(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("v"))


@query(f"""WITH {_CENTS}, w AS (SELECT event_id, count(v) OVER x AS n, sum(v) OVER x AS s, sum(v * v) OVER x AS q FROM e WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 14 PRECEDING))
SELECT event_id, round(CASE WHEN n > 1 THEN (n * q - s * s)::DOUBLE / (n * (n - 1)) / n ELSE 0.0 END, 4) AS running_variance FROM w""")
def running_variance(spark, sf_dir):
    return windows.running_variance(_cents(spark, sf_dir), "user_id", ["ts", "event_id"], "v").select("event_id", F.round("running_variance", 4).alias("running_variance"))


@query(f"""WITH {_CENTS}, w AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS a, count(v) OVER x AS n, sum(v) OVER x AS s, sum(v * v) OVER x AS q FROM e WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT event_id, pos, round((n * q - s * s)::DOUBLE / (n * n) / 4, 4) AS sliding_variance FROM w WHERE pos < a - 4""")
def sliding_variance(spark, sf_dir):
    w = windows.sliding_variance(_cents(spark, sf_dir), "user_id", ["ts", "event_id"], "v", 4)
    return w.select("event_id", F.col("pos").cast("bigint").alias("pos"), F.round("sliding_variance", 4).alias("sliding_variance"))


@query(f"""WITH {_CENTS}, w AS (SELECT event_id, count(v) OVER x AS n, sum(v) OVER x AS s, sum(v * v) OVER x AS q FROM e WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, round((n * q - s * s)::DOUBLE / (n * n), 4) AS suffix_variance FROM w WHERE n >= 10""")
def suffix_variance(spark, sf_dir):
    return windows.suffix_variance(_cents(spark, sf_dir), "user_id", ["ts", "event_id"], "v").select("event_id", F.round("suffix_variance", 4).alias("suffix_variance"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), u AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM l),
n AS (SELECT *, first_value(CASE WHEN line <> '' THEN {'p': pos, 'l': line} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS x FROM u),
f AS (SELECT DISTINCT doc_id, unnest(range(pos, x.p)) AS f FROM n WHERE x.l = line AND length(line) > 3 AND length(line) < 200 AND NOT starts_with(line, '[MISSING_PAGE')),
g AS (SELECT doc_id, f, coalesce(f - lag(f) OVER (PARTITION BY doc_id ORDER BY f), 0) > 3 AS b FROM f), i AS (SELECT doc_id, f, sum(b::INT) OVER (PARTITION BY doc_id ORDER BY f) AS i FROM g)
SELECT doc_id, min(f) AS first_line, max(f) + 2 AS end_line FROM i GROUP BY doc_id, i HAVING max(f) + 2 - min(f) > 2""")
def near_dup_line_islands(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return windows.line_islands(lines.withColumn("pos", F.col("pos").cast("bigint")), "doc_id", "pos", "line", least=2)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def doc_skip_anti(spark, sf_dir):
    return pages.not_done(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_left_join(spark, sf_dir):
    return pages.with_optional(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("""SELECT conv_id, count(*) AS pages, count(*) FILTER (length(text) > 0) AS recognised, round(100 * count(*) FILTER (length(text) > 0) / greatest(1, count(*)), 6) AS percentage FROM conversations GROUP BY conv_id HAVING count(*) FILTER (length(text) > 0) > 0""")
def page_count_recognised(spark, sf_dir):
    return pages.recognised_pages(table(spark, sf_dir, "conversations"), "conv_id", "text")


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice * (96 / 72.0)::DOUBLE, 0) AS BIGINT) AS px FROM lineitem")
def figure_px(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pages.to_pixels(F.col("l_extendedprice")).alias("px"))


@query("SELECT page_id, md5(html) AS hash FROM pages")
def page_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5("html").alias("hash"))


@query("SELECT conv_id, turn, role, text, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM conversations")
def last_page_flag(spark, sf_dir):
    return pages.last_of_document(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""SELECT conv_id, turn, CASE WHEN text = '[MISSING_PAGE_POST]' THEN chr(10) || chr(10) || '[MISSING_PAGE_EMPTY:' || turn || ']' || chr(10) || chr(10)
WHEN turn % 3 > 0 THEN chr(10) || chr(10) || '[MISSING_PAGE_FAIL:' || turn || ']' || chr(10) || chr(10) WHEN turn % 5 = 0 THEN chr(10) || chr(10) || '[MISSING_PAGE_EMPTY:' || turn || ']' || chr(10) || chr(10) ELSE text END AS page FROM conversations""")
def missing_page_markers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    repeats = F.when(F.col("turn") % 3 > 0, F.col("turn") % 3).when(F.col("turn") % 5 == 0, F.lit(0))
    return c.select("conv_id", "turn", pages.page_marker(F.col("text"), F.col("turn"), repeats).alias("page"))


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, round(sum(n) - sum(n * n)::DOUBLE / sum(n), 6) AS gini FROM c GROUP BY source")
def language_gini(spark, sf_dir):
    return windows.gini(table(spark, sf_dir, "documents"), "source", "lang").select("source", F.round("gini", 6).alias("gini"))


@query("""WITH m AS (SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS med FROM events) SELECT event_type, round(med, 6) AS median, round(median(abs(value - med)), 6) AS mad FROM m GROUP BY event_type, med""")
def class_spread(spark, sf_dir):
    return windows.class_spread(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("SELECT event_id, CAST((value > 2)::INT + (value > 7)::INT + (value > 30)::INT AS INT) AS step, CASE WHEN value >= 30 THEN 2 WHEN value >= 7 THEN 1 WHEN value >= 2.5 THEN 0 END::BIGINT AS last_break FROM events WHERE value IS NOT NULL")
def staircase_steps(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    breaks = F.array(F.lit(2.5), F.lit(7.0), F.lit(30.0))
    return e.select("event_id", windows.staircase(F.col("value"), breaks).alias("step"), windows.last_break(F.col("value"), breaks).alias("last_break"))


@query("""WITH c AS (SELECT l_returnflag, l_linenumber, l_linestatus, count(*) AS n, min(l_orderkey) AS f FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linenumber, l_linestatus FROM c QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY n DESC, f) = 1""")
def column_spec_mode(spark, sf_dir):
    return windows.column_spec_mode(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", "l_linestatus", "l_orderkey")


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:5], ' ') AS head, array_to_string(string_split(text, ' ')[-5:], ' ') AS tail FROM documents")
def edge_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(pages.first_words(F.col("text"), 5), " ").alias("head"), F.array_join(pages.last_words(F.col("text"), 5), " ").alias("tail"))


@query(r"SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, '\[(?:\?\?(?:. )?)+\]')")
def unresolved_filter(spark, sf_dir):
    return pages.without_unresolved(table(spark, sf_dir, "documents")).select("doc_id", "lang")


@query("""WITH p AS (SELECT conv_id, turn, text FROM conversations), c AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE turn % 2 = 0) SELECT p.conv_id, p.turn, c.text AS cached_text, c.text IS NOT NULL AS cached FROM p LEFT JOIN c USING (conv_id, turn)""")
def page_cache(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return pages.fill_from_cache(c.select("conv_id", "turn"), c.where("turn % 2 = 0").distinct(), ["conv_id", "turn"])


@query()
def modality_metrics(spark, sf_dir):
    return metrics.summarise(metrics.page_metrics(metrics.by_modality(_pairs(spark, sf_dir)), bleu=True), "modality")


@query()
def truncate_repetitions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", repetition.truncate_repetitions("text").alias("text"))


@query()
def missing_page_post(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", repetition.remove_hallucinated_references("text").alias("text"))


@query()
def postprocess_pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", repetition.postprocess("text").alias("text"))


@query()
def html_markdown(spark, sf_dir):
    # the pages aren't papers, so each is taken as the article of one
    page = F.concat(F.lit("<article>"), "html", F.lit("</article>"))
    return table(spark, sf_dir, "pages").select("page_id", html.to_markdown(page).alias("x")).select("page_id", "x.*")


@query()
def fuzzy_ratio(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("doc_id", similarity.ratio("pred", "truth").alias("ratio"))


@query()
def fuzzy_position(spark, sf_dir):
    p = _pairs(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)  # small files, much work a row
    first = F.array_join(pages.first_words(F.col("truth"), 3), " ")
    return p.select("doc_id", "item_id", similarity.fuzzy_position(first, F.col("pred")).alias("x")).select("doc_id", "item_id", "x.*")


@query()
def split_documents(spark, sf_dir):
    """Conversations as papers whose turns are pages: each is to come out again as it went in."""
    c = table(spark, sf_dir, "conversations").where("length(text) > 0")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    papers = c.groupBy("conv_id").agg(turns.alias("texts")).select(
        F.col("conv_id").cast("string").alias("paper_id"), F.array_join("texts", "\n\n").alias("markdown"), F.transform("texts", lambda t: F.split(t, r"(?<=[.?!,]) ")).alias("pages"),
        F.lit(None).cast("array<struct<page:int,caption:string,text:string,figType:string>>").alias("figures"), F.lit(None).cast("map<string,string>").alias("bodies"),
    )
    return splitting.split_documents(papers.repartition(4 * spark.sparkContext.defaultParallelism))  # few bytes, much work a row
