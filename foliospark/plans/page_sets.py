"""Joins, sets, files and records of pages.  Files are written below the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import similarity
from foliospark.operators import pages
from foliospark.sources import files
from foliospark.sources.shared import scratch

from .registry import query, table


@query("SELECT lang, text AS dumped FROM documents WHERE length(text) > 0")
def modality_dump(spark, sf_dir):
    path = scratch(spark, "dumps")
    files.write_dumps(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", path)
    return files.read_dumps(spark, path).select("lang", F.col("value").alias("dumped"))


@query("SELECT doc_id AS image, trim(text) AS markdown, CASE WHEN doc_id % 3 = 0 THEN 'ocr/' || doc_id END AS ocr FROM documents WHERE doc_id % 4 > 0")
def index_round_trip(spark, sf_dir):
    path, d = scratch(spark, "index"), table(spark, sf_dir, "documents")
    rows = d.select(F.when(F.col("doc_id") % 4 > 0, F.col("doc_id").cast("string")).alias("image"), F.trim("text").alias("markdown"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ocr/"), "doc_id")).alias("ocr"))
    files.write_index(rows, path)
    return files.read_index(spark, path).select(F.col("image").cast("bigint").alias("image"), "markdown", "ocr")


@query("""SELECT item_id, reverse(text) AS pred, text AS truth FROM benchmark ORDER BY item_id LIMIT 25""")
def results_round_trip(spark, sf_dir):
    path = scratch(spark, "results")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.reverse("text").alias("pred"), F.col("text").alias("truth"), F.length("text").alias("size"))
    files.write_results(b, "item_id", path, {"length": "size"})
    return files.read_results(spark, path, 25).select(F.col("pos").cast("bigint").alias("item_id"), "pred", "truth")


@query(r"""SELECT source AS paper_id, doc_id AS page_no, text FROM documents WHERE length(text) > 0 AND NOT regexp_matches(text, '\[(?:\?\?(?:. )?)+\]')""")
def page_sink(spark, sf_dir):
    path = scratch(spark, "pages")
    files.write_pages(table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("page_no"), "text"), path)
    return spark.read.parquet(path).select("paper_id", "page_no", "text")


@query(r"""SELECT conv_id, md5(regexp_replace(regexp_replace(regexp_replace(string_agg(text, '' ORDER BY turn, text), '^\s+', ''), '\s+$', ''), '\n{3,}', chr(10) || chr(10), 'g')) AS document FROM conversations WHERE text IS NOT NULL GROUP BY conv_id HAVING length(trim(string_agg(text, ''))) > 0""")
def prediction_sink(spark, sf_dir):
    path = scratch(spark, "predictions")
    files.write_predictions(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("page_no"), "text"), path)
    return spark.read.parquet(path).select(F.col("paper_id").alias("conv_id"), F.md5("markdown").alias("document"))


@query("SELECT DISTINCT md5(source) AS md5, doc_id AS page_no, text FROM documents")
def cache_sink(spark, sf_dir):
    path = scratch(spark, "cache")
    d = table(spark, sf_dir, "documents").select(F.md5("source").alias("md5"), F.col("doc_id").alias("page_no"), "text")
    files.write_cache(d.unionByName(d), path)
    return spark.read.parquet(path)


@query("""WITH p AS (SELECT conv_id, turn, least(1.0, length(text) / 100.0)::DOUBLE AS score FROM conversations), s AS (SELECT conv_id, turn, max(score) AS score FROM p GROUP BY ALL)
SELECT conv_id, turn::VARCHAR AS page, round(score, 6) AS score, count(*) OVER (PARTITION BY conv_id) AS num_pages, printf('%02d_s=%.2f.mmd', turn, score) AS name FROM s""")
def meta_records(spark, sf_dir):
    path = scratch(spark, "meta")
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), (F.col("turn") + 1).alias("page_no"), F.least(F.lit(1.0), F.length("text") / 100.0).alias("score"))
    files.write_meta(p.groupBy("paper_id", "page_no").agg(F.max("score").alias("score")), path)
    m = spark.read.schema("paper_id bigint, num_pages bigint, page_scores map<string,double>").json(path).select(F.col("paper_id").alias("conv_id"), "num_pages", F.explode("page_scores").alias("page", "score"))
    return m.select("conv_id", "page", F.round("score", 6).alias("score"), "num_pages", files.scored_name(F.col("page").cast("int"), F.col("score")).alias("name"))


@query("""WITH p AS (SELECT doc_id // 10 AS paper_id, doc_id % 10 + 1 AS page_no, text FROM documents), i AS (SELECT doc_id // 10 AS paper_id, doc_id % 10 + 1 AS page_no, 'img/' || doc_id AS image FROM documents WHERE doc_id % 6 < 5),
o AS (SELECT doc_id // 10 AS paper_id, doc_id % 10 + 1 AS page_no, 'ocr/' || doc_id AS ocr FROM documents WHERE doc_id % 3 = 0), n AS (SELECT doc_id // 10 AS paper_id, 5 + (doc_id // 10) % 5 AS num_pages FROM documents WHERE (doc_id // 10) % 9 > 0 GROUP BY ALL),
f AS (SELECT doc_id // 10 AS paper_id, doc_id AS pos, CASE WHEN doc_id % 7 > 0 THEN doc_id * 7 % 12 END AS page, CASE WHEN doc_id % 5 > 1 THEN 'c' || doc_id WHEN doc_id % 5 = 1 THEN 't' || doc_id END AS caption FROM documents),
g AS (SELECT paper_id, page + 1 AS page_no, string_agg(caption, ',' ORDER BY pos) AS figures FROM f JOIN n USING (paper_id) WHERE page IS NOT NULL AND page < num_pages AND caption IS NOT NULL GROUP BY ALL)
SELECT paper_id, page_no, image, md5(trim(text)) AS markdown, ocr, coalesce(figures, '') AS figures FROM p JOIN i USING (paper_id, page_no) JOIN n USING (paper_id) LEFT JOIN o USING (paper_id, page_no) LEFT JOIN g USING (paper_id, page_no) WHERE page_no <= num_pages""")
def page_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumns({"paper_id": F.floor(F.col("doc_id") / 10).cast("bigint"), "page_no": F.col("doc_id") % 10 + 1})
    images = d.where("doc_id % 6 < 5").select("paper_id", "page_no", F.concat(F.lit("img/"), "doc_id").alias("image"))
    ocr = d.where("doc_id % 3 = 0").select("paper_id", "page_no", F.concat(F.lit("ocr/"), "doc_id").alias("ocr"))
    papers = d.where("paper_id % 9 > 0").select("paper_id", (5 + F.col("paper_id") % 5).alias("num_pages")).distinct()
    figures = d.select(
        "paper_id", F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") * 7 % 12).alias("page"), F.when(F.col("doc_id") % 5 > 1, F.concat(F.lit("c"), "doc_id")).alias("caption"),
        F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("t"), "doc_id")).alias("text"), F.lit("Figure").alias("fig_type"),
    )
    out = pages.index_pages(d.select("paper_id", "page_no", "text"), images, figures, papers, ocr)
    return out.select("paper_id", "page_no", "image", F.md5("markdown").alias("markdown"), "ocr", F.array_join(F.transform("meta", lambda f: f["caption"]), ",").alias("figures"))


@query("""WITH m AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'broken {' ELSE '{"num_pages": ' || (event_id % 9) || ', "pdffigures": [{"page": ' || (event_id % 4) || ', "caption": "' || event_type || '"}]}' END AS j FROM events)
SELECT event_id, CAST(j->>'$.num_pages' AS INT) AS num_pages, CAST(j->>'$.pdffigures[0].page' AS INT) AS page, j->>'$.pdffigures[0].caption' AS caption FROM m WHERE json_valid(j)""")
def meta_files(spark, sf_dir):
    j = F.when(F.col("event_id") % 5 == 0, "broken {").otherwise(F.format_string('{"num_pages": %d, "pdffigures": [{"page": %d, "caption": "%s"}]}', F.col("event_id") % 9, F.col("event_id") % 4, F.col("event_type")))
    m = files.read_meta(table(spark, sf_dir, "events").select("event_id", j.alias("value")))
    return m.select("event_id", "meta.num_pages", F.col("meta.pdffigures")[0]["page"].alias("page"), F.col("meta.pdffigures")[0]["caption"].alias("caption"))


@query("""WITH m AS (SELECT event_id, event_type AS c FROM events), f AS (SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN [c || '1', c || '2'] WHEN event_id % 3 = 1 THEN [c || '1', c || '2', c || '3'] ELSE [] END) AS caption FROM m) SELECT event_id, caption FROM f""")
def figure_files(spark, sf_dir):
    c, k = F.col("event_type"), F.col("event_id") % 3
    j = F.when(k == 0, F.format_string('[{"page": 0, "caption": "%s1"}, {"caption": "%s2"}]', c, c)).when(k == 1, F.format_string('{"Figure": [{"caption": "%s1"}, {"caption": "%s2"}], "Table": [{"caption": "%s3"}]}', c, c, c)).otherwise("null")
    return table(spark, sf_dir, "events").select("event_id", F.explode(files.figure_list(j)).alias("f")).select("event_id", "f.caption")


@query(r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10)) AS a FROM documents) SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS paragraph FROM p""")
def text_paragraphs(spark, sf_dir):
    p = files.paragraphs(table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n\n")).alias("text")), "doc_id", "text")
    return p.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "paragraph")


@query(r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), ', ', chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10)) AS b FROM documents), l AS (SELECT doc_id, b, list_filter(flatten(list_transform(b, lambda x: string_split(x, chr(10)))), lambda q: length(q) > 10) AS l FROM p)
SELECT doc_id, len(b) AS blocks, len(l) AS lines, md5(array_to_string(l, '|')) AS content FROM l""")
def page_text_lines(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit(". "), F.lit(".\n\n\n")), F.lit(", "), F.lit("\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", files.page_lines(t, lines=False).alias("b"), files.page_lines(t).alias("l"))
    return d.select("doc_id", F.size("b").cast("bigint").alias("blocks"), F.size("l").cast("bigint").alias("lines"), F.md5(F.array_join("l", "|")).alias("content"))


@query("""WITH t AS (SELECT doc_id, source || 'v' || (doc_id % 3) AS id FROM documents), d AS (SELECT split_part(event_type || 'v9', 'v', 1) AS p FROM events UNION SELECT min(source) FROM documents) SELECT doc_id, id FROM t WHERE split_part(id, 'v', 1) NOT IN (SELECT p FROM d)""")
def versions_not_done(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    todo = d.select("doc_id", F.concat("source", F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("id"))
    done = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("v9")).alias("id")).unionByName(d.agg(F.concat(F.min("source"), F.lit("v7")).alias("id")))
    return pages.not_done(todo, done, "id", versions=True).select("doc_id", "id")


@query("SELECT conv_id, turn, text FROM conversations WHERE turn BETWEEN 2 AND 4")
def requested_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return pages.page_range(c, 2, 4, "turn").select("conv_id", "turn", "text")


@query("SELECT d.doc_id, l.toxic, 'match' AS kind FROM documents d JOIN labels l USING (doc_id) UNION ALL SELECT doc_id, NULL, 'alone' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def stems_paired(spark, sf_dir):
    both, alone = pages.paired(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    return both.select("doc_id", "toxic", F.lit("match").alias("kind")).unionByName(alone.select("doc_id", F.lit(None).cast("int").alias("toxic"), F.lit("alone").alias("kind")))


@query("SELECT doc_id AS id, text, 'documents' AS part FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark")
def datasets_joined(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return d.select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("part")).unionByName(b.select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("part")))


@query("SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS path FROM pages")
def unique_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("path")).distinct()


@query("SELECT conv_id, turn FROM conversations EXCEPT ALL SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0")
def pages_to_compute(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return c.exceptAll(c.where("turn % 2 = 0"))


@query("WITH f AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' '))) AS w FROM documents) SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: length(x) > 10)) AS long_ones, md5(array_to_string(w, '|')) AS words FROM f")
def flattened_words(spark, sf_dir):
    w = F.flatten(F.transform(F.split("text", "\n", -1), lambda x: F.split(x, " ", -1)))
    d = table(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n"), F.size(pages.longer_than(F.col("w"))).cast("bigint").alias("long_ones"), F.md5(F.array_join("w", "|")).alias("words"))


@query("SELECT doc_id, md5('7:' || doc_id) AS shuffle_key, row_number() OVER (ORDER BY md5('7:' || doc_id)) AS place FROM documents ORDER BY shuffle_key LIMIT 300")
def shuffled_head(spark, sf_dir):
    from pyspark.sql import Window

    head = pages.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7).limit(300)
    return head.withColumn("place", F.row_number().over(Window.orderBy("shuffle_key")))


@query("""WITH f AS (SELECT event_type AS page, event_id AS pos, CAST(round(value * 100) AS BIGINT) % 1000 AS start, event_id % 9 AS length, (event_id % 100) / 100.0 AS score FROM events WHERE value IS NOT NULL)
SELECT page, pos, start, row_number() OVER (PARTITION BY page ORDER BY start DESC, pos) AS turn FROM f WHERE score > 0.8 AND length > 0""")
def figure_spots(spark, sf_dir):
    f = table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("page"), F.col("event_id").alias("pos"), (F.round(F.col("value") * 100).cast("bigint") % 1000).alias("start"), (F.col("event_id") % 9).alias("length"), ((F.col("event_id") % 100) / 100.0).alias("score"))
    return pages.without_figure_spots(f, "page").select("page", "pos", "start", F.col("turn").cast("bigint").alias("turn"))


@query("SELECT d.doc_id, reverse(d.text) AS text FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL AND d.text IS NOT NULL")
def prepared_batches(spark, sf_dir):
    joined = pages.with_optional(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), "doc_id")
    return pages.with_callable(pages.complete(joined), "text", lambda s: s[::-1]).select("doc_id", "text")


@query("SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents")
def records_split(spark, sf_dir):
    r = pages.split_record(table(spark, sf_dir, "documents"), "doc_id", "text")
    return r.select("doc_id", F.md5("text").alias("text"), "meta.*")


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 1 THEN chr(10) || chr(10) || '[MISSING_PAGE_FAIL:' || turn || ']' || chr(10) || chr(10) WHEN turn % 5 = 2 THEN chr(10) || chr(10) || '[MISSING_PAGE_EMPTY:' || turn || ']' || chr(10) || chr(10)
ELSE replace(regexp_replace(replace(text, ' the ', ' \\. http://a.org/b '), '((?:https?|ftp)://[\\w-]+(?:\\.[\\w-]+)+[\\w.,@?^=%&:/~+#-]*[\\w@?^=%&/~+#-])', '[\\1](\\1)', 'g'), '\\. ', '. ') END AS page FROM conversations""".replace("\\\\", "\\"))
def page_output(spark, sf_dir):
    repeats = F.when(F.col("turn") % 5 == 1, 3).when(F.col("turn") % 5 == 2, 0)
    t = F.replace("text", F.lit(" the "), F.lit(" \\. http://a.org/b "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pages.page_marker(t, F.col("turn"), repeats, markdown=True).alias("page"))


@query(r"""WITH m AS (SELECT doc_id, replace(replace(replace(text, '. ', '\) '), ', ', ' \[v\] \('), chr(10), '\begin{tabular}x\end{tabular}') AS p FROM documents), a AS (SELECT doc_id, regexp_extract_all(p, '\\\((.*?)\\\)', 1) AS i, regexp_replace(p, '\\\((.*?)\\\)', '', 'g') AS p FROM m),
b AS (SELECT doc_id, i, regexp_extract_all(p, '\\\[(.+?)\\\]', 1) AS d, regexp_replace(p, '\\\[(.+?)\\\]', '', 'g') AS p FROM a)
SELECT doc_id, array_to_string(i, chr(10)) || array_to_string(d, chr(10)) AS math, array_to_string(regexp_extract_all(p, '(?s)\\begin\{tabular\}(.+?)(?:\\end\{tabular\}|\z)', 1), chr(10)) AS tables, trim(regexp_replace(p, '(?s)\\begin\{tabular\}(.+?)(?:\\end\{tabular\}|\z)', '', 'g')) AS text FROM b""")
def modality_split(spark, sf_dir):
    t = F.replace(F.replace(F.replace("text", F.lit(". "), F.lit("\\) ")), F.lit(", "), F.lit(" \\[v\\] \\(")), F.lit("\n"), F.lit("\\begin{tabular}x\\end{tabular}"))
    return table(spark, sf_dir, "documents").select("doc_id", similarity.modalities(t).alias("m")).select("doc_id", "m.math", "m.tables", "m.text")


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, '{\"k\":' || CAST(props->>'$.k' AS BIGINT) || '}' AS again FROM events WHERE json_valid(props)")
def json_records(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("x", F.from_json("props", "k bigint")).where("x is not null")
    return e.select("event_id", "x.k", F.to_json("x").alias("again"))
