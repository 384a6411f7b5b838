"""Files as tables, and tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX = "image string, markdown string, ocr string, meta array<struct<page:int,caption:string,text:string,figType:string>>, _corrupt_record string"


def stem(path: str = "path"):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, html) of *.html; hard blanks become blanks."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.html").select(stem("_metadata.file_path").alias("paper_id"), "value")
    return raw.select("paper_id", F.translate("value", " ", " ").alias("html"))


def read_binary(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(paper_id, md5, content) of files at any depth."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return raw.select(stem().alias("paper_id"), F.md5("content").alias("md5"), "content")


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.mmd") -> DataFrame:
    """(paper_id, page_no, text) from <paper>/<page>.mmd at any depth."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    path = F.col("_metadata.file_path")
    return raw.select(F.element_at(F.split(path, "/"), -2).alias("paper_id"), F.regexp_extract(path, r"(\d+)[^/]*$", 1).cast("int").alias("page_no"), F.col("value").alias("text"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A page index of JSON lines; broken lines and those without an image are left out."""
    rows = spark.read.schema(INDEX).json(path, mode="PERMISSIVE")
    return rows.where("_corrupt_record is null and image is not null").drop("_corrupt_record")


def figure_list(json: str | Column) -> Column:
    """The figures of a figure file, whether it holds a list or lists by kind; null for anything else."""
    x = F.trim(F.col(json) if isinstance(json, str) else json)
    one = "struct<page:int,caption:string,text:string,figType:string>"
    flat = F.flatten(F.map_values(F.from_json(x, f"map<string,array<{one}>>")))
    return F.when(x.startswith("["), F.from_json(x, f"array<{one}>")).when(x.startswith("{"), flat)


def read_meta(raw: DataFrame, json: str = "value") -> DataFrame:
    """raw with `meta` of papers' meta files; papers whose file can't be read are left out."""
    schema = "num_pages int, pdffigures array<struct<page:int,caption:string,text:string,figType:string>>, page_scores map<string,double>, _broken string"
    out = raw.withColumn("meta", F.from_json(json, schema, {"columnNameOfCorruptRecord": "_broken"}))
    return out.where("meta is not null and meta._broken is null").withColumn("meta", F.col("meta").dropFields("_broken"))


def with_images(index: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Index rows whose image exists."""
    return index.join(images.select(*keys), keys, "left_semi")


def existing(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(path) of the files that paths, with * in them or not, stand for; each once."""
    jvm, found = spark.sparkContext._jvm, set()
    for x in patterns:
        p = jvm.org.apache.hadoop.fs.Path(x)
        found |= {str(f.getPath()) for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []}
    return spark.createDataFrame([(x,) for x in sorted(found)], "path string")


def listed_paths(spark: SparkSession, list_file: str) -> DataFrame:
    """(path) of a file with a path on each line that isn't blank."""
    return spark.read.text(list_file).select(F.trim("value").alias("path")).where("path <> ''")


def split_index(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The page index of a split; ValueError if there is none."""
    at = split_path(path, split)
    if existing(spark, [at]).isEmpty():
        raise ValueError(f"no index for {split}: {at}")
    return read_index(spark, at)


@F.pandas_udf(T.IntegerType())
def pdf_pages(content):
    """Pages of a PDF: its page objects, also those in compressed object streams; null for what isn't a PDF."""
    import re
    import zlib

    import pandas as pd

    def count(data: bytes | None) -> int | None:
        if data is None or not bytes(data).startswith(b"%PDF"):
            return None
        data = bytes(data)
        parts = [data]
        for m in re.finditer(rb"/ObjStm\b[^>]*>>\s*stream\r?\n", data):
            try:
                parts.append(zlib.decompressobj().decompress(data[m.end() :]))
            except zlib.error:
                continue
        return sum(len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", x)) for x in parts)

    return pd.Series([count(x) for x in content], dtype="Int32")


def paragraphs(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, paragraph): texts cut at empty lines, of which several in a row count as one."""
    return pages.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"\n\n", -1)).alias("pos", "paragraph"))


def page_lines(text: str | Column, lines: bool = True, blocks: bool = True, least: int = 10) -> Column:
    """The lines of a page, or its blocks, or both undone; only lines are held to be longer than `least`."""
    x = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"\n\n", -1) if blocks else F.array(x)
    return F.filter(F.flatten(F.transform(parts, lambda b: F.split(b, "\n", -1))), lambda q: F.length(q) > least) if lines else parts


def split_path(path: str, split: str) -> str:
    """The index of a split: the path itself if its name holds the split's, else with the split's name in front."""
    head, _, name = path.rpartition("/")
    base = name.rsplit(".", 1)[0]
    return path if split in base else f"{head + '/' if head else ''}{split}.jsonl"


def page_numbers(spec: str) -> list[int]:
    """1-based numbers of "1-4,7"."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.partition("-")
        out += range(int(a), int(b or a) + 1)
    return out


def read_results(spark: SparkSession, path: str, head: int = -1) -> DataFrame:
    """(pos, pred, truth) of an evaluation's JSON file; the shorter list decides."""
    raw = spark.read.schema("predictions array<string>, ground_truths array<string>").json(path, multiLine=True)
    n = F.least(F.size("predictions"), F.size("ground_truths"))
    rows = raw.select(F.posexplode(F.slice(F.arrays_zip("predictions", "ground_truths"), F.lit(1), F.greatest(n, F.lit(0)))).alias("pos", "x"))
    rows = rows.select("pos", F.col("x.predictions").alias("pred"), F.col("x.ground_truths").alias("truth"))
    return rows.where(F.col("pos") < head) if head >= 0 else rows


def seek_map(lines: DataFrame, order: str, text: str, buckets: int = 0) -> DataFrame:
    """(order, offset): the byte at which every line begins, each followed by one line break.

    Sums run in ranges of the (numeric) order and are carried on by the ranges' totals, so no one
    task sees all lines; only one total for each range goes through a single window."""
    n = int(buckets or lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = lines.select(order, (F.octet_length(text) + 1).cast("bigint").alias("size"))
    ends = size.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    part = size.crossJoin(F.broadcast(ends)).select(order, "size", F.floor((F.col(order) - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * n).alias("part"))
    w = Window.partitionBy("part").orderBy(order)
    inner = part.withColumn("within", F.sum("size").over(w) - F.col("size"))
    total = part.groupBy("part").agg(F.sum("size").alias("all"))
    before = total.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    return inner.join(before, "part").select(order, (F.col("within") + F.col("before")).alias("offset"))


def write_index(pages: DataFrame, path: str) -> None:
    """JSON lines; absent fields are left out."""
    pages.write.mode("overwrite").json(path, ignoreNullFields=True)


def write_pages(pages: DataFrame, path: str) -> None:
    """One folder a paper; empty pages and such with unresolved references are left out."""
    from foliospark.operators.pages import without_unresolved

    without_unresolved(pages.where("length(text) > 0")).write.mode("overwrite").partitionBy("paper_id").parquet(path)


def write_page_texts(pages: DataFrame, path: str) -> None:
    """Text files paper_id=.../page_no=.../, without empty pages and those with unresolved references."""
    from foliospark.operators.pages import without_unresolved

    rows = without_unresolved(pages.where("length(text) > 0")).select("paper_id", "page_no", "text")
    rows.write.mode("overwrite").partitionBy("paper_id", "page_no").text(path)


def paper_meta(pages: DataFrame) -> DataFrame:
    """One row for each paper: num_pages and page_scores by 0-based page."""
    scores = F.map_from_entries(F.array_sort(F.collect_list(F.struct((F.col("page_no") - 1).cast("string").alias("key"), F.col("score").alias("value")))))
    return pages.groupBy("paper_id").agg(F.count("*").alias("num_pages"), scores.alias("page_scores"))


def write_meta(pages: DataFrame, path: str) -> None:
    paper_meta(pages).write.mode("overwrite").json(path)


def scored_name(page: Column, score: Column) -> Column:
    """The name of a page's file with its score."""
    return F.format_string("%02d_s=%.2f.mmd", page, score)


def write_documents(documents: DataFrame, path: str) -> None:
    """(paper_id, markdown) of whole documents; those without text are left out."""
    documents.select("paper_id", "markdown").where("length(markdown) > 0").write.mode("overwrite").parquet(path)


def write_predictions(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages put together into documents, written if a path is given."""
    from foliospark.operators.pages import assemble

    out = assemble(pages, "paper_id", "page_no", "text").withColumnRenamed("document", "markdown")
    if path:
        write_documents(out, path)
    return out


def write_cache(pages: DataFrame, path: str) -> None:
    """Pages by the hash of the file they came from, for later requests."""
    pages.select("md5", "page_no", "text").dropDuplicates(["md5", "page_no"]).write.mode("append").parquet(path)


def write_results(pairs: DataFrame, order: str, path: str, metrics: dict[str, str] | None = None) -> None:
    """An evaluation as one JSON record: predictions and ground truths in order, and each metric's values and mean.
    One record holds the whole evaluation, as that file format has it."""
    row = F.array_sort(F.collect_list(F.struct(order, *pairs.columns)))
    get = lambda c: F.transform(row, lambda x: x[c])
    cols = [get("pred").alias("predictions"), get("truth").alias("ground_truths")]
    for name, c in (metrics or {}).items():
        cols += [get(c).alias(f"{name}_accuracies"), F.avg(c).alias(f"{name}_accuracy")]
    pairs.agg(*cols).write.mode("overwrite").json(path)


RULER = "\n\n------------------\n\n"


def write_dumps(rows: DataFrame, order: str, text: str, by: str, path: str) -> None:
    """Texts in order under by=.../, a ruler behind each; files of a kind follow one another by name.  No task has more than its range."""
    rows = rows.where(F.length(text) > 0).select(by, order, text)
    rows.repartitionByRange(by, order).sortWithinPartitions(by, order).select(by, text).write.mode("overwrite").option("lineSep", RULER).partitionBy(by).text(path)


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", RULER).text(path)
