"""Pages and documents: filters, joins, assembly, headers, chunks, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import mapped

UNRESOLVED = r"\[(?:\?\?(?:. )?)+\]"
HEADER_STOP = sorted(set("to a we of is in for and are fig. the figure this that".split()))  # blanks besides


# --- filters and joins ----------------------------------------------------------------------


def longer_than(strings: Column, least: int = 10) -> Column:
    return F.filter(strings, lambda x: F.length(x) > least)


def without_unresolved(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.where(~F.col(text).rlike(UNRESOLVED))


def recognised_pages(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pages, recognised, percentage) of documents with any text."""
    n = pages.groupBy(key).agg(F.count("*").alias("pages"), F.count_if(F.length(text) > 0).alias("recognised"))
    return n.where("recognised > 0").withColumn("percentage", F.round(100 * F.col("recognised") / F.greatest(F.lit(1), "pages"), 6))


def paired(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(matches, rows of left without a match)."""
    return left.join(right, key), left.join(right.select(key), key, "left_anti")


def with_optional(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    return left.join(right, key, "left")


def version_prefix(c: Column) -> Column:
    """What precedes the first v of an id: all versions of a paper share it."""
    return F.split_part(c, F.lit("v"), F.lit(1))


def not_done(todo: DataFrame, done: DataFrame, key: str, versions: bool = False) -> DataFrame:
    """Rows whose output doesn't exist yet; with `versions` any version of it counts."""
    if not versions:
        return todo.join(done.select(key), key, "left_anti")
    own = todo.withColumn("_prefix", version_prefix(F.col(key)))
    return own.join(done.select(version_prefix(F.col(key)).alias("_prefix")), "_prefix", "left_anti").drop("_prefix")


def fill_from_cache(pages: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with the cached text where there is one; `cached` tells which need computing."""
    known = cache.select(*keys, F.col("text").alias("cached_text"))
    return pages.join(known, keys, "left").withColumn("cached", F.col("cached_text").isNotNull())


def page_range(pages: DataFrame, start: int | None, stop: int | None, page: str = "page_no") -> DataFrame:
    """Pages start to stop, from 1; all of them unless both are given."""
    return pages if start is None or stop is None else pages.where(F.col(page).between(start, stop))


def figures_by_page(figures: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, page, figures in order); figures without a page, or beyond the last, are left out."""
    ok = figures.where("page is not null and page < num_pages and coalesce(caption, text) is not null")
    item = F.struct("pos", F.coalesce("caption", "text").alias("caption"), "fig_type")
    return ok.groupBy(key, "page").agg(F.array_sort(F.collect_list(item)).alias("figures"))


def index_pages(pages: DataFrame, images: DataFrame, figures: DataFrame, papers: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """The page index: pages (paper_id, page_no, text) that have an image and lie within num_pages of papers (paper_id, num_pages), with
    the path of their OCR text or null, and meta, the page's figures (pos, page, caption, text, fig_type) in order, none being an empty array."""
    keys = ["paper_id", "page_no"]
    out = pages.join(images.select(*keys, "image"), keys).join(papers.select("paper_id", "num_pages"), "paper_id").where("page_no <= num_pages")
    out = out.join(ocr.select(*keys, "ocr"), keys, "left") if ocr is not None else out.withColumn("ocr", F.lit(None).cast("string"))
    found = figures_by_page(figures.join(papers.select("paper_id", "num_pages"), "paper_id")).withColumn("page_no", F.col("page") + 1).drop("page")
    out = out.join(found, keys, "left")
    return out.select(*keys, "image", F.trim("text").alias("markdown"), "ocr", F.coalesce("figures", F.slice("figures", 1, 0), F.array().cast(found.schema["figures"].dataType)).alias("meta"))


def split_record(rows: DataFrame, *popped: str, rest: str = "meta") -> DataFrame:
    """Some columns by themselves and all others as one struct."""
    return rows.select(*popped, F.struct(*(c for c in rows.columns if c not in popped)).alias(rest))


def complete(rows: DataFrame) -> DataFrame:
    """Rows without any null, as batches are made of."""
    return rows.dropna()


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that the seed and the key alone decide; shuffle_key says it."""
    return rows.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("shuffle_key")


def without_figure_spots(figures: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """Places of figures in page texts that are sure enough, from the last to the first of each key, numbered in this order."""
    w = Window.partitionBy(key).orderBy(F.desc("start"), "pos")
    return figures.where((F.col("score") > least) & (F.col("length") > 0)).withColumn("turn", F.row_number().over(w))


def with_callable(rows: DataFrame, column: str, f, out: str | None = None) -> DataFrame:
    """rows with a text column passed through a function of one text, in batches; nulls stay."""
    return rows.withColumn(out or column, mapped(f)(F.col(column)))


def to_pixels(points: Column, dpi: int = 96) -> Column:
    """Typographic points to pixels, halves to even."""
    return F.bround(points * (dpi / 72)).cast("bigint")


# --- assembly --------------------------------------------------------------------------------


def assemble(pages: DataFrame, key: str, order: str, text: str, separator: str = "") -> DataFrame:
    """(key, document): page texts in order; ends stripped, at most one empty line in a row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda p: p[text])
    doc = pages.where(F.col(text).isNotNull()).groupBy(key).agg(F.array_join(parts, separator).alias("document"))
    return doc.withColumn("document", F.regexp_replace(F.regexp_replace("document", r"^\s+|\s+\z", ""), r"\n{3,}", "\n\n"))


def page_marker(text: Column, page: Column, repeats: Column, skipping: bool = True, markdown: bool = False) -> Column:
    """Text of a page, made compatible with Markdown if wanted, or a marker of why there is none."""
    from foliospark.functions.text import markdown_compatible

    out = F.when(text == "[MISSING_PAGE_POST]", F.format_string("\n\n[MISSING_PAGE_EMPTY:%d]\n\n", page))
    if skipping:
        out = out.when(repeats > 0, F.format_string("\n\n[MISSING_PAGE_FAIL:%d]\n\n", page)).when(repeats == 0, F.format_string("\n\n[MISSING_PAGE_EMPTY:%d]\n\n", page))
    return out.otherwise(markdown_compatible(text) if markdown else text)


def last_of_document(pages: DataFrame, key: str, page: str) -> DataFrame:
    return pages.withColumn("is_last", F.col(page) == F.max(page).over(Window.partitionBy(key)))


# --- headers, chunks -------------------------------------------------------------------------


def header_words(pages: DataFrame, key: str, text: str, words: int = 10, share: float = 0.4) -> DataFrame:
    """(key, word, share): words among the first `words` of pages, by how many of them there are to a page.
    Repeats on one page count, as they do in the method this follows."""
    first = F.filter(F.slice(F.split(F.lower(text), " ", -1), 1, words), lambda w: w != "")
    count = pages.select(key, F.explode(first).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    size = pages.groupBy(key).agg(F.count("*").alias("pages"))
    kept = count.where(~F.col("word").isin(HEADER_STOP) & ~F.col("word").startswith("\\"))
    return kept.join(size, key).withColumn("share", F.round(F.col("n") / F.col("pages"), 6)).where(F.col("n") >= share * F.col("pages")).select(key, "word", "share")


def remove_words(first_line: Column, words: list[str]) -> Column:
    """A line without the words, wherever they stand and in any case."""
    for w in words:
        pattern = r"-\s*\d{1,3}\s*-|-" if w == "-" else r"\Q" + w.replace(r"\E", r"\E\\E\Q") + r"\E"
        first_line = F.regexp_replace(first_line, "(?i)" + pattern, "")
    return first_line


def without_header_words(pages: DataFrame, key: str, lines: str, words: int = 10, share: float = 0.4) -> DataFrame:
    """pages with the words that many of the key's pages begin with removed from their first lines, those that reach `words` words;
    the words go wherever they stand and in any case, a hyphen with the page number it encloses."""
    frequent = header_words(pages.withColumn("_first", F.array_join(lines, " ")), key, "_first", words, share)
    frequent = frequent.groupBy(key).agg(F.array_sort(F.collect_list("word")).alias("_words"))
    size = F.transform(lines, lambda x: F.size(F.split(x, " ", -1)))
    before = F.transform(size, lambda _, i: F.aggregate(F.slice(size, F.lit(1), i), F.lit(0), lambda a, n: a + n))

    def cleaned(line: Column) -> Column:
        def less(acc, w):
            acc = F.when(w == "-", F.regexp_replace(acc, r"-\s*\d{1,3}\s*-", "")).otherwise(acc)
            return F.regexp_replace(acc, F.concat(F.lit(r"(?iu)\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), F.lit(""))

        return F.aggregate(F.col("_words"), line, less)

    out = F.transform(lines, lambda x, i: F.when(F.get(before, i) < words, cleaned(x)).otherwise(x))
    joined = pages.join(frequent, key, "left")
    return joined.withColumn(lines, F.when(F.col("_words").isNull(), F.col(lines)).otherwise(out)).drop("_words")


def document_lines(docs: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(key, pos, line) of lines of at least `least` characters; pos counts all lines, from 0."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).where(F.length("line") >= least)


def chunks(docs: DataFrame, key: str, text: str, chars: int = 600) -> DataFrame:
    """(key, chunk, lines, n_chars): lines of more than one character, grouped so that a chunk of average lines has about `chars`."""
    lines = docs.select(key, F.explode(F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.length(x) > 1), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))).alias("l")).select(key, "l.*")
    size = lines.groupBy(key).agg((1 + F.floor(chars * F.count("*") / F.sum(F.length("line")))).cast("bigint").alias("per"))
    return lines.join(size, key).withColumn("chunk", F.floor(F.col("pos") / F.col("per"))).groupBy(key, "chunk").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("n_chars"))


def accepted_pages(pages: DataFrame, key: str, page: str, score: str, least: float = 0.9) -> DataFrame:
    """Pages by the mean of the scores of their two borders; after the last comes a certain one."""
    w = Window.partitionBy(key).orderBy(page)
    mean = (F.col(score) + F.coalesce(F.lead(score).over(w), F.lit(1.0))) / 2
    return pages.withColumn("_mean", mean).where(F.col("_mean") >= least).withColumn("page_score", F.round("_mean", 6)).drop("_mean")


def first_words(c: Column, n: int) -> Column:
    return F.slice(F.split(c, " "), 1, n)


def last_words(c: Column, n: int) -> Column:
    w = F.split(c, " ")
    return F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), F.lit(n))


def best_caption(captions: DataFrame, figures: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """For every caption the figure of the same paper most like it, the first of equals."""
    from foliospark.functions.similarity import ratio

    pairs = captions.join(figures, key).withColumn("ratio", ratio("caption", "figure_text"))
    w = Window.partitionBy(key, "caption_id").orderBy(F.desc("ratio"), "figure_pos")
    return pairs.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & (F.col("ratio") >= least)).drop("_n")
