import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import html, repetition, similarity, text
from foliospark.operators import pages, windows
from foliospark.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "given_", "want"),
    [
        (text.remove_pretty_linebreaks, "a\nb\n\nc\n* d\ne", "a b\n\nc\n* d e"),
        (text.remove_pretty_linebreaks, None, None),
        (text.replace_ligatures, "eﬃcient ﬁne", "efficient fine"),
        (text.dehyphenate, "a hyphen-\nated word", "a hyphenated\n word"),
        (text.remove_numbers, " **12** a_b3 ", "ab"),
        (text.strip_special_chars, "\\frac{A}{B} - \\sum_i \\varphi", "abxi\\phi"),
        (text.latex_escape, "a&b\\_{", "a\\&b\\textbackslash{}\\_\\{"),
        (text.ocr_cleanup, "\na\n  b", "a\n\nb"),
        (text.format_document, "\n\na \n\n\n\nb   c", "a\n\nb c"),
        (text.close_environments, "\\begin{table}\\begin{tabular}x", "\\begin{table}\\begin{tabular}x\\end{tabular}\\end{table}"),
        (text.drop_trailing_title, "a\n## B", "a"),
        (text.drop_trailing_title, "## B", "## B"),
        (text.normalise_tex, "$$ a \\ne b % no\n c $$", "\\(a \\neq b   c\\)"),
        (text.normalise_tex, " $ $ ", ""),
        (text.without_figure_bodies, "a [TABLE:1]x\ny[ENDTABLE] b", "a [TABLE:1][ENDTABLE] b"),
        (text.markdown_compatible, "(1.2a) \\[x\\]", "\\[x \\tag{1.2a}\\]"),
        (text.markdown_compatible, "see http://a.org/b.", "see [http://a.org/b](http://a.org/b)."),
        (text.heading_rules, "# 1.2\n\nText\n## Last", "\nText"),
        (text.reference_rules, "x _a__b_ y", "x \\(a_{b}\\) y"),
        (text.joiner, "# T", "\n\n# T"),
        (text.joiner, "end.", "end.\n\n "),
        (text.table_rules, "a\n\n\n\n.\n" + "&" * 401, "a\n\n"),
        (text.clean_html_whitespace, "\n\n a  b\n", "\n a b\n"),
        (text.to_ascii, "café – naïve", "cafe - naive"),
        (lambda c: text.extract_figures(c)["TABLE:1"], "[TABLE:1]x[ENDTABLE][TABLE:1] y [ENDTABLE]", "y"),
        (lambda c: text.surrounding_blanks(c)["trail"], " a \n", " \n"),
        (lambda c: F.size(text.drop_trailing_blank(F.split(c, ","))), "a, ,b, ,", 3),
        (text.next_punctuation, "ab. c", 2),
    ],
)
def test_text(spark, f, given_, want):
    assert one(spark, given_, f) == want


@settings(max_examples=200)
@given(st.text("ab", max_size=9), st.text("abc", max_size=9))
def test_indel_ratio(a, b):
    best = max((len(s) for n in range(len(a) + 1) for s in map("".join, itertools.combinations(a, n)) if _within(s, b)), default=0)
    assert similarity.common_subsequence(a, b) == best


def _within(s, t):
    it = iter(t)
    return all(c in it for c in s)


def slow_cut_period(s, least):
    best = None
    for p in range(least, len(s) // 2):
        if s[len(s) - p :] == s[len(s) - 2 * p : len(s) - p]:
            best = p
    return best


@settings(max_examples=300)
@given(st.text("ab", max_size=40), st.integers(1, 5))
def test_tail_period_against_every_length(s, least):
    assert repetition.tail_period(s, least) == slow_cut_period(s, least)


def test_repetition():
    sentence = "This sentence comes again and again here. "
    assert repetition.cut_repetitions("Start of it. " + sentence * 9) == ("Start of it. " + sentence * 2).strip()
    rng = random.Random(1)
    plain = "".join(rng.choice("abcdefgh ") for _ in range(500))
    assert repetition.cut_repetitions(plain) == plain
    assert repetition.cut_repetitions("short" * 5) == "short" * 5
    lines = [f"* [{i}] A. Author, Title of a paper" for i in range(20)]
    assert repetition.like_lines([repetition._plain(x) for x in lines]) == [(0, 20)]
    assert repetition.like_lines(["equal line"] * 15) == []
    assert "[MISSING_PAGE_POST]" in repetition.mark_invented_references("Text.\n\n## References\n\n" + "\n".join(lines))
    assert repetition.split_inline_bullets("- a b - c d") == "- a b\n- c d\n"


def test_similarity(spark):
    assert similarity.bleu_score("a b c d e".split(), "a b c d e".split()) == pytest.approx(1)
    assert similarity.bleu_score("a b".split(), "a b".split()) == 0
    assert similarity.locate("needle", "hay neexle hay")[0] == 4
    row = spark.createDataFrame([("a b \\(x\\) \\[y\\] \\begin{tabular}t",)], "p string").select(similarity.modalities(F.col("p")).alias("m")).first().m
    assert (row.text, row.math, row.tables) == ("a b", "xy", "t")
    s = spark.createDataFrame([("   ", "abcd"), ("abc", "abcd"), ("a b c", "a b d")], "p string, t string").select(similarity.set_scores(F.col("p"), F.col("t")).alias("s")).collect()
    assert [r.s.f_measure for r in s[:2]] == [None, None] and s[2].s.precision == pytest.approx(2 / 3)


def test_html():
    page = "<nav>x</nav><article class='ltx_document'><h1 class='ltx_title ltx_title_document'>T</h1><section><h2 class='ltx_title'>S</h2><div class='ltx_para'><p class='ltx_p'>A <em class='ltx_emph'>b</em> <math alttext='x' display='inline'></math> <a class='ltx_ref' href='#bib.bib3'>3</a></p></div></section><table class='ltx_tabular'><tr class='ltx_tr'><td class='ltx_td ltx_align_left' colspan=2>a&amp;b</td></tr><tr class='ltx_tr'><td class='ltx_td ltx_align_left'>c</td><td class='ltx_td'>d</td></tr></table></article>"
    ok, error, md, figures = html.markdown(page)
    assert ok and md.startswith("# T\n\n## S\n\nA _b_ \\(x\\) 3\n\n")
    assert "\\begin{tabular}{lc}\n\\multicolumn{2}{l}{a\\&b} \\\\\nc & d\n\\end{tabular}" in md
    assert html.markdown("<p>x</p>")[1] == "no article" and html.markdown(None)[0] is False
    assert html.markdown("<article><figure class='ltx_figure' id='F1'>c</figure></article>")[3] == {"FIGURE:F1": "c"}
    assert "unresolved" in html.markdown("<article><cite class='ltx_missing_citation'>zz</cite></article>")[1]


def test_pages(spark):
    p = spark.createDataFrame([(1, 2, "b"), (1, 1, "a\n\n\n"), (2, 1, None)], "id int, page_no int, text string")
    assert [tuple(r) for r in pages.assemble(p, "id", "page_no", "text").collect()] == [(1, "a\n\n\nb".replace("\n\n\n", "\n\n"))]
    assert pages.page_range(p, 2, 3).count() == 1 and pages.page_range(p, 2, None).count() == 3
    todo, done = spark.createDataFrame([("a1v2",), ("b1",)], "k string"), spark.createDataFrame([("a1v1",)], "k string")
    assert [r.k for r in pages.not_done(todo, done, "k", versions=True).collect()] == ["b1"]
    assert spark.range(1).select(pages.to_pixels(F.lit(1.875))).first()[0] == 2
    caps = spark.createDataFrame([(1, 1, "Figure of cats"), (1, 2, "nothing")], "paper int, caption_id int, caption string")
    figs = spark.createDataFrame([(1, 0, "Figure of cats!"), (1, 1, "Figure of cats!")], "paper int, figure_pos int, figure_text string")
    assert [(r.caption_id, r.figure_pos) for r in pages.best_caption(caps, figs, "paper").collect()] == [(1, 0)]
    assert spark.range(1).select(pages.remove_words(F.lit("Head 12 - 3 - (x"), ["head", "(", "-"])).first()[0].split() == ["12", "x"]


def test_windows(spark):
    low = spark.createDataFrame([("k", i, 0.01 if i >= 40 else 1.0, 400) for i in range(60)] + [("u", i, 1.0, 60) for i in range(60)], "k string, pos int, value double, steps int")
    assert {r.k: r.repeats_from for r in windows.repetition_verdict(low, "k").collect()} == {"k": int(40 * 1.08 + 120), "u": None}
    flat = spark.createDataFrame([("k", i, float(i % 2) if i < 50 else 0.0) for i in range(400)], "k string, step int, value double")
    assert 0 < windows.stopping_step(flat, "k", "step", "value").first().stop_step < 400
    spans = spark.createDataFrame([([[{"colspan": 1}, {"colspan": 2}], [{"colspan": 1}]],)], "rows array<array<struct<colspan:int>>>")
    assert spans.select(windows.table_width(F.col("rows"))).first()[0] == 3


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.jsonl").write_text('{"image": "a.png", "markdown": "m"}\nbroken\n{"markdown": "n"}\n')
    assert [r.image for r in files.read_index(spark, str(tmp_path / "in/x.jsonl")).collect()] == ["a.png"]
    (tmp_path / "r.json").write_text('{"predictions": ["a", "b", "c"], "ground_truths": ["x", "y"]}')
    assert files.read_results(spark, str(tmp_path / "r.json")).count() == 2 and files.read_results(spark, str(tmp_path / "r.json"), 1).count() == 1
    assert files.page_numbers("1-3, 7") == [1, 2, 3, 7]
    assert files.split_path("d/train.jsonl", "test") == "d/test.jsonl" and files.split_path("d/mytest.jsonl", "test") == "d/mytest.jsonl"
    (tmp_path / "h").mkdir()
    (tmp_path / "h/p1.html").write_text("<article>a\xa0b</article>")
    assert [tuple(r) for r in files.read_html(spark, str(tmp_path / "h")).collect()] == [("p1", "<article>a b</article>")]
    (tmp_path / "m/p1").mkdir(parents=True)
    (tmp_path / "m/p1/07.mmd").write_text("t")
    assert [tuple(r) for r in files.read_pages(spark, str(tmp_path / "m")).collect()] == [("p1", 7, "t")]


def test_stream_drops_pages_that_come_twice(spark, tmp_path):
    from foliospark.streaming import incremental

    folder = str(tmp_path / "pages")
    for k in range(2):
        spark.sql("select 'h' md5, 1 page_no, 'text' text, timestamp'2024-01-01' ts").write.mode("append").parquet(folder)
    q = incremental.keep_writing(incremental.once_per_page(incremental.page_stream(spark, folder, files_per_trigger=1)), str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True)
    assert q.awaitTermination(120) and spark.read.parquet(str(tmp_path / "out")).count() == 1
