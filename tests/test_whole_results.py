"""Queries that SQL can't express, on small tables, against slow versions written from their rules."""

import math
import re
from collections import Counter

import pytest

from foliospark import catalog

TEXTS = [
    "a plain text of some words \\(x+y\\) and \\[z_1\\] with more",
    "\\begin{tabular}{c} a & b \\end{tabular} after it \\(a\\) \\(b\\)",
    "open \\begin{tabular} never closed", "abc", "", None, "of the and of the and it was", "words of an item here",
    "Start. " + "the same thing again and again it is. " * 6, "x" * 10 + "0123456789 abcdefghij klmnopqrst uvwxyz" * 3, "no repeats at all in this text, none whatsoever here",
]
ITEMS = ["words of an item \\(x+y\\) here and \\[z_2\\]", "the and of something else \\begin{tabular}{c} a & b \\end{tabular}", "zzz yyy"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def pairs():
    return [(i, t, ITEMS[i % 3]) for i, t in enumerate(TEXTS)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_fuzzy_ratio(spark, folder):
    got = {r.doc_id: r.ratio for r in catalog.QUERIES["fuzzy_ratio"](spark, folder).collect()}
    for i, p, t in pairs():
        assert got[i] is None if p is None else got[i] == pytest.approx(2 * lcs(p, t) / (len(p) + len(t)))


def modality(page):
    inline = re.findall(r"\\\((.*?)(?<!\\)\\\)", page)
    page = re.sub(r"\\\((.*?)(?<!\\)\\\)", "", page)
    display = re.findall(r"\\\[(.+?)(?<!\\)\\\]", page)
    page = re.sub(r"\\\[(.+?)(?<!\\)\\\]", "", page)
    body = r"\\begin\{tabular\}(.+?)(?:\\end\{tabular\}|\Z)"
    return {"math": "\n".join(inline) + "\n".join(display), "tables": "\n".join(re.findall(body, page, re.S)), "text": re.sub(body, "", page, flags=re.S).strip()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(old + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def bleu(truth, pred):
    score = 1.0
    for n in range(1, 5):
        have, want = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (pred, truth))
        score *= sum((have & want).values()) / max(1, sum(have.values()))
    return score**0.25 * min(1.0, math.exp(1 - len(truth) / len(pred))) if score else 0.0


def test_modality_metrics(spark, folder):
    got = {r.modality: r for r in catalog.QUERIES["modality_metrics"](spark, folder).collect()}
    for kind in ("text", "math", "tables"):
        values = {k: [] for k in ("edit_dist", "precision", "recall", "f_measure", "bleu")}
        for _, p, t in pairs():
            if p is None:
                continue
            p, t = modality(p)[kind], modality(t)[kind]
            if len(p) < 4 or len(t) < 4:
                continue
            a, b = set(p.split()), set(t.split())
            values["edit_dist"].append(distance(p, t) / max(len(p), len(t)))
            pr, re_ = len(a & b) / len(a), len(a & b) / len(b)
            values["precision"].append(pr)
            values["recall"].append(re_)
            values["f_measure"].append(2 * pr * re_ / (pr + re_) if pr + re_ else 0.0)
            values["bleu"].append(bleu(t.split(), p.split()))
        assert got[kind].n == len(TEXTS)
        for k, v in values.items():
            assert got[kind][k] == (pytest.approx(sum(v) / len(v), abs=1e-5) if v else None), (kind, k)


def slow_truncation(s, least=30):
    low = s.lower()
    if len(low) < 2 * least:
        return s
    best = None
    for n in range(least, len(low) // 2):
        if low[-n:] == low[-2 * n : -n]:
            best = n
    if best is None:
        return s
    unit, end = low[-best:], len(low)
    while low[:end].endswith(unit):
        end -= best
    tail = low[end:]
    while True:
        stop = min((low.find(c, end) for c in ".?!\n" if low.find(c, end) >= 0), default=None)
        begin = max((low.rfind(c, 1, end) for c in ".?!\n"), default=-1)
        if not stop or begin < 1:
            return s[:end]
        end = stop + 1
        if low[begin:stop] in tail:
            return s[:end]


def test_truncated_repetitions(spark, folder):
    got = {r.doc_id: r.text for r in catalog.QUERIES["truncate_repetitions"](spark, folder).collect()}
    assert got == {i: None if t is None else slow_truncation(t) for i, t in enumerate(TEXTS)}
    assert len(got[8]) < len(TEXTS[8]) and len(got[9]) < len(TEXTS[9])


def test_missing_page_post(spark, tmp_path):
    refs = "Text before it.\n\n## References\n" + "\n".join(f"* [{k}] A. Author, The same title of a paper, Journal {k}" for k in range(20))
    fine = "Text.\n\n## References\n* [1] One, A title\n* [2] Another author, something quite different\n* [3] Third of them, on still other matters"
    spark.createDataFrame([(0, refs), (1, fine), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in catalog.QUERIES["missing_page_post"](spark, str(tmp_path)).collect()}
    assert got[0].startswith("Text before it.") and got[0].count("[MISSING_PAGE_POST]") == 1 and "Author" not in got[0]
    assert got[1] == fine and got[2] is None and got[3] == ""


def test_postprocessed_pages(spark, tmp_path):
    pages = ["# 1.2\n\nBody of the page. " + "it goes round and round in circles. " * 5 + "\n## Last", "\\begin{table} \\begin{tabular}{c}a\\end{tabular} \\end{table} Table", "* one item * two items", None]
    spark.createDataFrame([(0, i, t) for i, t in enumerate(pages)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.text for r in catalog.QUERIES["postprocess_pages"](spark, str(tmp_path)).collect()}
    assert "1.2" not in got[0] and "## Last" not in got[0] and got[0].count("round and round") < 5
    assert "\\begin{table}\n\\begin{tabular}" in got[1] and "\\end{tabular}\n\\end{table}" in got[1]
    assert got[2].strip() == "* one item\n* two items" and got[3] is None


def test_html_of_papers(spark, tmp_path):
    html = '<section class="ltx_section"><h2 class="ltx_title">A &amp; B</h2><p class="ltx_p">See <em class="ltx_emph">this</em> <math class="ltx_Math" alttext="\\le x" display="inline"></math>.</p><ul class="ltx_itemize"><li>one</li><li>two</li></ul></section>'
    spark.createDataFrame([(1, html), (2, None), (3, '<cite class="ltx_cite"><span class="ltx_missing_citation">nowhere</span></cite>')], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in catalog.QUERIES["html_markdown"](spark, str(tmp_path)).collect()}
    assert got[1].markdown == "## A & B\n\nSee _this_ \\(\\leq x\\).\n\n* one\n* two\n\n" and got[1].ok
    assert not got[2].ok and got[3].error.startswith("unresolved")


def test_documents_of_turns(spark, tmp_path):
    words = [f"w{k:04}o" for k in range(2000)]
    turns = [(0, t, ". ".join(" ".join(words[(t * 40 + i) * 9 : (t * 40 + i + 1) * 9]) for i in range(40))) for t in range(5)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.page_no: r for r in catalog.QUERIES["split_documents"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and sum(got[k].text.replace(" ", "") == turns[k - 1][2].replace(" ", "") for k in got) >= 4
