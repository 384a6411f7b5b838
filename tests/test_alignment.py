"""Borders of pages, step functions and the classifier against slow versions, and whole documents cut into their pages."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import alignment as al
from foliospark.functions import similarity, text
from foliospark.operators import splitting
from foliospark.sources import files


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(old + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abcd", max_size=12), st.sampled_from([0.025, 0.5, 0.9]))
def test_locate_against_every_stretch(needle, hay, rate):
    most = min(len(needle) - 1, int(len(needle) * rate) + 5)
    every = {(s, e): edits(needle, hay[s:e]) for s in range(len(hay) + 1) for e in range(s, len(hay) + 1)}
    least = min(every.values())
    at, score = similarity.locate(needle, hay, rate)
    if least > most:
        assert (at, score) == (-1, 0.0)
    else:
        assert score == pytest.approx(1 - least / max(1, most)) and min(d for (s, _), d in every.items() if s == at) == least
        assert min(e for (s, e), d in every.items() if d == least) in {e for (s, e), d in every.items() if s == at and d == least}


@given(st.text("ab \\[]()*_{}\n-#XR", max_size=30))
def test_comparable_is_the_column_function(s):
    assert al.comparable(s) == s_lower(s)


def s_lower(s):
    for a, b in text.SPECIAL:
        s = b.join(s.split(a))
    return s.lower()


@given(st.text("abc d*_", max_size=30), st.integers(0, 30))
def test_source_place_without_formulae(s, at):
    plain = al.comparable(s)
    at = min(at, len(plain))
    place = al.source_place(s, at)
    if s and at < len(plain):
        assert al.comparable(s[:place])[:at] == plain[:at] and al.comparable(s[place:]) in plain


@pytest.mark.parametrize(("s", "at", "want"), [("ab cd", 2, 3), ("a \\(x+y\\) b", 2, 2), ("## 2 Title", 0, 0), ("", 3, 3), ("a\\[b\\]c", 2, 1)])
def test_source_place(s, at, want):
    assert al.source_place(s, at) == want


def slow_impurity(labels, c, a, b):
    own = [x for i, x in enumerate(labels) if a < i <= b]
    s = sum(x == c for x in own)
    return len(own) - s * s / len(own) if own else 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=2, max_size=6), st.integers(0, 4), st.randoms())
def test_steps_of_clean_and_noisy_labels(sizes, noise, rng):
    labels = np.repeat(np.arange(len(sizes)), sizes)
    for _ in range(noise * (len(labels) > 20)):
        labels[rng.randrange(len(labels))] = rng.randrange(len(sizes))
    steps = al.label_steps(labels, len(sizes))
    assert len(steps) == len(sizes) - 1 and ((steps >= 0.5) & (steps <= len(labels) - 0.5)).all() and (steps % 1 == 0.5).all()


def test_steps_lie_at_the_changes_of_long_runs():
    labels = np.repeat(np.arange(5), [30, 40, 25, 50, 35])
    rng = np.random.default_rng(1)
    labels[rng.integers(0, len(labels), 12)] = rng.integers(0, 5, 12)
    assert np.abs(al.label_steps(labels, 5) - (np.cumsum([30, 40, 25, 50]) - 0.5)).max() <= 2
    assert al.label_steps(np.zeros(4, int), 1).size == 0
    assert (al.page_of(np.array([0, 1, 2, 3]), np.array([0.5, 2.5])) == [0, 1, 1, 2]).all()


def test_classifier_finds_the_page_of_a_paragraph():
    rng = random.Random(4)
    vocabulary = [["w" + str(rng.randrange(10**6)) for _ in range(60)] for _ in range(4)]
    lines = [(" ".join(rng.choices(vocabulary[k], k=12)), k) for k in range(4) for _ in range(20)]
    model = al.LinearClassifier(*map(list, zip(*lines)))
    asked = [" ".join(rng.choices(vocabulary[k], k=40)) for k in range(4)]
    assert model.predict(asked).tolist() == [0, 1, 2, 3]


def document(rng, pages=5):
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    lines = [[" ".join(word() for _ in range(12)) for _ in range(rng.randint(14, 30))] for _ in range(pages)]
    flat = [x for p in lines for x in p]
    return lines, "\n\n".join(" ".join(flat[i : i + 4]) for i in range(0, len(flat), 4))


def test_documents_come_apart_as_they_were(spark):
    rng = random.Random(5)
    made = {f"p{k}": document(rng) for k in range(6)}
    rows = [(k, md + " [FOOTNOTE:1][ENDFOOTNOTE]", [["Journal of Things 20"] + p for p in pages], [(4, "A caption of the table of things", None, "Figure"), (9, "beyond", None, "Figure"), (None, "nowhere", None, "Table")], {"FIGURE:f": "A caption of the table of thinks", "FOOTNOTE:1": "the note"}) for k, (pages, md) in made.items()]
    rows += [("none", None, [["a"]], None, None), ("bare", "some text of one page", [["some text"]], None, None), ("empty", "", [["a line"], ["b line"]], None, None), ("nopages", "x", [], None, None), ("blank", "text here", [[], None], None, None)]
    papers = spark.createDataFrame(rows, "paper_id string, markdown string, pages array<array<string>>, figures array<struct<page:int,caption:string,text:string,figType:string>>, bodies map<string,string>")
    got = {(r.paper_id, r.page_no): r for r in splitting.split_documents(papers).collect()}
    right = sum(al.comparable(got[k, i + 1].text.split("\n\nA caption")[0].replace(" the note", "")) == al.comparable(" ".join(p)) for k, (pages, _) in made.items() for i, p in enumerate(pages))
    assert right >= 27  # of 30
    assert all("the note" in got[k, 5].text and got[k, 5].text.count("A caption of the table of thinks") == 1 for k in made if got[k, 5].text)
    assert got["bare", 1].text == "some text of one page" and got["empty", 2].text == "" and {k for k, _ in got} == {*made, "bare", "empty", "blank"}


def test_borders_judge_their_pages():
    pages, md = document(random.Random(6), 3)
    paragraphs = md.split("\n\n")
    b = al.Borders(paragraphs)
    at = 0
    for k in (1, 2):
        at += len(pages[k - 1])
        para, place, score = b.find(at // 4, " ".join(pages[k][:2]))
        assert score == 1.0 and para == at // 4
    assert b.agreement(2, " ".join(pages[1])) > 0.9 and b.agreement(0, "x") == b.agreement(9, "x") == 0.0


def test_unicode_to_latex_in_both_forms(spark):
    samples = ["α ≤ {β}  and “quotes”", "  Übung – café ", "x∈ℝ\u2009→ \\ne 3", ""]
    got = [r.y for r in spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, x string").orderBy("i").select(text.unicode_to_latex("x").alias("y")).collect()]
    assert got[:2] == ["\\alpha \\leq \\beta and \"quotes\"", "Ubung - cafe"]
    assert [al.unicode_to_latex(s) for s in samples][0] == got[0]


def test_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.pdf\n\n b.pdf \n")
    assert [r.path for r in files.listed_paths(spark, str(tmp_path / "list.txt")).collect()] == ["a.pdf", "b.pdf"]
    (tmp_path / "train.jsonl").write_text('{"image": "i", "markdown": "m"}\n{broken\n')
    assert files.split_index(spark, f"{tmp_path}/train.jsonl", "train").count() == 1
    with pytest.raises(ValueError):
        files.split_index(spark, f"{tmp_path}/train.jsonl", "test")
    assert files.existing(spark, [f"{tmp_path}/*.txt", f"{tmp_path}/list.txt", f"{tmp_path}/none"]).count() == 1
    import zlib

    packed = zlib.compress(b"<</Type /Page>> <</Type/Page /x 1>>")
    pdf = b"%PDF-1.5\n1 0 obj <</Type /Pages>> endobj 2 0 obj <</Type /Page>> endobj\n3 0 obj <</Type /ObjStm /Length 9>>\nstream\n" + packed + b"\nendstream"
    rows = spark.createDataFrame([(1, bytearray(pdf)), (2, bytearray(b"no")), (3, None)], "i int, content binary")
    assert [r.n for r in rows.orderBy("i").select(files.pdf_pages("content").alias("n")).collect()] == [3, None, None]
    p = spark.createDataFrame([("a", 1, "text"), ("a", 2, ""), ("b", 1, "see [??]")], "paper_id string, page_no int, text string")
    files.write_page_texts(p, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 1
    raw = spark.createDataFrame([("x", '{"num_pages": 2}'), ("y", "{"), ("z", None)], "paper_id string, value string")
    assert [r.paper_id for r in files.read_meta(raw).collect()] == ["x"]
    images = spark.createDataFrame([("i",)], "image string")
    index = spark.createDataFrame([("i", 1), ("j", 2)], "image string, n int")
    assert files.with_images(index, images, ["image"]).count() == 1


def test_deep_pages_are_set_aside(spark):
    from foliospark.functions import html

    pages = [(1, "<article>" + "<div>" * 3000 + "x" + "</div>" * 3000 + "</article>"), (2, "<article><p>fine \u03b1</p></article>"), (3, "no"), (4, "<article>" + "<div>" * 1500 + "y" + "</div>" * 1500 + "</article>")]
    good, bad = html.converted(spark.createDataFrame(pages, "page_id int, html string"))
    assert {r.page_id for r in good.collect()} >= {2} and {1, 3} <= {r.page_id for r in bad.collect()}
    tex = html.markdown('<article><math class="ltx_Math" alttext="\\displaystyle a \\ne b" display="inline"></math></article>')
    assert tex[2] == "\\( a \\neq b\\)"
