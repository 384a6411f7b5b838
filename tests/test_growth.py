"""Rules that must cost no pass over the text, and no table of both lengths, for each of their cases."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark import catalog
from foliospark.functions import similarity, text
from foliospark.operators import pages

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def made(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def test_unicode_as_latex_has_few_passes_and_the_rules_results(spark):
    rng = random.Random(2)
    signs = [c for c, _ in text.UNICODE_TEX] + list("ÀéßæœŸ日😀\x1c \t\n{}ab") + ["\\ne ", "\\n", "e ", "\\textmu", "\\text", "mu", "\\>"]
    samples = [made(rng, signs, 40) for _ in range(200)] + [made(rng, "aeo {}", 30), "", "\x0b \\ne ", None]
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, x string")
    x = text.replace_all(text.strip("x"), text.UNICODE_TEX)
    x = text.strip(text.substitute(F.translate(x, "{}", "  "), (r"\s{2,}", " ")))
    slow = text.to_ascii(text.replace_all(x, text.SYNONYMS))
    assert all(r.y == r.z for r in rows.select(text.unicode_to_latex("x").alias("y"), slow.alias("z")).collect())
    assert plan(catalog.QUERIES["unicode_as_latex"](spark, SF)).count("replace(") < 10


def test_synonyms_of_texts_with_and_without_commands(spark):
    rows = spark.createDataFrame([("\\ne x\\textmu",), ("ne x",), (None,)], "x string")
    assert [r.y for r in rows.select(text.latex_synonyms("x").alias("y")).collect()] == ["\\neq x\\mu", "ne x", None]


def test_tex_is_normalised_once_for_both_forms(spark):
    rng = random.Random(3)
    parts = ["$", "$$", "\\(", "\\)", "\\[", "\\]", "%", "\\%", "\n", " ", "\t", "\\ne ", "\\displaystyle", "\\text", "style", "a", "é", "\x1c"]
    samples = [made(rng, parts, rng.randrange(12)) for _ in range(300)] + [None]
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, x string")
    x = text.strip(text.substitute(text.strip("x"), (r"^(?:\\\(|\\\[|\$\$|\$)", ""), (r"(?:\\\)|\\\]|\$\$|\$)\z", "")))
    slow = lambda a, b: F.when(x == "", "").otherwise(F.concat(F.lit(a), text.remove_styles(text.replace_all(text.tex_one_line(x), text.SYNONYMS)), F.lit(b)))
    got = rows.select(text.normalise_tex("x").alias("a"), text.normalise_tex("x", inline=False).alias("b"), slow("\\(", "\\)").alias("c"), slow("\\[", "\\]").alias("d")).collect()
    assert all((r.a, r.b) == (r.c, r.d) for r in got)
    assert plan(catalog.QUERIES["tex_normal_form"](spark, SF)).count("replace(") < 12


def test_token_sets_are_made_once(spark):
    assert plan(catalog.QUERIES["token_set_prf"](spark, SF)).count("regexp_extract_all(") == 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(old + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edit_distance_by_bits(spark):
    rng = random.Random(4)
    pairs = [(made(rng, "abé😀"[: rng.randint(1, 4)], rng.randrange(90)), made(rng, "abcé😀", rng.randrange(90))) for _ in range(400)]
    assert all(similarity.edit_distance(a, b) == edits(a, b) for a, b in pairs)
    rows = spark.createDataFrame([*pairs[:50], (None, "abcd"), ("abcd", None)], "a string, b string")
    got = rows.select(similarity.edit_distance_share(F.col("a"), F.col("b")).alias("x"), F.when(similarity.long_enough(F.col("a"), F.col("b")), F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))).alias("y")).collect()
    assert all(r.x == r.y for r in got) and got[-1].x is None
    assert "ArrowEvalPython" in plan(catalog.QUERIES["doc_edit_similarity"](spark, SF))
    began = time.perf_counter()
    similarity.edit_distance(made(rng, "abcdef ", 120_000), made(rng, "abcdef ", 400))
    assert time.perf_counter() - began < 2


def test_bleu_counts_only_what_the_truth_has():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert similarity.bleu_score(a, b) == pytest.approx(slow_bleu(a, b))


def slow_bleu(truth, pred):
    from collections import Counter

    score = 1.0
    for n in range(1, 5):
        have, want = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (pred, truth))
        score *= sum((have & want).values()) / max(1, sum(have.values()))
    return score**0.25 * min(1.0, np.exp(1 - len(truth) / len(pred))) if score else 0.0


def test_modality_metrics_read_the_pairs_by_one_python_step(spark):
    assert "ArrowEvalPython" in plan(catalog.QUERIES["modality_metrics"](spark, SF)) and plan(catalog.QUERIES["modality_metrics"](spark, SF)).count("EvalPython") == 1


def slow_row(needle, hay, free):
    ramp = np.arange(len(hay) + 1, dtype=np.int32)
    row = np.zeros_like(ramp) if free else ramp.copy()
    for i, c in enumerate(needle, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (hay != c), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - ramp) + ramp
    return row


def test_border_search_rows():
    rng = np.random.default_rng(6)
    for _ in range(200):
        x, y = rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint32), rng.integers(0, 4, rng.integers(0, 70)).astype(np.uint32)
        for free in (True, False):
            assert (similarity._last_row(x, y, free) == slow_row(x, y, free)).all()
    x, y, took = rng.integers(0, 30, 120), rng.integers(0, 30, 200_000), []
    for f in (similarity._last_row, slow_row):
        began = time.perf_counter()
        f(x, y, True)
        took.append(time.perf_counter() - began)
    assert took[0] < took[1] / 2


def test_callables_get_a_batch_in_parts(spark):
    rows = spark.createDataFrame([(i, None if i % 9 == 0 else f"a\x00é{i}") for i in range(1000)], "i int, x string")
    got = {r.i: r.x for r in pages.with_callable(rows, "x", lambda s: s[::-1]).collect()}
    assert got == {i: None if i % 9 == 0 else f"a\x00é{i}"[::-1] for i in range(1000)}
    assert pages.with_callable(rows.where("i < 0"), "x", lambda s: s).count() == 0
    texts = pa.array(["x" * 10_000] * 2000)
    tracemalloc.start()
    out = text.mapped(lambda s: s[::-1]).func(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 2000 and most < 5e6  # of 20 MB of text
