import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import packing, pretoken, token_counts

VOC = pretoken.DEFAULT_VOCABULARY
HARD = ["don't we'll  I've 'sort ''s 's", "a\n\nb  c \n d", "  lead", "trail  ", "éè 12½ x2y", "", "tab\t\tx", "a 's b", "re're're", "　x  你好!!", "aaaaaaaaaaaaaaaaaaaa", "------------------ 'll'l", "x'", "'", "'d", "\n'tis", "\U0001f600\U0001f600 ok"]
ALPHABET = st.text(alphabet="abtsredlmv' \n\t1.!-é你\U0001f600", max_size=40)


def brute(text):
    enc, _ = pretoken.encoding(VOC)
    return [len(enc.encode_ordinary(text[:k])) for k in range(len(text) + 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=5))
def test_prefix_counts_equal_encoding_every_prefix(texts):
    steps, begins = token_counts.prefix_steps(pa.array(texts, pa.string()), VOC)
    for i, t in enumerate(texts):
        assert [0, *np.cumsum(steps[begins[i] : begins[i + 1]]).tolist()] == brute(t)


def test_hard_texts():
    steps, begins = token_counts.prefix_steps(pa.array(HARD), VOC)
    for i, t in enumerate(HARD):
        assert [0, *np.cumsum(steps[begins[i] : begins[i + 1]]).tolist()] == brute(t), t
    assert pretoken.token_totals(pa.array(HARD), VOC).tolist() == [brute(t)[-1] for t in HARD]


def one_by_one(lengths, capacity):
    """Best-fit decreasing, item after item."""
    windows = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(windows) if r >= n]
        if fit:
            windows[min(fit, key=lambda i: windows[i])] -= n
        else:
            windows.append(capacity - n)
    return sorted(windows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_class_packing_is_best_fit_decreasing(lengths):
    hist = {n: lengths.count(n) for n in set(lengths)}
    rules, used = packing.packing_rules(hist, 20)
    left = [20] * used
    for n, count in hist.items():
        own = sorted((r.tolist() for r in rules if r[0] == n), key=lambda r: r[1])
        for k in range(count):
            _, i, w, m = [r for r in own if r[1] <= k][-1]
            left[w + (k - i) // m] -= n
    assert min(left, default=0) >= 0
    assert sorted(left) == one_by_one(lengths, 20)


def test_pack_covers_each_token_once(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", "cat"]) for _ in range(rng.choice([1, 3, 30, 200]))) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1), (100, None, 1), (101, "", 1), (3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = packing.pack(docs, capacity=64).collect()
    want = {i: brute(t)[-1] for i, t in enumerate(texts)}
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_tokens
    assert have == {i: n * (2 if i == 3 else 1) for i, n in want.items()}
    used = {}
    for r in got:
        used[r.window_id] = used.get(r.window_id, 0) + r.n_tokens
    assert max(used.values()) <= 64 and set(used) == set(range(len(used)))
    cut = [n for i, n in [*want.items(), (3, want[3])] for n in [64] * (n // 64) + [n % 64] * bool(n % 64)]
    assert sorted(64 - u for u in used.values()) == one_by_one(cut, 64)


def test_pack_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_prefix_query(spark):
    rows = [(1, "The cat  sat on\n\nthe mat's edge"), (2, None), (None, "abc"), (1, ""), (5, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("steps", F.lit(1))
    out = token_counts.prefix_token_counts(docs, budgets=(4,))
    got = out.withColumn("t5", token_counts.tokens_in_prefix("steps", F.lit(5))).withColumn("fit", token_counts.longest_prefix_within("steps", F.lit(4))).collect()
    assert len(got) == 5
    for r, (_, t) in zip(sorted(got, key=lambda r: r.n_chars), sorted(rows, key=lambda r: len(r[1] or ""))):
        b = brute(t or "")
        assert r.n_tokens == b[-1] and r.t5 == b[min(5, len(b) - 1)]
        assert r.chars_in_4 == r.fit == max(k for k, n in enumerate(b) if n <= 4)
