import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import embedding_dedup as ed
from foliospark.llm import suffix_dedup as sd


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x & 1 for x in b)), max_size=12), max_size=7))
def test_loser_tree_merges_and_knows_shared_lengths(runs):
    runs = [sorted(set(r)) for r in runs]
    shared = []
    for r in runs:
        s, _ = sd.front_code(np.frombuffer(b"".join(r), np.uint8).reshape(-1, 6))
        shared.append(s.tolist() + [-1])
    if not runs:
        return
    out = list(sd.LoserTree([r + [None] for r in runs], shared))
    texts = [runs[r][i] for r, i, _ in out]
    assert texts == sorted(x for r in runs for x in r)
    for (a, b), (_, _, h) in zip(zip(texts, texts[1:]), out[1:]):
        assert h == next((k for k in range(6) if a[k] != b[k]), 6)


@given(st.lists(st.binary(min_size=5, max_size=5), max_size=30))
def test_front_code_round_trip(rows):
    keys = np.frombuffer(b"".join(sorted(rows)), np.uint8).reshape(-1, 5)
    assert (sd.front_decode(*sd.front_code(keys), 5) == keys).all()


def brute_passages(texts, n):
    """Words of each document that lie in a window of n words which an earlier place has."""
    seen, covered = {}, {i: set() for i in texts}
    for i in sorted(texts):
        words = texts[i].lower().split()
        for k in range(len(words) - n + 1):
            w = tuple(words[k : k + n])
            if w in seen:
                covered[i] |= set(range(k, k + n))
            else:
                seen[w] = i
    return covered


def test_repeated_passages_against_every_window(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randrange(30))
    shared = [[word() for _ in range(n)] for n in (50, 51, 80, 300, 49, 40)]
    texts = {}
    for i in range(40):
        parts = [[word() for _ in range(rng.randrange(60))]]
        for p in rng.sample(shared, rng.randrange(3)):
            parts += [p, [word() for _ in range(rng.randrange(1, 60))]]
        texts[i] = " ".join(w for p in parts for w in p)
    texts[40] = texts[3]
    texts[41] = " ".join(["again"] * 400)
    rows = [(i, t, "x") for i, t in texts.items()] + [(None, texts[3], "x"), (99, None, "x"), (98, "", "x"), (3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string").repartition(5)
    got = {i: set() for i in texts}
    for r in sd.repeated_passages(docs).collect():
        assert r.end_word - r.start_word >= 50
        mine, kept = (texts[i].split()[a : a + r.end_word - r.start_word] for i, a in ((r.doc_id, r.start_word), (r.kept_doc_id, r.kept_start_word)))
        assert mine == kept and (r.kept_doc_id, r.kept_start_word) < (r.doc_id, r.start_word)
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    want = brute_passages(texts, 50)
    got.pop(41), want.pop(41)  # one word over and over: covered from its second place on
    assert got == want


def test_passage_beyond_what_the_earliest_copy_holds(spark):
    word = iter(range(10**6))
    new = lambda n: [f"w{next(word)}" for _ in range(n)]
    docs, want = [], set()
    for k in range(60):
        passage, at = new(50), k % 11
        a, b, c = 3 * k, 3 * k + 1, 3 * k + 2
        docs += [(a, new(5) + passage[at : at + 40] + new(5)), (b, new(7) + passage + new(3)), (c, new(2) + passage + new(9))]
        want.add((c, 2, 52, b, 7))
    early, late = new(60), new(40)
    docs += [(900, early), (901, new(4) + early + late), (902, early + late + new(3))]
    want |= {(901, 4, 64, 900, 0), (902, 0, 60, 900, 0), (902, 0, 100, 901, 4)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id bigint, text string").repartition(3)
    assert {tuple(r) for r in sd.repeated_passages(docs).collect()} == want


def test_passages_copied_many_times_with_ids_of_strings(spark):
    word = iter(range(10**6))
    new = lambda n: [f"w{next(word)}" for _ in range(n)]
    passage, other = new(120), new(60)
    docs = [(f"d{i:03}", new(i % 7) + passage + (new(3) + other if i % 5 == 2 else new(i % 4))) for i in range(120)]
    want = {(f"d{i:03}", i % 7, i % 7 + 120, "d000", 0) for i in range(1, 120)}
    want |= {(f"d{i:03}", i % 7 + 123, i % 7 + 183, "d002", 2 + 123) for i in range(7, 120, 5)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id string, text string").repartition(2)
    runs = sd.repeated_passages(docs)
    assert {tuple(r) for r in runs.collect()} == want


def test_passages_of_nothing(spark):
    assert sd.repeated_passages(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    with pytest.raises(ValueError):
        sd.repeated_passages(spark.createDataFrame([], "doc_id int, text string"), 20)


def brute_groups(x, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(len(x))
    near = x @ x.T >= threshold
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def test_embedding_groups_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 16))
    near = base[rng.integers(0, 60, 300)] + rng.normal(size=(300, 16)) * 0.08
    x = np.concatenate([base, near, base[:5], base[:5] * 3])
    want = brute_groups(x, 0.95)
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    rows += [(None, x[0].tolist(), 1), (2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [1.0, 2.0], 1), (2004, [float("nan")] * 16, 1), (7, x[7].tolist(), 1), (2005, [None] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rep int")
    monkeypatch.setattr(ed, "BASE", 16)
    got = {r.vec_id: r.group_id for r in ed.near_duplicate_vectors(df, tile=60).collect()}
    sizes = np.bincount(want, minlength=len(x))
    assert got == {i: int(g) for i, g in enumerate(want) if sizes[g] > 1}
    assert ed.near_duplicate_vectors(spark.createDataFrame([], "vec_id int, embedding array<float>")).count() == 0


def test_embeddings_with_ids_of_strings_and_of_any_scale(spark):
    rows = [("b", [1.0, 2.0]), ("a", [2e-20, 4e-20]), ("c", [1e300, 2e300]), ("d", [2.0, -1.0]), ("e", [float("inf"), 1.0]), ("b", [2.0, -1.0]), ("f", [-0.0, 0.0])]
    got = ed.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [("a", "a"), ("b", "a"), ("b", "b"), ("c", "a"), ("d", "b")]


def test_sequences_with_small_intervals(monkeypatch):
    monkeypatch.setattr(ed, "BASE", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    eps = (2 * (1 - 0.97)) ** 0.5
    up = np.arange(60)
    for a, b in ed.join_sequences(x[:30], x[30:], eps, 0.97) + ed.join_sequences(x[:30], None, eps, 0.97) + [(a + 30, b + 30) for a, b in ed.join_sequences(x[30:], None, eps, 0.97)]:
        up[up == max(up[a], up[b])] = min(up[a], up[b])
    assert (up == brute_groups(x.astype(float), 0.97)).all()
