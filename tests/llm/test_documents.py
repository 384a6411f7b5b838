"""Near duplicates, lines, contamination, toxicity and the pipeline against brute force, and the cases their docstrings define."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import arrowtext, decontaminate, line_dedup, minhash_dedup, packing, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 int, label string, version int, rep int, c2 string"
EMPTY_ROWS = [(None, "no id here at all", None), (9001, None, None), (9002, "", None), (9003, " \n.. \n", None)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, *("en", "s", len(t) if t is not None else None), 1, "x", 1, 1, "c") for i, t, *_ in rows], SCHEMA).repartition(4)


def words(rng, n):
    return ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]


def grams(t, n=3):
    w = re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+", t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def closure(ids, near):
    label = {i: i for i in ids}
    again = True
    while again:
        again = False
        for a in ids:
            for b in ids:
                if near(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    again = True
    return label


def near_fixture():
    rng = random.Random(11)
    texts = {i: words(rng, rng.randrange(1, 120)) for i in range(40)}
    for i in range(40, 90):
        w = list(texts[rng.randrange(12)])
        for _ in range(len(w) // 25):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        texts[i] = w
    texts = {i: " ".join(w) for i, w in texts.items()}
    texts[90], texts[91] = texts[0], texts[0].upper() + "!"
    texts[92] = " ".join(words(rng, 20_000))
    texts[93] = texts[92] + " more"
    return texts


def test_near_duplicates_against_all_pairs(spark):
    texts = near_fixture()
    sets = {i: grams(t) for i, t in texts.items()}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = {(a, b) for a in texts for b in texts if a < b and jaccard(a, b) >= minhash_dedup.THRESHOLD}
    docs = table(spark, [*texts.items(), *EMPTY_ROWS, (5, texts[5])])
    got = {r.doc_id: r.group_id for r in minhash_dedup.near_duplicates(docs).collect()}
    found = {(a, b) for a, b in pairs if got.get(a) == got.get(b) is not None}
    assert len(found) >= 0.9 * len(pairs)
    want = closure(list(texts), lambda a, b: (min(a, b), max(a, b)) in pairs)
    assert all(want[i] == want[g] for i, g in got.items())
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert {None, 9001, 9002, 9003} <= set(left) and set(left) & set(texts) == set(texts) - {i for i, g in got.items() if i != g}


def test_no_text_is_lost_when_a_doc_id_repeats(spark):
    x, y, near = "one two three four five six", "quite another text than that", "one two three four five six seven"
    for rows in ([(1, x), (2, x), (2, y)], [(2, y), (2, x), (1, x)], [(2, x), (2, y), (1, x), (1, x)]):
        left = sorted((r.doc_id, r.text) for r in minhash_dedup.drop_near_duplicates(table(spark, rows)).collect())
        assert sorted(set(left)) == [(1, x), (2, y)] and len(left) == 2 + rows.count((1, x)) - 1
        assert sorted(map(tuple, minhash_dedup.near_duplicates(table(spark, rows)).collect())) == [(1, 1), (2, 1)]
    left = minhash_dedup.drop_near_duplicates(table(spark, [(7, x), (7, near), (7, y)])).collect()
    assert len(left) == 2 and y in {r.text for r in left}
    names = spark.createDataFrame([("b", x), ("a", x), ("c", None)], "doc_id string, text string")
    assert sorted(r.doc_id for r in minhash_dedup.drop_near_duplicates(names).collect()) == ["a", "c"]


def test_near_duplicates_of_nothing(spark):
    assert minhash_dedup.near_duplicates(table(spark, []).limit(0)).count() == 0
    assert minhash_dedup.drop_near_duplicates(table(spark, EMPTY_ROWS)).count() == 4


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def test_lines_against_all_pairs(spark):
    rng = random.Random(4)
    pool = [" ".join(words(rng, rng.randrange(3, 8))) for _ in range(30)] + ["short", "tiny line x", "é" * 25, "a" * 300]
    docs = {}
    for i in range(25):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            x = rng.choice(pool)
            k, how = rng.randrange(len(x)), rng.randrange(5)
            lines.append(rng.choice(["", "  "]) + (x[:k] + "Q" + x[k + (how == 1) :] if how in (0, 1) else x[:k] + x[k + 1 :] if how == 2 else x))
        docs[i] = "\n".join(lines)
    rows = [(i, k, x.strip()) for i, t in docs.items() for k, x in enumerate(t.split("\n"))]
    want = set()
    for n, (i, k, x) in enumerate(rows):
        if len(x) >= 10 and any(x == y or min(len(x), len(y)) >= 20 and distance_one(x, y) for _, _, y in rows[:n]):
            want.add((i, k))
    src = table(spark, [*docs.items(), *EMPTY_ROWS, (3, docs[3])])
    got = line_dedup.duplicate_lines(src).collect()
    assert {(r.doc_id, r.line_no) for r in got} == want
    for r in got:
        assert (r.kept_doc_id, r.kept_line_no) < (r.doc_id, r.line_no)
    out = line_dedup.dedup_lines(src)
    assert out.columns == src.columns
    left = {}
    for r in out.collect():
        left.setdefault(r.doc_id, []).append(r)
    for i, t in docs.items():
        lines = [x for k, x in enumerate(t.split("\n")) if (i, k) not in want]
        if any(x.strip() for x in lines):
            assert all(r.text == "\n".join(lines) and r.n_chars == len(r.text) for r in left[i])
        else:
            assert i not in left
    assert {None, 9001, 9002, 9003} <= set(left)
    assert line_dedup.dedup_lines(src.limit(0)).count() == 0


def slow_alignment(item, text):
    best, prev = 0.0, [0.0] * (len(text) + 1)
    for w in item:
        row = [0.0]
        for j, x in enumerate(text, 1):
            row.append(max(0.0, prev[j - 1] + (1.0 if w == x else decontaminate.MISMATCH), prev[j] + decontaminate.GAP, row[-1] + decontaminate.GAP))
        best, prev = max(best, *row), row
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=8), st.lists(st.integers(0, 4), max_size=14))
def test_alignment_against_the_whole_table(item, text):
    assert decontaminate.smith_waterman(np.array(item, np.uint64), np.array(text, np.uint64))[0] == pytest.approx(slow_alignment(item, text))


def contamination_fixture():
    rng = random.Random(8)
    items = {i: " ".join(words(rng, rng.randrange(12, 40))) for i in range(12)}
    docs = {i: words(rng, rng.randrange(1, 300)) for i in range(60)}
    for i in range(0, 60, 3):
        w = items[i // 5].split()
        if i % 2:
            w[len(w) // 3] = "edited"
            del w[len(w) // 2]
        docs[i][len(docs[i]) // 2 : 0] = w
    return items, {i: " ".join(w) for i, w in docs.items()}


def test_contamination_against_every_pair(spark):
    items, docs = contamination_fixture()
    bench = spark.createDataFrame([*items.items(), (None, "x y z"), (90, None), (91, "one two"), (92, "")], "item_id bigint, text string")
    src = table(spark, [*docs.items(), *EMPTY_ROWS, (0, docs[0])])
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(src, bench).collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if slow_alignment(x.split(), t.split()) >= decontaminate.THRESHOLD * len(x.split())}
    assert set(got) == want and len(want) >= 20
    for (d, i), r in got.items():
        assert r.score == pytest.approx(slow_alignment(items[i].split(), docs[d].split()) / len(items[i].split()))
    joined = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(src, bench, broadcast_limit=0).collect()}
    assert joined == want
    for limit in (0, 10**6):
        kept = decontaminate.drop_contaminated(src, bench, broadcast_limit=limit)
        assert kept.columns == src.columns
        assert {r.doc_id for r in kept.collect()} == (set(docs) | {None, 9001, 9002, 9003}) - {d for d, _ in want}
    assert decontaminate.contaminated(src.limit(0), bench).count() == 0 and decontaminate.drop_contaminated(src, bench.limit(0)).count() == src.count()


def test_both_ways_of_decontamination_are_equal(spark):
    items, docs = contamination_fixture()
    whole = [(i, items[i]) for i in (3, 4, 5)]
    bench = spark.createDataFrame([*items.items(), (0, items[7]), (0, items[7]), (5, "rare short"), (6, None), (7, ""), (8, "die дом é")], "item_id bigint, text string")
    rows = [*docs.items(), (1, "clean words only"), (2, docs[0]), (2, "clean"), (2, docs[0]), (70, "some rare short words"), (71, "x " + whole[0][1]), (None, whole[1][1]), (72, "die дом é"), (73, None), (74, "")]
    src = table(spark, rows)
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    found = [order(decontaminate.contaminated(src, bench, broadcast_limit=k)) for k in (0, 10**6)]
    assert found[0] == found[1]
    assert {(70, 5), (71, 3), (72, 8)} <= {(d, i) for d, i, *_ in found[0]}
    # the second text of item 0 is looked for as well
    assert {d for d, i, *_ in found[0] if i == 7} <= {d for d, i, *_ in found[0] if i == 0}
    kept = [order(decontaminate.drop_contaminated(src, bench, broadcast_limit=k)) for k in (0, 10**6)]
    assert kept[0] == kept[1]
    left = [(r[0], r[1]) for r in kept[0]]
    assert (1, "clean words only") in left and (2, "clean") in left and (2, docs[0]) not in left and (None, whole[1][1]) in left


def test_slices_without_a_match_have_the_same_schema():
    ids = pa.array([7], pa.int64())
    words = arrowtext.hashed_words(pa.array(["one two three four"]))[0]
    _, grams, _, _ = next(decontaminate.gram_series(words, np.array([0, 4]), [3]))
    seeds = decontaminate.Seeds(grams, np.zeros(2, np.int64), [3], [words])
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], names=["doc_id", "text"])
    out = list(decontaminate._scanner(seeds, ids, 0.5, False)([batch("nothing of it here"), batch("one two three four")]))
    assert out[0].schema == out[1].schema and [b.num_rows for b in out] == [0, 1] and out[1].column(1).to_pylist() == [7]


def small_model():
    rng = random.Random(2)
    column = pa.array([" ".join(rng.choice(["stupid", "idiot", "people", "letter", "hello", "good", "class", "assist"]) for _ in range(200)) for _ in range(20)])
    tri = np.zeros(toxicity.SIZE**3)
    for b in toxicity._trigram_counter([pa.RecordBatch.from_arrays([column], names=["text"])]):
        tri[b.column(0).to_numpy()] += b.column(1).to_numpy()
    tri = tri.reshape(toxicity.SIZE, toxicity.SIZE, toxicity.SIZE)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + toxicity.SIZE)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    return np.log((tri + 10 * p2[None]) / (tri.sum(2, keepdims=True) + 10))


def reading_score(said, model, keep=-9.0):
    x = y = 0
    s = 0.0
    for c in said:
        k = toxicity._symbol(c)
        if k == 28:
            s, x, y = s + keep + (model[x, y, 0] if y else 0.0), 0, 0
        else:
            s, x, y = s + model[x, y, k], y, k
    return s + (model[x, y, 0] if y else 0.0)


@settings(max_examples=150, deadline=None)
@given(st.text("sTupid1!$€£{. ooé_", min_size=1, max_size=7))
def test_decoding_against_all_paths(token):
    model = small_model()
    said = toxicity.decode(token, model)
    paths = {"".join(p) for p in itertools.product(*toxicity.lattice(token))}
    assert said in paths and reading_score(said, model) == pytest.approx(max(reading_score(p, model) for p in paths))


def test_long_stretches_and_currencies():
    model = small_model()
    for before in range(40):
        token = " ".join("good" * 10)[: 2 * before] + "s t u p i d" + " " + " ".join("hello" * 30)
        low = ("x9 " + token + " ends here").encode()
        raw = np.frombuffer(low, np.uint8)
        r = toxicity.Restorer(model)
        assert any("stupid" in t for t in r.restored(raw, arrowtext.fold_case(raw), np.array([0, len(low)]))[1])
    for text, want in (("an id€ot, that", "id€ot,"), ("a £etter by", "£etter"), ("a {lass here", "{lass"), ("“good” people’s", None), ("20€ or £5", None), ("i € o t", "i € o t")):
        raw = np.frombuffer(text.encode(), np.uint8)
        spans = toxicity.Restorer.suspects(raw, arrowtext.fold_case(raw), np.array([0, len(raw)]))
        assert [raw[a:b].tobytes().decode() for a, b in spans] == ([want] if want else [])
    assert toxicity.decode("p€opl€", model) == "people"
    began = time.time()
    assert len(toxicity.decode("s t u p 1 d " * 3000, model)) > 10_000
    assert time.time() - began < 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["bad", "badly", "Bäd", "word", "wording", "x", "bad-word", "é", "of"]), max_size=12), min_size=1, max_size=6), st.randoms())
def test_word_values_against_words_one_by_one(texts, rng):
    column = pa.array([" ".join(t) for t in texts])
    raw, offsets = arrowtext.column_bytes(column)
    low = arrowtext.fold_case(raw)
    f = toxicity.Features(low, offsets)
    keys = np.unique(np.concatenate([*f.levels, f.gram, np.array([5], np.uint64)]))
    known = np.sort(np.array(rng.sample(keys.tolist(), rng.randint(1, len(keys))), np.uint64))
    change = [rng.uniform(-1, 2) for _ in known]
    weights = toxicity.Weights(known, change, [c > 0.5 for c in change])
    hot = np.zeros(1 << toxicity._BITS, bool)
    hot[toxicity._bit(weights.hot)] = True
    of, hot_keys, want = dict(zip(known.tolist(), change)), set(weights.hot.tolist()), {}
    for i, d in enumerate(f.doc.tolist()):
        levels, grams_ = [h[i] for h in map(np.ndarray.tolist, f.levels)], f.gram[f.gram_word == i].tolist()
        if hot_keys.isdisjoint(levels + grams_):
            continue
        value = next((of[h] for h in levels if h in of), max([0.0, *(of[g] for g in grams_ if g in hot_keys)]))
        if value > 0:
            want[d, levels[0]] = value
    doc, value = toxicity.word_values(low, offsets, weights, hot)
    assert sorted(zip(doc.tolist(), value.tolist())) == sorted((d, v) for (d, _), v in want.items())


def test_decoding():
    model = small_model()
    for hidden, word in (("1d10t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("h e l l o", "hello"), ("gooood", "good"), ("p30pl3", "people"), ("class", "class")):
        assert toxicity.decode(hidden, model) == word
    low = b"a cl455 x 1d10t. plain words h e l l o end"
    raw = np.frombuffer(low, np.uint8)
    found = toxicity.Restorer.suspects(raw, arrowtext.fold_case(raw), np.array([0, len(low)]))
    assert {low[a:b] for a, b in found} >= {b"cl455", b"1d10t.", b"h e l l o"}


def test_toxicity_on_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    r = toxicity.toxic_documents(docs, fit).join(held.withColumnRenamed("toxic", "truth"), "doc_id").groupBy("truth", "toxic").count().collect()
    n = {(x.truth, x.toxic): x["count"] for x in r}
    assert n.get((1, True), 0) >= 0.8 * (n.get((1, True), 0) + n.get((1, False), 0)), n
    assert n.get((0, True), 0) <= 0.01 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_a_toxic_document_copied_often_makes_no_clean_one_toxic(spark):
    rng = random.Random(9)
    common = words(rng, 300)
    text_of = lambda: " ".join(rng.choices(common, k=80))
    clean, bad = [text_of() for _ in range(400)], [text_of() + f" horrible{i % 3} swine" for i in range(60)]
    rare = words(rng, 60)
    copied = " ".join(rare) + " swine"
    near = [" ".join(w if rng.random() > 0.02 else "edit" for w in copied.split()) for _ in range(40)]
    innocent = [text_of() + " " + " ".join(rng.sample(rare, 12)) for _ in range(30)]
    rows = [*((t, 0) for t in clean), *((t, 1) for t in bad), *((t, 1) for t in [copied] * 40 + near)]
    docs = table(spark, [*((i, t) for i, (t, _) in enumerate(rows)), *((1000 + i, t) for i, t in enumerate(innocent)), (2000, text_of() + " sw1ne")])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxic_documents(docs, labels).collect()}
    assert not any(got[1000 + i] for i in range(30)) and got[2000] and not any(got[i] for i, (_, y) in enumerate(rows) if not y)


def test_toxicity_cases(spark):
    docs = table(spark, [*((i, "plain text of no harm") for i in range(5)), *EMPTY_ROWS, (1, "plain text of no harm")])
    labels = spark.createDataFrame([(0, 0), (None, 1), (1, None)], "doc_id bigint, toxic int")
    got = toxicity.toxic_documents(docs, labels).collect()
    assert len(got) == 10 and not any(r.toxic for r in got)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns and toxicity.drop_toxic(docs, labels).count() == 10
    assert toxicity.toxic_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_pipeline_against_its_parts(spark, tmp_path):
    rng = random.Random(6)
    items, docs = contamination_fixture()
    docs |= {100 + i: t for i, t in near_fixture().items()}
    docs = {i: t + "\n" + rng.choice(["one line that repeats in documents", "another line of text that repeats"]) + "\n" + " ".join(words(rng, 30)) for i, t in docs.items()}
    table(spark, [*docs.items(), *EMPTY_ROWS]).drop("h1", "label", "version", "rep", "c2").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items.items()), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    # by hand: lines first, then groups, then contamination
    seen, left = {}, {}
    for i in sorted(docs):
        keep = []
        for x in docs[i].split("\n"):
            if len(x.strip()) < 10 or not (x.strip() in seen or any(distance_one(x.strip(), y) for y in seen if min(len(x), len(y)) >= 20)):
                keep.append(x)
            seen[x.strip()] = 1
        left[i] = "\n".join(keep)
    sets = {i: grams(t) for i, t in left.items()}
    ids = list(left)
    label = closure(ids, lambda a, b: 2 * min(len(sets[a]), len(sets[b])) > max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= minhash_dedup.THRESHOLD * len(sets[a] | sets[b]))
    left = {i: t for i, t in left.items() if label[i] == i}
    left = {i: t for i, t in left.items() if not any(slow_alignment(x.split(), t.split()) >= decontaminate.THRESHOLD * len(x.split()) for x in items.values() if set(x.split()) & set(t.split()))}
    want = {r.doc_id: r.n_tokens for r in packing.token_lengths(spark.createDataFrame([*left.items(), (9003, " \n.. \n")], "doc_id bigint, text string")).collect()}
    have = {}
    for r in got.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_tokens
    assert have == want


def test_pipeline_with_empty_tables_and_clashing_columns(spark, tmp_path):
    x = "one line of text that nobody repeats anywhere"
    rows = [(1, x), (None, x), (2, None), (3, ""), (4, "another text that is its own and long enough"), (4, "a second text of that document, not like it")]
    docs, labels, bench = table(spark, rows), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), spark.createDataFrame([], "item_id bigint, text string")
    for name, empty in (("none", True), ("some", False)):
        sf = str(tmp_path / name)
        (docs.limit(0) if empty else docs).write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        bench.write.parquet(f"{sf}/benchmark.parquet")
        made = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:4]:
            made = f(spark, made, sf)
            assert made.columns == docs.columns and made.count() == (0 if empty else len(rows)), stage
        got = sorted((r.doc_id, r.start_token) for r in corpus_pipeline.run(spark, sf).collect())
        assert got == ([] if empty else [(1, 0), (4, 0), (4, 0)])
