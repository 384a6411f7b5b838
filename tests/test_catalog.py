import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from foliospark import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    return None if pd.isna(v) else round(float(v), 5) if isinstance(v, float) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    have, want = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(have.columns) == sorted(want.columns) and rows(have) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(old + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_fuzzy_position_in_other_texts_against_brute_force(spark, tmp_path):
    items = [(0, "alpha beta gamma and more"), (1, "one two six and more"), (2, "zzzzz qqqqq xxxxx and more")]
    texts = ["a alpha bata gamma b", "on two six at first", "nothing of it", "no alpa beta gama", "seven one twoo sax", "", "alpha beta gamma", None, "it is so"]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalog.QUERIES["fuzzy_position"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and got[7].start is None and got[0].start == 2 and got[6].start == 0
    for i, text in enumerate(texts):
        if text is None:
            continue
        needle = " ".join(items[i % 3][1].split()[:3])
        most = min(len(needle) - 1, len(needle) // 2 + 5)
        least = {s: min(edits(needle, text[s:e]) for e in range(s, len(text) + 1)) for s in range(len(text) + 1)}
        best = min(least.values())
        if best > most:
            assert (got[i].start, got[i].score) == (-1, 0)
        else:
            assert least[got[i].start] == best and got[i].score == pytest.approx(1 - best / most)
