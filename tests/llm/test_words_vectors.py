"""Spelling variants, hard negatives and the quality classifier against plain versions and held-out labels."""

import random
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oppweave.llm import classifier, negatives, queries, spelling
from oppweave.llm.registry import ORACLES, QUERIES
from oppweave.workloads.check import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_spelling_variants"])
def test_queries_equal_their_twins(spark, name):
    got = QUERIES[name](spark, SF)
    found = duck(SF).execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    assert rows and rows == rows_of(columns, found.fetchall())


# ------------------------------------------------------------------ spelling


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def test_all_pairs_by_one_edit(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(400)}
    words |= {"x" * n for n in range(2, 60)} | {"x" * 20 + "y" + "x" * 30, "q" * 3000, "q" * 2999, "q" * 1500 + "r" + "q" * 1499}
    got = {tuple(r) for r in spelling.one_edit_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_levels_follow_each_other():
    assert [spelling.border(k) for k in range(12)] == [0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48]


def test_words_of_odd_rows(spark):
    rows = [
        (1, "Hello hello HELLO, Àbcde×÷ÿ abcd ABCDÉ"), (1, "Hello hello HELLO, Àbcde×÷ÿ abcd ABCDÉ"), (None, "hello"), (2, None), (3, ""),
        (4, "z" * 100_000 + " hello"), (5, "ŁÓDŹłódź hellos"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r["word"]: r["n"] for r in spelling.count_words(docs, rarest=1).collect()}
    assert got == {"hello": 8, "Àbcde×÷ÿ": 2, "abcdÉ": 2, "z" * 100_000: 1, "hellos": 1}
    every = {r["word"]: r["n"] for r in spelling.count_words(docs, rarest=1, damage=1).collect()}

    def damaged(doc_id, run):
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode()) % len(run)
        return run[:h] + run[h + 1 :]

    assert every["z" * 99_999] == 1 and damaged(5, "hellos") in every
    assert "abcdÉ" not in every and not any(len(w) < 5 for w in every)


def test_forms_and_roots(spark):
    n = {"colour": 40, "color": 16, "colr": 1, "colors": 8, "coolors": 4, "dolour": 20, "colours": 40, "alone": 3}
    words = spark.createDataFrame(list(n.items()), "word string, n int")
    got = {r["word"]: r for r in spelling.variant_groups(words).collect()}
    for w, r in got.items():
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= 2 * n[w] else None
        assert (r["n"], r["n_near"], r["form"], r["form_n"]) == (n[w], len(near), form, n.get(form))
    assert got["coolors"]["root"] == "colours" and got["alone"]["root"] == "alone"
    assert spelling.variant_groups(words.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.variant_groups(words, times=1)


# ------------------------------------------------------------------ hard negatives


def test_pairs_come_by_falling_sum():
    a, b = np.array([3.0, -1, 7, 7]), np.array([0.5, 9, -4])
    found = list(negatives.by_sum(a, b))
    assert [round(s, 9) for s, _, _ in found] == sorted((x + y for x in a for y in b), reverse=True)
    assert len({(i, j) for _, i, j in found}) == 12 and all(a[i] + b[j] == s for s, i, j in found)


def vectors(seed=3, n=900, d=7):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, d))
    rows = []
    for k in range(n):
        v = middle[k % 6] + 0.4 * rng.normal(size=d)
        if k % 3 == 0:
            v = middle[0]  # a third of all vectors are equal
        rows.append((k, v.astype(np.float32).tolist(), int(rng.integers(0, 4))))
    return rows


def brute(rows, k=5):
    q = {i: (lab, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v, lab in rows}
    out = []
    for a in (i for i in q if i % 50 == 0):
        scored = sorted((-int(q[a][1] @ q[b][1]), b) for b in q if b != a)
        for s, p in [x for x in scored if q[x[1]][0] == q[a][0]][:k]:
            inside = ((-t, b) for t, b in scored if q[b][0] != q[a][0] and 80 * -s <= 100 * -t <= 100 * -s)
            out += [(a, p, rank, b, -s, t) for rank, (t, b) in enumerate(islice(inside, k), 1)]
    return sorted(out)


def test_search_equals_a_full_comparison(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SLICE_VALUES", 300)  # many slices
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("q", F.lit("clash"))
    index, placed = negatives.build_index(negatives.scaled(table, 256.0))
    assert index.rows.sum() == len(rows) == placed.count() and index.slices.max() > 1
    got = sorted(tuple(r) for r in negatives.hard_negatives(negatives.scaled(table, 256.0), F.col("id") % 50 == 0).collect())
    assert got == brute(rows)


def test_visits_stop_at_a_certified_bound():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 4)) * 3 + c for c in (-400, 0, 400)])
    books = negatives.centres(x[:, :2], 3), negatives.centres(x[:, 2:], 3)
    own = [negatives.nearest(h, b) for h, b in zip((x[:, :2], x[:, 2:]), books)]
    radii = [np.array([np.linalg.norm(h[o == k] - b[k], axis=1).max() for k in range(3)]) for h, b, o in zip((x[:, :2], x[:, 2:]), books, own)]
    cell = own[0] * 3 + own[1]
    index = negatives.Index(books, tuple(radii), np.ones(9, dtype=int), np.bincount(cell, minlength=9) + 4096)
    anchor = x[800]
    first = {c for c, _ in index.visits(anchor, None)}
    best = np.sort(x[np.isin(cell, list(first))] @ anchor)[-5]
    assert len(first) == 1 and list(index.visits(anchor, best)) == []  # the rest cannot hold anything better
    for least in (-1e9, 0.0, best):
        seen = first | {c for c, _ in index.visits(anchor, least)}
        assert (x[~np.isin(cell, list(seen))] @ anchor < least).all()


def test_odd_vectors_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.1], 2), (2, [0.8, 0.1], 2), (3, None, 1), (4, [1.0, None], 2), (5, [float("nan"), 1.0], 2),
        (6, [float("inf"), 1.0], 2), (7, [1.0], 2), (8, [], 2), (9, [0.9, 0.0], None), (None, [0.9, 0.0], 2), (11, [1e30, 0.0], 2),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in negatives.hard_negatives(negatives.scaled(table, 256.0), F.col("id") % 100 == 0).collect()]
    assert got == [(0, 1, 1, 2, 256 * 230, 256 * 204)]
    assert negatives.hard_negatives(negatives.scaled(table.limit(0), 256.0), F.col("id") % 100 == 0).collect() == []


# ------------------------------------------------------------------ classifier


def test_held_out_documents_are_told_apart(spark):
    scored = {r["doc_id"]: r for r in queries.op12_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for k, r in scored.items())
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in scored.values())
    held = [(scored[r["doc_id"]]["predicted"], r["quality"]) for r in labels if scored[r["doc_id"]]["held_out"]]
    assert len(held) > 40 and np.mean([p == q for p, q in held]) >= 0.95


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    plain = classifier.fit_trees(docs, labels)
    odd = docs.withColumn("label", F.lit(7)).withColumn("x", F.lit("clash")).withColumn("id", F.lit(1))
    same = classifier.fit_trees(odd, labels.withColumn("text", F.lit("clash")))
    assert all(np.array_equal(getattr(plain, c), getattr(same, c)) for c in ("feature", "threshold", "left", "right", "value"))


def test_flat_trees_walk_like_single_ones():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, len(classifier.STATISTICS)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = classifier.grow(x, y, trees=20)

    def walk(row):
        total = model.base
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        return total

    assert np.allclose(model.raw(x[:80]), [walk(r) for r in x[:80]])
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.97


def test_scores_without_labels_texts_or_rows(spark):
    one = classifier.grow(np.zeros((3, 19)), np.ones(3))
    assert classifier.grow(np.zeros((0, 19)), np.zeros(0)).score(np.zeros((2, 19))).tolist() == [0.5, 0.5]
    assert one.score(np.zeros((1, 19))).tolist() == [0.8]
    texts = [None, "", " \n ", "word " * 200_000, "é", "same", "same"]
    docs = spark.createDataFrame([(t, 9.0) for t in texts], "text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    ids = docs.withColumn("doc_id", F.lit(1).cast("long"))
    model = classifier.fit_trees(ids, none)
    assert {r["score"] for r in classifier.with_scores(docs, model).collect()} == {0.5}
    assert classifier.with_scores(docs.limit(0), model).count() == 0
    values = classifier.statistics(pa.array(texts))
    assert not values[:3].any() and np.isfinite(values).all() and (values[5] == values[6]).all()
    counted = Counter(classifier.STATISTICS)
    assert max(counted.values()) == 1 and values.shape == (7, len(counted))
