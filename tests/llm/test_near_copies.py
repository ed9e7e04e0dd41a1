"""The Jaccard join against all pairs in memory."""

import random
import re

import pytest

from oppweave.llm import jaccard, queries
from oppweave.llm.components import components


def brute(rows):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root(k), []).append(i)
    small = {r: min((i for i in v if i is not None), default=None) for r, v in least.items()}
    return sorted((str(rows[k][0]), len(sets[k]), str(small[root(k)])) for k in range(len(rows)))


def edited(words, rng, rate):
    return " ".join(rng.choice("xyz") + str(rng.randrange(999)) if rng.random() < rate else w for w in words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 7, 40, 150]))
        for _ in range(rng.choice([1, 2, 6, 25])):
            out.append(edited(base, rng, rng.choice([0, 0.005, 0.02, 0.06])))
    out += [passage + " " + " ".join(rng.choices(vocabulary, k=30)) for _ in range(20)]
    out += ["", None, " \t\n", "One Two three", "one two THREE", "one two three four", "É a b c d e", "é a b c d e", "w " * 4000]
    out += [out[0], out[0], "a b c d e\x0bf", "a b c d e f"]
    rows = [(k, t) for k, t in enumerate(out)] + [(None, out[0]), (None, "alone with no id at all here"), (3, "repeated id text of six words")]
    rng.shuffle(rows)
    return rows


def test_groups_equal_all_pairs(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, component_id int, set_key int").repartition(7)
    got = jaccard.near_groups(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(rows)


def test_small_chunks_and_common_shingles_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_NODES", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.near_groups(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(rows)


def test_one_document_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    groups = brute(rows)
    named = {g for _, n, g in groups if n and g != "None"}
    unnamed = sum(1 for _, n, g in groups if n and g == "None")  # each alone in these rows
    empty = sum(1 for _, n, _ in groups if not n)
    got = kept.collect()
    assert len(got) == len(named) + unnamed + empty
    assert {str(r["doc_id"]) for r in got} >= named


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_groups(docs).count() == 0 and jaccard.drop_near_copies(docs).count() == 0


def test_divide_skip_counts_members():
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randrange(1, 25))) for _ in range(rng.randrange(1, 20))]
        least = rng.randrange(1, len(lists) + 2)
        want = {d: n for d in range(30) if (n := sum(d in own for own in lists)) >= least}
        assert dict(jaccard.divide_skip(lists, least)) == want


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(205, 200), (200, 203), (203, 205)] + [(7, 7)]
    nodes = spark.createDataFrame([(k,) for k in (*range(41), *range(100, 130), 200, 203, 205, 300)], "id long")
    got = {r["id"]: r["component"] for r in components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 130))
    assert got[205] == got[203] == 200 and got[300] == 300 and len(got) == 75


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op4_jaccard_join(spark, sf).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(rows)
