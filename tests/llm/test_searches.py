"""Nearest neighbours and ranked documents against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlark.llm import lexical, vector_tree

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def slow_neighbours(rows, k, queries):
    """{query row: [(id, score)]}; rows are (id, vector) of those that take part, ids may be null."""
    x = np.array([v for _, v in rows], np.float64)
    size = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        scores = (x * x[q]).sum(axis=1) / (size[q] * size)
        order = sorted((j for j in range(len(rows)) if j != q), key=lambda j: (-scores[j], rows[j][0] is None, rows[j][0] or 0))
        out[q] = [(rows[j][0], scores[j]) for j in order[:k]]
    return out


def test_neighbours_recall_on_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    queries = [i for i, r in enumerate(rows) if r[0] % 50 == 0]
    true = {rows[q][0]: x for q, x in slow_neighbours(rows, 5, queries).items()}
    found = vector_tree.neighbours(vectors, F.col("vec_id") % 50 == 0).collect()
    assert Counter(r.query_id for r in found) == dict.fromkeys(true, 5)
    place = {r[0]: i for i, r in enumerate(rows)}
    for r in found:
        a, b = (np.array(rows[place[i]][1], np.float64) for i in (r.query_id, r.vec_id))
        assert r.score == pytest.approx(float(a @ b / math.sqrt((a @ a) * (b @ b))), abs=1e-14)
    for q in true:
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
    hits = sum((r.query_id, r.vec_id) in {(q, i) for q, x in true.items() for i, _ in x} for r in found)
    assert hits / len(found) >= 0.9


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    """Null, zero, non-finite and odd-sized vectors; ties, copies, scaled copies, null and repeated ids, clashing columns; all leaves visited."""
    monkeypatch.setattr(vector_tree, "LEAF", 8)
    monkeypatch.setattr(vector_tree, "BLOCK", 7)
    monkeypatch.setattr(vector_tree, "PACK", 3)
    draw = np.random.default_rng(11)
    rows = [(i, [float(v) for v in draw.normal(size=6)]) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 0.5, 0.0, 0.0, -1.0]) for i in range(40)] + [(50, rows[3][1]), (None, rows[3][1]), (400, [v * 1e200 for v in rows[3][1]]), (450, [v * 1e-200 for v in rows[4][1]])]
    bad = [(500, None), (501, [0.0] * 6), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] + [1.0] * 5), (601, [float("inf")] + [1.0] * 5), (602, [1.0]), (650, [])]
    table = spark.createDataFrame([(*r, 1.0, 2) for r in rows + bad], "vec_id long, embedding array<double>, score double, rank int").repartition(3)
    scaled = [(i, list(np.array(v) / max(abs(x) for x in v))) for i, v in rows]
    want = slow_neighbours(scaled, 5, [i for i, r in enumerate(rows) if r[0] is not None and r[0] % 50 == 0])
    found = vector_tree.neighbours(table, F.col("vec_id") % 50 == 0, recall=1.0).collect()
    assert sorted((r.query_id, r.vec_id is None, r.vec_id or 0, round(r.score, 9)) for r in found) == sorted((rows[q][0], i is None, i or 0, round(float(s), 9)) for q, x in want.items() for i, s in x)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in vector_tree.neighbours(few, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    assert vector_tree.neighbours(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert vector_tree.neighbours(few.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert vector_tree.neighbours(few.where("vec_id = 3"), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_holds_every_vector_and_visits_every_leaf():
    draw = np.random.default_rng(12)
    # two thirds in one tight group: the group has leaves of its own
    x = vector_tree.unit(np.concatenate([draw.normal(size=(1000, 8)), np.ones(8) + 0.01 * draw.normal(size=(2000, 8))]))
    tree, leaves = vector_tree.fit(x, 48)
    sizes = np.bincount(vector_tree.leaves_of(tree, x), minlength=leaves)
    assert sizes.sum() == 3000 and sizes.max() < 600 and leaves >= 24
    assert sorted(vector_tree.best_bins(tree, x[5], leaves)) == list(range(leaves))
    assert vector_tree.best_bins(tree, x[5], 3) == vector_tree.best_bins(tree, x[5], leaves)[:3]


def slow_ranked(docs, items, k):
    terms = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n_docs, n_terms = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall((text or "").translate(UPPER))), []
        for d, c in terms:
            m, score = 75 + 25 * c.total() * n_docs // n_terms, 0
            for t, times in asked.items():
                if t in c:
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, n, None if nameless else d, -s) for n, (s, nameless, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


DOCS = "doc_id long, text string, item_id long, score long, terms string"


@pytest.mark.parametrize("small", [True, False])
def test_ranked_against_all_documents(spark, monkeypatch, small):
    """Skewed words, ties, nulls, repeated ids, very long texts, other alphabets; once with every bound small."""
    if small:
        for name, bound in (("VOCABULARY", 3), ("ENTRIES", 40), ("CHUNK", 11), ("TABLE", 300), ("PAIRS", 5)):
            monkeypatch.setattr(lexical, name, bound)
    draw = random.Random(12)
    words = ["the", "Of", "été", "ÉTÉ", "λόγος", "x1", *(f"w{i}" for i in range(60))]
    text = lambda n: draw.choice([" ", "-", "\n"]).join(draw.choice(words[: draw.choice([3, 6, 20, 66])]) for _ in range(n))
    docs = [(i, text(draw.randrange(40))) for i in range(250)] + [(300 + i, "same words here w1 w2") for i in range(30)]
    docs += [(7, "w59 w58"), (7, "w59 w58"), (None, "w59 w57 the"), (400, None), (401, ""), (402, " .,\n"), (403, "w3 " * 5000 + "rare"), (404, "z" * 4000)]
    items = [(i, text(draw.randrange(1, 12))) for i in range(25)] + [(30, None), (31, ""), (32, "nowhere"), (33, "same words w1"), (33, "the the W59 w59"), (None, "Rare w3"), (34, "The")]
    table = spark.createDataFrame([(*r, 5, 5, "x") for r in docs], DOCS).repartition(4)
    asked = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    for k in (1, 4, 20):
        found = lexical.ranked(table, asked, k)
        assert sorted(map(tuple, found.collect()), key=repr) == slow_ranked(docs, items, k), k
    assert lexical.ranked(table.limit(0), asked).count() == lexical.ranked(table, asked.limit(0)).count() == 0
    assert lexical.ranked(table.where("doc_id = 404"), asked).count() == 0


def test_thresholds_leave_terms_out(spark):
    """An item with a rare term many documents hold needs no candidates by its common ones."""
    docs = spark.createDataFrame([(i, "common " * 3 + ("rare" if i < 30 else "other")) for i in range(2000)], "doc_id long, text string")
    asked = lexical._items(spark.createDataFrame([(1, "common rare")], "item_id long, text string"))
    vocabulary = asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("key"))
    forward = lexical._forward(docs, vocabulary)
    statistics = lexical.term_statistics(forward, 2000, 8000, 20)
    entries = asked.join(vocabulary, "term").join(statistics, "key").select("item", "item_id", "key", (F.col("weight") * F.col("n")).alias("weight"), "most", "kth").toPandas()
    block = lexical.Block(entries)
    assert len(block.lead_key) == 1 and len(block.key) == 2 and block.threshold[0] > block.rest[0] >= 0
