"""Nulls, repeated ids, empty tables, odd texts and clashing names, through operators and the whole pipeline."""

import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from postlark.llm import repeats, rules, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_repeats_with_null_and_repeated_ids(spark):
    """Rows of one id aren't smaller than one another; rows without one are the smallest and lose nothing."""
    draw = random.Random(2)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passages = [text(60), text(130), text(49)]
    rows = [(draw.choice([None, 1, 1, 2, 3, 3, 9]), text(draw.randrange(30)) + draw.choice(passages) + text(draw.randrange(30)) + draw.choice(passages)) for _ in range(24)] + [(4, passages[1]), (4, passages[1]), (5, passages[1]), (None, passages[1]), (6, None), (None, None), (7, "")]
    strings = [(d, t or "", {(t or "")[i : i + 50] for i in range(len(t or "") - 49)}) for d, t in rows]
    want = Counter()
    for d, t, _ in strings:
        gone = [False] * len(t)
        if d is not None:
            seen = set().union(*(s for e, _, s in strings if e is None or e < d))
            for i in range(len(t) - 49):
                if t[i : i + 50] in seen:
                    gone[i : i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[d, len(t), sum(gone), spans, hashlib.sha256("".join(c for c, g in zip(t, gone, strict=True) if not g).encode()).hexdigest()] += 1
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, least string, n_bytes int")
    assert Counter(map(tuple, repeats.without_repeats(table).collect())) == want


def test_warc_ties_and_clashing_names(spark):
    long, other = "a" * 1200, "b" * 1000
    rows = [(None, long), (7, long), (3, long), (None, other), (8, "short"), (None, "short"), (5, None), (6, "")]
    table = spark.createDataFrame([(d, "http://x", h, "mine", 1, "r") for d, h in rows], "page_id long, url string, html string, record_type string, payload_bytes long, refers_to string")
    out = Counter(map(tuple, warc.archived_pages(table).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    known = {(d, len(h or ""), sha(h), "revisit" if d == 3 else "response", 7 if d == 3 else None) for d, h in rows if d is not None}
    assert known <= set(out) and sum(out.values()) == len(rows)
    assert sorted((r[1], r[2]) for r in out.elements() if r[0] is None) == sorted((len(h), sha(h)) for d, h in rows if d is None)


def grown(cells, edges):
    """The best single condition, then the next, by trying all of them: the gain as FOIL defines it, by counting rows."""
    conditions = ()

    def counts(c):
        rows = [(b, g) for bins, b, g in cells if all((bins[f] > t) == above for f, above, t in c)]
        return sum(b for b, _ in rows), sum(g for _, g in rows)

    while len(conditions) < rules.MAX_CONDITIONS and all(counts(conditions)):
        bad, good = counts(conditions)
        gains = {}
        for f, own in enumerate(edges):
            for t in range(len(own)):
                for above in (False, True):
                    b, g = counts((*conditions, (f, above, t)))
                    if b >= rules.LEAST_COVER:
                        gains[f, above, t] = b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good)))
        if not gains or max(gains.values()) <= 1e-9:
            break
        conditions = (*conditions, max(gains, key=gains.get))
    return conditions, counts(conditions)


def test_rules_are_grown_and_pruned_as_counting_says():
    """Gains of grown conjunctions equal those of the best by trial, and no condition that pruning leaves could go without loss."""
    draw = random.Random(6)
    for _ in range(30):
        edges = [[0.1, 0.2, 0.3], [0.5], [1.0, 2.0]]
        rows = [tuple(draw.randrange(len(e) + 1) for e in edges) for _ in range(200)]
        cells = [(bins, *((1, 0) if (bins[0] > 1 and bins[2] < 2) != (draw.random() < 0.1) else (0, 1))) for bins in rows]
        found = rules._grow(cells, [len(e) + 1 for e in edges])
        _, want = grown(cells, edges)
        got = rules._counts(cells, found)
        assert got[0] >= rules.LEAST_COVER and abs(got[0] / sum(got) - want[0] / sum(want)) < 1e-9
        worth = lambda c: (lambda b, g: (b - g) / (b + g) if b + g else -1.0)(*rules._counts(cells[::2], c))  # noqa: E731, B023
        kept = rules._prune(cells[::2], found)
        assert worth(kept) >= worth(found) and (len(kept) == 1 or all(worth(kept[:k] + kept[k + 1 :]) < worth(kept) for k in range(len(kept))))
        for rule in rules.cover(cells[::2], cells[1::2], edges, ("a", "b", "c")):
            assert rule.conditions


def pipeline_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 150").write.parquet(f"{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_pipeline_on_nulls_and_odd_rows(spark, tmp_path):
    import corpus_pipeline

    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    odd = [(500, None, "en", "s", 0), (501, "", None, None, None), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 mail a@b.cd", "en", None, 7), (502, " \n ", "en", "s", 3), (base[0][0], base[0][1], None, "other", None), (503, "ab " * 60_000, "en", "s", 180_000), base[3]]
    sf = pipeline_tables(spark, tmp_path, base + odd)
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")], name
        ids = {r.doc_id for r in docs.collect()}
        kept = ids if kept is None else kept
        assert ids <= kept and 500 not in ids and 501 not in ids and 502 not in ids, name
    assert not any("a@b.cd" in r.text for r in docs.collect())
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "n_tokens"] and all(r.n_tokens == len(r.ids) for r in out.collect())


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    sf = pipeline_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    names = ("u", "copy", "copies", "kept", "n_words", "component_id", "a", "n", "k", "label", "spans", "shuffle_key", "rule")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in names])
    columns, sf = docs.columns, f"file://{tmp_path}"
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns and all(r[c] == f"{c}-{r.doc_id}" for r in docs.collect() for c in names), name
