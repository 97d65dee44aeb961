"""Ranked lexical search of all documents for a set of items: a join seeded with thresholds.

1. Documents become a forward index: for each document its number of terms and how often it has each term that
   any item has. A second pass gives, for each term, how many documents hold it, the largest and the kth
   largest of its factors; times the term's weight these are its largest and its kth impact.
2. A term's kth impact, times how often an item has the term, is no more than the item's kth score: so many
   documents score at least as much by this term alone. The largest of these is the item's threshold.
3. An item's terms are ordered by their bounds, the largest first. Terms at the end whose bounds, taken
   together, stay below the threshold bring no document among the first k by themselves: only
   documents with one of the terms before them are candidates.
4. A task reads documents, adds up impacts of the leading terms, leaves those that the bounds of the
   other terms can't bring to the threshold, and scores the rest exactly. Thresholds rise with what the task has
   found, and it passes on no more than k documents an item. Items come in blocks of bounded size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents that are ranked for an item.
RANKED = 20
#: What a term is: text without ASCII signs, in UTF-8, where all other characters have bytes above 0x7F.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Terms up to which tasks hold the items' vocabulary; beyond, it is joined. Terms of items in a block.
VOCABULARY, ENTRIES = 1_000_000, 1 << 20
#: Bytes of a text that are taken at once; places of the tables in which documents are scored; pairs scored exactly at once.
CHUNK, TABLE, PAIRS = 1 << 20, 1 << 21, 1 << 15


def counted_terms(text: str | None) -> Counter:
    """How often a text has each term; long texts are taken in parts that end between terms."""
    data, out, at = (text or "").encode().lower(), Counter(), 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            rest = TERM.match(data, end)
            end = rest.end() if rest else end
        out.update(TERM.findall(data, at, end))
        at = end
    return out


def _items(items: DataFrame) -> DataFrame:
    """(item, item_id, term, n), written: the terms of each row of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [counted_terms(t.as_py()) for t in batch.column(2)]
            which = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            terms, n = [t.decode() for c in counts for t in c], [k for c in counts for k in c.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which)), pa.array(terms, pa.string()), pa.array(n, pa.int64())], ["item", "item_id", "term", "n"])

    rows = written(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"), "items")
    return written(rows.mapInArrow(run, "item long, item_id long, term string, n long"), "item_terms")


def _forward(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(row, doc_id, size, terms, counts), written: of each document with a term, those of the vocabulary (term, key)."""
    known = None
    if vocabulary.count() <= VOCABULARY:
        known = docs.sparkSession.sparkContext.broadcast({r.term.encode(): r.key for r in vocabulary.toLocalIterator()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = [counted_terms(t.as_py()) for t in part.column(1)]
                sizes = np.array([c.total() for c in counts], np.int64)
                if known is None:
                    held = [[(t.decode(), n) for t, n in c.items()] for c in counts]
                else:
                    keys = known.value
                    held = [sorted((keys[t], c[t]) for t in c.keys() & keys.keys()) for c in counts]
                ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
                terms = pa.array([t for h in held for t, _ in h], pa.string() if known is None else pa.int64())
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (terms, pa.array([n for h in held for _, n in h], pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *lists], ["doc_id", "size", "terms", "counts"]).filter(pa.array(sizes > 0))

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = plain.mapInArrow(count, f"doc_id long, size long, terms array<{'string' if known is None else 'long'}>, counts array<long>")
    out = written(out.select(F.monotonically_increasing_id().alias("row"), "*"), "forward")
    if known is not None:
        return out
    each = out.select("row", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("row", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    lists = each.join(vocabulary, "term").groupBy("row").agg(F.collect_list(F.struct("key", "n")).alias("held"))
    none = F.array().cast("array<struct<key:long,n:long>>")
    held = out.select("row", "doc_id", "size").join(lists, "row", "left").withColumn("held", F.coalesce("held", none))
    return written(held.select("row", "doc_id", "size", F.col("held.key").alias("terms"), F.col("held.n").alias("counts")), "forward")


class Factors:
    """The factor of a term in a document: it grows with its occurrences and falls with the document's length."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms

    def __call__(self, sizes: np.ndarray, counts: np.ndarray, each: np.ndarray) -> np.ndarray:
        """Factors of counts; each is how many terms a document has here."""
        lengths = np.array([75 + 25 * int(n) * self.n_docs // self.n_terms for n in sizes], np.int64)
        return 1_000_000_000 * counts // (1000 * counts + 12 * np.repeat(lengths, each))


def _flat(batch: pa.RecordBatch, factors: Factors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, factors, and how many of them each document of a batch (row, doc_id, size, terms, counts) has."""
    each = np.diff(batch.column(3).offsets.to_numpy())
    terms, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4))
    return terms, factors(batch.column(2).to_numpy(), counts, each), each


def term_statistics(forward: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(key, weight, most, kth): each term's weight, its largest factor and its kth largest (0 where fewer documents hold it)."""
    factors = Factors(n_docs, n_terms)

    def merged(terms: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((-found, terms))
        terms, found = terms[order], found[order]
        first = np.flatnonzero(np.diff(terms, prepend=terms[:1] - 1))
        nth = np.arange(len(terms)) - np.repeat(first, np.diff(np.append(first, len(terms))))
        return terms[nth < k], found[nth < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, totals = (np.zeros(0, np.int64), np.zeros(0, np.int64)), Counter()
        for batch in batches:
            if batch.num_rows:
                terms, found, _ = _flat(batch, factors)
                keys, n = np.unique(terms, return_counts=True)
                totals.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
                best = merged(np.concatenate([best[0], terms]), np.concatenate([best[1], found]))
        keys, first = np.unique(best[0], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(best[0])).astype(np.int32)), pa.array(best[1]))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([totals[x] for x in keys.tolist()], pa.int64()), lists], ["key", "df", "best"])

    parts = forward.mapInArrow(run, "key long, df long, best array<long>").groupBy("key")
    held = parts.agg(F.sum("df").alias("df"), F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best"))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    return held.select("key", weight.alias("weight"), F.col("best")[0].alias("most"), F.coalesce(F.get("best", F.lit(k - 1)), F.lit(0)).cast("long").alias("kth"))


class Block:
    """Some items with their terms, split into leading and other ones by the thresholds."""

    def __init__(self, entries: pd.DataFrame):
        """Entries are (item, item_id, key, weight, most, kth); weights hold how often the item has the term."""
        entries = entries.assign(bound=entries["weight"] * entries["most"], least=entries["weight"] * entries["kth"])
        entries = entries.sort_values(["item", "bound", "key"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
        by_item = entries.groupby("item", sort=True)
        self.items = by_item["item_id"].first().index.to_numpy()
        named = by_item["item_id"].first()
        self.ids, self.nameless = named.fillna(0).to_numpy(np.int64), named.isna().to_numpy(bool)
        self.threshold = by_item["least"].max().to_numpy(np.int64)
        which = np.searchsorted(self.items, entries["item"].to_numpy())
        # what this term and those behind it can bring together
        ahead = by_item["bound"].cumsum().to_numpy(np.int64) - entries["bound"].to_numpy(np.int64)
        total = by_item["bound"].sum().to_numpy(np.int64)
        leading = total[which] - ahead >= np.maximum(self.threshold, 1)[which]
        self.rest = np.zeros(len(self.items), np.int64)
        np.add.at(self.rest, which[~leading], entries["bound"].to_numpy(np.int64)[~leading])
        # by item, for exact scores
        self.start = np.append(np.searchsorted(which, np.arange(len(self.items))), len(which))
        self.key, self.weight = entries["key"].to_numpy(np.int64), entries["weight"].to_numpy(np.int64)
        # by term, for candidates
        order = np.argsort(self.key[leading], kind="stable")
        self.lead_key, self.lead_item, self.lead_weight = self.key[leading][order], which[leading][order], self.weight[leading][order]


def _sums(block: Block, table: np.ndarray, terms: np.ndarray, docs: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Exact scores of pairs; the table has a document's factors by term, its last column is zero."""
    where = np.searchsorted(terms, block.key)
    where[where == len(terms)] = 0
    column = np.where(terms[where] == block.key, where, len(terms)) if len(terms) else np.zeros(len(block.key), np.int64)
    out = np.zeros(len(docs), np.int64)
    sizes = (block.start[1:] - block.start[:-1])[items]
    slices = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS, prepend=-1)), len(docs))
    for a, b in zip(slices[:-1], slices[1:], strict=True):
        size = sizes[a:b]
        ends = np.cumsum(size)
        entry = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(block.start[items[a:b]], size)
        out[a:b] = np.add.reduceat(table[np.repeat(docs[a:b], size), column[entry]] * block.weight[entry], ends - size)
    return out


def _scored(block: Block, threshold: np.ndarray, terms: np.ndarray, factors: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, items and exact scores of the pairs that reach the thresholds."""
    n = len(each)
    doc, (names, own) = np.repeat(np.arange(n), each), np.unique(terms, return_inverse=True)
    table = np.zeros((n, len(names) + 1), np.int64)
    table[doc, own] = factors
    found = np.zeros((n, len(block.items)), np.int64)
    low, high = np.searchsorted(block.lead_key, names, "left"), np.searchsorted(block.lead_key, names, "right")
    order = np.argsort(own, kind="stable")
    ends = np.cumsum(np.bincount(own, minlength=len(names)))
    for t in np.flatnonzero(high > low):
        some = order[(ends[t - 1] if t else 0) : ends[t]]
        found[doc[some][:, None], block.lead_item[low[t] : high[t]]] += factors[some][:, None] * block.lead_weight[low[t] : high[t]]
    docs, items = np.nonzero((found > 0) & (found + block.rest >= threshold))
    scores = _sums(block, table, names, docs, items)
    good = scores >= np.maximum(threshold[items], 1)
    return docs[good], items[good], scores[good]


FOUND = "item long, item_id long, row long, doc_id long, score long"


def _searched(forward: DataFrame, entries: pd.DataFrame, factors: Factors, k: int) -> DataFrame:
    """At most k documents of each task and item of a block: all that may be among the item's first k."""
    held = forward.sparkSession.sparkContext.broadcast(Block(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        threshold = block.threshold.copy()
        best = [np.zeros(0, np.int64) for _ in range(5)]  # item, score, nameless, doc_id, row

        def first(*more: np.ndarray) -> list[np.ndarray]:
            item, score, nameless, doc_id, row = all_ = [np.concatenate(x) for x in zip(best, more, strict=True)]
            order = np.lexsort((row, doc_id, nameless, -score, item))
            item = item[order]
            head = np.flatnonzero(np.diff(item, prepend=-1))
            nth = np.arange(len(item)) - np.repeat(head, np.diff(np.append(head, len(item))))
            full = nth == k - 1
            threshold[item[full]] = np.maximum(threshold[item[full]], score[order][full])
            return [x[order][nth < k] for x in all_]

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # documents are taken together as far as the tables stay bounded
                offsets = batch.column(3).offsets.to_numpy()
                many = np.arange(1, batch.num_rows - at + 1)
                room = (many * (offsets[at + 1 : batch.num_rows + 1] - offsets[at]) <= TABLE) & (many * len(block.items) <= TABLE)
                take = max(1, int(np.argmin(room)) if not room.all() else len(room))
                part = batch.slice(at, take)
                at += take
                terms, found, each = _flat(part, factors)
                docs, items, scores = _scored(block, threshold, terms, found, each)
                if len(docs):
                    doc_id = part.column(1)
                    best = first(items, scores, doc_id.is_null().to_numpy(zero_copy_only=False)[docs].astype(np.int64), doc_id.fill_null(0).to_numpy()[docs], part.column(0).to_numpy()[docs])
        item, score, nameless, doc_id, row = best
        yield pa.RecordBatch.from_arrays([pa.array(block.items[item]), pa.array(block.ids[item], mask=block.nameless[item]), pa.array(row), pa.array(doc_id, mask=nameless.astype(bool)), pa.array(score)], ["item", "item_id", "row", "doc_id", "score"])

    return forward.mapInArrow(run, FOUND)


def ranked(docs: DataFrame, items: DataFrame, k: int = RANKED) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of each item with the highest scores above 0.

    A score adds up, over the item's terms with repeats, floor(1000 ln((2N + 2) / (2 df + 1))) times the factor of the
    term in the document; see Factors. Equal scores come by doc_id, rows without one last. Every row of ``docs`` is a
    document and every row of ``items`` an item, whatever ids they share. Null and empty texts have no
    terms: such documents aren't counted, such items have no rows. Only doc_id or item_id and text are read.
    """
    spark = docs.sparkSession
    asked = _items(items)
    vocabulary = written(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("key")), "vocabulary")
    forward = _forward(docs, vocabulary)
    n_docs, n_terms = forward.agg(F.count("*"), F.sum("size")).first()
    if not n_docs or asked.isEmpty():
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    statistics = term_statistics(forward, n_docs, n_terms, k)
    known = asked.join(vocabulary, "term").join(statistics, "key").where("weight > 0")
    entries = written(known.select("item", "item_id", "key", (F.col("weight") * F.col("n")).alias("weight"), "most", "kth"), "entries")
    blocks = -(-entries.count() // ENTRIES)
    if not blocks:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    of_block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    parts = [_searched(forward, entries.where(of_block == b).toPandas(), Factors(n_docs, n_terms), k) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RANKED_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
items AS (
  SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
totals AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0),
held AS (SELECT row, doc_id, len(terms) AS size, unnest(terms) AS term FROM docs),
counts AS (SELECT row, doc_id, size, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM items) GROUP BY row, doc_id, size, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM counts, totals GROUP BY term),
impacts AS (SELECT row, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n_docs) // n_terms))) AS impact FROM counts JOIN weights USING (term), totals),
scores AS (SELECT item, item_id, row, doc_id, sum(impact)::BIGINT AS score FROM items JOIN impacts USING (term) GROUP BY item, item_id, row, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM placed WHERE rank <= {RANKED}
"""
