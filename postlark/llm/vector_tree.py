"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

1. A bounded sample fits the tree: each node's vectors are parted by k-means on the sphere, and parts that are to
   hold several leaves are parted again, so crowded regions have more leaves.
2. Every vector goes down to its leaf. Leaves that many vectors share are cut into blocks of bounded size;
   neighbouring leaves form a bin, so a query is sent once to each bin it visits rather than once a leaf.
3. A query goes through the tree by a priority queue that holds the branches not taken, nearest first,
   and visits leaves in the order in which they leave the queue. How many is calibrated: a bounded sample of
   queries is compared with every vector, and visits widen until the wanted share of their true neighbours
   lies in visited leaves.
4. Packs of queries meet the blocks of their bin; each query is compared with the blocks of its leaves. What may be
   among the nearest is scored again, pair by pair, in double precision on the vectors as they came.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Bounds of the sample that the tree is fitted on, in vectors and in numbers; queries that visits are calibrated on.
SAMPLE, SAMPLE_NUMBERS, CALIBRATED = 65_536, 1 << 23, 256
#: Branches of a node, rounds of k-means, vectors that a leaf should hold, leaves and sampled vectors a leaf at the most and least.
BRANCHES, ROUNDS, LEAF, LEAVES, LEAST = 16, 8, 256, 4096, 8
#: Vectors of a block, bins, queries of a pack.
BLOCK, BINS, PACK = 2048, 128, 512
#: The share of true neighbours that calibration asks for.
RECALL = 0.95
_SEED = 20


# -- the tree -------------------------------------------------------------------------------------


@dataclass
class Node:
    """Centres of the branches and what they lead to; a leaf has its number and no branches."""

    centres: np.ndarray | None = None
    branches: list[Node] = field(default_factory=list)
    leaf: int = -1


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one. Scaling by powers of two first keeps squares from over- or underflowing, without rounding."""
    x = np.asarray(vectors, np.float64)
    _, power = np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))
    x = np.ldexp(x, -power)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _k_means(x: np.ndarray, k: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and each vector's centre; a centre without vectors takes one of those that fit worst."""
    centres = x[np.sort(draw.choice(len(x), k, replace=False))]
    for _ in range(ROUNDS):
        near = x @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.divide(sums, size, out=centres.copy(), where=size > 0)
    return centres, (x @ centres.T).argmax(axis=1)


def fit(sample: np.ndarray, leaves: int, seed: int = _SEED) -> tuple[Node, int]:
    """A tree over vectors of length one with about so many leaves, and how many there are, numbered from left to right."""
    draw, count = np.random.default_rng(seed), 0

    def grow(x: np.ndarray, wanted: int) -> Node:
        nonlocal count
        if wanted > 1 and len(x) >= 2 * LEAST:
            centres, own = _k_means(x, min(BRANCHES, wanted, len(x) // LEAST), draw)
            held = [b for b in range(len(centres)) if (own == b).any()]
            if len(held) > 1:
                return Node(centres[held], [grow(x[own == b], round(wanted * np.count_nonzero(own == b) / len(x))) for b in held])
        count += 1
        return Node(leaf=count - 1)

    return grow(sample, leaves), count


def leaves_of(root: Node, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector, down the nearest centres."""
    out = np.zeros(len(x), np.int32)
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, some = todo.pop()
        if node.leaf >= 0:
            out[some] = node.leaf
            continue
        own = (x[some] @ node.centres.T).argmax(axis=1)
        todo += [(b, some[own == k]) for k, b in enumerate(node.branches) if (own == k).any()]
    return out


def best_bins(root: Node, query: np.ndarray, visits: int) -> list[int]:
    """The first leaves by best-bin-first traversal."""
    found, queue, n = [], [(-1.0, 0, root)], 0
    while queue and len(found) < visits:
        _, _, node = heapq.heappop(queue)
        if node.leaf >= 0:
            found.append(node.leaf)
            continue
        for near, branch in zip(node.centres @ query, node.branches, strict=True):
            n += 1
            heapq.heappush(queue, (-float(near), n, branch))
    return found


# -- vectors in Arrow -----------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _kind(vectors: DataFrame) -> type:
    return np.float32 if vectors.schema["vector"].dataType.elementType == T.FloatType() else np.float64


def prepared(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, vector, is_query) of the vectors that take part, written.

    Null, empty and zero vectors, and those with a null or non-finite component, take no part; nor do those of
    another length than the most frequent one (the largest of several).
    """
    vector = F.col(vector_col)
    if vectors.schema[vector_col].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        vector = vector.cast("array<double>")
    held = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = held.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0)).withColumn("row", F.monotonically_increasing_id())
    held = written(held.select("row", "id", "vector", "is_query"), "vectors")
    size = held.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return held if size is None else held.where(F.size("vector") == size["size"])


def without_crowds(held: DataFrame, k: int) -> DataFrame:
    """Of wholly equal vectors the k + 1 with the least ids: no others can be among anyone's k nearest, as equal vectors score equally."""
    hashed = held.withColumn("hash", F.xxhash64("vector"))
    crowds = written(hashed.groupBy("hash").count().where(F.col("count") > k + 1).select("hash"), "crowds")
    if crowds.isEmpty():
        return held
    order = Window.partitionBy("vector").orderBy(F.asc_nulls_last("id"), "row")
    first = hashed.join(crowds, "hash", "left_semi").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    return hashed.join(crowds, "hash", "left_anti").unionByName(first.drop("nth")).drop("hash")


def _top(scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by score, then id (rows without one last), then row."""
    return np.lexsort((rows, ids, nameless, -scores))[:k]


def _exact(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each from its own two vectors alone."""
    q, x = np.asarray(query, np.float64), np.asarray(others, np.float64)
    if max(np.abs(q).max(), np.abs(x).max(initial=0)) > 1e100 or min(np.abs(q).max(), np.abs(x).max(axis=1).min(initial=1)) < 1e-100:
        q, x = np.ldexp(q, -np.frexp(np.abs(q).max())[1]), np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))


def nearest_in(queries: np.ndarray, own: np.ndarray, block: np.ndarray, rows: np.ndarray, ids: np.ndarray, nameless: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (own is its row) the places in the block of its k nearest and their scores."""
    near = unit(queries) @ unit(block).T
    cut = max(0, near.shape[1] - k - 1)
    # equal vectors may differ in the last bits here; all that could be among the nearest are scored again
    least = np.partition(near, cut, axis=1)[:, cut] - 1e-9
    for q in range(len(queries)):
        some = np.flatnonzero(near[q] >= least[q])
        some = some[rows[some] != own[q]]
        scores = _exact(queries[q], block[some])
        best = _top(scores, ids[some], nameless[some], rows[some], k)
        yield q, some[best], scores[best]


def _drawn(held: DataFrame, n: int, most: int) -> DataFrame:
    """At most so many of n rows, by least hash; a share that is somewhat larger is cut off first, so that no task sorts many."""
    hashed = held.withColumn("hash", F.pmod(F.xxhash64("row", F.lit(_SEED)), F.lit(1 << 40)))
    return hashed.where(F.col("hash") < int((1 << 40) * min(1.0, (1.2 * most + 100) / max(1, n)))).orderBy("hash").limit(most).drop("hash")


FOUND = "query long, query_id long, row long, id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _found(query: list, query_id: list, rows: list, ids: list, nameless: list, scores: list) -> pa.RecordBatch:
    cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    arrays = [pa.array(cat(query, np.int64)), pa.array(cat(query_id, np.int64)), pa.array(cat(rows, np.int64)), pa.array(cat(ids, np.int64), mask=cat(nameless, bool)), pa.array(cat(scores, np.float64))]
    return pa.RecordBatch.from_arrays(arrays, ["query", "query_id", "row", "id", "score"])


def exact_neighbours(held: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """(query, query_id, row, id, score, rank): the true k nearest of a bounded number of queries (row, id, vector), all vectors compared."""
    if queries.empty:
        return held.sparkSession.createDataFrame([], FOUND + ", rank int")
    matrix, own, names = np.stack(list(queries["vector"])), queries["row"].to_numpy(), queries["id"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, block = batch.column(0).to_numpy(), _matrix(batch.column(2))
                ids, nameless = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
                parts = [(np.full(len(p), own[q]), np.full(len(p), names[q]), rows[p], ids[p], nameless[p], s) for q, p, s in nearest_in(matrix, own, block, rows, ids, nameless, k)]
                yield _found(*map(list, zip(*parts, strict=True)))

    return _best(held.select("row", "id", "vector").mapInArrow(run, FOUND), k)


def calibrated_visits(tree: Node, leaves: int, held: DataFrame, queries: pd.DataFrame, k: int, recall: float = RECALL) -> tuple[int, float]:
    """How many leaves to visit so that the wanted share of the queries' true neighbours is found, and the share found."""
    true = exact_neighbours(held, queries, k).select("query", "row").join(held.select("row", "vector"), "row").toPandas()
    if true.empty:
        return leaves, 1.0
    true["leaf"] = leaves_of(tree, unit(np.stack(list(true["vector"]))))
    places = []
    for own, vector in zip(queries["row"], unit(np.stack(list(queries["vector"]))), strict=True):
        nth = {leaf: n for n, leaf in enumerate(best_bins(tree, vector, leaves), 1)}
        places += [nth[leaf] for leaf in true.loc[true["query"] == own, "leaf"]]
    places.sort()
    visits = places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]
    return visits, float(np.mean(np.array(places) <= visits))


# -- the search -----------------------------------------------------------------------------------


def _blocks(held: DataFrame, tree: Node, first: np.ndarray, count: np.ndarray, bin_of: np.ndarray) -> DataFrame:
    """(bin, leaf, rows, ids, nameless, vectors): the vectors of a leaf, at most some BLOCK of them, packed."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaves_of(tree, unit(_matrix(batch.column(2)))) if batch.num_rows else np.zeros(0, np.int32)
            block = first[leaf] + batch.column(3).to_numpy() % count[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(leaf), *batch.columns[:3]], ["block", "leaf", "row", "id", "vector"])

    kind = held.schema["vector"].dataType.simpleString()

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        leaf = int(frame["leaf"].iloc[0])
        ids = frame["id"].astype("Int64")
        arrays = frame["row"].to_numpy(np.int64), ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy(bool), np.stack(list(frame["vector"]))
        return pd.DataFrame([(int(bin_of[leaf]), leaf, *(a.tobytes() for a in arrays))], columns=["bin", "leaf", "rows", "ids", "nameless", "vectors"])

    spread = held.select("row", "id", "vector", F.pmod(F.xxhash64("row"), F.lit(1 << 31)).alias("hash"))
    placed = spread.mapInArrow(place, f"block long, leaf int, row long, id long, vector {kind}")
    return placed.groupBy("block").applyInPandas(pack, "bin int, leaf int, rows binary, ids binary, nameless binary, vectors binary")


def _packs(queries: DataFrame, tree: Node, visits: int, bin_of: np.ndarray) -> DataFrame:
    """(bin, queries, query_ids, query_vectors, which, where): queries that visit a bin, and pairs of query and leaf by leaf."""

    def row(b: int, held: list) -> tuple:
        rows, ids, vectors, leaves = zip(*held, strict=True)
        which, where = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in leaves]), np.concatenate(leaves).astype(np.int32)
        order = np.argsort(where, kind="stable")
        return b, np.array(rows).tobytes(), np.array(ids).tobytes(), np.stack(vectors).tobytes(), which[order].tobytes(), where[order].tobytes()

    def frame(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bin", "queries", "query_ids", "query_vectors", "which", "where"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, full = _matrix(batch.column(2)), []
            for own, name, vector, direction in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), vectors, unit(vectors), strict=True):
                by_bin = defaultdict(list)
                for leaf in best_bins(tree, direction, visits):
                    by_bin[int(bin_of[leaf])].append(leaf)
                for b, leaves in by_bin.items():
                    held[b].append((own, name, vector, leaves))
                    if len(held[b]) == PACK:
                        full.append(row(b, held.pop(b)))
            if full:
                yield frame(full)
        if held:
            yield frame([row(b, some) for b, some in held.items()])

    return queries.select("row", "id", "vector").mapInArrow(run, "bin int, queries binary, query_ids binary, query_vectors binary, which binary, where binary")


def _met(packs: DataFrame, blocks: DataFrame, kind: type, k: int) -> DataFrame:
    """The k nearest of each query in each block of its leaves."""
    columns = ["queries", "query_ids", "query_vectors", "which", "where", "leaf", "rows", "ids", "nameless", "vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, names, vectors, which, where, leaf, rows, ids, nameless, block = (batch.column(c)[i].as_py() for c in range(len(columns)))
                where = np.frombuffer(where, np.int32)
                some = np.frombuffer(which, np.int32)[slice(*np.searchsorted(where, [leaf, leaf + 1]))]
                if not len(some):
                    continue
                own, names, rows, ids = (np.frombuffer(x, np.int64) for x in (own, names, rows, ids))
                nameless = np.frombuffer(nameless, bool)
                queries, block = np.frombuffer(vectors, kind).reshape(len(own), -1)[some], np.frombuffer(block, kind).reshape(len(rows), -1)
                parts = [(np.full(len(p), own[some[q]]), np.full(len(p), names[some[q]]), rows[p], ids[p], nameless[p], s) for q, p, s in nearest_in(queries, own[some], block, rows, ids, nameless, k)]
                yield _found(*map(list, zip(*parts, strict=True)))

    # a pair of pack and block has under two megabytes; few are handed over together
    return packs.join(blocks.hint("shuffle_merge"), "bin").select(*columns).mapInArrow(run, FOUND)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that are found of each query, nearest first.

    Queries are the rows for which ``is_query`` is true and whose id isn't null; candidates are all rows but the query's own.
    The score is the cosine in double precision; equal scores come by id, rows without an id last. Vectors
    that are null, empty, zero or hold null or non-finite components take no part, nor do those of another length than
    the most frequent one. Rows that share an id are rows of their own: each is a query if they are, and
    a candidate of the others. With no more than k candidates all of them come. An empty table gives an empty result.
    """
    held = prepared(vectors, is_query & F.col(id_col).isNotNull(), id_col, vector_col)
    n, size = held.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return held.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexed = without_crowds(held, k)
    bounded = min(SAMPLE, max(1, SAMPLE_NUMBERS // size))
    sample = unit(np.stack([r[0] for r in _drawn(held, n, bounded).select("vector").toPandas().itertuples(index=False)]))
    tree, leaves = fit(sample, min(LEAVES, max(1, n // LEAF), max(1, len(sample) // LEAST)))
    asked = held.where("is_query").select("row", "id", "vector")
    visits, _ = calibrated_visits(tree, leaves, indexed, _drawn(asked, asked.count(), CALIBRATED).toPandas(), k, recall)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(leaves, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(leaves_of(tree, unit(_matrix(batch.column(0)))), minlength=leaves)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["leaf", "n"])

    sizes = np.zeros(leaves, np.int64)
    for leaf, many in indexed.select("vector").mapInArrow(counted, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect():
        sizes[leaf] = many
    # blocks of a leaf are numbered from first on; bins hold neighbouring leaves and about equally many vectors
    count = np.maximum(1, -(-sizes // BLOCK))
    first = np.cumsum(count) - count
    bins = min(BINS, leaves)
    bin_of = np.minimum(bins - 1, (np.cumsum(sizes) - sizes) * bins // max(1, sizes.sum())).astype(np.int32)
    found = _met(_packs(asked, tree, visits, bin_of), _blocks(indexed, tree, first, count, bin_of), _kind(held), k)
    return _best(found, k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
