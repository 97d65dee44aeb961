"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, by prefix trees.

Sets are sequences under one global order, rare n-grams first. Two similar sets share an n-gram in their
prefixes, the first few elements. The join has four steps:

1. An n-gram that only one document has can't be shared. Each set's shared n-grams are counted, and
   documents of which too few are shared leave.
2. The others are ordered by how many documents hold an n-gram. Prefix elements are the roots of tries;
   roots with the same documents are one.
3. In each root two pivots are compared with the root's other documents. Pairs of documents that are
   connected by then need no comparison.
4. Roots that still have documents of several components are cut into blocks of bounded size. The sets of
   a block form a trie, which the documents of another block go down together: a node matches what it adds
   to its parent's beginning once for all sequences below it, hands the overlap down, and is left by the
   documents that not even all of the remaining elements would bring to the threshold. The few pairs that
   are left go down whole sets' tries, where the overlap is exact.

The result is the connected components; no link between different texts is lost, and none is expanded
into all pairs of a group. Documents of equal sets form a class that takes part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, packed, unpacked, written
from .components import components
from .rolling import Ranges, mix

WORDS, SIMILARITY = 5, 80  # per cent
#: Up to so many ids, a list of documents is sent to all tasks; a longer one is joined by shuffling.
LISTED = 1_000_000
#: n-grams that are sorted together, and that a task packs at once; bits of an n-gram that are kept within a part.
SORTED, PACKED, LOW_BITS = 1 << 21, 1 << 20, 28
#: Documents in a block of a root; how many prefixes' length of a set a block holds.
BLOCK, LONGER = 1024, 2
#: Entries of the matrix in which documents go down a trie together.
MATRIX = 1 << 22
_CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, in order; long texts are taken in chunks that end at white space."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + _CHUNK)
        if end < len(text):
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
        data = np.frombuffer(text, np.uint8, end - at, at)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~_SPACE[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        out.append(Ranges(data).hashes(edge[::2], edge[1::2]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted 63-bit hashes of a text's distinct n-grams; of the whole sequence if it is shorter."""
    w = word_hashes(text.encode("utf-8").lower()) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + w[k : len(w) - n + 1 + k]
    return np.unique(mix(total) >> np.uint64(1))


def set_hash(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    return int(mix(shingles).sum(dtype=np.uint64).view(np.int64))


# -- the trie -------------------------------------------------------------------------------------


class Sequences:
    """Ordered sets, or the known beginnings of them, in one flat array.

    ``size`` is that of the whole set; ``rest`` says how many elements of it follow the known ones in the
    order. Elements that no other set has may be missing: they count in ``size`` alone.
    """

    def __init__(self, lists: list[np.ndarray], size, rest=None, label=None):
        self.length = np.array([len(x) for x in lists], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
        self.size = np.asarray(size, np.int64)
        self.rest = np.zeros(len(lists), np.int64) if rest is None else np.asarray(rest, np.int64)
        self.label = np.arange(-1, -1 - len(lists), -1) if label is None else np.asarray(label, np.int64)

    def __len__(self) -> int:
        return len(self.length)

    def row(self, k: int) -> np.ndarray:
        return self.flat[self.start[k] : self.start[k] + self.length[k]]

    def take(self, some) -> Sequences:
        return Sequences([self.row(k) for k in some], self.size[some], self.rest[some], self.label[some])


def similar(walkers: Sequences, others: Sequences, percent: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Which walkers (indices) can still be similar to which others; for whole sets the answer is exact.

    Pairs of one label are left out. Walkers are taken a few at a time, so that the matrix of their matches
    stays bounded.
    """
    if not len(walkers) or not len(others):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.array(sorted(range(len(others)), key=lambda k: others.row(k).astype(">i8").tobytes()), np.int64)
    tree = others.take(rank)
    common = np.intersect1d(walkers.flat, tree.flat)
    step = max(1, MATRIX // (len(common) + 1))
    found = [_descend(walkers.take(np.arange(at, min(at + step, len(walkers)))), at, tree, common, percent) for at in range(0, len(walkers), step)]
    return np.concatenate([f[0] for f in found]), rank[np.concatenate([f[1] for f in found])]


def _matches(has: np.ndarray, who: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of some elements each walker has."""
    return has[np.ix_(who, at)].sum(1)


def _descend(w: Sequences, base: int, tree: Sequences, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Walks one trie: a node is a range of the tree's sorted sequences with a common beginning."""
    row = np.repeat(np.arange(len(w)), w.length)
    place = np.searchsorted(common, w.flat)
    width = len(common) + 1
    ahead = np.bincount(row * width + place, minlength=len(w) * width).reshape(len(w), width)
    ahead = ahead[:, ::-1].cumsum(1)[:, ::-1] + w.rest[:, None]  # elements after the k-th common one, those unknown included
    hit = np.flatnonzero(place < len(common))
    hit = hit[common[place[hit]] == w.flat[hit]]
    has = np.zeros((len(w), width), np.int32)
    has[row[hit], place[hit]] = 1
    # beyond the last element that is known of a walker nothing can be said
    last = np.where(w.rest > 0, w.flat[w.start + w.length - 1] if len(w.flat) else 0, np.iinfo(np.int64).max)
    total = tree.length + tree.rest
    out_w, out_t = [], []
    stack = [(0, len(tree), 0, np.arange(len(w)), np.zeros(len(w), np.int64))]
    while stack:
        lo, hi, depth, who, matched = stack.pop()
        alone = tree.label[lo] if (tree.label[lo:hi] == tree.label[lo]).all() else None
        if alone is not None:
            other = w.label[who] != alone
            who, matched = who[other], matched[other]
        if not len(who):
            continue
        first = tree.row(lo)
        if hi - lo == 1:
            end = len(first)
        else:
            back = tree.row(hi - 1)
            n = min(len(first), len(back))
            differ = np.flatnonzero(first[depth:n] != back[depth:n])
            end = depth + int(differ[0]) if len(differ) else n
        known = end
        if end > depth:
            segment = first[depth:end]
            at = np.searchsorted(common, segment)
            at = at[(at < len(common)) & (common[np.minimum(at, len(common) - 1)] == segment)] if len(common) else at[:0]
            if len(at):
                matched = matched + _matches(has, who, at)
            remain = ahead[who, np.searchsorted(common, segment[-1], "right")]
            known = depth + np.searchsorted(segment, last[who], "right")
        else:
            remain = ahead[who, np.searchsorted(common, first[depth - 1], "right") if depth else 0]
            known = np.full(len(who), end)
        ended = (known < end) | (hi - lo == 1)  # what is left of a walker, or of the tree, is one step
        # bounds of all sequences below the node
        bound = (100 + percent) * (matched + np.minimum(remain, total[lo:hi].max() - known)) >= percent * (w.size[who] + tree.size[lo:hi].min())
        for one in np.flatnonzero(bound & ended):
            exact = (100 + percent) * (matched[one] + np.minimum(remain[one], total[lo:hi] - known[one])) >= percent * (w.size[who[one]] + tree.size[lo:hi])
            t = lo + np.flatnonzero(exact & (tree.label[lo:hi] != w.label[who[one]]))
            out_t.append(t)
            out_w.append(np.full(len(t), base + who[one]))
        go = bound & ~ended
        if not go.any():
            continue
        who, matched, remain = who[go], matched[go], remain[go]
        while lo < hi and tree.length[lo] == end:  # sequences that end at this node come first
            exact = (100 + percent) * (matched + np.minimum(remain, total[lo] - end)) >= percent * (w.size[who] + tree.size[lo])
            exact &= w.label[who] != tree.label[lo]
            out_w.append(base + who[exact])
            out_t.append(np.full(int(exact.sum()), lo))
            lo += 1
        if lo == hi:
            continue
        following = tree.flat[tree.start[lo:hi] + end]
        cuts = np.flatnonzero(np.concatenate([[True], following[1:] != following[:-1], [True]]))
        stack += [(lo + a, lo + b, end, who, matched) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if not out_w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_w).astype(np.int64), np.concatenate(out_t).astype(np.int64)


# -- which documents share enough -------------------------------------------------------------------


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _signatures(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, n, a): set size and a hash of the set; ``whole`` adds the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t.as_py()) for t in part.column(1)]
                columns = [part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([_lists(sets)] if whole else [])], ["doc_id", "n", "a", *(["keys"] if whole else [])])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, a long" + (", keys array<long>" if whole else ""))


def restricted(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs whose doc_id is (or, for left_anti, isn't) among ``ids``, a written table of one column."""
    return docs.join(F.broadcast(ids) if ids.count() <= LISTED else ids, "doc_id", how)


def _shared_counts(docs: DataFrame, total: int) -> DataFrame:
    """(doc_id, shared): how many n-grams of a document another row has too; now and then one too many, never too few.

    n-grams are cut to a part, its first bits, and LOW_BITS more. A task sorts those of some documents and
    packs them by part. What several of these documents have is counted at once, and one mark of it goes to
    the part for the others' sake, so an n-gram that very many documents have doesn't pile up in its part.
    """
    bits = min(24, max(6, (total // SORTED).bit_length()))
    within = min(20, 36 - bits)  # bits of a document's number in a pack
    shift, low = np.uint64(63 - bits - LOW_BITS), np.uint64((1 << LOW_BITS) - 1)

    def rows(names: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        number = np.repeat(np.arange(len(names), dtype=np.uint64), [len(x) for x in names])
        codes = np.sort((np.concatenate(names) << np.uint64(within)) | number)
        name, number = codes >> np.uint64(within), (codes & np.uint64((1 << within) - 1)).astype(np.int64)
        head = np.concatenate([[True], name[1:] != name[:-1]])
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(name)))
        alone = np.repeat(number[begin] == number[begin + size - 1], size)  # one document's, though perhaps more than once
        held = np.array(ids, np.int64)
        out = []
        if not alone.all():
            counts = np.bincount(number[~alone], minlength=len(ids))
            some = np.flatnonzero(counts)
            out.append((-1 - int(mix(held[:1].view(np.uint64))[0] % np.uint64(1 << bits)), packed(counts[some].astype(np.int64)), packed(held[some])))
        for chosen in (alone, head & ~alone):
            part = name[chosen] >> np.uint64(LOW_BITS)
            own, who = (name[chosen] & low).astype(np.uint32), held[number[chosen]]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out.append((int(part[a]), packed(np.diff(own[a:b], prepend=np.uint32(0))), packed(who[a:b]) if chosen is alone else None))
        part, first, second = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(first, pa.binary()), pa.array(second, pa.binary())], ["part", "names", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, n = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                s = shingle_set(text.as_py())
                if not len(s):
                    continue
                names.append(s >> shift)
                ids.append(doc_id.as_py())
                n += len(s)
                if n >= PACKED or len(ids) == 1 << within:
                    yield rows(names, ids)
                    names, ids, n = [], [], 0
        if n:
            yield rows(names, ids)
        names.clear()
        give_back()

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        if int(frame["part"].iloc[0]) < 0:
            return pd.DataFrame({"doc_id": np.concatenate([unpacked(x, np.int64) for x in frame["ids"]]), "shared": np.concatenate([unpacked(x, np.int64) for x in frame["names"]])})
        names = [np.cumsum(unpacked(x, np.uint32), dtype=np.uint64) for x in frame["names"]]
        ids = [None if x is None else unpacked(x, np.int64) for x in frame["ids"]]
        marked = np.repeat([x is None for x in ids], [len(x) for x in names])
        held = np.concatenate([np.zeros(len(n), np.int64) if x is None else x for n, x in zip(names, ids, strict=True)])
        codes = np.sort((np.concatenate(names) << np.uint64(32)) | np.arange(len(held), dtype=np.uint64))
        name, order = codes >> np.uint64(32), (codes & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        met = np.logical_or.reduceat(marked[order], begin) | (np.minimum.reduceat(held[order], begin) < np.maximum.reduceat(held[order], begin))
        chosen = order[np.repeat(met, np.diff(np.append(begin, len(name))))]
        found, counts = np.unique(held[chosen[~marked[chosen]]], return_counts=True)
        return pd.DataFrame({"doc_id": found, "shared": counts.astype(np.int64)})

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, "part long, names binary, ids binary")
    return parts.groupBy("part").applyInPandas(settle, "doc_id long, shared long").groupBy("doc_id").agg(F.sum("shared").alias("shared"))


def _needed(n: Column) -> Column:
    """So many elements of a set of n at least are shared with any similar set."""
    return F.ceil(F.lit(SIMILARITY) * n / 100)


def _ordered(sets: DataFrame) -> DataFrame:
    """(a, n, keys): shared n-grams only, rare ones first; sets with too few are left out.

    An element is a number whose first bits grow with how many sets hold it; the others are its hash's.
    """
    elements = sets.select("a", "n", F.explode("keys").alias("k"))
    counts = elements.groupBy("k").agg(F.count("*").alias("held")).where("held > 1")
    level = F.least(F.lit(127), F.floor(4 * F.log2("held"))).cast("long")
    key = F.shiftleft(level, 56).bitwiseOR(F.shiftrightunsigned("k", 7))
    kept = elements.join(counts, "k").select("a", "n", key.alias("key"))
    return kept.groupBy("a").agg(F.min("n").alias("n"), F.array_sort(F.collect_list("key")).alias("keys")).where(F.size("keys") >= _needed(F.col("n")))


# -- the join ---------------------------------------------------------------------------------------


def _similar_size(x: str, y: str) -> Column:
    return 100 * F.least(x, y) >= SIMILARITY * F.greatest(x, y)


def _linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (x, y) of sets (a, n, keys), those that are links. The sets compared with one x form a trie."""
    with_y = pairs.join(sets.select(F.col("a").alias("y"), F.col("n").alias("n_y"), F.col("keys").alias("keys_y")), "y")
    with_x = with_y.join(sets.select(F.col("a").alias("x"), F.col("n").alias("n_x"), F.col("keys").alias("keys_x")), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy()
            if not len(x):
                continue
            n_x, n_y = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            own, other = (lambda i, c=batch.column(c): c[int(i)].values.to_numpy() for c in (2, 3))
            starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            keep = [np.zeros(0, np.int64)]
            for s, e in zip(starts, [*starts[1:], len(x)], strict=True):
                _, t = similar(Sequences([own(s)], n_x[s : s + 1], label=[0]), Sequences([other(k) for k in range(s, e)], n_y[s:e]))
                keep.append(s + t)
            at = pa.array(np.sort(np.concatenate(keep)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return with_x.sortWithinPartitions("x").select("x", "y", "keys_x", "keys_y", "n_x", "n_y").mapInArrow(run, "a long, b long")


def _roots(sets: DataFrame) -> DataFrame:
    """(k, a, n): which sets meet in a root, a prefix element; of roots with the same sets one is left."""
    prefix = F.slice("keys", F.lit(1), (F.size("keys") - _needed(F.col("n")) + 1).cast("int"))
    postings = sets.select("a", "n", F.explode(prefix).alias("k"))
    members = F.sum(F.shiftright(F.xxhash64("a"), 32)), F.sum(F.shiftright(F.xxhash64(F.lit(1), "a"), 32))
    roots = postings.groupBy("k").agg(F.count("*").alias("m"), *[s.alias(f"s{i}") for i, s in enumerate(members)]).where("m > 1")
    return postings.join(roots.groupBy("m", "s0", "s1").agg(F.min("k").alias("k")).select("k", "m"), "k").select("k", "m", "a", "n")


def _pivot_pairs(roots: DataFrame) -> DataFrame:
    """(x, y): two documents of each root, x, and those that they are compared with."""
    order = F.struct(F.xxhash64("a").alias("h"), "a", "n")
    pivots = roots.groupBy("k").agg(F.array_distinct(F.array(F.min(order), F.max(order))).alias("p")).select("k", F.explode("p").alias("p"))
    return roots.join(pivots.select("k", F.col("p.a").alias("x"), F.col("p.n").alias("n_x")), "k").where("a <> x").where(_similar_size("n", "n_x")).select("x", F.col("a").alias("y")).distinct()


def _block_pairs(roots: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y): pairs of different labels that no trie of a root rules out, each in the root of its first common element.

    A root's documents are put into blocks: a label with many documents has blocks of its own, which needn't
    be compared with one another; the others share blocks.
    """
    placed = roots.where("m > 2").join(labels.select(F.col("doc_id").alias("a"), "label"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    by_label = placed.groupBy("k", "label").count()
    mixed = by_label.groupBy("k").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("count") < BLOCK, F.col("count")).otherwise(0)).alias("pooled")).where("labels > 1")
    share = by_label.join(mixed, "k").select("k", "label", (F.col("count") >= BLOCK).alias("own"), F.ceil(F.when(F.col("count") >= BLOCK, F.col("count")).otherwise(F.col("pooled")) / BLOCK).alias("parts"))
    placed = written(placed.join(share, ["k", "label"]).select("k", "a", "n", "label", F.when(F.col("own"), F.struct("label", F.pmod(F.xxhash64("a"), "parts").alias("part"))).otherwise(F.struct(F.lit(-(2**63)).alias("label"), F.pmod(F.xxhash64("a"), "parts").alias("part"))).alias("block"), "own"), "placed")
    blocks = placed.groupBy("k", "block", "own").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    left, right = (blocks.select("k", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "own", "least", "most")]) for s in "lr")
    # blocks of one label need no comparison; of those left, there are as many as a root's size in blocks, squared
    turns = left.join(right, "k").where("block_l <= block_r").where("least_l <> most_r or most_l <> least_r").select("k", "block_l", "block_r")
    sides = turns.select("k", "block_l", "block_r", F.explode(F.array_distinct(F.array(F.struct(F.col("block_l").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block_r").alias("block"), F.when(F.col("block_l") == F.col("block_r"), 0).otherwise(1).alias("side"))))).alias("s"))
    prefix = (F.size("keys") - _needed(F.col("n")) + 1) * LONGER
    known = F.slice("keys", F.lit(1), prefix.cast("int"))
    begun = sets.select("a", known.alias("known"), (F.size("keys") - F.size(known)).cast("long").alias("rest"))
    rows = placed.join(sides.select("k", F.col("s.block").alias("block"), "s.side", "block_l", "block_r"), ["k", "block"]).join(begun, "a")
    rows = rows.select("k", "block_l", "block_r", "side", "a", "n", "label", "rest", "known", F.array_position("known", F.col("k")).alias("at"))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("a")
        one, two = (frame[frame["side"] == s] for s in (0, 1))
        same = not len(two)
        # what lies before the root is common to no pair whose first common element it is; other pairs meet elsewhere
        below = [Sequences([k[i - 1 :] for k, i in zip(g["known"], g["at"], strict=True)], g["n"], g["rest"], g["label"]) for g in ((one,) if same else (one, two))]
        x, y = similar(below[0], below[-1])
        if same:
            x, y = x[x < y], y[x < y]
        above = [[k[: i - 1] for k, i in zip(g["known"], g["at"], strict=True)] for g in ((one,) if same else (one, two))]
        first = np.array([not len(np.intersect1d(above[0][i], above[-1][j], assume_unique=True)) for i, j in zip(x, y, strict=True)], bool)
        a, b = one["a"].to_numpy()[x[first]], (one if same else two)["a"].to_numpy()[y[first]]
        return pd.DataFrame({"x": np.minimum(a, b), "y": np.maximum(a, b)})

    return rows.groupBy("k", "block_l", "block_r").applyInPandas(meet, "x long, y long")


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Words are lower-cased in A-Z and split at ASCII white space; a set is the distinct five-word shingles,
    or the whole sequence of a shorter text. Documents without words have an empty set and are linked with
    nothing: component_id is their own doc_id. Rows that share a doc_id but not the text take part each with
    its own text. Rows without a doc_id take no part: their n_shingles is that of their text, their
    component_id null. An empty table gives an empty result.
    """
    first = written(_signatures(docs), "signatures")
    known = first.where("n > 0 and doc_id is not null")
    total = known.agg(F.sum("n")).first()[0] or 0
    counts = _shared_counts(docs.where("doc_id is not null"), total)
    near = written(known.join(counts, "doc_id").where(F.col("shared") >= _needed(F.col("n"))).groupBy("a").agg(F.min("doc_id").alias("rep")), "near")
    reps = written(near.select(F.col("rep").alias("doc_id")).distinct(), "reps")
    whole = _signatures(restricted(docs, reps), whole=True).join(near.select(F.col("rep").alias("doc_id"), "a"), ["doc_id", "a"], "left_semi")
    sets = written(_ordered(written(whole.dropDuplicates(["a"]), "whole")), "sets")

    roots = written(_roots(sets), "roots")
    links = written(_linked_pairs(_pivot_pairs(roots), sets), "links")
    more = written(_linked_pairs(written(_block_pairs(roots, sets, components(links)), "pairs"), sets), "links")
    labels = components(links.unionByName(more)).withColumnRenamed("doc_id", "a")

    joined = near.join(labels, "a", "left").withColumn("label", F.coalesce("label", "a"))
    named = joined.join(joined.groupBy("label").agg(F.min("rep").alias("component")), "label").select("a", "component")
    return first.join(named, "a", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
