"""Removal of byte strings that an earlier document holds, by a difference cover.

Positions of a text whose remainder modulo PERIOD lies in COVER are sampled. COVER is a perfect difference
set: whatever two positions i and j are, some k below PERIOD makes i + k and j + k both sampled. Two equal
strings of SPAN bytes hence have a sampled position each, k bytes in, that starts the same TUPLE bytes.

The sampled tuples of all documents are sorted and named, and those that only one document has are left
out. The others are named again at nearly twice the length, once for the strings that begin shortly before
the position and once for those that begin further ahead; as only SPAN bytes are ever compared, the
recursion ends there. A name at a position stands for a run of strings, the unsampled positions before it
included. Within each name, sorted neighbours are compared: an occurrence whose whole context (all bytes of
its strings) is in an earlier document goes as a whole, and the strings of the others are merged and
compared one by one, by their hashes. Documents with equal texts are settled beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, unpacked, written
from .ngram_join import restricted
from .rolling import Ranges, mix

#: Bytes of a string that counts as repeated.
SPAN = 50
#: A perfect difference set: each remainder but 0 is the difference of exactly one pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes that are left of a string at its sampled position, however far in that is.
TUPLE = SPAN - PERIOD + 1
#: Strings that begin fewer bytes before the position than this are named apart from those that begin further ahead.
NEAR = 16
#: Sampled tuples that are sorted together, and that a task packs at once.
SORTED, PACKED = 1 << 20, 1 << 20
#: Bytes of short texts that are taken together.
TOGETHER = 1 << 18


class Sampled:
    """The sampled positions of some texts, their tuples, and the runs of strings that they stand for.

    The texts lie one after the other in one array; nothing reaches from one into the next.
    """

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.ranges = Ranges(self.data)
        periods = np.where(size >= SPAN, -(-size // PERIOD), 0)
        text = np.repeat(np.arange(len(texts)), periods)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods)
        at = ((self.start[text] + nth * PERIOD)[:, None] + np.array(COVER)).ravel()
        text = np.repeat(text, len(COVER))
        inside = at + TUPLE <= self.end[text]
        self.at, self.text = at[inside], text[inside]

    def tuples(self) -> np.ndarray:
        return self.ranges.hashes(self.at, self.at + TUPLE)

    def runs(self, some: np.ndarray | slice, anchors: bool = True) -> None:
        """Sets first, after (starts of strings, end exclusive), context, owner (text) and anchor of the runs at some sampled positions."""
        p, text = self.at[some], self.text[some]
        begin, last = self.start[text], self.end[text] - SPAN
        far = (np.maximum(p - (PERIOD - 1), begin), np.minimum(p - NEAR, last), p - NEAR, p + TUPLE)
        near = (np.maximum(p - (NEAR - 1), begin), np.minimum(p, last), p, p + SPAN - NEAR + 1)
        parts = []
        for kind, (first, end, a, b) in enumerate((far, near)):
            real = np.flatnonzero(first <= end)
            first, end = first[real], end[real]
            shape = (((p[real] - first) * SPAN + (end - first)) * 2 + kind).astype(np.uint64)
            # the context holds the anchor, at a place that the shape gives
            context = mix(self.ranges.hashes(first, end + SPAN) + shape)
            anchor = mix(self.ranges.hashes(a[real], b[real]) + np.uint64(kind)) if anchors else context
            parts.append((first, end + 1, context, text[real], anchor))
        self.first, self.after, self.context, self.owner, self.anchor = (np.concatenate(x) for x in zip(*parts, strict=True))

    def listed(self, lists: list) -> np.ndarray:
        """For each start of a string, whether it is in a run whose context its text's list has."""
        self.runs(slice(None), anchors=False)
        chosen = _in_lists(self.context, self.owner, lists)
        size = len(self.data) + 1
        return np.cumsum(np.bincount(self.first[chosen], minlength=size) - np.bincount(self.after[chosen], minlength=size)) > 0


def _in_lists(hashes: np.ndarray, text: np.ndarray, lists: list) -> np.ndarray:
    """Whether each hash is in the list of its text; None is an empty list."""
    sizes = [0 if x is None else len(x) for x in lists]
    if not sum(sizes):
        return np.zeros(len(hashes), bool)
    apart = mix(np.arange(1, len(lists) + 1, dtype=np.uint64))
    wanted = np.sort(np.concatenate([np.asarray(x, np.int64) for x in lists if x is not None]).view(np.uint64) + np.repeat(apart, sizes))
    own = hashes + apart[text]
    where = np.searchsorted(wanted, own)
    where[where == len(wanted)] = 0
    return wanted[where] == own


def _bytes(text) -> bytes:
    return text.encode("utf-8") if text else b""


def _together(column: pa.Array) -> Iterator[tuple[slice, list[bytes]]]:
    """Neighbouring texts of at most TOGETHER bytes, or one longer text, and where they are."""
    at, held, n = 0, [], 0
    for k, t in enumerate(column):
        data = _bytes(t.as_py())
        if held and n + len(data) > TOGETHER:
            yield slice(at, k), held
            at, held, n = k, [], 0
        held.append(data)
        n += len(data)
    if held:
        yield slice(at, at + len(held)), held


def _lists(column: pa.Array, part: slice) -> list:
    return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in column[part]]


def _shared_tuples(docs: DataFrame, bits: int) -> DataFrame:
    """(doc_id, name): tuples of a document that another document has too. Names are the first 32 + bits bits of a hash.

    A task sorts the tuples of some documents and packs them by the first bits. A tuple that several of these
    documents have needs no further proof: it is passed on for each of them and sorted with the others once
    only, so a tuple that very many documents have doesn't pile up where it is sorted.
    """
    shift, low = np.uint64(32 - bits), np.uint64(0xFFFFFFFF)

    def rows(names: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, names))
        names, ids = names[order], ids[order]
        new = np.concatenate([[True], (names[1:] != names[:-1]) | (ids[1:] != ids[:-1])])
        names, ids = names[new], ids[new]
        head = np.concatenate([[True], names[1:] != names[:-1]])
        alone = head & np.concatenate([head[1:], [True]])
        out = []
        if not alone.all():
            out.append((-1 - int(mix(ids[:1].view(np.uint64))[0] % np.uint64(1 << bits)), packed(names[~alone]), packed(ids[~alone])))
        names, ids = names[head], ids[head]
        parts = names >> np.uint64(32)
        cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = (names[a:b] & low).astype(np.uint32)
            out.append((int(parts[a]), packed(np.diff(own, prepend=np.uint32(0))), packed(ids[a:b])))
        part, held, owners = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(held, pa.binary()), pa.array(owners, pa.binary())], ["part", "names", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, n = [], [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part, texts in _together(batch.column(1)):
                sampled = Sampled(texts)
                names.append(sampled.tuples() >> shift)
                ids.append(doc_ids[part][sampled.text])
                n += len(names[-1])
                if n >= PACKED:
                    yield rows(np.concatenate(names), np.concatenate(ids))
                    names, ids, n = [], [], 0
        if n:
            yield rows(np.concatenate(names), np.concatenate(ids))

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        ids = np.concatenate([unpacked(x, np.int64) for x in frame["ids"]])
        if part < 0:
            names = np.concatenate([unpacked(x, np.uint64) for x in frame["names"]])
        else:
            names = np.concatenate([np.cumsum(unpacked(x, np.uint32), dtype=np.uint64) for x in frame["names"]]) + (np.uint64(part) << np.uint64(32))
            order = np.argsort(names, kind="stable")
            names, ids = names[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
            keep = np.repeat(several, np.diff(np.append(first, len(names))))
            names, ids = names[keep], ids[keep]
        return pd.DataFrame({"doc_id": ids, "name": names.view(np.int64)})

    parts = docs.select("doc_id", "text").mapInArrow(pack, "part long, names binary, ids binary")
    return parts.groupBy("part").applyInPandas(sort, "doc_id long, name long")


def _occurrences(texts: DataFrame, bits: int) -> DataFrame:
    """(anchor, context, doc_id) of the runs at the tuples that are listed in ``names``, one row for each in a document."""
    shift = np.uint64(32 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_numpy()
            for part, held in _together(batch.column(1)):
                s = Sampled(held)
                s.runs(_in_lists(s.tuples() >> shift, s.text, _lists(batch.column(2), part)))
                rows = pd.DataFrame({"anchor": s.anchor.view(np.int64), "context": s.context.view(np.int64), "doc_id": doc_ids[part][s.owner]})
                yield pa.RecordBatch.from_pandas(rows.drop_duplicates(), preserve_index=False)

    return texts.select("doc_id", "text", "names").mapInArrow(run, "anchor long, context long, doc_id long")


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(texts: list[bytes], runs: list, windows: list) -> list[tuple[int, int, int, str]]:
    """Bytes, removed bytes, spans and the digest of the rest of each text, when the strings of its listed runs and its listed strings go."""
    s = Sampled(texts)
    gone_starts = s.listed(runs)
    for k in (k for k, w in enumerate(windows) if w is not None):
        starts = np.arange(s.start[k], s.end[k] - SPAN + 1)
        gone_starts[starts[_in_lists(s.ranges.hashes(starts, starts + SPAN), np.zeros(len(starts), np.int64), [windows[k]])]] = True
    starts, size = np.flatnonzero(gone_starts), len(s.data) + 1
    gone = (np.cumsum(np.bincount(starts, minlength=size) - np.bincount(starts + SPAN, minlength=size)) > 0)[:-1]
    out = []
    for a, b in zip(s.start, s.end, strict=True):
        own = gone[a:b]
        spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(len(own) > 0 and own[0])
        out.append((int(b - a), int(np.count_nonzero(own)), spans, hashlib.sha256(s.data[a:b][~own].tobytes()).hexdigest()))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller doc_id.
    Null and empty texts have no bytes. Documents that share a doc_id aren't smaller than one another; each
    row is judged. Rows without a doc_id count as the smallest of all and lose nothing.
    """
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digests = written(plain.select("doc_id", F.sha2("text", 256).alias("whole"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    least = digests.groupBy("whole").agg(F.min("doc_id").alias("least"))
    placed = digests.join(least, "whole")
    copies = written(placed.where((F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= SPAN)).select("doc_id").distinct(), "copies")
    own = restricted(plain, copies, "left_anti")

    # as many parts as keep what is sorted together bounded
    tuples = (digests.agg(F.sum("n_bytes")).first()[0] or 0) * len(COVER) // PERIOD
    bits = min(32, max(6, (tuples // SORTED).bit_length()))
    names = written(_shared_tuples(own, bits), "names")
    named = restricted(own, written(names.select("doc_id").distinct(), "ids")).join(names.groupBy("doc_id").agg(F.collect_set("name").alias("names")), "doc_id")

    by_anchor, by_context = Window.partitionBy("anchor"), Window.partitionBy("anchor", "context")
    met = _occurrences(named, bits).withColumn("low", F.min("doc_id").over(by_anchor)).withColumn("high", F.max("doc_id").over(by_anchor)).where("low <> high")
    several = F.min("context").over(by_anchor) != F.max("context").over(by_anchor)
    shared = met.withColumn("several", several).withColumn("earliest", F.min("doc_id").over(by_context))
    # whole: an earlier document has the context; compared: the first to have a context, of several with this anchor
    shared = written(shared.select("anchor", "context", "doc_id", (F.col("earliest") < F.col("doc_id")).alias("whole"), "several").where("whole or several"), "shared")

    def of_docs(rows: DataFrame, name: str) -> DataFrame:
        return written(rows.groupBy("doc_id").agg(F.collect_list("context").alias("runs")), name)

    compared = of_docs(shared.where("not whole"), "compared")
    texts = restricted(own, written(compared.select("doc_id"), "ids"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_numpy()
            for part, held in _together(batch.column(1)):
                s = Sampled(held)
                starts = np.flatnonzero(s.listed(_lists(batch.column(2), part)))
                owner = np.searchsorted(s.end, starts, "right")
                rows = pd.DataFrame({"window": s.ranges.hashes(starts, starts + SPAN).view(np.int64), "doc_id": doc_ids[part][owner]})
                yield pa.RecordBatch.from_pandas(rows.drop_duplicates(), preserve_index=False)

    found = texts.join(compared, "doc_id").select("doc_id", "text", "runs").mapInArrow(windows, "window long, doc_id long")
    earlier = written(found.withColumn("least", F.min("doc_id").over(Window.partitionBy("window"))).where("least < doc_id").select("window", "doc_id"), "earlier")

    gone = shared.where("whole").groupBy("doc_id").agg(F.collect_list("context").alias("runs"))
    some = earlier.groupBy("doc_id").agg(F.collect_list("window").alias("windows"))
    decided = written(gone.join(some, "doc_id", "full"), "decided")
    changed = restricted(own, written(decided.select("doc_id"), "ids")).join(decided, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, held in _together(batch.column(1)):
                rows = pd.DataFrame(_cut(held, _lists(batch.column(2), part), _lists(batch.column(3), part)), columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
                rows.insert(0, "doc_id", batch.column(0).to_numpy()[part])
                yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    cuts = changed.select("doc_id", "text", "runs", "windows").mapInArrow(cut, SCHEMA)
    rest = placed.join(decided.select("doc_id"), "doc_id", "left_anti")
    copied = (F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= SPAN)
    nothing = hashlib.sha256(b"").hexdigest()
    settled = rest.select("doc_id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(copied, 1).otherwise(0).cast("long").alias("n_spans"), F.when(copied, nothing).otherwise(F.col("whole")).alias("kept_sha256"))
    return settled.unionByName(cuts).withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))
