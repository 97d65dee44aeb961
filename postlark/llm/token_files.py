"""Token ids in binary files, compressed by Re-Pair grammars.

A shard holds consecutive documents. Its token stream is rewritten in rounds: count all neighbouring
id pairs inside documents, give each that is frequent a nonterminal, replace them, the more frequent first where
two overlap, and go on with the shorter stream until no pair is frequent any more. A pair is frequent if its rule saves clearly
more room than it takes. The file keeps the rules and the length to which each nonterminal expands, so that
one document, or one position in it, is decoded without the others.

Layout of a shard, little-endian:
    8 bytes  magic
    6 x u64  documents, rules, symbols, tokens, first nonterminal, bits of a symbol above 16
    i64[documents]      document ids, ascending
    u64[documents + 1]  first symbol of each document
    u64[documents + 1]  first token of each document, within the shard
    u32[rules]          expansion lengths
    planes[2 * rules]   right-hand sides, two symbols each
    planes[symbols]     the compressed stream
Planes of n symbols are u16[n], the lower 16 bits of each, and then for each bit above the bits of all, the
first symbol's in the highest place, filled up to bytes.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import loaded
from .common import PART, as_uri, fresh_path, open_file, parts, put_file, written

MAGIC = b"RPSHARD1"
END_ID = 2
#: A shard is closed when it holds so many tokens.
SHARD_TOKENS = 2_000_000
#: Fixed value: the golden ratio's bits, by which numbers are scrambled.
SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
#: Counts of pairs are told apart by powers of the 4th root of 2, so that a chain of pairs, each a little more frequent than the last, doesn't take a round each.
CLASSES = 4
#: A pair gets its rule in a round in which it keeps this part of its places at least; otherwise it waits for what others leave it.
KEPT = 0.5
#: Bytes that a rule takes besides its two symbols: the length it expands to.
RULE_BYTES = 4
#: Documents that are read and expanded together.
READ = 256


def worth(first: int) -> int:
    """How often a pair must occur to get a rule: so often that it saves half as much again as its rule takes.

    Each occurrence saves one symbol, the rule takes two and its length; symbols have 16 bits and those above, as
    many as the first rule's symbol needs. Rules of rarer pairs break even at best, and take occurrences from one another:
    with them files were larger (1.154 bytes a token against 1.152 on 1,700 documents of check_s).
    """
    symbol = max(16, first.bit_length()) / 8
    return math.ceil(1.5 * (2 * symbol + RULE_BYTES) / symbol)


class Grammar:
    """Re-Pair over one stream. ``ends`` marks the last symbol of each document: no pair reaches across or into it."""

    def __init__(self, first: int):
        self.first = first
        self.rules = np.zeros((0, 2), np.uint32)
        self.lengths = np.zeros(0, np.uint64)

    def compress(self, stream: np.ndarray, ends: np.ndarray, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The shorter stream and its marks of ends, in rounds until no pair occurs ``least`` times.

        In a round the frequent pairs get rules, the more frequent first where two overlap. Symbols stay where they
        are and know their neighbours, so a round looks at pairs with a new symbol and at frequent pairs that were
        passed over; all others can't have become frequent.
        """
        least = worth(self.first) if least is None else least
        n = len(stream)
        seq, closed = stream.astype(np.uint32), np.append(ends, True).astype(bool)  # the last is behind the stream and before it
        after, before, alive = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32), np.ones(n, bool)
        sizes, rules = np.concatenate([np.ones(self.first, np.uint64), self.lengths]), [self.rules]
        at = np.flatnonzero(~(closed[:-1] | closed[1:])).astype(np.int32)
        while len(at):
            at, which, pairs, counts, second = self._frequent(seq, after, at, least, len(sizes) > self.first)
            if not len(at):
                break
            joined = at[1:] == after[at[:-1]]
            taken, passed, used = self._chosen(joined, which, pairs, counts, second, least)
            here = at[taken]
            gone = after[here]
            behind = after[gone]
            seq[here] = len(sizes) + (np.cumsum(used) - 1)[which[taken]]
            after[here], before[behind], alive[gone] = behind, here, False
            sizes = np.concatenate([sizes, sizes[pairs[used]].sum(1)])
            rules.append(pairs[used].astype(np.uint32))
            front = before[here]
            at = np.sort(np.concatenate([here[~closed[behind]], front[~closed[front]], at[passed]]))
            at = at[np.append(True, at[1:] != at[:-1])[: len(at)]]
        self.rules, self.lengths = np.concatenate(rules), sizes[self.first :]
        return seq[alive], closed[:-1][alive]

    @staticmethod
    def _frequent(seq: np.ndarray, after: np.ndarray, at: np.ndarray, least: int, mostly_rare: bool) -> tuple[np.ndarray, ...]:
        """Of some places, in order, those of frequent pairs; their pairs' numbers; the pairs and their counts; which places are
        the second, fourth and so on of a run of one symbol. These don't count, as they overlap others of the same pair."""
        left, right = seq[at], seq[after[at]]
        second = np.zeros(len(at), bool)
        same = np.flatnonzero(left == right)
        second[same] = _every_second(same, at[1:] == after[at[:-1]])
        symbol = max(1, int(max(left.max(), right.max())).bit_length())
        code = (left.astype(np.uint64) << np.uint64(symbol)) | right
        del left, right
        if mostly_rare:  # pairs whose slot is counted less often are rare; what shares a slot is told apart below
            slot = ((code * SCRAMBLE) >> np.uint64(44)).astype(np.int32)
            may = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] >= least)
            at, code, second = at[may], code[may], second[may]
        counted = np.flatnonzero(~second)
        code, bits = code[counted], len(counted).bit_length()
        if 2 * symbol + bits <= 64:  # the places are sorted along with the pairs
            keys = np.sort((code << np.uint64(bits)) | np.arange(len(code), dtype=np.uint64))
            code, order = keys >> np.uint64(bits), (keys & np.uint64((1 << bits) - 1)).astype(np.int32)
            del keys
        else:
            order = np.argsort(code, kind="stable")
            code = code[order]
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        counts = np.diff(np.append(begin, len(code)))
        often = counts >= least
        number = np.full(len(at), -1, np.int32)
        number[counted[order]] = np.repeat(np.where(often, np.cumsum(often) - 1, -1).astype(np.int32), counts)
        late = np.flatnonzero(second)
        number[late] = number[late - 1]
        stay = np.flatnonzero(number >= 0)
        chosen = code[begin[often]]
        pairs = np.stack([chosen >> np.uint64(symbol), chosen & np.uint64((1 << symbol) - 1)], 1).astype(np.int64)
        return at[stay], number[stay], pairs, counts[often], second[stay]

    @staticmethod
    def _chosen(joined: np.ndarray, which: np.ndarray, pairs: np.ndarray, counts: np.ndarray, second: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
        """Places that are replaced, places that neither are nor overlap one that is, and the pairs that get rules.

        A place is taken if its pair is more frequent than those that it overlaps, of about equally frequent ones by scrambled
        numbers. Pairs that keep enough places get rules, and these also take what is then left of their places. The
        first in this order keeps all its places, so every round has a rule.
        """
        mixed = (pairs[:, 0].astype(np.uint64) << np.uint64(32) | pairs[:, 1].astype(np.uint64)) * SCRAMBLE >> np.uint64(32)
        rank = ((CLASSES * np.log2(counts)).astype(np.uint64) + np.uint64(1) << np.uint64(32) | mixed)[which]
        rank[second] = 0
        beats = rank[1:] > rank[:-1]
        taken = rank > 0
        taken[1:] &= ~joined | beats
        taken[:-1] &= ~joined | ~beats
        used = np.bincount(which[taken], minlength=len(pairs)) >= np.maximum(least, KEPT * counts)
        if not used.any():
            used[np.argmax(counts)] = True
            taken = ~second
        taken &= used[which]
        free = ~_overlapped(taken, joined)
        rest = np.flatnonzero(free & used[which])
        taken[rest[~_every_second(rest, joined)]] = True
        return taken, ~_overlapped(taken, joined), used

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return expand(symbols, self.first, self.rules)


def _every_second(some: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Of some places, by their numbers, the second, fourth and so on of every run of places that overlap; ``joined[k]``: place k overlaps the next."""
    k = np.arange(len(some))
    begins = np.ones(len(some), bool)
    begins[1:] = (np.diff(some) != 1) | ~joined[some[1:] - 1]
    return (k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 1


def _overlapped(taken: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The places taken and those that overlap one."""
    out = taken.copy()
    out[1:] |= joined & taken[:-1]
    out[:-1] |= joined & taken[1:]
    return out


def expand(symbols: np.ndarray, first: int, rules: np.ndarray) -> np.ndarray:
    """Token ids of any part of a compressed stream."""
    seq = symbols.astype(np.int64)
    while True:
        inner = seq >= first
        if not inner.any():
            return seq.astype(np.uint32)
        place = np.cumsum(1 + inner) - 1 - inner
        out = np.empty(len(seq) + int(inner.sum()), np.int64)
        out[place] = np.where(inner, rules[np.where(inner, seq - first, 0), 0] if len(rules) else seq, seq)
        out[place[inner] + 1] = rules[seq[inner] - first, 1]
        seq = out


def planes(symbols: np.ndarray, above: int) -> bytes:
    """Symbols as 16 lower bits each, and the bits above place by place."""
    bits = [np.packbits((symbols >> np.uint32(16 + b)).astype(np.uint8) & 1).tobytes() for b in range(above)]
    return b"".join([(symbols & np.uint32(0xFFFF)).astype("<u2").tobytes(), *bits])


def read_planes(file, start: int, n: int, above: int, a: int, b: int) -> np.ndarray:
    """Symbols a to b of the n whose planes begin at a place of the file; only their bytes are read."""
    file.seek(start + 2 * a)
    out = np.frombuffer(file.read(2 * (b - a)), "<u2").astype(np.uint32)
    for k in range(above):
        file.seek(start + 2 * n + k * -(-n // 8) + a // 8)
        bits = np.unpackbits(np.frombuffer(file.read(-(-b // 8) - a // 8), np.uint8))
        out |= bits[a % 8 : a % 8 + b - a].astype(np.uint32) << np.uint32(16 + k)
    return out


def pack(doc_ids: list[int], encoded: list[np.ndarray], first: int) -> bytes:
    """A shard of documents whose ids end with the end id."""
    lengths = np.array([len(x) for x in encoded], np.int64)
    stream = np.concatenate(encoded) if encoded else np.zeros(0, np.uint32)
    tokens_at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)
    ends = np.zeros(len(stream), bool)
    ends[(tokens_at[1:] - np.uint64(1)).astype(np.int64)] = True
    grammar = Grammar(first)
    symbols, marks = grammar.compress(stream, ends)
    symbols_at = np.concatenate([[0], np.flatnonzero(marks) + 1]).astype(np.uint64)
    above = max(0, int(first + len(grammar.rules) - 1).bit_length() - 16)
    head = struct.pack("<6Q", len(doc_ids), len(grammar.rules), len(symbols), len(stream), first, above)
    index = [np.array(doc_ids, "<i8"), symbols_at.astype("<u8"), tokens_at.astype("<u8"), grammar.lengths.astype("<u4")]
    return b"".join([MAGIC, head, *[x.tobytes() for x in index], planes(grammar.rules.ravel(), above), planes(symbols, above)])


class Shard:
    """Random access to the documents of one file."""

    def __init__(self, file):
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a shard of token ids")
        n, rules, self.n_symbols, tokens, self.first, self.above = struct.unpack("<6Q", file.read(48))
        array = lambda kind, count: np.frombuffer(file.read(count * np.dtype(kind).itemsize), kind)
        self.doc_ids, self.symbols_at, self.tokens_at = array("<i8", n), array("<u8", n + 1), array("<u8", n + 1)
        self.lengths, at = array("<u4", rules), file.tell()
        self.rules = read_planes(file, at, 2 * rules, self.above, 0, 2 * rules).reshape(-1, 2)
        self.sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths.astype(np.int64)])
        self.n_tokens, self.body = tokens, at + 4 * rules + self.above * -(-2 * rules // 8)

    def symbols(self, first: int, last: int) -> np.ndarray:
        return read_planes(self.file, self.body, self.n_symbols, self.above, int(self.symbols_at[first]), int(self.symbols_at[last]))

    @cached_property
    def looked_up(self) -> tuple[np.ndarray, np.ndarray]:
        """What all symbols stand for, one after the other, and where each begins: for reading the whole file."""
        whole = expand(np.arange(self.first, self.first + len(self.rules)), self.first, self.rules)
        return np.concatenate([np.arange(self.first, dtype=np.uint32), whole]), np.cumsum(self.sizes) - self.sizes

    def documents(self, first: int, last: int) -> np.ndarray:
        """Ids of some neighbouring documents, by looking up what symbols stand for."""
        ids, begins = self.looked_up
        symbols = self.symbols(first, last)
        size = self.sizes[symbols]
        place = np.cumsum(size)
        return ids[np.repeat(begins[symbols] - place + size, size) + np.arange(place[-1] if len(place) else 0)]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, its end id included; only its own rules are expanded."""
        return expand(self.symbols(k, k + 1), self.first, self.rules)

    def tokens(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the k-th document; only the nonterminals that overlap them are expanded."""
        symbols = self.symbols(k, k + 1).astype(np.int64)
        ends = np.cumsum(self.sizes[symbols])
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(symbols[a:b], self.first, self.rules)[start - skipped : stop - skipped]


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents, in ascending doc_id order, into shards under ``folder``.

    Returns one row per shard: path, part, seq, n_docs, n_tokens, n_bytes (of the file) and base (tokens in
    all shards before it). Null texts count as empty: they hold the end id alone. Rows that share a doc_id stay separate,
    in the order of their texts. A null doc_id is stored as the smallest long. An empty table has no
    shard. The files are written once: the returned table is read from what the tasks reported.
    """
    spark = docs.sparkSession
    uri = as_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        part, seq = TaskContext.get().partitionId(), 0
        first = len(bpe.tokens)
        ids: list[int] = []
        encoded: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            path, data = f"{uri}/shard-{part:06d}-{seq:06d}.rps", pack(ids, encoded, first)
            put_file(path, data)
            return pa.RecordBatch.from_pydict({"path": [path], "part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [held], "n_bytes": [len(data)]})

        for some in chain.from_iterable(parts(batch, 1, PART) for batch in batches):
            found, ends = bpe.encode_texts(some.column(1))
            found, stops = np.insert(found, ends, END_ID), ends + np.arange(1, len(ends) + 1)
            for doc_id, a, b in zip(some.column(0).to_pylist(), np.append(0, stops)[:-1].tolist(), stops.tolist(), strict=True):
                tokens = found[a:b]
                ids.append(doc_id)
                encoded.append(tokens)
                held += len(tokens)
                if held >= shard_tokens:
                    yield close()
                    ids, encoded, held, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    ordered = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = written(ordered.mapInArrow(run, "path string, part long, seq long, n_docs long, n_tokens long, n_bytes long"), "shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the writing job
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return shards.join(totals, "part").select("path", "part", "seq", "n_docs", "n_tokens", "n_bytes", (F.col("part_base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("base"))


def read_token_files(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of write_token_files, read a few documents at a time."""
    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"], strict=True):
                with open_file(path) as f:
                    shard = Shard(f)
                    n, at, crc = len(shard.doc_ids), shard.tokens_at.astype(np.int64), []
                    for a in range(0, n, READ):
                        b = min(n, a + READ)
                        ids = shard.documents(a, b).astype("<u4")
                        crc += [zlib.crc32(ids[at[k] - at[a] : at[k + 1] - at[a]]) for k in range(a, b)]
                yield pd.DataFrame({"doc_id": shard.doc_ids.astype(np.int64), "start": base + at[:-1], "n_tokens": np.diff(at), "ids_crc32": np.array(crc, np.int64)})

    return shards.select("path", "base").repartition(tasks, "path").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents to token files in the shared folder and describe what the files hold."""
    return read_token_files(write_token_files(docs, vocabulary, fresh_path(docs.sparkSession, "tokens")))
