"""BPE encoding and decoding by tree concatenation.

White space always separates tokens of a word-level BPE, so texts are first cut at ASCII white
space and every distinct piece is encoded once per worker and remembered. Words of plain letters,
digits and signs, which are most, are lower-cased and cut into runs here, by the rules that the
vocabulary file states, for many texts at once; only the different runs of a stretch of text are looked up,
and the merges of those that are new are applied together. Plain words with apostrophes are cut one by one and
their runs go to the library's model. All other words go to the library whole. A piece without white space has no safe cut. If it is long, it is cut into leaves at arbitrary places, all leaves are
encoded in one batch, and neighbours are joined pairwise, level by level, up a binary tree: at each
join a window around the cut is encoded anew and grows until it holds, on either side of the cut, a
token which the side's own encoding has at the same place. Of two neighbouring BPE tokens it only
depends on the two whether they can stand side by side, so the left part up to its shared token, the
window between the shared tokens, and the rest of the right part are the encoding of the whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import by_parts, give_back

#: Code points in a leaf of the tree; pieces of up to twice as many are encoded whole.
LEAF = 4096
#: Code points on either side of a join in its first window; doubled until both sides agree.
WINDOW = 64
#: A shared token lies at least so far from the cut: farther than any special token is long.
MARGIN = 24
#: Words that a worker remembers, and their bytes. When its memory is full, between two texts, those of several texts stay, half of it at most.
REMEMBERED, REMEMBERED_BYTES = 200_000, 1 << 23
#: Characters of the longest word that is cut into runs here.
LONGEST = 48

#: The public word-level tokenizer's own settings, for which the quick path below holds.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Characters which that normalizer only lower-cases, one by one, and which are letters, digits or signs without doubt.
PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f]+")
RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xd6\xd8-\xf6\xf8-\u012f]+|[0-9]|[^a-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u012f]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level BPE: printable Latin-1 bytes stand for themselves, the others follow from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
#: Characters above ASCII to the letters that stand for their UTF-8 bytes.
SHOWN = {c: "".join(BYTE_LETTERS[b] for b in chr(c).encode("utf-8")) for c in range(0xA1, 0x130)}

#: Bytes of text that are cut together; a longer piece without white space is not divided.
STRETCH = 1 << 20
#: Fewer new words than these go to the library's model one by one.
TOGETHER = 256
#: What a byte is when plain words are cut: HARD ones keep their whole word from being cut.
SPACE, LETTER, DIGIT, SIGN, HARD = range(5)


def _kinds() -> np.ndarray:
    """The kind of every byte. The two bytes of plain Latin letters count as hard until both are looked at; so do apostrophes, which can begin a run of letters."""
    kind = np.full(256, HARD, np.uint8)
    kind[0x21:0x7F] = SIGN
    kind[ord("'")] = HARD
    for first, last, what in (("a", "z", LETTER), ("A", "Z", LETTER), ("0", "9", DIGIT), ("\t", "\r", SPACE), (" ", " ", SPACE)):
        kind[ord(first) : ord(last) + 1] = what
    return kind


KIND = _kinds()
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

Token = tuple[int, int, int]  # id, first code point, end


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of many stretches, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def cut_words(raw: np.ndarray, splits: np.ndarray, plain: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces between white space, where they begin, and which were left whole; plain words are lower-cased and cut into runs, others stay whole.

    ``splits``: places where a text ends and the next begins, white space or not. A word that has other characters than
    plain ones, an apostrophe or the beginning of a special token stays whole, and so do all if ``plain`` is false.
    """
    kind, low = KIND[raw], LOWER[raw]
    high = np.flatnonzero(raw >= 0x80)
    if len(high):
        lead = high[(raw[high] == 0xC3) | (raw[high] == 0xC4)]
        a, b = raw[lead], raw[lead + 1]
        latin = np.where(a == 0xC3, (b != 0x97) & (b != 0xB7), b <= 0xAF)  # U+00C0 to U+012F without the signs of times and division
        lead, a, b = lead[latin], a[latin], b[latin]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] = np.where(a == 0xC3, b + np.uint8(0x20) * (b <= 0x9E), b | 1)
    blank = kind == SPACE
    hard = np.flatnonzero(kind == HARD) if plain else np.flatnonzero(~blank)
    special = np.flatnonzero(raw[:-1] == ord("<"))
    hard = np.concatenate([hard, special[raw[special + 1] == ord("|")]])
    if len(hard):
        before = np.concatenate([[True], blank[:-1]])
        before[splits] = True
        first = np.flatnonzero(before & ~blank)
        after = np.concatenate([before[1:] | blank[1:], [True]])
        last = np.flatnonzero(after & ~blank)
        words = np.unique(np.searchsorted(first, hard, "right") - 1)
        inside = spread(first[words], last[words] - first[words] + 1)
        kind[inside], low[inside] = HARD, raw[inside]
    edge = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == DIGIT)
    edge[splits] = True
    edge &= ~blank
    shown = low[~blank]
    starts = np.append(np.flatnonzero(edge[~blank]), len(shown)).astype(np.int32)
    begins = np.flatnonzero(edge)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(starts), pa.py_buffer(shown)]), begins, kind[begins] == HARD


class Merges:
    """The merges of a byte-level vocabulary, applied to many runs at once: in every round each run merges the first of its pairs of least rank."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict):
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = {b: BYTE_LETTERS[b] for b in range(256)}
        self.inner, self.last = (np.array([vocabulary.get(c + end, -1) for c in letters.values()], np.int64) for end in ("", suffix))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = self._key(*np.array([[vocabulary[a], vocabulary[b]] for a, b in pairs], np.int64).reshape(-1, 2).T)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.bits = max(4, 2 + len(keys).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1), np.full(1 << self.bits, self.NONE)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.ranks[slot[free]] = keys[rest[free]], rest[free]
            left = self.keys[slot] != keys[rest]
            rest, slot = rest[left], (slot[left] + 1) % len(self.keys)

    @staticmethod
    def applies(model: dict) -> bool:
        """Whether merges are all there is to the model, and every byte has a symbol."""
        usual = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        ends = ("", model.get("end_of_word_suffix") or "")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]] if usual else []
        return usual and len(set(merges)) == len(merges) > 0 and all(c + end in model["vocab"] for c in BYTE_LETTERS.values() for end in ends)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left << 31) | right

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        slot = self._slot(key)
        held = self.keys[slot]
        rank = np.where(held == key, self.ranks[slot], self.NONE)
        other = np.flatnonzero((held != key) & (held >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) % len(self.keys)
            held = self.keys[slot[other]]
            hit = held == key[other]
            rank[other[hit]] = self.ranks[slot[other[hit]]]
            other = other[~hit & (held >= 0)]
        return rank

    def encode(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs, one after the other, and how many each has. No run is empty."""
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        raw = np.frombuffer(b"".join(runs), np.uint8)
        symbol, run, last = self.inner[raw], np.arange(len(runs)), np.cumsum(size) - 1
        symbol[last] = self.last[raw[last]]
        rank = np.append(self._rank(symbol[:-1], symbol[1:]), self.NONE)[: len(symbol)]
        rank[last] = self.NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(run):
            last = np.cumsum(size) - 1
            first = last - size + 1
            best = np.minimum.reduceat((rank.astype(np.int64) << 32) | np.arange(len(rank)), first)
            least, at = best >> 32, best & 0xFFFFFFFF
            whole = least == self.NONE
            stay = np.ones(len(symbol), bool)
            if whole.any():
                ready = spread(first[whole], size[whole])
                done.append((run[whole], size[whole], symbol[ready]))
                stay[ready] = False
                run, size, first, last, least, at = (x[~whole] for x in (run, size, first, last, least, at))
            symbol[at] = self.made[least]
            rank[at] = self.NONE
            more = at[at + 1 < last]
            rank[more] = self._rank(symbol[more], symbol[more + 2])
            more = at[at > first]
            rank[more - 1] = self._rank(symbol[more - 1], symbol[more])
            stay[at + 1] = False
            symbol, rank, size = symbol[stay], rank[stay], size - 1
        size, ids = np.zeros(len(runs), np.int64), np.zeros(sum(len(x) for *_, x in done), np.uint32)
        for which, n, _ in done:
            size[which] = n
        begin = np.cumsum(size) - size
        for which, n, symbols in done:
            ids[spread(begin[which], n)] = symbols
        return ids, size


class Words(dict):
    """Runs (text) and words (bytes) to their numbers, from 0 on; what isn't known gets the next number and is put into ``new``."""

    def __init__(self):
        self.new: list[str | bytes] = []

    def __missing__(self, word: str | bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class TreeBpe:
    """Encodes and decodes as ``tokenizers`` does, without truncation, padding or added ids."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.window = leaf, window
        self._forget()
        settings = json.loads(self.tokenizer.to_str())
        self.plain = settings["normalizer"] == NORMALIZER and settings["pre_tokenizer"] == PRE_TOKENIZER
        self.merges = Merges(settings["model"]) if self.plain and Merges.applies(settings["model"]) else None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.plain_join = self.tokenizer.decoder is None

    # -- encoding ---------------------------------------------------------------------------

    def _forget(self) -> None:
        """No word is known; ids of the n-th of the ``learned`` words are ``ids[starts[n] : starts[n + 1]]``, and it was met ``seen[n]`` times."""
        self.words, self.learned, self.held = Words(), 0, 0
        self.ids, self.starts, self.seen = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _forget_rare(self) -> None:
        """Words that were met once go, and of the others the rarer ones beyond half of what may be remembered."""
        seen, known = self.seen[: self.learned], list(self.words)
        least = 2 if len(seen) <= REMEMBERED // 2 else max(2, int(np.partition(seen, -(REMEMBERED // 2))[-(REMEMBERED // 2)]) + 1)
        stay = np.flatnonzero(seen >= least)
        if sum(len(known[n]) for n in stay) > REMEMBERED_BYTES // 2:
            stay = stay[:0]
        size = self.starts[stay + 1] - self.starts[stay]
        ids = self.ids[spread(self.starts[stay], size)]
        self._forget()
        self.words.update((known[n], k) for k, n in enumerate(stay))
        self._room(len(stay), len(ids))
        self.ids[: len(ids)] = ids
        self.starts[1 : len(stay) + 1] = np.cumsum(size)
        self.learned, self.held = len(stay), sum(map(len, self.words))

    def _room(self, words: int, ids: int) -> None:
        while len(self.starts) <= words + 1:
            self.starts, self.seen = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.seen, np.zeros_like(self.seen)])
        while len(self.ids) < ids:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text; a null or empty text has none."""
        return self.encode_ids(text).tolist()

    def encode_ids(self, text: str | None) -> np.ndarray:
        """The same as an array of 32-bit numbers."""
        return self.encode_texts(pa.array([text], pa.large_string()))[0]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many texts, one after the other, and where those of each end; null and empty texts have none."""
        texts = texts.fill_null("").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        found, ends, held, a = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64), 0, int(bounds[0])
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        while a < bounds[-1]:
            b = min(a + STRETCH, int(bounds[-1]))
            text_end = int(bounds[np.searchsorted(bounds, b)])
            blank = KIND[raw[b:text_end]] == SPACE
            b = b + int(np.argmax(blank)) if blank.any() else text_end
            i, j = np.searchsorted(bounds, [a, b], "right")
            ids, at = self._encode_stretch(raw[a:b], bounds[i:j] - a)
            ends[i - 1 : j - 1] = held + at
            found.append(ids)
            held += len(ids)
            a = b
        return np.concatenate(found), ends

    def _encode_stretch(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a stretch that ends at white space or with a text, and how many come before each of some ends of texts."""
        if len(self.words) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self._forget_rare()
        pieces, begins, whole = cut_words(raw, ends[ends < len(raw)], self.plain)
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        number = np.fromiter(map(self.words.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        if self.words.new:
            hard = np.zeros(len(number), bool)
            hard[which[whole]] = True
            self._learn(hard[number >= self.learned])  # new ones have got their numbers in this order
        self.seen[number] += np.bincount(which, minlength=len(number)).astype(np.int32)
        size = (self.starts[number + 1] - self.starts[number])[which]
        place = np.concatenate([[0], np.cumsum(size)])
        return self.ids[spread(self.starts[number][which], size)], place[np.searchsorted(begins, ends)]

    def _learn(self, hard: np.ndarray) -> None:
        """Encodes the new words and keeps their ids behind those of the others; those that aren't hard are lower-cased runs."""
        words, self.words.new = self.words.new, []
        known = self.learned
        merged = ~hard & (np.fromiter(map(len, words), np.int64, len(words)) <= LONGEST) & (self.merges is not None and len(words) >= TOGETHER)
        rest = self._encode_words([w for w, m in zip(words, merged.tolist(), strict=True) if not m])
        sizes = np.fromiter(map(len, rest), np.int64, len(rest))
        groups = [(np.concatenate([np.flatnonzero(~merged), np.arange(len(words), len(self.words) - known)]), np.fromiter(chain.from_iterable(rest), np.uint32, sizes.sum()), sizes)]
        if merged.any():
            groups.append((np.flatnonzero(merged), *self.merges.encode([w for w, m in zip(words, merged.tolist(), strict=True) if m])))
        size = np.zeros(len(self.words) - known, np.int64)
        for at, _, n in groups:
            size[at] = n
        ends = self.starts[known] + np.cumsum(size)
        self._room(len(self.words), int(ends[-1]))
        for at, ids, n in groups:
            self.ids[spread(ends[at] - n, n)] = ids
        self.starts[known + 1 : known + 1 + len(ends)] = ends
        self.learned = len(self.words)
        self.held += sum(map(len, words))

    def _encode_words(self, pieces: list[bytes]) -> list[Sequence[int]]:
        """The ids of each word, and then of each run that was met for the first time."""
        out: list[Sequence[int]] = []
        rest: list[int] = []
        fresh: dict[str, list[int]] = {}
        for n, piece in enumerate(pieces):
            word = piece.decode("utf-8")
            if self.plain and len(word) <= LONGEST and PLAIN.fullmatch(word) and "<|" not in word:
                word = word.lower()
                if word.isalpha():
                    out.append(self._encode_run(word, fresh))
                else:
                    out.append([i for run in RUNS.findall(word) for i in self._encode_run(run, fresh)])
            elif len(word) > 2 * self.leaf:
                out.append([t[0] for t in self.encode_unsplit(word)])
            else:
                out.append(())
                rest.append(n)
        if rest:
            for n, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[n].decode("utf-8") for n in rest], add_special_tokens=False), strict=True):
                out[n] = e.ids
        return [*out, *fresh.values()]

    def _encode_run(self, run: str, fresh: dict[str, list[int]]) -> list[int]:
        """The ids of a lower-cased run; one that isn't known gets the next number and goes into ``fresh``."""
        n = self.words.get(run)
        if n is None:
            self.words[run] = len(self.words)
            shown = run if run.isascii() else run.translate(SHOWN)
            ids = fresh[run] = [t.id for t in self.tokenizer.model.tokenize(shown)]
            return ids
        if n >= self.learned:
            return fresh[run]
        self.seen[n] += 1
        return self.ids[self.starts[n] : self.starts[n + 1]].tolist()

    def _encode_leaves(self, texts: list[str], starts: list[int]) -> list[list[Token]]:
        encoded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [[(i, s + a, s + b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)] for e, s in zip(encoded, starts, strict=True)]

    def encode_unsplit(self, text: str) -> list[Token]:
        """Tokens of a text without white space, by a binary tree of leaves."""
        cuts = [0]
        while len(text) - cuts[-1] > self.leaf:
            cut = cuts[-1] + self.leaf
            while cut < len(text) and not self._can_cut(text, cut):
                cut += 1
            cuts.append(cut)
        if cuts[-1] < len(text):
            cuts.append(len(text))
        nodes = self._encode_leaves([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], cuts[:-1])
        inner = cuts[1:-1]
        while len(nodes) > 1:
            ends = [0, *inner, len(text)]
            joined = [self._join(text, nodes[k], nodes[k + 1], *ends[k : k + 3]) for k in range(0, len(nodes) - 1, 2)]
            nodes, inner = joined + nodes[len(nodes) - len(nodes) % 2 :], inner[1::2]
        return nodes[0] if nodes else []

    @staticmethod
    def _can_cut(text: str, cut: int) -> bool:
        """Whether normalizing the two sides alone gives the same as normalizing them together."""
        a, b = text[max(0, cut - 8) : cut], text[cut : cut + 8]
        return unicodedata.combining(text[cut]) == 0 and unicodedata.normalize("NFC", a + b) == unicodedata.normalize("NFC", a) + unicodedata.normalize("NFC", b)

    def _join(self, text: str, left: list[Token], right: list[Token], start: int, cut: int, end: int) -> list[Token]:
        """The encoding of text[start:end] from those of its parts on either side of cut."""
        reach = self.window
        while True:
            a, b = max(start, cut - reach), min(end, cut + reach)
            while a > start and not self._can_cut(text, a):
                a -= 1
            while b < end and not self._can_cut(text, b):
                b += 1
            window = self._encode_leaves([text[a:b]], [a])[0]
            i = self._shared_left(left, window, cut, a == start)
            j = self._shared_right(right, window, cut, b == end)
            if i is not None and j is not None and i[1] <= j[1]:
                return left[: i[0]] + window[i[1] : j[1]] + right[j[0] :]
            if a == start and b == end:
                return window
            reach *= 2

    @staticmethod
    def _shared_left(left: list[Token], window: list[Token], cut: int, whole: bool) -> tuple[int, int] | None:
        """How many tokens of left stay, and where the window takes over; the last shared token."""
        if whole:
            return 0, 0
        at: dict[Token, int] = {}
        for n in range(len(left) - 1, -1, -1):
            if window and left[n][2] < window[0][1]:
                break
            at[left[n]] = n
        for m in range(len(window) - 1, 0, -1):
            t = window[m]
            if t[2] <= cut - MARGIN and t in at and at[t] and left[at[t] - 1][2] <= t[1] and window[m - 1][2] <= t[1]:
                return at[t], m
        return None

    @staticmethod
    def _shared_right(right: list[Token], window: list[Token], cut: int, whole: bool) -> tuple[int, int] | None:
        if whole:
            return len(right), len(window)
        at: dict[Token, int] = {}
        for n, t in enumerate(right):
            if window and t[1] > window[-1][2]:
                break
            at[t] = n
        for m, t in enumerate(window[:-1]):
            if t[1] >= cut + MARGIN and t in at and at[t] + 1 < len(right) and right[at[t] + 1][1] >= t[2] and window[m + 1][1] >= t[2]:
                return at[t] + 1, m + 1
        return None

    # -- decoding ---------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of token ids, special ones included."""
        if self.plain_join:
            tokens = self.tokens
            return " ".join([tokens[i] for i in ids])
        return self.tokenizer.decode(ids, skip_special_tokens=False)


_LOADED: dict[str, TreeBpe] = {}


def loaded(path: str) -> TreeBpe:
    """The worker's own encoder; loaded once in each Python process."""
    if path not in _LOADED:
        _LOADED.clear()
        give_back()  # workers are used again: what stages before left
        _LOADED[path] = TreeBpe(path)
        gc.freeze()
        gc.set_threshold(200_000, 50, 50)  # the words that it remembers are no garbage
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row. Null and empty texts have an empty array; repeated rows give repeated results."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)

        def encoded(part: pa.RecordBatch) -> pa.RecordBatch:
            found, ends = bpe.encode_texts(part.column(1))
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(found.view(np.int32)))
            return pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

        yield from by_parts(batches, 1, encoded)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of what encode_documents returns; a null array gives an empty text."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            texts = pa.array([bpe.decode(x.as_py() or []) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, encoded and decoded again.

    A null or empty text has 0 tokens and digests of the empty string. Repeated rows give repeated
    results. Only doc_id and text are read, so other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        decimal = [str(i) for i in range(len(bpe.tokens))]

        def digests(part: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_hash, text_hash = [], [], []
            found, ends = bpe.encode_texts(part.column(1))
            for a, b in zip(np.append(0, ends)[:-1].tolist(), ends.tolist(), strict=True):
                ids = found[a:b].tolist()
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        yield from by_parts(batches, 1, digests)

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
