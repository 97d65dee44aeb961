"""Each operator against brute force, an exact round trip, or hand-made cases with nulls, ties and clashing columns."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlark.llm import bpe, chat, common, mixing, ngram_join, pii, repeats, rules, spotsigs, token_files, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, a long, k string"


@pytest.fixture(scope="module")
def docs(spark):
    """The small table and odd rows: nulls, empty and blank texts, repeats, a long unsplit text, clashing columns."""
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{SF}/documents.parquet").withColumn("a", F.lit(1).cast("long")).withColumn("k", F.lit("x"))
    long = "ab1" * 4000
    odd = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "one two"), (1005, long), (1006, "ONE two three four five six"), (1007, "one TWO three four five six")]
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in odd] + [(1003, "one two", None, None, None, None, None)]
    return base.unionByName(spark.createDataFrame(rows, DOCS)).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_ngram_join(spark, docs, texts):
    out = {r.doc_id: r for r in ngram_join.linked(docs).collect()}
    sets, group = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sorted(sets):
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    assert {d: (r.n_shingles, r.component_id) for d, r in out.items()} == {d: (len(sets[d]), root(d)) for d in sets}
    assert ngram_join.linked(empty(spark)).count() == 0


def test_trie_is_exact_for_whole_sets_and_safe_for_beginnings():
    rng = np.random.default_rng(1)
    for turn in range(300):
        base = np.unique(rng.integers(0, 60, rng.integers(3, 40)))
        draw = lambda: np.unique(np.concatenate([rng.choice(base, rng.integers(len(base) // 2, len(base) + 1), replace=False), rng.integers(0, 60, rng.integers(0, 6))]))
        own, others = [draw() for _ in range(7)], [draw() for _ in range(9)]
        alone = rng.integers(0, 3, 16)  # elements that no other set has, in the sizes only
        n_own, n_others = np.array([len(o) for o in own]) + alone[:7], np.array([len(o) for o in others]) + alone[7:]
        label_own, label_others = (np.arange(7), np.arange(7, 16)) if turn % 3 else (rng.integers(0, 3, 7), rng.integers(0, 3, 9))
        want = {(x, y) for x in range(7) for y in range(9) if label_own[x] != label_others[y] and 180 * len(np.intersect1d(own[x], others[y])) >= 80 * (n_own[x] + n_others[y])}
        x, y = ngram_join.similar(ngram_join.Sequences(own, n_own, label=label_own), ngram_join.Sequences(others, n_others, label=label_others))
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == want and len(x) == len(want)
        cut = rng.integers(1, 12, 16)
        begun = [s[: cut[k]] for k, s in enumerate([*own, *others])]
        rest = np.array([len(s) - len(b) for s, b in zip([*own, *others], begun, strict=True)])
        x, y = ngram_join.similar(ngram_join.Sequences(begun[:7], n_own, rest[:7], label_own), ngram_join.Sequences(begun[7:], n_others, rest[7:], label_others))
        assert want <= set(zip(x.tolist(), y.tolist(), strict=True))


def test_trie_shares_its_matching(monkeypatch):
    """Shared beginnings are matched once, and what lies below a pruned node isn't matched."""
    matched, plain = [], ngram_join._matches
    monkeypatch.setattr(ngram_join, "_matches", lambda has, who, at: matched.append(len(at)) or plain(has, who, at))
    own = np.arange(1000, 1200)
    alike = [np.append(own[:190], 5000 + k) for k in range(50)]
    other = [np.concatenate([np.arange(100), own[k : k + 100]]) for k in range(50)]
    sets = alike + other
    _, found = ngram_join.similar(ngram_join.Sequences([own], [len(own)], label=[0]), ngram_join.Sequences(sets, [len(o) for o in sets]))
    assert sorted(found.tolist()) == list(range(50))
    assert sum(matched) <= 190 + 50 + 100


def components_by_force(rows):
    sets, group = {}, {d: d for d, _ in rows}
    for d, t in rows:
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sorted(sets):
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {d: root(d) for d in group}


def test_large_groups_near_the_threshold(spark, monkeypatch):
    """Copies of one text with more or fewer edits, over several blocks of a root, equal brute force."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(5)
    base, rows = [f"b{k}" for k in range(150)], []
    for d in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
        rows.append((d * 3 + 1, " ".join(words)))
    out = {r.doc_id: r.component_id for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = components_by_force(rows)
    assert out == want and len(set(want.values())) > 3


def test_join_of_rows_without_or_with_one_doc_id(spark):
    text, other = "a b c d e f g h", "k l m n o p q r"
    rows = [(None, text), (5, text), (9, text), (None, other), (7, "x"), (7, other), (8, other), (7, None)]
    out = sorted(map(tuple, ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(None, 4, None), (5, 4, 5), (9, 4, 5), (None, 4, None), (7, 1, 7), (7, 4, 7), (8, 4, 7), (7, 0, 7)], key=str)


def test_frequent_shingles_and_chains(spark):
    """Many documents share one passage, and a chain of near copies hangs together."""
    passage = [f"p{k}" for k in range(30)]
    rows = [(i, " ".join([*(f"w{i}_{k}" for k in range(40)), *passage])) for i in range(60)]
    chain = [f"c{k}" for k in range(120)]
    for step in range(6):
        rows.append((100 + step, " ".join([f"x{k}" if k < 4 * step else w for k, w in enumerate(chain)])))
    out = {r.doc_id: r.component_id for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[100 + s] for s in range(6)] == [100] * 6 and all(out[i] == i for i in range(60))


def test_quality_features(docs, texts, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = {r.doc_id: r for r in rules.judged(docs, labels).collect()}
    for d, t in texts.items():
        w = WORDS.findall(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        r = out[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_learned_rules_hold_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learned = rules.learn(docs, labels.where("doc_id % 2 = 0"))
    judged = {r.doc_id: r.kept for r in rules.judged(docs, labels, rules=learned).where("not base_failed").collect()}
    held = [(r.quality, judged[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in judged]
    assert learned and sum(k for q, k in held if q) >= 0.99 * sum(q for q, _ in held)
    assert sum(not k for q, k in held if not q) >= 0.8 * sum(not q for q, _ in held)
    assert rules.learn(docs, labels.limit(0)) == []


def test_warc_round_trip(spark, tmp_path):
    long = "é<p>" * 400
    pages = spark.createDataFrame([(1, "u", long), (2, None, long), (3, "u\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long)], "page_id long, url string, html string")
    out = {r.page_id: r for r in warc.archived_pages(pages).collect()}
    assert [out[k].record_type for k in (1, 2, 3, 4, 5)] == ["revisit", "response", "response", "response", "response"] and out[1].refers_to == 2
    assert out[1].payload_bytes == len(long.encode()) and out[5].payload_digest == hashlib.sha1(b"").hexdigest() and None in out
    assert warc.archived_pages(pages.limit(0)).count() == 0
    index = warc.write_bundles(pages.where("page_id = 3"), f"file://{tmp_path}/w").collect()[0]
    with warc.open_file(index.bundle) as f:
        fields, payload = warc.parse_record(warc.BundleReader(f).record(index.frame, index.offset, index.length))
    assert payload == b"short" and fields["WARC-Target-URI"] == "u  X: y"


def slow_signatures(text):
    """Signatures in plain Python: chained 64-bit hashes of an anchor and the first content words after it, 40 bits each."""
    w = [x for x in re.split("[ \\t\\n\\x0b\\f\\r" + re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + "]+", text.lower()) if x]

    def name(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64(p.encode(), seed=h).intdigest()
        return h & ((1 << 40) - 1)

    found = set()
    for i, x in enumerate(w):
        ahead = [y for y in w[i + 1 : i + 1 + spotsigs.AHEAD] if y not in spotsigs.ANCHORS]
        if x in spotsigs.ANCHORS and len(ahead) >= spotsigs.CHAIN:
            found.add(name(x, *ahead[: spotsigs.CHAIN]))
    return found or {name(*w[i : i + 2]) for i in range(len(w))}


def shown(signatures):
    return ",".join(f"{x:X}" for x in sorted(signatures))


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, texts, spark):
    one = docs.dropDuplicates(["doc_id"])
    out = {r.doc_id: r for r in spotsigs.fingerprinted(one).collect()}
    ids = sorted(texts)
    for d, after in zip(ids, ids[1:] + ids[:1], strict=True):
        t, q = texts[d], len(texts[d]) // 4
        assert out[d].n_chars == len(t) and out[d].edited_sha256 == hashlib.sha256((t[: len(t) - q] + texts[after][:q]).encode()).hexdigest()
        edited = t[: len(t) - q] + texts[after][:q]
        own, changed, following = slow_signatures(t), slow_signatures(edited), slow_signatures(texts[after])
        assert out[d].fingerprint == shown(own) and out[d].edited_fingerprint == shown(changed)
        assert out[d].near_edited == pytest.approx(alike(own, changed), abs=1e-12) and out[d].near_next == pytest.approx(alike(own, following), abs=1e-12)
    assert out[1003].fingerprint == out[1004].fingerprint != "" and out[1001].fingerprint == ""
    assert spotsigs.fingerprinted(empty(spark)).count() == 0
    prints = {d: set(r.fingerprint.split(",")) for d, r in out.items() if r.fingerprint}
    least = {}
    for d in sorted(prints):
        least.setdefault(frozenset(prints[d]), d)
    reps = list(least.values())
    want = {(min(a, b), max(a, b)) for a in reps for b in reps if a < b and len(prints[a] & prints[b]) >= 0.8 * len(prints[a] | prints[b])}
    assert {(r.a, r.b) for r in spotsigs.near_copies(one).collect()} == want


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_base(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            digits = re.sub(r"[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), list(BASE).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_pii(docs, texts, spark):
    out = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    for d, t in texts.items():
        want = slow_base(t)
        assert out[d].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(filter(None, out[d].spans.split(",")))
    assert pii.pii_report(empty(spark)).count() == 0 and pii.redacted(docs).columns == docs.columns


def test_pii_keeps_large_ids_and_nulls(spark):
    rows = [(2**60 + 1, "a@b.c", None, 2**60 + 3), (None, None, 4, None), (None, "x", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, k long").coalesce(1)
    assert [(r.doc_id, r.n_email, r.spans, r.scores) for r in pii.pii_report(docs).collect()] == [(2**60 + 1, 1, "email:0:5", "0.90"), (None, 0, "", ""), (None, 0, "", "")]
    assert list(map(tuple, pii.redacted(docs).collect())) == [(2**60 + 1, "[EMAIL]", 7, 2**60 + 3), (None, None, 0, None), (None, "x", 1, 1)]


def test_pii_context_moves_scores():
    score = lambda t: [x for _, x in pii.scored_spans(t)]
    assert score("GB82 WEST 1234 5698 7654 32") == [0.8] and score("account GB82 WEST 1234 5698 7654 32") == [1.0] and score("order GB82 WEST 1234 5698 7654 32") == []
    assert score("card 4111 1111 1111 1111") == [1.0] and score("4111 1111 1111 1111") == [0.8] and score("order 4111 1111 1111 1111") == [0.5]
    assert score("ssn 123-45-6789") == [0.7] and score("123-45-6789") == []


def test_pii_random_texts():
    import random

    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(["1", "25", "4111 1111 1111 1111", "+", ".", "-", " ", "@", "a", "b.c", "é", "("]) for _ in range(rng.randint(0, 25)))
        assert [f"{k}:{a}:{b}" for k, a, b in pii.find_spans(t) if k in pii.BASE] == slow_base(t), t


def test_pii_added_kinds():
    t = "account GB82 WEST 1234 5698 7654 32, call (555) 010 1234, ssn 123-45-6789, no 124-45-6789"
    assert [t[a:b] for _, a, b in pii.find_spans(t)] == ["GB82 WEST 1234 5698 7654 32", "(555) 010 1234", "123-45-6789", "124-45-6789"]
    assert pii.find_spans("GB83 WEST 1234 5698 7654 32 and 555 010 1234") == [] and pii.redact("x a@b.c y", pii.find_spans("x a@b.c y")) == "x [EMAIL] y"


def test_token_files(docs, texts, spark, tmp_path):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    one = docs.dropDuplicates(["doc_id"])
    start, want = 0, set()
    for d in sorted(texts):
        ids = [*tokenizer.encode(texts[d], add_special_tokens=False).ids, 2]
        want.add((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    shards = token_files.write_token_files(one, VOCABULARY, str(tmp_path / "t"), shard_tokens=20_000)
    assert {tuple(r) for r in token_files.read_token_files(shards).collect()} == want
    assert token_files.token_file_digests(empty(spark), VOCABULARY).count() == 0
    with token_files.open_file(shards.orderBy("base").first().path) as f:
        shard = token_files.Shard(f)
        whole = shard.document(0)
        assert len(shard.rules) and shard.tokens(0, 5, 9).tolist() == whole[5:9].tolist()
        assert (token_files.expand(np.arange(shard.first, shard.first + len(shard.rules)), shard.first, shard.rules)).size == int(shard.lengths.sum())


def test_bpe_tree():
    import random

    tree, rng = bpe.TreeBpe(VOCABULARY, leaf=100, window=8), random.Random(1)
    for _ in range(300):
        letters = rng.choice(["abcdefghiklmnop", "aab", "ab'sre", "0123456789ab", "éèüñß漢字かな", "<|endoftext|>x'", "éäo", "!?.,#"])
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, 1500)))
        assert [i for i, *_ in tree.encode_unsplit(t)] == tree.tokenizer.encode(t, add_special_tokens=False).ids


def test_bpe_words_one_character_at_a_time(monkeypatch):
    """Every character that words are cut at here, alone, among letters and beside signs, as the library does; with words remembered and forgotten."""
    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    own, rng = bpe.TreeBpe(VOCABULARY), random.Random(2)
    letters = [c for c in map(chr, range(0x21, 0x250)) if bpe.PLAIN.fullmatch(c)]
    texts = [f"{c} a{c}b\t{c}{c} ,{c}1 '{c}\n {c}s" for c in letters]
    texts += [f"{t} \u4e00" for t in texts]  # one sign that isn't plain sends every word its own way
    texts += [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(20)) for _ in range(300)]
    texts += ["it's IT'S we'll 'tis O'Neil's x'RE", "\u0130stanbul \u212a \ufb01n", "a\u0301b \u1e9e <|endoftext|>x"]
    for n, t in enumerate(texts):
        if n % 90 == 0:
            own._forget_rare()
        assert own.encode(t) == own.tokenizer.encode(t, add_special_tokens=False).ids, t
        assert own.encode_ids(t).tolist() == own.encode(t)


def test_grammar_goes_on_until_nothing_pays():
    rng = np.random.default_rng(4)
    for first, size in ((40, 5000), (70_000, 3000), (5, 4000)):
        parts = [rng.integers(0, first, n) for n in (3, 7, 11)]
        stream = np.concatenate([parts[k] for k in rng.integers(0, 3, size // 5)] + [np.zeros(64, np.int64)]).astype(np.uint32)
        ends = rng.random(len(stream)) < 0.02
        ends[-1] = True
        docs = np.split(stream, np.flatnonzero(ends)[:-1] + 1)
        data = token_files.pack(list(range(len(docs))), docs, first)
        shard = token_files.Shard(io.BytesIO(data))
        assert all(shard.document(k).tolist() == d.tolist() for k, d in enumerate(docs)) and shard.above == max(0, int(first + len(shard.rules) - 1).bit_length() - 16)
        symbols = shard.symbols(0, len(docs)).astype(np.int64)
        at = shard.symbols_at.astype(np.int64)
        inside = np.ones(len(symbols) - 1, bool)
        last = at[1:] - 1  # no pair reaches into the last symbol of a document
        inside[[x for x in np.concatenate([last, last - 1]) if 0 <= x < len(inside)]] = False
        pairs = Counter(zip(symbols[:-1][inside].tolist(), symbols[1:][inside].tolist(), strict=True))
        assert all(n < token_files.worth(first) or a == b for (a, b), n in pairs.items())
        k = int(np.argmax(np.diff(shard.tokens_at)))
        whole = docs[k].tolist()
        assert all(shard.tokens(k, a, min(a + 3, len(whole))).tolist() == whole[a : a + 3] for a in range(0, len(whole), 2))


def test_grammar_isnt_stopped_by_a_run():
    """The most frequent pair is that of a run, whose places overlap too much for a rule; the other pairs, which overlap one another, get theirs."""
    first = 40
    assert token_files.worth(first) == 6
    stream = np.array([7] * 11 + [1, 2, 3] * 9 + [0], np.uint32)
    grammar = token_files.Grammar(first)
    symbols, marks = grammar.compress(stream, np.arange(len(stream)) == len(stream) - 1)
    assert len(grammar.rules) and grammar.expand(symbols).tolist() == stream.tolist() and marks.tolist() == [False] * (len(symbols) - 1) + [True]
    pairs = Counter(zip(symbols[:-2].tolist(), symbols[1:-1].tolist(), strict=True))
    assert all(n < 6 or a == b for (a, b), n in pairs.items())


def test_bpe_of_many_texts_at_once(monkeypatch):
    """Texts side by side, nulls, empty ones, slices, special tokens and cut words give what the library gives for each, whatever the stretches are."""
    tokenizer, rng = Tokenizer.from_file(VOCABULARY), random.Random(3)
    parts = ["the", "The", "THERE", "\u00c9l\u00e8ve", "na\u00efve", "\u0100\u012f\u0130", "x\u00d7y", "it's", "'tis", "<|endoftext|>", "a<|", "|>b", "1234", "a1b22", ".,!?", "caf\u00e9-bar", "e\u0301", "\u6f22\u5b57", "\x01", "\x1c", "\u00a0", "w" * 60, "zq" * 30 + "1"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\t  "]) for _ in range(rng.randint(0, 12))) for _ in range(600)] + [None, "", " \n", None, "end"]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for stretch, together in ((1, 1), (64, 256), (1 << 22, 1)):
        monkeypatch.setattr(bpe, "STRETCH", stretch)
        monkeypatch.setattr(bpe, "TOGETHER", together)
        tree = bpe.TreeBpe(VOCABULARY)
        assert tree.merges is not None
        for a, b in ((0, len(texts)), (17, 40), (len(texts) - 5, len(texts)), (5, 5)):
            ids, ends = tree.encode_texts(pa.array(texts, pa.string()).slice(a, b - a))
            assert [x.tolist() for x in np.split(ids, ends)[:-1]] == want[a:b] and len(ends) == b - a


def test_merges_of_many_runs():
    """Merges are applied run by run as the library applies them, also where one pair occurs again and again."""
    tree, rng = bpe.TreeBpe(VOCABULARY), random.Random(5)
    runs = [("".join(rng.choice(letters) for _ in range(rng.randint(1, 48)))) for letters in ("ab", "ehnrst", "abcdefghijklmnopqrstuvwxyz", ".,!?#", "e\u00e9\u00fc") for _ in range(300)]
    ids, size = tree.merges.encode([r.encode() for r in runs])
    assert [x.tolist() for x in np.split(ids, np.cumsum(size))[:-1]] == [[t.id for t in tree.tokenizer.model.tokenize(r.translate(bpe.SHOWN))] for r in runs]


class Mapped:
    """Stands for a DataFrame: mapInArrow gives the function that a task would call."""

    def __init__(self, schema):
        self.schema, self.columns = schema, schema.names

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_batches_are_worked_on_in_parts(docs, monkeypatch):
    rows = docs.select("doc_id", "text")
    frame, table = Mapped(rows.schema), rows.toArrow().combine_chunks()
    whole = table.to_batches()[0]
    size = dict(enumerate(len((t or "").encode()) for t in table["text"].to_pylist()[3:]))
    for run in (bpe.encode_documents(frame, VOCABULARY), bpe.round_trip_digests(frame, VOCABULARY), pii.redacted(frame)):
        monkeypatch.setattr(common, "PART", 1 << 40)
        (at_once,) = run(iter([whole.slice(3)]))
        monkeypatch.setattr(common, "PART", 5000)
        out = list(run(iter([whole.slice(3), whole.slice(0, 0)])))
        assert pa.Table.from_batches(out) == pa.Table.from_batches([at_once]) and at_once.num_rows == len(size)
        at = 0
        for part in out[:-1]:
            assert sum(size[n] for n in range(at + 1, at + part.num_rows)) <= 5000
            at += part.num_rows
        assert out[-1].num_rows == 0 and len(out) > 20


def test_bpe(docs, texts, spark):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    extra = [(-1, "Ünïcode x İstanbul \u001c a<|endoftext|>b ΣΑΣ it's 12 é")]
    out = {r.doc_id: r for r in bpe.round_trip_digests(docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")), VOCABULARY).collect()}
    for d, t in (texts | dict(extra)).items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (out[d].n_tokens, out[d].ids_sha256, out[d].decoded_sha256) == want
    assert bpe.round_trip_digests(empty(spark), VOCABULARY).count() == 0


def test_mixing(docs, spark):
    out = mixing.mixed(docs, weights={"src1": 3, "src2": 1})
    assert {r.source for r in out.select("source").distinct().collect()} <= {"src1", "src2"} and set(docs.columns) < set(out.columns)
    again = mixing.mixed(docs.repartition(3), weights={"src1": 3, "src2": 1})
    assert sorted(map(str, out.select("doc_id", "copy").collect())) == sorted(map(str, again.select("doc_id", "copy").collect()))
    many = spark.range(20_000).selectExpr("id as doc_id", "'x' as text", "if(id % 2 = 0, 'a', null) as source")
    counts = Counter((r.doc_id, r.source) for r in mixing.mixed(many, repetition=2.0, weights={"a": 3, "null": 1}).collect())
    a = [counts[i, "a"] for i in range(0, 20_000, 2)]
    assert abs(np.mean(a) - 3) < 0.1 and abs(np.var(a) - 3) < 0.25
    assert mixing.mixed(empty(spark)).count() == 0


def test_mixing_of_large_rates(spark, monkeypatch):
    """A rate too large for one table of probabilities is drawn in parts; copies come in blocks and are numbered through."""
    monkeypatch.setattr(mixing, "BLOCK", 256)
    rows = [(k, "x" * 400_000 if k < 1 else "y", "big" if k < 1 else "tiny") for k in range(201)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights={"big": 1, "tiny": 3})
    counts = {r.doc_id: (r.n, r.least, r.most, r.kinds) for r in out.where("source = 'tiny'").groupBy("doc_id").agg(*[F.expr(x) for x in ("count(*) n", "min(copy) least", "max(copy) most", "count(distinct copy) kinds")]).collect()}
    rate = 400_200 * 0.75 / 200
    n = np.array([c[0] for c in counts.values()])
    assert len(counts) == 200 and all((0, c[0] - 1, c[0]) == c[1:] for c in counts.values())
    assert abs(n.mean() - rate) < 4 * (rate / 200) ** 0.5 and 0.7 < n.var() / rate < 1.4


def slow_repeats(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        t = texts[d].encode()
        own = [t[i : i + 50] for i in range(len(t) - 49)]
        gone = [False] * len(t)
        for i, s in enumerate(own):
            if s in seen:
                gone[i : i + 50] = [True] * 50
        seen.update(own)
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[d] = len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()
    return out


def test_repeats(docs, texts, spark):
    assert {r.doc_id: tuple(r)[1:] for r in repeats.without_repeats(docs.dropDuplicates(["doc_id"])).collect()} == slow_repeats(texts)
    assert repeats.without_repeats(empty(spark)).count() == 0


def test_difference_cover():
    """Two equal strings have a sampled position the same number of bytes in, wherever they start."""
    sampled = [{k for k in range(repeats.PERIOD) if (i + k) % repeats.PERIOD in repeats.COVER} for i in range(repeats.PERIOD)]
    assert all(a & b for a in sampled for b in sampled)
    values = np.array([0, 1, 255, 256, 2**40], np.int64)
    assert (repeats.unpacked(repeats.packed(values), np.int64) == values).all()


@pytest.mark.parametrize("packed", [64, 1 << 20])
def test_repeats_shifted_copies(spark, monkeypatch, packed):
    """Passages of 49 bytes and more, shifted, overlapping, edited and very frequent, packed in few and many parts."""
    monkeypatch.setattr(repeats, "PACKED", packed)
    draw = random.Random(9)
    text = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    passages, common = [text(n) for n in (40, 45, 60, 120, 300)], text(70)
    rows = {k: text(draw.randrange(90)) + draw.choice(passages)[draw.randrange(12) :] + text(draw.randrange(40)) + common[draw.randrange(20) :] + draw.choice(passages) for k in range(60)}
    rows |= {60: "x" * 49, 61: "x" * 50, 62: "x" * 81, 63: "y" + "x" * 51, 64: passages[4][:150] + "!" + passages[4][151:], 65: None, 66: ""}
    out = repeats.without_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == slow_repeats({k: v or "" for k, v in rows.items()})


def test_repeats_edges(spark):
    import random

    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = {}
    for i in range(80):
        a, b = sorted((rng.randint(0, 90), rng.randint(0, 90)))
        rows[i] = "".join(rng.choice("ijklm") for _ in range(rng.randint(0, 30))) + passage[a:b] + "z" * rng.choice([0, 49, 50, 51, 120]) + passage[: rng.randint(0, 90)]
    out = repeats.without_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == slow_repeats(rows)


def test_chat(spark):
    rows = [(1, 0, "user", "a<|im_end|>\n"), (1, 1, "assistant", "<\\|x|>"), (1, 1, "assistant", None), (2, 0, None, ""), (None, 0, "system", "q"), (3, 2, "us\ner", "<|"), (3, 1, "assistant", "b<")]
    out = {r.conv_id: r for r in chat.chat_digests(chat.with_hostile(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    groups = defaultdict(list)
    for c, o, r, t in rows + [(-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)]:
        groups[c].append((o, r or "", t or ""))
    for c, turns in groups.items():
        turns = sorted(turns)
        said = "".join(t for _, r, t in turns if r == "assistant")
        want = len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()
        assert tuple(out[c])[1:5] == want
    one, two = (spark.createDataFrame([(2**60 + 1, 0, r, "t"), (None, 0, r, "t")], "conv_id long, turn long, role string, text string") for r in ("us\ner", "us er"))
    one, two = ({r.conv_id: r.turns_sha256 for r in chat.chat_digests(x).collect()} for x in (one, two))
    assert set(one) == {2**60 + 1, None} and one[None] != two[None]
    segments = chat.formatted_chats(spark.createDataFrame([(1, 0, "user", "q|" * 50_000), (1, 1, "assistant", "a<|im_end|>" * 20_000)], "conv_id long, turn long, role string, text string")).orderBy("segment").collect()
    assert len(segments) > 3 and chat.unescape("".join(s.text for s in segments if s.learned)) == "a<|im_end|>" * 20_000
    assert chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_template_language():
    render = chat.compile_template("{% set x = 'a' + \"b\" %}{{ x|upper }}{% if 1 == 1 %}y{% else %}{{ never }}{% endif %}{% for m in messages %}{{ m['t'] }}{% generation %}!{% endgeneration %}{% endfor %}")
    assert list(render([{"t": "p"}])) == [("AB", False), ("y", False), ("p", False), ("!", True)]
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if false %}q{% endif %}")) == (chat.Emit(chat.Const("abc")),)
    for bad in ("{% for x %}", "{{ x|eval }}", "{{ f() }}", "{% if x %}", "{{ 'a' b }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    with pytest.raises(chat.TemplateError):
        list(chat.compile_template("{{ messages.__class__ }}")([]))


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    step = documents
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, step, SF)
        assert after.columns == documents.columns, name
        step = after.cache()
    ids = {r.doc_id for r in step.select("doc_id").collect()}
    assert out.columns == ["doc_id", "ids", "n_tokens"] and {r.doc_id for r in out.select("doc_id").distinct().collect()} <= ids
    assert not any(r.n_email for r in pii.pii_report(step).collect())


def slow_quality(spark, rows, docs, labels):
    learned = rules.learn(docs, labels)
    shares = {r.doc_id: r for r in rules.features(docs).collect()}
    met = lambda r, c: r[c.feature] is not None and (r[c.feature] > c.threshold if c.above else r[c.feature] <= c.threshold)
    out = []
    for r in rows:
        w = WORDS.findall(r.text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w) and not any(all(met(shares[r.doc_id], c) for c in rule.conditions) for rule in learned):
            out.append(tuple(r))
    return out


def slow_near_duplicates(rows):
    sets, group = {}, {r.doc_id: r.doc_id for r in rows}
    for r in rows:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                x, y = sorted((group[a], group[b]))
                group = {d: x if g == y else g for d, g in group.items()}
    return [tuple(r) for r in rows if group[r.doc_id] == r.doc_id]


def slow_mixture(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += max(len(r.text), 1)
    weight = {s: n**mixing.TEMPERATURE for s, n in sizes.items()}
    out = []
    for r in rows:
        rate = sum(sizes.values()) * weight[r.source] / sum(weight.values()) / sizes[r.source]
        u = (int(hashlib.sha256(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out += [tuple(r)] * k
    return out


def test_pipeline_stages_keep_and_give_exactly_what_they_should(spark):
    """Every stage's rows, and those of the whole chain, against plain Python over the rows of the stage before."""
    import corpus_pipeline

    tokenizer = Tokenizer.from_file(VOCABULARY)
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plain = {
        "quality": lambda rows: slow_quality(spark, rows, documents, labels),
        "near_duplicates": slow_near_duplicates,
        "personal_data": lambda rows: [(r.doc_id, t := pii.redact(r.text, pii.find_spans(r.text)), r.lang, r.source, len(t)) for r in rows],
        "mixture": slow_mixture,
        "tokens": lambda rows: [(r.doc_id, ids := tokenizer.encode(r.text, add_special_tokens=False).ids, len(ids)) for r in rows],
    }
    assert [name for name, _ in corpus_pipeline.STAGES] == list(plain) and documents.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    step, rows, kept = documents, documents.collect(), []
    for name, stage in corpus_pipeline.STAGES:
        want = sorted(plain[name](rows))
        step = mixing.written(stage(spark, step, SF), name)
        rows = step.collect()
        assert sorted(map(tuple, rows)) == want, name
        kept.append(len(rows))
    assert len(documents.collect()) > kept[0] > kept[1] == kept[2] and kept[3] == kept[4] > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_worth_of_a_rule():
    """A pair gets a rule from that count on: what it saves is half as much again as two symbols and a length."""
    for first in (5, 40_000, 70_000, 1 << 20):
        n, symbol = token_files.worth(first), max(16, first.bit_length()) / 8
        assert n * symbol >= 1.5 * (2 * symbol + token_files.RULE_BYTES) > (n - 1) * symbol


CLASHING = ("u", "copies", "copy", "source_key", "shuffle_key", "row", "rate", "id", "n_words", "kept", "rule", "base_failed", "_document", "_text", "cumulative")


def test_clashing_names_through_rules_and_mixing(spark):
    """Columns named like those that the operators make come back as they were."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    own = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in CLASHING])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = rules.kept_documents(own, labels)
    assert found.columns == own.columns and {r.doc_id for r in found.collect()} == {r.doc_id for r in rules.judged(docs, labels).where("kept").collect()}
    assert all(r[c] == f"{c}-{r.doc_id}" for r in found.collect() for c in CLASHING)
    assert rules.judged(own, labels, keep=["n_words", "u"]).columns == ["doc_id", "u", *rules.RESULT[1:]]
    plain, mine = mixing.mixed(docs), mixing.mixed(own)
    assert sorted((r.doc_id, r.copy, r.shuffle_key) for r in plain.collect()) == sorted((r.doc_id, r.copy, r.shuffle_key) for r in mine.collect())
    assert all(r[c] == f"{c}-{r.doc_id}" for r in mine.collect() for c in CLASHING if c not in ("copy", "shuffle_key"))
    assert sorted(map(str, mixing.mixed(own, numbered=False).collect())) == sorted(str(r) for r in own.collect() for _ in range(sum(x.doc_id == r.doc_id for x in plain.collect())))


def test_mixing_of_null_and_repeated_ids(spark):
    """Rows of one id share a draw, a null id counts as the text null; both as plain Python draws them."""
    from pyspark.sql import Row

    rows = [Row(doc_id=k % 7 if k % 5 else None, text="x" * (1 + k % 9) if k % 4 else None, source=["a", "b", None][k % 3]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights, sizes = {}, Counter()
    for r in rows:
        sizes[r.source or "null"] += max(len(r.text or ""), 1)
    weights = {s: n**mixing.TEMPERATURE for s, n in sizes.items()}
    want = Counter()
    for r in rows:
        s = r.source or "null"
        rate = 3.0 * sum(sizes.values()) * weights[s] / sum(weights.values()) / sizes[s]
        u = (int(hashlib.sha256(f"{mixing.SEED}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k, p = k + 1, p * rate / (k + 1)
            c += p
        for n in range(k):
            want[r.doc_id, r.text, r.source, n] += 1
    assert Counter((r.doc_id, r.text, r.source, r.copy) for r in mixing.mixed(docs, repetition=3.0).collect()) == want


def test_time_grows_with_the_length_of_a_text():
    """Many spans in one text, and a turn over many segments: twice as much takes about twice as long, not four times."""
    import time

    def seconds(f):
        took = []
        for _ in range(3):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    spans = lambda n: "mail a@b.cd call +49 30 1234567 ssn 123-45-6789 " * n
    small, large = (seconds(lambda n=n: pii.scored_spans(spans(n))) for n in (1500, 6000))
    assert large < 8 * small
    turn = lambda n: [(chat.START + "user\n", False), *[("x" * 65536, False)] * n, (chat.END + "\n", False)]
    small, large = (seconds(lambda n=n: list(chat.read_chat(turn(n)))) for n in (400, 1600))
    assert large < 8 * small
    assert [t for _, t, _ in chat.read_chat([(chat.START + "user\nab" + chat.END[:4], False), (chat.END[4:], True), ("\n" + chat.START + "x\ny", False), (chat.END, False), ("\n", False)])] == ["ab", "y"]
