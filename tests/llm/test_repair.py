"""Conversation repair against plain searches over edits."""

import hashlib
import random
import re
import zlib

import pytest

from postlark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, digest string, n long"
GOOD = re.compile(r"(s?(ua)+)?")


def edits(rows):
    """All edits of rows (role, text, must be deleted, truncated) with at most two insertions at a place, by exhaustion."""
    out = [(0, "", ())]
    for k in range(len(rows) + 1):
        out = [(c + 5 * len(i), a + "I" * len(i), r + i) for c, a, r in out for i in [(), ("user:",), ("assistant:",), ("user:", "assistant:"), ("assistant:", "user:")]]
        if k < len(rows):
            role, text, must, cut = rows[k]
            choices = [(2, "D", ())] + ([] if must else [(5 * cut, "K", (f"{role}:{text}",)), *((1 + 5 * cut, "R", (f"{x}:{text}",)) for x in ("user", "assistant"))])
            out = [(c + d, a + e, r + x) for c, a, r in out for d, e, x in choices]
    return min((c, a, r) for c, a, r in out if GOOD.fullmatch("".join(x[0] for x in r)))


def scan(rows):
    """The same by a table over prefixes, for long conversations."""
    ways = {"": (0, "", ())}
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(ways):
        best = dict(ways)
        for _ in range(3):
            for state, (c, a, r) in list(best.items()):
                for x in set(after[state]) - {"s"}:
                    best[x] = min(best.get(x, (10**9, "", ())), (c + 5, a + "I", (*r, {"u": "user:", "a": "assistant:"}[x])))
        return best

    for role, text, must, cut in rows:
        new = {}
        for state, (c, a, r) in inserted(ways).items():
            options = [(state, (c + 2, a + "D", r))]
            if not must:
                for x in after[state]:
                    full = {"u": "user", "a": "assistant"}.get(x)
                    if role[:1] == x:
                        options.append((x, (c + 5 * cut, a + "K", (*r, f"{role}:{text}"))))
                    if full:
                        options.append((x, (c + 5 * cut + 1, a + "R", (*r, f"{full}:{text}"))))
            for x, way in options:
                new[x] = min(new.get(x, (10**9, "", ())), way)
        ways = new
    return min(way for state, way in inserted(ways).items() if state in ("", "a"))


def expected(rows, search):
    """The report on (turn, role, text) of one conversation."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(r[2].encode()).hexdigest()))
    faults, seen, counts = [], set(), [0, 0, 0]
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        faults.append((role, text, fault in (0, 1), fault == 2))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, out = search(faults)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def of(spark, rows):
    return spark.createDataFrame([(*r, "mine", 7) for r in rows], SCHEMA)


def test_short_conversations_against_all_edits(spark):
    draw = random.Random(13)
    rows = {}
    for conv in range(150):
        size = draw.randrange(1, 4)
        rows[conv] = [(draw.choice([None, k, k, k, 0, 2]), draw.choice(["user", "assistant", "system", "tool", None, "user", "assistant"]), draw.choice(["Yes.", "no", "Ok! \n", "", " \t", None, f"t{k}.", f"t{k}"])) for k in range(size)]
    rows[None] = [(1, "assistant", "a."), (0, "user", "q?")]
    out = repair.repair_report(of(spark, [(c, *r) for c, x in rows.items() for r in x]))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    assert found == {c: expected(x, edits) for c, x in rows.items()} == {c: expected(x, scan) for c, x in rows.items()}


@pytest.mark.parametrize("small", [True, False])
def test_long_conversations_over_many_ranges(spark, monkeypatch, small):
    """One conversation with most rows, others beside it; ranges, reads and rounds of the tree are small once."""
    if small:
        monkeypatch.setattr(repair, "READ", 7)
        monkeypatch.setattr(repair, "TOGETHER", 2)
    draw = random.Random(14)
    rows = {c: [(draw.randrange(600) if draw.random() < 0.97 else None, draw.choice(["user", "assistant", "system", "x"]), draw.choice(["Same.", "", f"text {draw.randrange(900)}", f"text {draw.randrange(900)}."])) for _ in range(n)] for c, n in enumerate([1500, 3, 40, 1])}
    rows[4] = [(5, "user", "the same.")] * 300 + [(6, "user", "ümlaut 🙂" * 30), (7, "assistant", "z" * 100_000)]
    table = of(spark, [(c, *r) for c, x in rows.items() for r in x]).repartition(5)
    # without adaptive coalescing one conversation lies in several ranges
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(table).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {c: expected(x, scan) for c, x in rows.items()}
    turns = [r for r in repair.repaired_turns(table).collect() if r.conv_id == 2]
    assert sorted(r.place for r in turns) == list(range(len(turns)))
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in sorted(turns, key=lambda r: r.place)).encode()).hexdigest() == found[2][-1]


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in [(0, "user", "A? b."), (1, "assistant", None), (None, None, "C!")]] + [(None, 3, "user", "q.")]
    want = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r if r is not None else " ", x if x is not None else " "
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        want += [(c, t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, repair.damaged(of(spark, rows)).collect()), key=key) == sorted(want, key=key)
    only = of(spark, [(9, None, "user", "x")])
    assert [tuple(r) for r in repair.repair_report(only.limit(0), only).collect()] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_report(only.limit(0)).count() == 0 and repair.repaired_turns(only.limit(0)).count() == 0
    far = of(spark, [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")])
    assert [r.gaps for r in repair.repair_report(far).collect()] == [2**63 - 1]


def test_product_is_associative():
    draw = random.Random(15)
    for _ in range(200):
        kinds = "".join(draw.choice("suaxSUAXd") for _ in range(9))
        a, b = sorted((draw.randrange(1, 9), draw.randrange(1, 9)))
        parts = [p for p in (kinds[:a], kinds[a:b], kinds[b:]) if p]
        left, right = repair.product(parts[0]), repair.product(parts[-1])
        for p in parts[1:]:
            left = repair.times(left, repair.product(p))
        for p in reversed(parts[:-1]):
            right = repair.times(repair.product(p), right)
        assert left == right == repair.product(kinds)
