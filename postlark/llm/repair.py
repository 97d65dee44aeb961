"""Repair of the structure of conversations: a scan of min-plus matrices.

A repaired conversation's roles are ``(system? (user assistant)+)?``. The states that a reading of it goes
through are: nothing read yet, the system turn read, a user turn read, an assistant turn read. Each turn is
a 4x4 matrix: its entry [i][j] is the cheapest way to come from state i to state j over that turn, as a pair of
the cost and the audit, the letters of the edits. Pairs are added up in cost and strung together in audit; of
two, the cheaper one counts, or the one with the least audit. Turns that are inserted are a closure, taken in
before each turn and once more at the end.

The product of matrices is associative: letters determine costs, so no audit of a stretch of turns is the
beginning of another one of equal cost, and the order of audits survives stringing together. So a
conversation may be cut anywhere. Turns are dealt by ranges of their order, one long conversation over
many tasks; each task multiplies its stretches, and stretches of a conversation are multiplied in a tree.
Texts don't take part in that: turns are compared and ordered by digests and first characters, and texts
are shuffled once, when the edits are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What edits cost, and what a truncated turn that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Characters that count as blank, and those that end a turn.
BLANK, ENDS = " \t\n\x0b\f\r", ".!?"
#: First characters of a text by which turns of equal place and role are ordered before its digest.
HEAD = 32
#: Stretches of a conversation that are multiplied together in a round.
TOGETHER = 32

Entry = tuple[int, str] | None
Matrix = tuple[tuple[Entry, ...], ...]
_STATES = range(4)
_NOTHING, _SYSTEM, _USER, _ASSISTANT = _STATES
#: The states from which each role may be read, and the state after it.
_READS = {"s": ((_NOTHING,), _SYSTEM), "u": ((_NOTHING, _SYSTEM, _ASSISTANT), _USER), "a": ((_USER,), _ASSISTANT)}


def _least(entries: list[Entry]) -> Entry:
    return min((e for e in entries if e is not None), default=None)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product of two matrices of (cost, audit)."""
    join = lambda x, y: (x[0] + y[0], x[1] + y[1]) if x is not None and y is not None else None
    return tuple(tuple(_least([join(a[i][k], b[k][j]) for k in _STATES]) for j in _STATES) for i in _STATES)


def _matrix(steps: list[tuple[int, int, int, str]]) -> Matrix:
    """The matrix of (from, to, cost, letter)."""
    return tuple(tuple(_least([(cost, edit) for f, t, cost, edit in steps if (f, t) == (i, j)]) for j in _STATES) for i in _STATES)


def _closure() -> Matrix:
    """No insertion, or any number of them: paths longer than the number of states go round in circles."""
    step = _matrix([(f, to, INSERT, "I") for role in "ua" for before, to in [_READS[role]] for f in before])
    stay = _matrix([(i, i, 0, "") for i in _STATES])
    once = tuple(tuple(_least([stay[i][j], step[i][j]]) for j in _STATES) for i in _STATES)
    out = stay
    for _ in _STATES:
        out = times(out, once)
    return out


CLOSURE = _closure()


@lru_cache
def turn_matrix(kind: str) -> Matrix:
    """The matrix of one turn with the insertions before it.

    A kind is ``d`` for a turn that has to be deleted, else the role's first letter (``x`` for one that no
    conversation may have), in upper case if the turn is truncated.
    """
    steps = [(i, i, DELETE, "D") for i in _STATES]
    if kind != "d":
        more = TRUNCATED if kind.isupper() else 0
        for letter, (before, to) in _READS.items():
            if letter == kind.lower():
                steps += [(f, to, more, "K") for f in before]
            if letter != "s":
                steps += [(f, to, more + REROLE, "R") for f in before]
    return times(CLOSURE, _matrix(steps))


def product(kinds: str) -> Matrix:
    """The product of the matrices of some turns, as a tree; short stretches are remembered."""
    if len(kinds) <= 16:
        return _short(kinds)
    half = len(kinds) // 2
    return times(product(kinds[:half]), product(kinds[half:]))


@lru_cache(1 << 16)
def _short(kinds: str) -> Matrix:
    if len(kinds) == 1:
        return turn_matrix(kinds)
    half = len(kinds) // 2
    return times(_short(kinds[:half]), _short(kinds[half:]))


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """(cost, audit) of a whole conversation: from nothing to nothing, or to an assistant turn."""
    closed = times(matrix, CLOSURE)
    return _least([closed[_NOTHING][_NOTHING], closed[_NOTHING][_ASSISTANT]])


# -- stretches of a conversation ------------------------------------------------------------------

_LEGAL = {"su", "ua", "au"}


class Stretch(NamedTuple):
    """What is known of neighbouring turns of a conversation; least and most are the turns' numbers, where any has one."""

    least: int | None
    most: int | None
    distinct: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str
    last: str
    matrix: Matrix


def joined(a: Stretch, b: Stretch) -> Stretch:
    """Two stretches, one behind the other."""
    numbers = [x for x in (a.least, a.most, b.least, b.most) if x is not None]
    shared = int(a.most is not None and a.most == b.least)
    return Stretch(
        min(numbers, default=None), max(numbers, default=None), a.distinct + b.distinct - shared,
        a.blank + b.blank, a.duplicate + b.duplicate, a.truncated + b.truncated,
        a.illegal + b.illegal + (a.last + b.first not in _LEGAL), a.first, b.last, times(a.matrix, b.matrix),
    )


def in_tree(stretches: list[Stretch]) -> Stretch:
    while len(stretches) > 1:
        stretches = [joined(*stretches[i : i + 2]) if i + 1 < len(stretches) else stretches[i] for i in range(0, len(stretches), 2)]
    return stretches[0]


# -- turns as columns -----------------------------------------------------------------------------

#: The order of turns, and what tells them apart.
_CONV = ["has_conv", "conv"]
_PLACE = ["has_turn", "turn", "role", "head", "digest"]


def _turns(rows: DataFrame) -> DataFrame:
    """The turns with the columns of their order; nulls in role and text count as one space."""
    return rows.select(
        F.col("conv_id").isNotNull().alias("has_conv"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).select(*_CONV, "has_turn", "turn", "role", F.substring("text", 1, HEAD).alias("head"), F.md5("text").alias("digest"), "text")


def _judged(rows: DataFrame) -> DataFrame:
    """One row for each different turn: its order, how often it occurs, the role's initial, and the first's fault."""
    body = F.rtrim("text", F.lit(BLANK))
    initial = F.substring("role", 1, 1)
    fault = F.when(body == "", "b").when(~F.substring(body, -1, 1).isin(*ENDS), "t").otherwise("")
    turns = _turns(rows).select(*_CONV, *_PLACE, F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault.alias("fault"))
    some = turns.groupBy(*_CONV, *_PLACE, "initial", "fault").agg(F.count("*").alias("n"))
    # the least place of each role and text; the keys are unique on both sides, so no key is hot in the join
    earliest = some.groupBy(*_CONV, "role", "head", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("e"))
    earliest = earliest.select(*_CONV, "e.has_turn", "e.turn", "role", "head", "digest", F.lit(True).alias("new"))
    return some.join(earliest, [*_CONV, *_PLACE], "left").withColumn("new", F.coalesce("new", F.lit(False)))


_COUNTS = "least long, most long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string"
_STRETCH = f"has_conv boolean, conv long, has_turn boolean, turn long, role string, head string, digest string, whole boolean, {_COUNTS}, costs array<long>, audits array<string>"
_FIELDS = [f.split()[0] for f in _STRETCH.split(", ")]


def _packed(whole: bool, s: Stretch) -> tuple:
    """A stretch as columns. A whole conversation keeps only its result."""
    entries = [cheapest(s.matrix)] if whole else [e or (None, None) for row in s.matrix for e in row]
    return (whole, *s[:-1], [e[0] for e in entries], [e[1] for e in entries])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_FIELDS)
    return out.astype({"least": "Int64", "most": "Int64"})


def _unpacked(row) -> Stretch:
    entries = [None if pd.isna(c) else (int(c), a) for c, a in zip(row.costs, row.audits, strict=True)]
    number = lambda x: None if pd.isna(x) else int(x)
    return Stretch(number(row.least), number(row.most), *(int(x) for x in row[_FIELDS.index("distinct") : _FIELDS.index("first")]), row.first, row.last, tuple(tuple(entries[4 * i : 4 * i + 4]) for i in _STATES))


def _stretch(turns: list[tuple]) -> Stretch:
    """The stretch of (has_turn, turn, initial, fault, n, new); of equal turns all but the first of all are blank or duplicates."""
    kinds, initials, numbers = [], [], []
    blank = duplicate = truncated = 0
    for has_turn, turn, initial, fault, n, new in turns:
        again = n - bool(new)
        if fault == "b":
            blank += n
            kinds.append("d" * n)
        else:
            duplicate += again
            if new:
                truncated += fault == "t"
                kinds.append(initial.upper() if fault == "t" else initial)
            kinds.append("d" * again)
        initials.append(initial * n)
        if has_turn and (not numbers or numbers[-1] != turn):
            numbers.append(turn)
    roles = "".join(initials)
    illegal = sum(roles[i : i + 2] not in _LEGAL for i in range(len(roles) - 1))
    return Stretch(*((numbers[0], numbers[-1]) if numbers else (None, None)), len(numbers), blank, duplicate, truncated, illegal, roles[0], roles[-1], product("".join(kinds)))


#: Different turns of a stretch that a task reads before it multiplies them.
READ = 1 << 12


def _stretches(judged: DataFrame) -> DataFrame:
    """One stretch for each conversation and range of the order; a conversation that a range has whole is finished there."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, place, held, done, first_of_task, out = None, None, [], [], True, []

        def stretch() -> Stretch:
            return in_tree([*done, *([_stretch(held)] if held else [])])

        for frame in frames:
            for has_conv, conv, has_turn, turn, role, head, digest, initial, fault, n, new in frame.itertuples(index=False, name=None):
                if (has_conv, conv) != key:
                    if key is not None:
                        # what comes first in a range may have begun in the one before
                        out.append((*key, *place, *_packed(not first_of_task, stretch())))
                        first_of_task = False
                    key, place, held, done = (has_conv, conv), (has_turn, turn, role, head, digest), [], []
                held.append((has_turn, turn, initial, fault, n, new))
                if len(held) >= READ:
                    done, held = [in_tree([*done, _stretch(held)])], []
            if len(out) >= READ:
                yield _frame(out)
                out = []
        if key is not None:
            out.append((*key, *place, *_packed(False, stretch())))
        yield _frame(out)

    columns = [*_CONV, *_PLACE, "initial", "fault", "n", "new"]
    return judged.repartitionByRange(*_CONV, *_PLACE).sortWithinPartitions(*_CONV, *_PLACE).select(*columns).mapInPandas(fold, _STRETCH)


def _multiplied(stretches: DataFrame, whole: bool) -> DataFrame:
    """Stretches of each conversation and group, in their order, as one."""

    def multiply(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")[_FIELDS]
        rows = list(frame.itertuples(index=False))
        return _frame([(*rows[0][: len(_CONV) + len(_PLACE)], *_packed(whole, in_tree([_unpacked(r) for r in rows])))])

    return stretches.groupBy(*_CONV, "group").applyInPandas(multiply, _STRETCH)


def _verdicts(rows: DataFrame) -> DataFrame:
    """(has_conv, conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has turns."""
    stretches = written(_stretches(_judged(rows)), "stretches")
    order = Window.partitionBy(*_CONV).orderBy(*_PLACE)
    parts = stretches.where("not whole")
    rounds, most = 1, parts.groupBy(*_CONV).count().agg(F.max("count")).first()[0] or 0
    while TOGETHER**rounds < most:
        rounds += 1
    for k in range(rounds):
        numbered = parts.withColumn("at", F.row_number().over(order))
        parts = _multiplied(numbered.withColumn("group", F.floor((F.col("at") - 1) / TOGETHER)), k == rounds - 1)
    # the span of two far numbers is more than a long holds; a gap that large counts as the largest long
    gaps = F.least(F.col("most").cast("decimal(38,0)") - F.col("least") + 1 - F.col("distinct"), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    done = stretches.where("whole").unionByName(parts)
    return done.select(*_CONV, F.when(F.col("least").isNull(), 0).otherwise(gaps).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))


_VERDICT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _read(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Each conversation's verdict and, behind it, its turns in order; a conversation's rows lie in one task, which reads them as they come."""
    every = conversations.select(F.col("conv_id").isNotNull().alias("has_conv"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv")).distinct()
    verdicts = every.join(_verdicts(rows), _CONV, "left").na.fill(0, _VERDICT[:-1]).na.fill("", ["audit"])
    heads = verdicts.select(*_CONV, F.lit(False).alias("is_turn"), *_VERDICT, F.lit(False).alias("has_turn"), F.lit(0).cast("long").alias("turn"), *(F.lit("").alias(c) for c in ("role", "head", "digest", "text")))
    none = [F.lit(0).cast("long").alias(c) for c in _VERDICT[:-1]] + [F.lit("").alias("audit")]
    turns = _turns(rows).select(*_CONV, F.lit(True).alias("is_turn"), *none, *_PLACE, "text")
    order = [*_CONV, "is_turn", *_PLACE]
    return heads.unionByName(turns).repartition(*_CONV).sortWithinPartitions(*order).select(*_CONV, "is_turn", *_VERDICT, "role", "text")


def _edited(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(has_conv, conv, verdict, None, None) where a conversation begins, then (has_conv, conv, None, role, text) of each repaired turn."""
    key, audit, at, turn = None, "", 0, "user"

    def inserted() -> Iterator[tuple]:
        nonlocal at, turn
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield (*key, None, turn, "")
            turn = "assistant" if turn == "user" else "user"

    for frame in frames:
        for has_conv, conv, is_turn, *verdict, role, text in frame.itertuples(index=False, name=None):
            if not is_turn:
                if key is not None:
                    yield from inserted()
                key, audit, at, turn = (has_conv, conv), verdict[-1], 0, "user"
                yield (*key, verdict, None, None)
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "K" and role[:1] == "s":
                yield (*key, None, role, text)
                continue
            yield (*key, None, role if edit == "K" else turn, text)
            turn = "assistant" if turn == "user" else "user"
    if key is not None:
        yield from inserted()


def repaired_turns(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, role, text): the turns of every repaired conversation, numbered from 0; see repair_report."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, out = 0, []
        for has_conv, conv, verdict, role, text in _edited(frames):
            if verdict is not None:
                place = 0
                continue
            out.append((conv if has_conv else None, place, role, text))
            place += 1
            if len(out) >= READ:
                yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text"]).astype({"conv_id": "Int64"})
                out = []
        yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text"]).astype({"conv_id": "Int64"})

    return _read(rows, rows if conversations is None else conversations).mapInPandas(run, "conv_id long, place long, role string, text string")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``rows`` has conv_id, turn, role and text; conversations that only the table ``conversations`` has come
    without faults, costs or edits. Turns come by ``turn``, nulls first, then role, the first 32 characters of the text, and its
    digest; rows that are wholly equal are repeats of one another. A null role or text counts as one space; rows
    with a null conv_id are a conversation of their own. A role with another initial than s, u, a can't be
    kept, nor can an empty one. Other columns aren't read; an empty table gives an empty result.

    A digest over a whole conversation is one pass over its texts, in one task, which holds the audit and one
    batch of rows; everything before works on stretches of a conversation.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = [f.split()[0] for f in REPORT.split(", ")]
        head, digest, empty, out = None, None, True, []
        for has_conv, conv, verdict, role, text in _edited(frames):
            if verdict is not None:
                if head is not None:
                    out.append((*head, digest.hexdigest()))
                head, digest, empty = (conv if has_conv else None, *verdict), hashlib.sha256(), True
            else:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            if len(out) >= READ:
                yield pd.DataFrame(out, columns=fields).astype({"conv_id": "Int64"})
                out = []
        if head is not None:
            out.append((*head, digest.hexdigest()))
        yield pd.DataFrame(out, columns=fields).astype({"conv_id": "Int64"})

    return _read(rows, rows if conversations is None else conversations).mapInPandas(run, REPORT)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after one damage at most a row, drawn by the checksum of conv_id and turn; nulls are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(name("conv_id"), F.lit(":"), name("turn"))
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("draw"))
    drawn: Column = F.col("draw")
    text = F.when(drawn == 1, "").when(drawn == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(drawn == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(drawn == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(drawn != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _sql() -> str:
    """The same by a recursion over turns that carries the cheapest way to each state."""
    far = 1_000_000_000

    def step(v: str, cost: str, edit: str, add: str = "''") -> str:
        return f"{{'c': {v}.c + {cost}, 'a': {v}.a || {edit}, 'r': {v}.r || {add}}}"

    least = lambda *x: f"list_min([{', '.join(x)}])"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    to_user = least("v2", *(step(v, INSERT, "'I'", user) for v in ("v0", "v1", "v3")))
    to_assistant = least("v3", step("v2", INSERT, "'I'", assistant), *(step(v, 2 * INSERT, "'II'", f"{user} || {assistant}") for v in ("v0", "v1")))
    kept = lambda role: f"chr(10) || (CASE WHEN d.initial = '{role[0]}' THEN d.role ELSE '{role}' END) || ':' || d.text"
    cost = lambda role: f"(CASE WHEN d.must THEN {far} ELSE d.more END + CASE WHEN d.initial = '{role[0]}' THEN 0 ELSE {REROLE} END)"
    edit = lambda role: f"(CASE WHEN d.initial = '{role[0]}' THEN 'K' ELSE 'R' END)"
    gone = lambda v: step(v, DELETE, "'D'")
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS codes FROM conversations),
drawn AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, codes), lambda crc, code: list_reduce(list_prepend(xor(crc, code), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
         lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS draw FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE draw <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, rtrim(text, {blank}) AS body, left(role, 1) AS initial FROM damaged),
faults AS (
  SELECT *, body = '' AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS is_again, right(body, 1) NOT IN ('.', '!', '?') AS is_cut,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before, count(*) OVER (PARTITION BY conv_id) AS turns FROM placed),
d AS (
  SELECT conv_id, pos, turns, turn, role, text, initial, is_blank OR is_again AS must, CASE WHEN is_cut THEN {TRUNCATED} ELSE 0 END AS more, is_blank,
         NOT is_blank AND is_again AS is_duplicate, NOT is_blank AND NOT is_again AND is_cut AS is_truncated, before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS is_illegal FROM faults),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(is_blank::INT) AS blank, sum(is_duplicate::INT) AS duplicate, sum(is_truncated::INT) AS truncated, sum(is_illegal::INT) AS illegal
  FROM d GROUP BY conv_id),
read AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS v0, {", ".join(f"{{'c': {far}::BIGINT, 'a': '', 'r': ''}} AS v{i}" for i in (1, 2, 3))} FROM counted
  UNION ALL
  SELECT conv_id, pos, {gone("v0")}, {least(gone("v1"), step("v0", f"CASE WHEN d_initial = 's' AND NOT d_must THEN d_more ELSE {far} END", "'K'", "chr(10) || d_role || ':' || d_text"))},
         {least(gone("v2"), *(step(v, cost("user").replace("d.", "d_"), edit("user").replace("d.", "d_"), kept("user").replace("d.", "d_")) for v in ("v0", "v1", "v3")))},
         {least(gone("v3"), step("v2", cost("assistant").replace("d.", "d_"), edit("assistant").replace("d.", "d_"), kept("assistant").replace("d.", "d_")))}
  FROM (SELECT r.conv_id, d.pos, r.v0, r.v1, {to_user.replace("v0", "r.v0").replace("v1", "r.v1").replace("v2", "r.v2").replace("v3", "r.v3")} AS v2,
               {to_assistant.replace("v0", "r.v0").replace("v1", "r.v1").replace("v2", "r.v2").replace("v3", "r.v3")} AS v3,
               d.initial AS d_initial, d.must AS d_must, d.more AS d_more, d.role AS d_role, d.text AS d_text
        FROM read r JOIN d ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.pos = r.pos + 1)),
ended AS (SELECT conv_id, {least("v0", to_assistant)} AS v FROM read r SEMI JOIN (SELECT DISTINCT conv_id, turns FROM d) t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.turns = r.pos)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.c, 0)::BIGINT AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(substr(v.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) every LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM every.conv_id
"""


REPAIR_SQL = _sql()
