"""Personal data: patterns propose spans, checks confirm them, nearby words adjust the score.

A pattern gives a candidate a starting score. A check of its digits drops it or lets it pass, and a
passed checksum raises the score. Words shortly before it then adjust the score: those of its kind, such
as "phone" or "account", raise it, those of other numbers, such as "order" or "isbn", lower it. A
candidate becomes a span if its score reaches the threshold and no earlier kind covers it. The four
base kinds are spans whenever they are confirmed, whatever their score; the others need a checksum or
context.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_parts

#: A candidate needs this score; a passed checksum adds so much, a context word within so many code points before it as much as it says.
THRESHOLD, CHECKSUM_GAIN, CONTEXT_CHARS, CONTEXT_GAIN, CONTEXT_LOSS = 0.6, 0.4, 48, 0.4, 0.3
BASE = ("email", "ip", "card", "phone")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The checksum of an international bank account number without spaces."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def _card(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and mod97(plain)


def _social(text: str) -> bool:
    """Area, group and serial numbers that are given out."""
    a, g, s = text.split("-")
    return a not in ("000", "666") and a < "900" and g != "00" and s != "0000"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: re.Pattern
    confirms: Callable[[str], bool]
    score: float
    checksum: bool = False
    context: re.Pattern | None = None
    needs: str = ""  # a text without it has no candidate


#: Words of numbers that aren't personal.
AGAINST = re.compile(r"(?i)\b(?:isbn|issn|order|invoice|serial|version|model|part)\b")
#: Digits before a run can't begin a match that the run itself doesn't, so the looks behind only save time.
RULES = (
    Rule("ip", re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), _ip, 0.7, context=re.compile(r"(?i)\b(?:ip|host|server|address)\b"), needs="."),
    Rule("card", re.compile(r"[0-9](?:[ -]?[0-9])+"), _card, 0.4, checksum=True, context=re.compile(r"(?i)\b(?:card|visa|mastercard|karte|tarjeta|carte)\b")),
    Rule("phone", re.compile(r"\+[0-9][ ().0-9-]+[0-9]"), _phone, 0.7, context=re.compile(r"(?i)\b(?:phone|tel|telefon|call|mobile|fax|tél|teléfono)\b"), needs="+"),
    Rule("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban, 0.4, checksum=True, context=re.compile(r"(?i)\b(?:iban|account|konto|cuenta|compte)\b")),
    Rule("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _social, 0.3, context=re.compile(r"(?i)\b(?:ssn|social security)\b"), needs="-"),
    Rule("national_phone", re.compile(r"(?<![0-9+(])\(?0?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"), lambda t: True, 0.3, context=re.compile(r"(?i)\b(?:phone|tel|telefon|call|mobile|fax|tél|teléfono)\b")),
)
EMAIL_SCORE = 0.9
KINDS = ("email", *(r.kind for r in RULES))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """From each @ sign outwards, so that long runs of letters without one cost nothing."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


_ANY_DIGIT = re.compile("[0-9]")


def scored_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[Span, float]]:
    """((kind, start, end) in code points, score), by start, then by kind as listed. Null texts have none.

    Base kinds are reported whatever covers them. An added kind gives way to any span that it overlaps.
    """
    if not text:
        return []
    spans = [(s, EMAIL_SCORE) for s in emails(text)]
    # of each kind, where its spans begin and end: they come in order and don't overlap
    held = [([a for (_, a, _), _ in spans], [b for (_, _, b), _ in spans])]

    def free(a: int, b: int) -> bool:
        places = ((begins, bisect_right(ends, a)) for begins, ends in held)
        return not any(k < len(begins) and begins[k] < b for begins, k in places)

    if _ANY_DIGIT.search(text):
        for rule in RULES:
            if rule.needs and rule.needs not in text:
                continue
            begins, ends = [], []
            for m in rule.pattern.finditer(text):
                if not rule.confirms(m[0]):
                    continue
                score = rule.score + CHECKSUM_GAIN * rule.checksum
                near = max(0, m.start() - CONTEXT_CHARS), m.start()
                if rule.context and rule.context.search(text, *near):
                    score += CONTEXT_GAIN
                elif AGAINST.search(text, *near):
                    score -= CONTEXT_LOSS
                if rule.kind in BASE or score >= threshold and free(m.start(), m.end()):
                    spans.append(((rule.kind, m.start(), m.end()), round(min(score, 1.0), 2)))
                    begins.append(m.start())
                    ends.append(m.end())
            held.append((begins, ends))
    return sorted(spans, key=lambda s: (s[0][1], KINDS.index(s[0][0]), s[0][2]))


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """The spans without their scores."""
    return [s for s, _ in scored_spans(text, threshold)]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with a mark such as ``[EMAIL]`` for each span; overlapping spans share the first one's mark."""
    if not spans:
        return text
    out, at, last = [], 0, -1
    for kind, a, b in spans:
        if a < last:
            at = last = max(last, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = last = b
    out.append(text[at:])
    return "".join(out)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, all spans and their scores, for every document.

    Null and empty texts have no span; their digest is that of the empty string. Each row is judged on
    its own, so repeated rows give repeated results; a null doc_id stays null. Other columns aren't read.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = scored_spans(text.as_py())
                base = [s for s, _ in found if s[0] in BASE]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed([s for s, _ in found]), ",".join(f"{x:.2f}" for _, x in found)))
            kinds = [pa.int64()] * len(BASE) + [pa.string()] * 3
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns, personal data in ``text`` replaced by marks.

    n_chars, where there is one, counts the new text; null stays null where the text is null too. All other
    columns, nulls among them, stay as they are.
    """
    names = docs.columns

    def marked(part: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(part.columns)
        texts = [redact(t, find_spans(t)) for t in part.column(names.index("text")).to_pylist()]
        columns[names.index("text")] = pa.array(texts, part.schema.field("text").type)
        if "n_chars" in names:
            k = names.index("n_chars")
            before = part.column(k).to_pylist()
            columns[k] = pa.array([None if n is None and t is None else len(t or "") for n, t in zip(before, texts, strict=True)], part.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_parts(batches, names.index("text"), marked)

    return docs.mapInArrow(run, docs.schema)
