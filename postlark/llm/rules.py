"""Quality rules: features of a text, and decision lists learned from labels, in DataFrame expressions only.

``features`` computes every feature of every document. ``learn`` draws a bounded sample of labelled
documents, bins the features at sample quantiles, lets Spark count labels for each combination of bins,
and learns from these counts alone: sequential covering grows a conjunction of thresholds by FOIL gain
on two thirds of the sample, prunes it on the rest while precision doesn't fall, keeps it if it is
precise enough, removes what it covers, and goes on. ``verdict`` turns the ordered list into one
conditional expression, so applying it is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Base rule: fewer words fail, and so do texts with more than this per cent of their words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: At most so many labelled rows are learned from, those whose hashed doc_id is least.
SAMPLE_ROWS = 20_000
#: Bins of a feature; rules of a list; conditions of a rule; rows that a rule covers at least.
BINS, MAX_RULES, MAX_CONDITIONS, LEAST_COVER = 16, 12, 3, 4
#: A rule is kept if so large a part of what it covers is bad, both where it grew and where it was pruned.
PRECISION = 0.97
LEARNED = ("symbol_share", "repeat_share", "upper_share", "mark_share", "bar_share", "word_length", "dup_line_share", "digit_share", "distinct_share")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever (in lambdas too) body uses it.

    A column of its own wouldn't do: a filter that is pushed below it puts its expression in each place.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_hashes(w: Column) -> Column:
    """A 64-bit hash of each window of WINDOW words, by its first word. (A slice would copy the whole array each time.)"""
    windows = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - WINDOW), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(WINDOW)]))
    return bound(w, lambda v: F.when(F.size(v) >= WINDOW, windows(v)).otherwise(F.array().cast("array<long>")))


def repeated_words(w: Column) -> Column:
    """How many words lie in a five-word window that occurs twice or more in the text.

    Windows are compared by 64-bit hashes. Only texts in which some hash repeats pay for finding where:
    their hashes are sorted with their places, equal neighbours are marked, and the marked places'
    windows are merged from left to right.
    """
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, k: F.struct(x.alias("h"), (k + 1).alias("i"))))).otherwise(none)

    def merged(o: Column) -> Column:
        same = lambda k, s: F.coalesce(F.get(o, k)["h"] == s["h"], F.lit(False))
        marked = F.transform(o, lambda s, k: F.when(same(k - 1, s) | same(k + 1, s), s["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct((i + (WINDOW - 1)).alias("end"), (acc["n"] + i + (WINDOW - 1) - F.greatest(acc["end"], i - 1)).alias("n"))
        return F.aggregate(F.array_sort(F.array_compact(marked)), start, step)["n"]

    return bound(bound(window_hashes(w), ordered), merged).cast("long")


def features(docs: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """doc_id, the base counts, the learned features and the columns named in ``keep``.

    Null and empty texts count as having no word: all counts and shares are 0. Rows are judged one by
    one, so ties and repeated rows don't matter.
    """
    kept = [c for c in keep if c != "doc_id"]
    base = docs.select("doc_id", *kept, F.coalesce("text", F.lit("")).alias("_text"))
    split = base.withColumn("_words", words(F.col("_text")))
    split = split.withColumn("n_repeat_words", repeated_words(F.col("_words"))).withColumn("_flat", F.array_join("_words", ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length("_flat") - F.length(F.regexp_replace("_flat", pattern, ""))
    counted = split.select(
        "doc_id",
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length("_flat").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_flat", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.struct(F.size(lines).alias("all"), F.size(F.array_distinct(lines)).alias("own")).alias("_lines"),
        "n_repeat_words",
        F.size(F.array_distinct("_words")).alias("_distinct"),
        without(r"\p{Lu}+").alias("_upper"),
        without(r"[!?]+").alias("_marks"),
        without(r"[0-9]+").alias("_digits"),
        F.size(F.filter("_words", lambda w: w == "|")).alias("_bars"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0).cast("double")
    n, c = F.col("n_words"), F.col("word_chars")
    return counted.select(
        "doc_id",
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("_lines.all") - F.col("_lines.own")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        share(F.col("n_symbols"), c).alias("symbol_share"),
        share(F.col("n_repeat_words"), n).alias("repeat_share"),
        share(F.col("_upper"), c).alias("upper_share"),
        share(F.col("_marks"), n).alias("mark_share"),
        share(F.col("_bars"), n).alias("bar_share"),
        share(c, n).alias("word_length"),
        share(F.col("_lines.all") - F.col("_lines.own"), F.col("_lines.all")).alias("dup_line_share"),
        share(F.col("_digits"), c).alias("digit_share"),
        share(F.col("_distinct"), n).alias("distinct_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


# -- learning -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Texts that meet all conditions are bad."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


Cell = tuple[tuple[int, ...], int, int]  # bins, bad rows, good rows


def _counts(cells: list[Cell], conditions: tuple) -> tuple[int, int]:
    bad = good = 0
    for bins, b, g in cells:
        if all((bins[f] > t) == above for f, above, t in conditions):
            bad, good = bad + b, good + g
    return bad, good


def _grow(cells: list[Cell], n_bins: list[int]) -> tuple:
    """The conjunction found by adding the condition of the highest FOIL gain until no good row is left."""
    conditions: tuple = ()
    bad, good = _counts(cells, ())
    while good and bad and len(conditions) < MAX_CONDITIONS:
        tallies: dict[tuple[int, int], list[int]] = {}
        total_bad = total_good = 0
        for bins, b, g in cells:
            if all((bins[f] > t) == above for f, above, t in conditions):
                total_bad, total_good = total_bad + b, total_good + g
                for f, k in enumerate(bins):
                    t = tallies.setdefault((f, k), [0, 0])
                    t[0], t[1] = t[0] + b, t[1] + g
        best, found = 0.0, None
        before = math.log2(total_bad / (total_bad + total_good))
        for f, n in enumerate(n_bins):
            low_bad = low_good = 0
            for k in range(n - 1):
                b, g = tallies.get((f, k), (0, 0))
                low_bad, low_good = low_bad + b, low_good + g
                for above, cb, cg in ((False, low_bad, low_good), (True, total_bad - low_bad, total_good - low_good)):
                    if cb >= LEAST_COVER:
                        gain = cb * (math.log2(cb / (cb + cg)) - before)
                        # at equal gain the stricter threshold wins, so that fewer unseen texts are caught
                        if gain > best + 1e-9 or above and found == (f, above, k - 1) and gain > best - 1e-9:
                            best, found = max(best, gain), (f, above, k)
        if found is None:
            break
        conditions = (*conditions, found)
        bad, good = _counts(cells, conditions)
    return conditions


def _prune(cells: list[Cell], conditions: tuple) -> tuple:
    """Drop conditions from the end's back while (bad - good) / (bad + good) on the other rows doesn't fall."""

    def worth(c: tuple) -> float:
        bad, good = _counts(cells, c)
        return (bad - good) / (bad + good) if bad + good else -1.0

    while len(conditions) > 1:
        best = max(range(len(conditions)), key=lambda k: worth(conditions[:k] + conditions[k + 1 :]))
        shorter = conditions[:best] + conditions[best + 1 :]
        if worth(shorter) < worth(conditions):
            break
        conditions = shorter
    return conditions


def cover(grow: list[Cell], prune: list[Cell], edges: list[list[float]], names: tuple[str, ...]) -> list[Rule]:
    """The decision list from binned counts. A bin k of a feature holds values above its edge k - 1, up to edge k."""
    rules, n_bins = [], [len(e) + 1 for e in edges]
    while len(rules) < MAX_RULES:
        conditions = _grow(grow, n_bins)
        if not conditions:
            break
        conditions = _prune(prune, conditions)
        (bad, good), (more_bad, more_good) = _counts(grow, conditions), _counts(prune, conditions)
        if bad < LEAST_COVER or bad < PRECISION * (bad + good) or more_bad < PRECISION * (more_bad + more_good):
            break
        rules.append(Rule(tuple(Condition(names[f], above, edges[f][t]) for f, above, t in conditions)))
        out = lambda cells, c=conditions: [x for x in cells if not all((x[0][f] > t) == above for f, above, t in c)]
        grow, prune = out(grow), out(prune)
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """A decision list of what makes labelled documents bad (quality 0).

    Learns from at most ``sample_rows`` labels, the ones whose hashed doc_id is least; rows that the base
    rule rejects anyway, and labels without a document or a quality, teach nothing. Without labels, or
    with labels of one kind only, the list is empty and the base rule decides alone.
    """
    # sample_rows bounds the sample's size, so documents are filtered where they are read
    order = F.xxhash64(F.lit("rules"), F.col("doc_id"))
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(order, "doc_id").limit(sample_rows)
    judged_sample = features(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality"), keep=["quality"]).persist()
    known = judged_sample.where(~base_failed()).select("doc_id", "quality", *LEARNED)
    try:
        marks = [k / BINS for k in range(BINS)]
        # shares are mostly 0: quantiles of what isn't, among good and among bad rows, and the places midway between them serve as edges
        cuts = known.groupBy((F.col("quality") == 0).alias("bad")).agg(*[F.percentile_approx(F.nullif(F.col(f), F.lit(0.0)), marks, 2000).alias(f) for f in LEARNED]).collect()
        if len(cuts) < 2:
            return []
        seen = [sorted({0.0, *(float(v) for row in cuts for v in row[f] or ())}) for f in LEARNED]
        edges = [sorted({*own, *((a + b) / 2 for a, b in zip(own, own[1:], strict=False))}) for own in seen]
        binned = [sum((F.col(f) > e).cast("int") for e in own) for f, own in zip(LEARNED, edges, strict=True)]
        third = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(3)) == 0
        bad = (F.col("quality") == 0).cast("long")
        cells = known.groupBy(third.alias("prune"), F.array(*binned).alias("bins")).agg(F.sum(bad).alias("bad"), F.sum(1 - bad).alias("good")).collect()
    finally:
        judged_sample.unpersist()
    split = {k: [(tuple(c["bins"]), c["bad"], c["good"]) for c in cells if c["prune"] == k] for k in (False, True)}
    return cover(split[False], split[True], edges, LEARNED)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that a text meets, from 1; 0 if it meets none. One conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(), k) if out is None else out.when(rule.column(), k)
    return F.lit(0) if out is None else out.otherwise(0)


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def judged(docs: DataFrame, labels: DataFrame, keep: Iterable[str] = (), rules: list[Rule] | None = None) -> DataFrame:
    """Base counts, ``base_failed``, ``kept`` and ``rule`` (which learned rule rejects it, 0: none) of every document.

    Columns to keep that are named like one of these results aren't kept; see kept_documents.
    """
    kept = [c for c in keep if c not in RESULT]
    found = learn(docs, labels) if rules is None else rules
    marked = features(docs, keep=kept).withColumn("base_failed", base_failed()).withColumn("rule", verdict(found))
    return marked.select("doc_id", *kept, *RESULT[1:7], (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def kept_documents(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The documents that neither the base rule nor the list rejects, with all of their columns, whatever these are named."""
    own = [f"own_{n}" for n in range(len(docs.columns))]  # the caller's columns by place, so that no name clashes
    named = dict(zip(docs.columns, own, strict=True))
    whole = docs.toDF(*own).select(*own, F.col(named["doc_id"]).alias("doc_id"), F.col(named["text"]).alias("text"))
    # what is learned comes from the documents as they are; rows are judged with all columns kept
    found = judged(whole, labels, keep=own, rules=learn(docs, labels) if rules is None else rules)
    # a filter on a generated column stays above the features, which are then computed once
    return found.withColumn("kept", F.explode(F.array("kept"))).where("kept").select(*[F.col(x).alias(c) for c, x in named.items()])
