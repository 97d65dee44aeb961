"""Scoring postings against a candidate: hard filters with reason codes, six weighted signals, top-k, evaluation, feedback.

The candidate's wishes are literals of the plan, so a match is one projection over the index and a top-k.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.text import contains_any, strip, text_or_null, timestamp, tokens
from ..sources.shared import kept
from .catalog import keep_first
from .contract import truth

#: Signals in order with their weights, factors of feedback events, modes of work and kinds of employment.
WEIGHTS = {"skills": 0.35, "title": 0.20, "location_work_mode": 0.15, "seniority": 0.10, "recency": 0.10, "compensation": 0.10}
FACTORS = {"not_relevant": (0.95, 0.95, 0.90, 0.95, 1.0, 0.98), "applied": (1.03, 1.03, 1.01, 1.02, 1.0, 1.01), "interviewed": (1.08, 1.08, 1.04, 1.05, 1.0, 1.02)}
LOWEST, HIGHEST = 0.5, 1.5
HALF_LIFE_DAYS = 90.0
MODES = ("remote", "hybrid", "onsite", "unknown")
EMPLOYMENT = ("full_time", "part_time", "contract", "internship", "temporary")
#: What a job says when it gives no visa.
NO_VISA = ("no sponsorship", "not sponsor")


@dataclass(frozen=True)
class Candidate:
    skills: tuple[str, ...] = ()
    titles: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    work_modes: tuple[str, ...] = ()
    seniority: tuple[str, ...] = ()
    employment: tuple[str, ...] = ()
    salary_minimum: float | None = None
    requires_sponsorship: bool | None = None
    authorized_locations: tuple[str, ...] = ()
    profile_id: str = ""

    def places(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.locations, *self.authorized_locations)))

    def title_tokens(self) -> list[list[str]]:
        """The tokens of each wished title; titles without tokens say nothing."""
        found = [sorted({t for t in re.findall("[a-z0-9]+", title.lower()) if len(t) >= 2}) for title in self.titles]
        return [t for t in found if t]


@dataclass(frozen=True)
class Policy:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    reason_limit: int = 3

    def normalized(self) -> dict[str, float]:
        total = sum(self.weights.get(k, 0.0) for k in WEIGHTS)
        return {k: self.weights.get(k, 0.0) / total if total else 1 / len(WEIGHTS) for k in WEIGHTS}


def work_mode(explicit: Column, remote: Column, location: Column) -> Column:
    place = F.lower(F.coalesce(text_or_null(location), F.lit("")))
    far = truth(remote)
    said = text_or_null(explicit)
    return F.when(said.isin(*MODES), said).when(F.coalesce(far, F.lit(False)) | place.contains("remote"), "remote").when(place.contains("hybrid"), "hybrid").when(far.eqNullSafe(F.lit(False)) | contains_any(place, ["onsite", "on-site"]), "onsite").otherwise("unknown")


def seniority(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.when(contains_any(t, ["principal", "staff"]), "staff").when(t.contains("senior"), "senior").when(contains_any(t, ["junior", "intern", "entry"]), "junior").otherwise("mid")


def whole_skills(c: Column) -> Column:
    """Skills as they are listed, lower-cased and without blanks; a skill of several words stays one."""
    cleaned = F.transform(F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")), lambda x: F.lower(strip(x)))
    return F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (x != "")))


def employment_type(c: Column) -> Column:
    """One of the known kinds, or unknown; blanks and hyphens count as underscores, case matters."""
    kind = F.regexp_replace(text_or_null(c), "[- ]", "_")
    return F.when(kind.isin(*EMPLOYMENT), kind).otherwise("unknown")


def index_jobs(df: DataFrame) -> DataFrame:
    """Canonical jobs with what matching needs: job_id, work_mode, seniority, employment_type, posted, skill_tokens and tokens.

    A job without an id of its own gets one from what it says. Skills are whole strings; titles, companies,
    places and descriptions are cut into tokens.
    """
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    said = F.concat_ws("|", *[F.coalesce(have(c).cast("string"), F.lit("")) for c in ("title", "company", "location", "posted_at", "apply_url")])
    skilled = F.array_union(whole_skills(F.col("skills")), F.array_union(tokens(F.col("title")), tokens(F.col("description_text"))))
    indexed = df.withColumns({
        "job_id": F.coalesce(text_or_null(have("source_job_id")), text_or_null(have("id")), F.substring(F.sha2(said, 256), 1, 16)),
        "work_mode": work_mode(have("work_mode"), have("remote"), have("location")),
        "seniority": F.coalesce(text_or_null(have("seniority")), seniority(F.col("title"))),
        "employment_type": employment_type(have("employment_type")),
        "posted": timestamp(have("posted_at")),
        "skill_tokens": F.array_sort(skilled),
    })
    return indexed.withColumn("tokens", F.array_sort(F.array_union("skill_tokens", F.array_union(tokens(F.col("company")), tokens(F.col("location"))))))


def postings(index: DataFrame, shards: int = 16, block: int = 4096) -> DataFrame:
    """(token, shard, block, job_ids): the inverted index, in blocks of jobs.

    A token's jobs are dealt to blocks by a hash of their ids: as many blocks as give about ``block`` jobs to
    each, so that what one task gathers stays bounded however common the token is. Most tokens have one.
    """
    # texts are cut into tokens once; counts and lists both read what is kept
    once = kept(index.select("job_id", F.array_distinct("tokens").alias("tokens")), "tokens")
    each = once.select("job_id", F.explode("tokens").alias("token"))
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)  # the few common ones
    blocks = each.join(counted, "token", "left").withColumn("block", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("job_id"), F.ceil(F.col("n") / block))).cast("long"))
    shard = (F.conv(F.substring(F.sha2("token", 256), 1, 2), 16, 10).cast("int") % shards).alias("shard")
    return blocks.groupBy("token", "block").agg(F.array_sort(F.collect_set("job_id")).alias("job_ids")).select("token", shard, "block", "job_ids")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, count) of lower-cased values; blanks are skipped."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lower(F.trim(F.col(c).cast("string"))).alias("value")) for c in columns])).alias("s")).select("s.*")
    return pairs.where("value <> ''").groupBy("name", "value").agg(F.count(F.lit(1)).alias("count"))


def offered() -> Column:
    return F.greatest("salary_min", "salary_max")


def _eligible(c: Candidate) -> dict[str, Column]:
    yes = F.lit(True)
    place = F.lower(F.coalesce("location", F.lit("")))
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(x), F.lit("")) for x in ("title", "description_text", "description_html")]))
    places = c.places()
    at = contains_any(place, list(places)) | ((F.col("work_mode") == "remote") & F.lit("remote" in places))
    return {
        "FILTER_LOCATION": at if places else yes,
        "FILTER_WORK_MODE": F.lower(F.coalesce("work_mode", F.lit("unknown"))).isin(*c.work_modes) if c.work_modes else yes,
        "FILTER_EMPLOYMENT_TYPE": F.lower(F.coalesce("employment_type", F.lit("unknown"))).isin(*c.employment) if c.employment else yes,
        "FILTER_SALARY": F.coalesce(offered() >= c.salary_minimum, F.lit(False)) if c.salary_minimum is not None else yes,
        "FILTER_VISA": ~contains_any(text, list(NO_VISA)) if c.requires_sponsorship else yes,
    }


def exclusions(c: Candidate) -> Column:
    """The codes of the filters that a job fails, in their order."""
    return F.array_compact(F.array(*[F.when(~ok, code) for code, ok in _eligible(c).items()]))


def signals(c: Candidate, now: str) -> dict[str, Column]:
    known = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    ok = _eligible(c)
    title = tokens(F.col("title"))
    likes = [F.size(F.array_intersect(title, known(t))) / F.size(F.array_union(title, known(t))) for t in c.title_tokens()]
    age = F.greatest(F.lit(0.0), (F.lit(now).cast("timestamp").cast("double") - F.col("posted").cast("double")) / 86400.0)
    pay = c.salary_minimum
    return {
        "skills": F.size(F.array_intersect(known(c.skills), F.col("tokens"))) / float(len(set(c.skills))) if c.skills else F.lit(0.5),
        "title": (F.greatest(*likes, F.lit(0.0), F.lit(0.0)) if c.titles else F.lit(0.5)).cast("double"),
        "location_work_mode": (ok["FILTER_LOCATION"].cast("int") + ok["FILTER_WORK_MODE"].cast("int")) / 2.0,
        "seniority": F.coalesce(F.lower(F.trim("seniority")).isin(*c.seniority), F.lit(False)).cast("double") if c.seniority else F.lit(0.5),
        "recency": F.coalesce(F.exp(-math.log(2.0) * age / HALF_LIFE_DAYS), F.lit(0.0)),
        "compensation": F.lit(0.5) if pay is None else F.when(offered().isNull(), 0.0).when(offered() >= pay, 1.0).when(F.lit(pay <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), offered() / (pay or 1.0)))),
    }


def reasons(weights: dict[str, Column | float], limit: int) -> Column:
    """The signals with the highest contributions, those that come first in the order among equals; figures have 6 places."""
    six = lambda c: F.round(c, 6)
    each = [F.struct((-six(F.col(f"signal_{k}") * w)).alias("order"), F.lit(n).alias("n"), F.lit(f"SIGNAL_{k.upper()}").alias("code"), six(F.col(f"signal_{k}")).alias("value"), six(F.lit(w) if isinstance(w, float) else w).alias("weight")) for n, (k, w) in enumerate(weights.items())]
    return F.transform(F.slice(F.array_sort(F.array(*each)), 1, limit), lambda r: F.struct(r["code"].alias("code"), r["value"].alias("value"), r["weight"].alias("weight"), (-r["order"]).alias("contribution")))


def missing_skills(c: Candidate) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(s) for s in c.skills]).cast("array<string>"), F.col("skill_tokens")))


def quality_flags(posted: Column | str = "posted_at") -> Column:
    """Codes of what a job lacks."""
    said = F.col(posted).isNotNull() if posted == "posted" else text_or_null(F.col(posted)).isNotNull()
    lacks = {"MISSING_COMPANY": text_or_null(F.col("company")).isNull(), "MISSING_POSTED_AT": ~said, "MISSING_DESCRIPTION": text_or_null(F.col("description_text")).isNull()}
    return F.array_compact(F.array(*[F.when(is_so, code) for code, is_so in lacks.items()]))


def scored(index: DataFrame, c: Candidate, now: str, policy: Policy | None = None, multipliers: dict[str, float] | None = None) -> DataFrame:
    """All jobs with exclude_reasons, score (6 places), signals, match_reasons, required_missing_skills and quality_flags."""
    policy = policy or Policy()
    weights = {k: w * (multipliers or {}).get(k, 1.0) for k, w in policy.normalized().items()}
    out = index.withColumns({"exclude_reasons": exclusions(c), **{f"signal_{k}": v for k, v in signals(c, now).items()}})
    total = sum((F.col(f"signal_{k}") * w for k, w in weights.items()), F.lit(0.0))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)
    return out.withColumns({"score": score, "match_reasons": reasons(weights, policy.reason_limit), "required_missing_skills": missing_skills(c), "quality_flags": quality_flags()})


def best_matches(index: DataFrame, c: Candidate, now: str, top_k: int = 25, **more) -> DataFrame:
    """Eligible jobs by score, then newest, then job_id."""
    eligible = scored(index, c, now, **more).where(F.size("exclude_reasons") == 0)
    return eligible.orderBy(F.desc("score"), F.desc_nulls_last("posted"), "job_id").limit(top_k)


def relevance(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """(k, precision, recall), averages over cases. ranked: case_id, job_id, rank from 1; relevant: case_id, job_id."""
    hits = ranked.join(relevant.dropDuplicates(["case_id", "job_id"]), ["case_id", "job_id"], "left_semi").groupBy("case_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    cases = relevant.groupBy("case_id").agg(F.count_distinct("job_id").alias("all")).join(hits, "case_id", "left")
    each = cases.select("all", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("h")) for k in ks])).alias("s"))
    return each.groupBy(F.col("s.k").alias("k")).agg(F.avg(F.col("s.h") / F.col("s.k")).alias("precision"), F.avg(F.col("s.h") / F.col("all")).alias("recall"))


#: The least precision and recall that an evaluation must reach.
LEAST = {("precision", 10): 0.60, ("recall", 25): 0.70}


def relevance_checks(measured: DataFrame, least: dict[tuple[str, int], float] | None = None) -> DataFrame:
    """(code, value, least, status) of a table of relevance; a figure that wasn't measured counts as 0."""
    least = least or LEAST
    row = measured.agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.round(name, 6))), F.lit(0.0)).alias(f"{name}_{k}") for name, k in least])
    checks = [F.struct(F.lit(f"EVAL_{name.upper()}_AT_{k}_BELOW_THRESHOLD").alias("code"), F.col(f"{name}_{k}").alias("value"), F.lit(limit).alias("least"), F.when(F.col(f"{name}_{k}") < limit, "fail").otherwise("pass").alias("status")) for (name, k), limit in least.items()]
    return row.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def index_summary(index: DataFrame) -> DataFrame:
    """One row: jobs and per cent (4 places) with a company, a date and a description; 0 of an empty index."""
    n = F.count(F.lit(1))
    pct = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(text_or_null(F.col(c)).isNotNull()) * 100.0, n), F.lit(0.0)), 4).alias(f"{c}_non_null_pct")
    return index.agg(n.alias("row_count"), *[pct(c) for c in ("company", "posted_at", "description_text")])


def feedback_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("profile_id", "event").agg(F.count(F.lit(1)).alias("count"))


def feedback_totals(events: DataFrame) -> DataFrame:
    """(profile_id, event, count): counts of each profile and event, of each event (no profile), and of all (neither), in one pass.

    Events without a profile count under the empty text, so that a total is told from them.
    """
    named = events.select(F.coalesce("profile_id", F.lit("")).alias("profile_id"), F.coalesce("event", F.lit("")).alias("event"))
    return named.groupingSets([["profile_id", "event"], ["event"], []], "profile_id", "event").agg(F.count(F.lit(1)).alias("count"))


#: Events that a new one is held against.
RECENT_EVENTS = 1000


def event_hash() -> Column:
    """What identifies an event: its profile, job, kind and meta (JSON, whose keys count in any order)."""
    meta = F.coalesce(F.to_json(F.try_parse_json("meta")), F.lit("{}"))
    return F.sha2(F.to_json(F.struct("event", "job_id", meta.alias("meta"), "profile_id")), 256)


def recorded(log: DataFrame, events: DataFrame) -> DataFrame:
    """Events (profile_id, job_id, event, meta, ordinal) that aren't in the log yet, with ``event_hash``, ready to be appended.

    Blank profiles and jobs, and unknown kinds, go. Of several equal events the first one counts. One is a duplicate if the last RECENT_EVENTS of
    the log (event_hash, ordinal) have it; what lies further back doesn't count.
    """
    tidy = events.withColumns({c: F.lower(text_or_null(F.col(c))) if c == "profile_id" else text_or_null(F.col(c)) for c in ("profile_id", "job_id")})
    known = tidy.where(F.col("event").isin(*FACTORS) & F.col("profile_id").isNotNull() & F.col("job_id").isNotNull()).withColumn("event_hash", event_hash())
    first = keep_first(known, "event_hash", "ordinal")
    return first.join(log.orderBy(F.desc("ordinal")).limit(RECENT_EVENTS).select("event_hash"), "event_hash", "left_anti")


def _composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The maps that do ``first`` and then ``then``. A map w -> min(high, max(low, factor * w)) is (factor, low, high) on axis 1.

    Where low meets high a map is constant; its factor is set to 1 there, so that no product runs over or under.
    """
    low, high = [np.minimum(then[:, 2], np.maximum(then[:, 1], then[:, 0] * first[:, k])) for k in (1, 2)]
    return np.stack([np.where(low == high, 1.0, first[:, 0] * then[:, 0]), low, high], 1)


def _composed_runs(runs: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """One map for each run of equal numbers, from its maps in their order; neighbours are composed until one is left."""
    while len(runs):
        starts = np.concatenate([[True], runs[1:] != runs[:-1]])
        if starts.all():
            break
        place = np.arange(len(runs))
        even = (place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0
        paired = np.flatnonzero(even[:-1] & ~starts[1:])
        maps[paired] = _composed(maps[paired], maps[paired + 1])
        runs, maps = runs[even], maps[even]
    return maps


def feedback_maps(events: DataFrame) -> DataFrame:
    """(profile_id, piece, factor, low, high): what the events of one profile in one range of the order do to its weights.

    Events are dealt to tasks by ranges of (profile, time, id), so a profile with many events is spread over
    many tasks; each task reads its range in order, holds one batch of it, and gives one row per profile.
    """
    known = events.where(F.col("event").isin(*FACTORS))
    order = ["profile_id", "recorded_at", "event_id", "event"]
    kind = F.coalesce(*[F.when(F.col("event") == k, F.lit(n)) for n, k in enumerate(FACTORS)])
    each = np.array([[f, np.full(len(f), LOWEST), np.full(len(f), HIGHEST)] for f in FACTORS.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = TaskContext.get().partitionId(), None

        def rows(profiles: pa.Array, maps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([profiles, pa.array([piece] * len(maps), pa.int32()), *[pa.array(list(maps[:, k]), pa.list_(pa.float64())) for k in range(3)]], ["profile_id", "piece", "factor", "low", "high"])

        for batch in batches:
            if not batch.num_rows:
                continue
            profiles, maps = batch.column(0), each[batch.column(1).to_numpy()]
            if held is not None:  # the last profile of one batch may go on in the next
                profiles, maps = pa.concat_arrays([held[0], profiles]), np.concatenate([held[1], maps])
            runs = profiles.dictionary_encode("encode").indices.to_numpy()
            profiles = profiles.take(pa.array(np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))))
            maps = _composed_runs(runs, maps)
            held = profiles[-1:], maps[-1:].copy()
            yield rows(profiles[:-1], maps[:-1])
        if held is not None:
            yield rows(*held)

    schema = StructType([events.schema["profile_id"], StructField("piece", IntegerType()), *[StructField(c, ArrayType(DoubleType())) for c in ("factor", "low", "high")]])
    return known.repartitionByRange(*order).sortWithinPartitions(*order).select("profile_id", kind.alias("kind")).mapInArrow(run, schema)


def feedback_weights(events: DataFrame) -> DataFrame:
    """(profile_id, signal, weight): each event multiplies a profile's weights in its order, clamped after each.

    Ranges of a profile's events are composed to one map each, and these are put in order: one row of a
    profile holds at most as many as there are tasks. Factors between two clamps are multiplied in another
    order than one by one, so a weight's last digits may differ.
    """
    ordered = feedback_maps(events).groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("piece", "factor", "low", "high"))).alias("maps"))

    def fold(n: int) -> Column:
        return F.aggregate("maps", F.lit(1.0), lambda w, m: F.greatest(m["low"][n], F.least(m["high"][n], w * m["factor"][n])))

    folded = [F.struct(F.lit(s).alias("signal"), fold(n).alias("weight")) for n, s in enumerate(WEIGHTS)]
    return ordered.select("profile_id", F.explode(F.array(*folded)).alias("s")).select("profile_id", "s.*")
