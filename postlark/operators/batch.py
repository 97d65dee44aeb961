"""Matching of many candidates at once, and relevance over cases of candidates and the jobs that suit them.

Candidates with the same wishes are matched once. Of a job only the tokens that someone asks for are kept, and of jobs
that no candidate can tell apart but by their dates, only the k that come first: later ones are behind these for everyone.

A score is bounded by what a job's keys bring. Keys are the job's tokens, the tokens of its title, its place and
its mode of work; lists of jobs by key are cut by age. A candidate's tokens are ordered by what each can add
to a score, the most first. Some jobs are scored first, the newest of each of its keys: the kth best of
them is a threshold that the candidate's first k reach. A job whose first token in the order is the nth has
none of those before it, so its score is at most what tokens from the nth on, its age and the rest of the
signals bring; where that stays below the threshold the list isn't read, and the age from which it does says
how far back the list is read. Jobs without any of the tokens are found by place or mode, as far back
as the threshold allows. What is found is scored exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip, tokens
from ..sources import files
from ..sources.shared import kept
from . import matching

#: Days of an age's bucket, the last bucket (everything older, and jobs without a date), and a margin for rounded scores.
BUCKET_DAYS, OLDEST, MARGIN = 30, 60, 2e-6
#: Jobs of a key that are scored first, for each one that is wanted.
SEEDS = 2
#: Rows of results that one task makes.
EXPANDED = 250_000

_LISTS = ("skills", "titles", "locations", "work_modes", "seniority", "employment", "authorized_locations")


def candidates_of(rows: DataFrame) -> DataFrame:
    """Candidates with every column: profile_id, the lists of matching.Candidate, salary_minimum and requires_sponsorship; what isn't there is empty or null.

    Repeated entries of a list count once. A null in a list is dropped. Columns of other names go.
    """
    have = set(rows.columns)
    empty = F.array().cast("array<string>")
    lists = [(F.coalesce(F.array_distinct(F.array_compact(c)), empty) if c in have else empty).alias(c) for c in _LISTS]
    plain = [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in (("salary_minimum", "double"), ("requires_sponsorship", "boolean"))]
    return rows.select(F.col("profile_id").cast("string").alias("profile_id"), *lists, *plain)


# -- jobs -----------------------------------------------------------------------------------------------


def _bucket(age: Column) -> Column:
    return F.coalesce(F.least(F.lit(OLDEST), F.floor(age / BUCKET_DAYS)), F.lit(OLDEST)).cast("int")


def job_table(index: DataFrame, now: str) -> DataFrame:
    """What scoring reads of an index (see matching.index_jobs), one row a job and no texts; ``other_tokens`` are those that aren't skill_tokens."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(x), F.lit("")) for x in ("title", "description_text", "description_html")]))
    age = F.greatest(F.lit(0.0), (F.lit(now).cast("timestamp").cast("double") - F.col("posted").cast("double")) / 86400.0)
    return index.select(
        F.monotonically_increasing_id().alias("job"), "job_id", "posted", age.alias("age"), "skill_tokens", F.array_except("tokens", "skill_tokens").alias("other_tokens"), tokens(F.col("title")).alias("title_tokens"),
        F.lower(F.coalesce("location", F.lit(""))).alias("place"), F.coalesce("work_mode", F.lit("unknown")).alias("mode"), F.lower(F.coalesce("employment_type", F.lit("unknown"))).alias("kind"),
        F.lower(F.trim("seniority")).alias("level"), matching.offered().alias("offered"), matching.contains_any(text, list(matching.NO_VISA)).alias("no_visa"), matching.quality_flags().alias("quality_flags"),
        F.size(tokens(F.col("title"))).alias("n_title"),
    )


def job_lists(table: DataFrame) -> DataFrame:
    """(key, listed, bucket, age, job): the lists of jobs by key. Keys are s:token (listed: one of skill_tokens), t:token of titles, p:place and m:mode."""

    def named(kind: str, c: Column, listed: bool = False) -> Column:
        return F.transform(c, lambda x: F.struct(F.concat(F.lit(kind + ":"), x).alias("key"), F.lit(listed).alias("listed")))

    keys = F.concat(named("s", F.col("skill_tokens"), True), named("s", F.col("other_tokens")), named("t", F.col("title_tokens")), named("p", F.array("place")), named("m", F.array(F.lower("mode"))))
    return table.select(F.explode(keys).alias("k"), _bucket(F.col("age")).alias("bucket"), "age", "job").select("k.*", "bucket", "age", "job")


# -- signals of pairs -----------------------------------------------------------------------------------


def _weight(signal: str, weights: dict[str, float]) -> Column:
    return F.lit(weights[signal]) * F.coalesce(F.col("multipliers")[signal], F.lit(1.0))


def eligible() -> dict[str, Column]:
    """The hard filters of pairs of a candidate and a job, by code."""
    places = F.array_distinct(F.concat("locations", "authorized_locations"))
    at = F.exists(places, lambda p: F.col("place").contains(p)) | ((F.col("mode") == "remote") & F.array_contains(places, "remote"))
    return {
        "FILTER_LOCATION": (F.size(places) == 0) | at,
        "FILTER_WORK_MODE": (F.size("work_modes") == 0) | F.array_contains("work_modes", F.lower("mode")),
        "FILTER_EMPLOYMENT_TYPE": (F.size("employment") == 0) | F.array_contains("employment", F.col("kind")),
        "FILTER_SALARY": F.col("salary_minimum").isNull() | F.coalesce(F.col("offered") >= F.col("salary_minimum"), F.lit(False)),
        "FILTER_VISA": ~(F.coalesce("requires_sponsorship", F.lit(False)) & F.col("no_visa")),
    }


def signals() -> dict[str, Column]:
    """The six signals of eligible pairs, as matching.signals has them for one candidate; of a job's tokens those that nobody asks for may be missing."""
    both = lambda t: F.size(F.array_intersect("title_tokens", t))
    shared = lambda t: both(t) / (F.col("n_title") + F.size(t) - both(t))
    likes = F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("title_sets", shared)))
    return {
        "skills": F.when(F.size("skills") > 0, F.size(F.array_intersect("skills", F.concat("skill_tokens", "other_tokens"))) / F.size("skills").cast("double")).otherwise(0.5),
        "title": F.when(F.size("titles") > 0, likes).otherwise(0.5),
        "location_work_mode": F.lit(1.0),
        "seniority": F.when(F.size("seniority") > 0, F.coalesce(F.array_contains("seniority", F.col("level")), F.lit(False)).cast("double")).otherwise(0.5),
        "recency": F.coalesce(F.exp(-math.log(2.0) * F.col("age") / matching.HALF_LIFE_DAYS), F.lit(0.0)),
        "compensation": F.when(F.col("salary_minimum").isNull(), 0.5).otherwise(1.0),
    }


def _scored(pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Eligible pairs with the signals and the score; pairs have the columns of candidates and jobs."""
    ok = F.lit(True)
    for passes in eligible().values():
        ok = ok & passes
    out = pairs.where(ok).withColumns({f"signal_{k}": v.cast("double") for k, v in signals().items()})
    total = F.lit(0.0)
    for k in weights:
        total = total + F.col(f"signal_{k}") * _weight(k, weights)
    return out.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6))


def _first(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("candidate").orderBy(F.desc("score"), F.desc_nulls_last("posted"), "job_id", "job")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# -- thresholds and lists -------------------------------------------------------------------------------


def _prepared(candidates: DataFrame, multipliers: DataFrame | None) -> DataFrame:
    """Candidates numbered, with the tokens of their titles, their multipliers, and a digest of all that they wish."""
    sets = F.filter(F.transform("titles", lambda t: F.array_sort(tokens(t))), lambda t: F.size(t) > 0)
    out = candidates.withColumn("candidate", F.monotonically_increasing_id()).withColumn("title_sets", F.array_distinct(sets))
    if multipliers is None:
        out = out.withColumn("multipliers", F.lit(None).cast("map<string,double>"))
    else:
        by_signal = multipliers.groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("signal", F.col("weight").cast("double")))).alias("multipliers"))
        out = out.join(by_signal, "profile_id", "left")
    all_ = F.struct(*[F.array_sort(c).alias(c) for c in _LISTS], "salary_minimum", "requires_sponsorship", F.array_sort(F.map_entries("multipliers")).alias("multipliers"))
    return out.withColumn("wish", F.sha2(F.to_json(all_), 256))


def _asked_keys(asked: DataFrame) -> DataFrame:
    """(key): the tokens that somebody asks for."""
    named = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind + ":"), x))
    return asked.select(F.explode(F.concat(named("s", F.col("skills")), named("t", F.flatten("title_sets")))).alias("key")).distinct()


def _met(asked: DataFrame, table: DataFrame) -> DataFrame:
    """(wish, place): wished places are parts of jobs' places; the different wishes are held against the different places."""
    wishes = asked.select(F.explode(F.concat("locations", "authorized_locations")).alias("wish")).distinct()
    return wishes.join(table.select("place").distinct(), F.col("place").contains(F.col("wish")))


def _leading(table: DataFrame, lists: DataFrame, asked: DataFrame, top_k: int) -> DataFrame:
    """The jobs that can be among the first ``top_k`` of a candidate, with those of their tokens that somebody asks for.

    Jobs are alike if they have the same of these tokens, meet the same wished places and salaries, and agree in what else
    a filter or a signal reads, their dates left aside. Of two like ones with dates the newer one never has the lower score, for
    no weight is negative; so each candidate has them in one order, which is by date and id, and needs the first ``top_k`` at
    most. Those without a date are alike among themselves.
    """
    has = lists.join(_asked_keys(asked), "key").groupBy("job").agg(F.collect_set(F.struct("key", "listed")).alias("has"))
    known = F.coalesce("has", F.array().cast("array<struct<key:string,listed:boolean>>"))

    def of(kind: str, listed: bool) -> Column:
        return F.array_sort(F.transform(F.filter(known, lambda x: x["key"].startswith(kind) & (x["listed"] == listed)), lambda x: F.substr(x["key"], F.lit(3))))

    # what scoring reads of places and salaries, by the different ones
    met = _met(asked, table).groupBy("place").agg(F.array_sort(F.collect_set("wish")).alias("met"))
    least = asked.select("salary_minimum").where("salary_minimum is not null").distinct()
    paid = table.select("offered").distinct().join(least, F.col("offered") >= F.col("salary_minimum")).groupBy("offered").agg(F.count(F.lit(1)).alias("paid"))
    plain = table.drop("skill_tokens", "other_tokens", "title_tokens").join(has, "job", "left").join(met, "place", "left").join(paid, "offered", "left")
    narrow = plain.withColumns({"skill_tokens": of("s:", True), "other_tokens": of("s:", False), "title_tokens": of("t:", False)}).drop("has")
    alike = [F.array_sort(F.concat("skill_tokens", "other_tokens")), "title_tokens", "n_title", "met", "mode", "kind", "level", "paid", "no_visa", F.col("posted").isNull()]
    order = Window.partitionBy(*alike).orderBy(F.desc_nulls_last("posted"), "job_id", "job")
    return narrow.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top_k).drop("nth", "met", "paid")


def _tokens_of(asked: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(candidate, key, bound, ahead): each token, what it can add, and what it and those behind it in the order can.

    Shares of titles add up to no less than the best likeness of a title, which divides by more tokens than the title has.
    """
    share = F.lit(1.0) / F.size("skills").cast("double") * _weight("skills", weights)
    skills = F.transform("skills", lambda s: F.struct(F.concat(F.lit("s:"), s).alias("key"), share.alias("bound")))
    title = F.flatten(F.transform("title_sets", lambda t: F.transform(t, lambda x: F.struct(F.concat(F.lit("t:"), x).alias("key"), (F.lit(1.0) / F.size(t).cast("double") * _weight("title", weights)).alias("bound")))))
    each = asked.select("candidate", F.explode(F.concat(skills, title)).alias("s")).groupBy("candidate", "s.key").agg(F.max("s.bound").alias("bound"))
    behind = Window.partitionBy("candidate").orderBy(F.desc("bound"), "key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return each.withColumn("ahead", F.sum("bound").over(behind))


def _paths_of(asked: DataFrame, table: DataFrame) -> DataFrame:
    """(candidate, key): the places, or else the modes, under which every eligible job of a candidate is listed."""
    wishes = asked.select("candidate", "work_modes", F.array_distinct(F.concat("locations", "authorized_locations")).alias("wished"))
    each = wishes.select("candidate", F.explode("wished").alias("wish"))
    met = _met(asked, table).select("wish", F.concat(F.lit("p:"), "place").alias("key"))
    at = each.join(met, "wish").select("candidate", "key")
    remote = wishes.where(F.array_contains("wished", "remote")).select("candidate", F.lit("m:remote").alias("key"))
    modes = F.when(F.size("work_modes") > 0, F.col("work_modes")).otherwise(F.array(*[F.lit(m) for m in matching.MODES]))
    free = wishes.where(F.size("wished") == 0).select("candidate", F.explode(modes).alias("mode")).select("candidate", F.concat(F.lit("m:"), "mode").alias("key"))
    return at.unionByName(remote).unionByName(free).distinct()


def _rest(weights: dict[str, float]) -> Column:
    """The most that signals other than those of tokens and recency bring to an eligible job."""
    fixed = F.when(F.size("skills") > 0, 0.0).otherwise(0.5) * _weight("skills", weights) + F.when(F.size("titles") > 0, 0.0).otherwise(0.5) * _weight("title", weights)
    level = F.when(F.size("seniority") > 0, 1.0).otherwise(0.5) * _weight("seniority", weights)
    return fixed + _weight("location_work_mode", weights) + level + F.when(F.col("salary_minimum").isNull(), 0.5).otherwise(1.0) * _weight("compensation", weights)


def best_matches(index: DataFrame, candidates: DataFrame, now: str, top_k: int = 25, policy: matching.Policy | None = None, multipliers: DataFrame | None = None) -> DataFrame:
    """(profile_id, rank, job_id, score, posted, match_reasons, required_missing_skills, quality_flags): the first jobs of every candidate.

    The same rows as matching.best_matches gives for each candidate: eligible jobs by score, then newest, then job_id.
    ``candidates`` has profile_id and the columns of candidates_of; ``multipliers`` (profile_id, signal, weight) those of
    feedback. Each row of candidates is one of its own, whatever profile_id it has; one without wishes gets the newest jobs. An empty
    index, or no candidates, give an empty result. Multipliers must not be negative.
    """
    table = kept(job_table(index, now), "jobs")
    return matches_in(table, job_lists(table), candidates, top_k, policy, multipliers)


def write_index(index: DataFrame, now: str, folder: str) -> dict:
    """Jobs and lists as a bundle under ``folder``, in the order of ids and keys, so that many runs match against one reading of the texts; returns the manifest."""
    table = kept(job_table(index, now), "jobs")
    tables = {"jobs": table.drop("skill_tokens", "other_tokens", "title_tokens").orderBy("job_id", "job"), "lists": job_lists(table).orderBy("key", "bucket", "job")}
    return files.write_bundle(tables, folder.rstrip("/"), {"now": now, "jobs": table.count()})


def matches_of_index(spark: SparkSession, folder: str, candidates: DataFrame, top_k: int = 25, policy: matching.Policy | None = None, multipliers: DataFrame | None = None) -> DataFrame:
    """best_matches against an index that write_index wrote; ages are those of its time."""
    _, tables = files.read_bundle(spark, folder.rstrip("/"))
    return matches_in(tables["jobs"], tables["lists"], candidates, top_k, policy, multipliers)


def matches_in(table: DataFrame, lists: DataFrame, candidates: DataFrame, top_k: int = 25, policy: matching.Policy | None = None, multipliers: DataFrame | None = None) -> DataFrame:
    """best_matches from tables of jobs and of their lists."""
    if top_k < 1:
        raise ValueError("top_k must be 1 or more")
    policy = policy or matching.Policy()
    weights = policy.normalized()
    if min(weights.values()) < 0:
        raise ValueError("weights must not be negative")
    people = kept(_prepared(candidates_of(candidates), multipliers), "candidates")
    asked = kept(people.drop("profile_id").dropDuplicates(["wish"]), "wishes")
    table = kept(_leading(table, lists, asked, top_k), "leading")
    lists = kept(job_lists(table).drop("listed"), "lists")
    tokens_, paths = _tokens_of(asked, weights), kept(_paths_of(asked, table), "paths")

    # few rows ask for many pairs: they are dealt to all tasks, or one would make the pairs of all candidates
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # the newest jobs of each key are scored first; their kth score is a threshold
    newest = Window.partitionBy("key").orderBy("age", "job")
    heads = lists.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= SEEDS * top_k).select("key", "job")
    seeds = tokens_.select("candidate", "key").unionByName(paths).repartition(tasks).join(heads, "key").select("candidate", "job").distinct()
    pairs = lambda found: found.join(table, "job").join(asked, "candidate")
    kth = _first(_scored(pairs(seeds), weights), top_k).where(F.col("rank") == top_k).select("candidate", F.col("score").alias("threshold"))

    # what recency must bring for a job to reach the threshold, by the first of the candidate's tokens that it has
    bounds = asked.select("candidate", _rest(weights).alias("rest"), _weight("recency", weights).alias("recency")).join(kth, "candidate", "left")
    ways = tokens_.select("candidate", "key", "ahead").unionByName(paths.select("candidate", "key", F.lit(0.0).alias("ahead")))
    lacking = F.col("threshold") - MARGIN - F.col("rest") - F.col("ahead")
    share = F.when(F.col("threshold").isNull() | (lacking <= 0), 0.0).otherwise(F.try_divide(lacking, "recency"))
    # without a weight of recency nothing makes up for what lacks
    reach = ways.join(bounds, "candidate").withColumn("share", share).where(F.col("share") <= 1.0)
    oldest = F.when(F.col("share") > 0, -F.log(2.0, F.col("share")) * matching.HALF_LIFE_DAYS + 1e-6)
    reach = reach.select("candidate", "key", oldest.alias("oldest"), F.explode(F.sequence(F.lit(0), _bucket(oldest))).alias("bucket")).repartition(tasks)
    found = reach.join(lists, ["key", "bucket"]).where(F.col("oldest").isNull() | (F.col("age") <= F.col("oldest"))).select("candidate", "job").distinct()
    first = _first(_scored(pairs(found), weights), top_k)
    shown = {k: _weight(k, weights) for k in weights}
    lacks = F.array_sort(F.array_except("skills", "skill_tokens"))
    best = kept(first.select("wish", "rank", "job_id", "score", "posted", matching.reasons(shown, policy.reason_limit).alias("match_reasons"), lacks.alias("required_missing_skills"), "quality_flags"), "best")

    # everyone with the same wishes gets the same jobs; candidates are dealt so that no task makes more than some EXPANDED rows
    return people.select("profile_id", "wish").repartition(max(tasks, people.count() * top_k // EXPANDED)).join(best, "wish").drop("wish")


# -- evaluation -----------------------------------------------------------------------------------------


def evaluated(index: DataFrame, cases: DataFrame, now: str, ks: tuple[int, ...] = (10, 25, 50), policy: matching.Policy | None = None) -> DataFrame:
    """(k, precision, recall): averages over cases, which are candidates with ``relevant`` (job ids that suit).

    Blank and repeated ids don't count; cases without any are left out, and where that leaves none the figures are an empty table.
    """
    if not ks:
        raise ValueError("there must be a k")
    ids = F.array_distinct(F.filter(F.transform("relevant", lambda x: strip(x.cast("string"))), lambda x: x.isNotNull() & (x != "")))
    known = kept(cases.withColumns({"relevant": ids, "profile_id": F.monotonically_increasing_id().cast("string")}).where(F.size("relevant") > 0), "cases")
    ranked = best_matches(index, known, now, max(ks), policy).select(F.col("profile_id").alias("case_id"), "job_id", "rank")
    return matching.relevance(ranked, known.select(F.col("profile_id").alias("case_id"), F.explode("relevant").alias("job_id")), tuple(sorted(set(ks))))


def evaluation_checks(measured: DataFrame, least: dict[tuple[str, int], float] | None = None) -> DataFrame:
    """(code, value, least, status) of evaluated's figures, rounded to 6 places; one that wasn't measured counts as 0."""
    return matching.relevance_checks(measured, least)
