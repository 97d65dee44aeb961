"""Profiles of a frame: nulls, distributions, per-source figures, deciles, months; and what differs between two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from ..functions.text import strip, timestamp

#: What stands for nothing, and the weights of the default quality profile.
SENTINELS = ("unknown", "n/a", "na", "none", "null")
CORE_WEIGHTS = {"title": 3.0, "company": 2.5, "description_text": 3.0, "apply_url": 2.5, "source": 1.5, "location": 1.5, "remote": 1.0, "posted_at": 1.5}
STRICT_WEIGHTS = {
    "title": 2.0, "company": 2.0, "description_text": 2.0, "apply_url": 1.5, "location": 2.0, "remote": 1.5, "posted_at": 1.5,
    "salary_min": 2.0, "salary_max": 2.0, "salary_currency": 1.0, "salary_interval": 1.0, "employment_type": 1.0,
}


def quality_weights(profile: str = "core_fields_weighted", columns: list[str] | None = None, overrides: dict[str, float] | None = None) -> dict[str, float]:
    """The weights of a named profile (core_fields_weighted, strict_recruiting, equal_weight_all), some replaced or added."""
    named = {"core_fields_weighted": CORE_WEIGHTS, "strict_recruiting": STRICT_WEIGHTS, "equal_weight_all": dict.fromkeys(columns or (), 1.0)}
    if profile not in named:
        raise ValueError(f"no quality profile {profile!r}")
    weights = named[profile] | (overrides or {})
    if sum(weights.values()) <= 0:
        raise ValueError("the weights of a quality score must have a positive sum")
    return dict(sorted(weights.items()))


def long_form(row: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    """One row of figures, turned into a row for each name."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(f"`{n}`").alias(value)) for n in names])).alias("s")).select("s.*")


def _percent(count: Column) -> Column:
    """Of all rows; 0 where there are none."""
    return F.coalesce(F.try_divide(count * 100.0, F.count(F.lit(1))), F.lit(0.0))


def null_percentages(df: DataFrame) -> DataFrame:
    """(column, null_pct) of all columns, in one pass; 0 of an empty frame."""
    row = df.agg(*[_percent(F.count_if(F.col(c).isNull())).alias(c) for c in df.columns])
    return long_form(row, df.columns, "column", "null_pct")


def quality_score(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: rows and 100 less the weighted per cent of nulls. Weighted columns that are absent are all null; an empty frame has 100."""
    weights = weights or CORE_WEIGHTS
    n = F.count(F.lit(1))
    parts = [F.lit(w) * (_percent(F.count_if(F.col(c).isNull())) if c in df.columns else F.lit(100.0)) for c, w in weights.items()]
    nulls = sum(parts[1:], parts[0]) / sum(weights.values())
    return df.agg(n.alias("row_count"), F.when(n == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - nulls))).alias("score_percent"))


def top_values(df: DataFrame, column: str, k: int = 10, blanks: bool = True) -> DataFrame:
    """(value, count, pct) of the k most frequent values; the percentage is always of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    value = F.col(column).cast("string")
    some = df if blanks else df.where(F.coalesce(F.trim(value), F.lit("")) != "")
    top = some.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(k)
    return top.crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") * 100.0 / F.col("total")).alias("pct"))


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column, null_count, empty_count, sentinel_count, distinct_count) of all columns, in one pass."""
    distinct = F.count_distinct if exact else F.approx_count_distinct

    def figures(c: str) -> Column:
        text = F.lower(F.trim(F.col(c).cast("string")))
        return F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("null_count"), F.count_if(text == "").alias("empty_count"), F.count_if(text.isin(*SENTINELS)).alias("sentinel_count"), distinct(F.col(c)).alias("distinct_count"))

    row = df.agg(*[figures(c).alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*[F.col(f"`{c}`") for c in df.columns])).alias("s")).select("s.*")


def source_profile(df: DataFrame) -> DataFrame:
    """Rows, per cent with a date and per cent remote of each source; unknown counts as not remote."""
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return df.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("rows"), share(F.col("posted_at").isNotNull()).alias("posted_at_pct"), share(F.col("remote")).alias("remote_pct"))


def consistency(df: DataFrame, by: str | None = None) -> DataFrame:
    """Rows whose title is their company, and whose lowest salary is above their highest; of each source if asked."""
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.trim("title") == F.trim("company")).alias("title_is_company"), F.count_if(F.col("salary_min") > F.col("salary_max")).alias("salary_inverted")]
    return df.groupBy(by).agg(*counts) if by else df.agg(*counts)


def consistency_of_both(raw: DataFrame, runtime: DataFrame) -> DataFrame:
    """By source: rows of both frames, raw rows whose title is their company, runtime rows with inverted salaries, and per cents of each."""
    named = lambda df: df.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("<null>")))
    a = named(raw).groupBy("source").agg(F.count(F.lit(1)).alias("rows_raw"), F.count_if(strip(F.col("title")) == strip(F.col("company"))).alias("title_is_company"))
    b = named(runtime).groupBy("source").agg(F.count(F.lit(1)).alias("rows_runtime"), F.count_if(F.col("salary_min") > F.col("salary_max")).alias("salary_inverted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    pct = lambda c, n: F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.col(n)), F.lit(0.0)), 4)
    both = a.join(b, "source", "full").select("source", *[zero(c) for c in ("rows_raw", "rows_runtime", "title_is_company", "salary_inverted")])
    return both.withColumns({"title_is_company_pct": pct("title_is_company", "rows_raw"), "salary_inverted_pct": pct("salary_inverted", "rows_runtime")})


def quality_by_source(df: DataFrame, worst: int = 3, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted score of each source and its fields with the most nulls, in one grouping; absent fields are all null."""
    weights = {c: w for c, w in sorted((weights or CORE_WEIGHTS).items()) if w > 0}
    named = df.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("<null>")))
    pct = lambda c: _percent(F.count_if(F.col(c).isNull())) if c in df.columns else F.lit(100.0)
    grouped = named.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), *[pct(c).alias(f"_{c}") for c in weights])
    nulls = sum((F.col(f"_{c}") * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    order = F.array_sort(F.array(*[F.struct((-F.col(f"_{c}")).alias("p"), F.lit(c).alias("c")) for c in weights]))
    return grouped.select("source", "rows", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - nulls)).alias("score_percent"), F.transform(F.slice(order, 1, worst), lambda s: s["c"]).alias("worst_fields"))


def key_fields(df: DataFrame, fields: tuple[str, ...] = ("id", "title", "company", "location", "remote", "description_text", "posted_at", "apply_url")) -> DataFrame:
    """(field, non_null_count, non_null_pct), 4 places; absent fields have 0."""
    row = df.agg(*[F.struct(F.lit(c).alias("field"), (F.count(c) if c in df.columns else F.lit(0)).cast("long").alias("non_null_count"), F.round(_percent(F.count(c)) if c in df.columns else F.lit(0.0), 4).alias("non_null_pct")).alias(c) for c in fields])
    return row.select(F.explode(F.array(*[F.col(f"`{c}`") for c in fields])).alias("s")).select("s.*")


def high_sentinels(df: DataFrame, limit: int = 10) -> DataFrame:
    """(column, sentinel_pct) of the columns with the largest share of words that stand for nothing."""
    row = df.agg(*[_percent(F.count_if(F.lower(F.trim(F.col(c).cast("string"))).isin(*SENTINELS))).alias(c) for c in df.columns])
    return long_form(row, df.columns, "column", "sentinel_pct").where("sentinel_pct > 0").orderBy(F.desc("sentinel_pct"), "column").limit(limit)


#: Ranges that the distinct values of a column are cut into.
RANGES = 64


def decile_curves(values: DataFrame, by: list[str]) -> DataFrame:
    """(<by>, quantile, value): the value nearest to each tenth of the sorted rows of each group; ``values`` has the groups and ``value``.

    Distinct values are counted once for all groups, and kept. They are cut into ranges of about equal numbers of
    distinct values, whatever their spread; the rows of each range say which ranges hold the wanted places, and
    only these are sorted, each by itself. Groups are few (columns, or sides of a comparison): their cuts and the sums of their
    ranges, RANGES at most for each, come to the driver.
    """
    spark = values.sparkSession
    counted = kept(values.where("value is not null").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")), "counted")
    cuts = counted.groupBy(*by).agg(F.percentile_approx("value", [k / RANGES for k in range(1, RANGES)], 10_000).alias("cuts"))
    known = F.broadcast(spark.createDataFrame(cuts.collect(), cuts.schema))
    placed = counted.join(known, by).withColumn("slot", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    sums: dict[tuple, list[tuple[int, int]]] = {}
    for *group, slot, rows in placed.groupBy(*by, "slot").agg(F.sum("n").alias("rows")).collect():
        sums.setdefault(tuple(group), []).append((slot, rows))
    wanted = []
    for group, slots in sums.items():
        total, before = sum(n for _, n in slots), 0
        places = [(q, int(q / 10.0 * (total - 1) + 0.5)) for q in range(11)]
        for slot, n in sorted(slots):
            if held := [(q, place - before) for q, place in places if before <= place < before + n]:
                wanted.append((*group, slot, held))
            before += n
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema if f.name in by)
    needed = F.broadcast(spark.createDataFrame(wanted, f"{keys}, slot int, held array<struct<q:int,place:long>>"))
    within = placed.join(needed, [*by, "slot"]).withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "slot").orderBy("value")))
    found = within.withColumn("t", F.explode("held")).where((F.col("t.place") < F.col("upto")) & (F.col("t.place") >= F.col("upto") - F.col("n")))
    return found.select(*by, (F.col("t.q") / 10.0).alias("quantile"), "value")


def deciles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, quantile, value): the deciles of some columns; see decile_curves."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return decile_curves(df.select(F.explode(each).alias("s")).select("s.*"), ["column"])


def distribution_with_rest(df: DataFrame, column: str, k: int = 50) -> DataFrame:
    """(value, count): the k most frequent values and ``__other__`` for all the rest."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("__null__")).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), "value").limit(k)
    rest = counts.join(F.broadcast(top.select("value")), "value", "left_anti").agg(F.sum("count").alias("count")).where("count is not null").select(F.lit("__other__").alias("value"), "count")
    return top.unionByName(rest)


def _time(df: DataFrame, column: str) -> Column:
    return F.col(column) if dict(df.dtypes)[column].startswith("timestamp") else timestamp(F.col(column))


def time_range(df: DataFrame, column: str) -> DataFrame:
    """One row: the first and the last time that can be read, null if none."""
    return df.agg(F.min(_time(df, column)).alias("first"), F.max(_time(df, column)).alias("last"))


def monthly(df: DataFrame, column: str) -> DataFrame:
    when = _time(df, column)
    return df.select(F.date_format(when, "yyyy-MM").alias("month")).where("month is not null").groupBy("month").agg(F.count(F.lit(1)).alias("count"))


# -- differences ------------------------------------------------------------------------------------


def null_diff(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per cent of nulls of each column in either frame, 0 where it is absent, and the difference."""
    a, b = null_percentages(base).withColumnRenamed("null_pct", "base_pct"), null_percentages(candidate).withColumnRenamed("null_pct", "candidate_pct")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.join(b, "column", "full").select("column", zero("base_pct").alias("base_pct"), zero("candidate_pct").alias("candidate_pct"), (zero("candidate_pct") - zero("base_pct")).alias("delta_pct"))


def source_diff(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Two source_profile tables side by side: figures of both, 0 where a source is absent, and what changed."""
    names = ("rows", "posted_at_pct", "remote_pct")
    a, b = (df.select("source", *[F.col(c).alias(f"{side}_{c}") for c in names]) for side, df in (("base", base), ("candidate", candidate)))
    filled = a.join(b, "source", "full").na.fill(0)
    return filled.withColumns({f"delta_{c}": F.col(f"candidate_{c}") - F.col(f"base_{c}") for c in names})


def jensen_shannon(base: DataFrame, candidate: DataFrame, column: str, k: int = 50) -> DataFrame:
    """One row: the divergence of a column's distributions, natural logarithm.

    Of either frame the k most frequent values count as such and all others as one. Null if a frame is empty.
    """
    tiny = 1e-12

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = distribution_with_rest(df, column, k)
        total = counts.agg(F.sum("count").alias("total"))
        return counts.crossJoin(F.broadcast(total)).select("value", (F.col("count") / F.col("total")).alias(name))

    both = shares(base, "p").join(shares(candidate, "q"), "value", "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln((F.col(c) + tiny) / (F.col("m") + tiny))).otherwise(0.0)
    return both.agg(F.when((F.sum("p") > 0) & (F.sum("q") > 0), 0.5 * F.sum(part("p")) + 0.5 * F.sum(part("q"))).alias("jsd"))


def stability_index(base: DataFrame, candidate: DataFrame, column: str) -> DataFrame:
    """One row: the population stability index between decile curves, 22 values in all; null if a frame has no values."""
    tiny = 1e-9
    sides = [df.select(F.lit(side).alias("side"), F.col(column).cast("double").alias("value")) for side, df in (("x", base), ("y", candidate))]
    points = decile_curves(sides[0].unionByName(sides[1]), ["side"])
    # 11 points of either side, in one row
    curve = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("quantile", "value")))).alias(side)

    def below(c: Column, v: Column) -> Column:
        """The share of a curve at or below a value; straight lines between its points."""
        first, last = F.get(c, F.lit(0)), F.try_element_at(c, F.lit(-1))
        points = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        at = F.get(F.filter(points, lambda s: v < s["b"]["value"]), F.lit(0))
        return F.when(v < first["value"], first["quantile"]).otherwise(F.coalesce(at["a"]["quantile"] + (v - at["a"]["value"]) / (at["b"]["value"] - at["a"]["value"]) * (at["b"]["quantile"] - at["a"]["quantile"]), last["quantile"]))

    both = points.agg(curve("x"), curve("y"))
    share = lambda c, k: below(c, F.get(F.col("x"), k)["value"]) - below(c, F.get(F.col("x"), k - 1)["value"])

    def part(k: Column) -> Column:
        p, q = share(F.col("x"), k), share(F.col("y"), k)
        a, b = F.greatest(p, F.lit(tiny)), F.greatest(q, F.lit(tiny))
        return F.when((p <= tiny) & (q <= tiny), 0.0).otherwise((a - b) * F.ln(a / b))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("x") - 1), part), F.lit(0.0), lambda s, v: s + v)
    return both.select(F.when((F.size("x") > 1) & (F.size("y") > 1), total).alias("psi"))
