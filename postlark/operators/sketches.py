"""Profiles that merge: small sketches of each column, stored by group, from which a profile of any range is read.

A day's rows are read once. Distinct values are HyperLogLog sketches, quantiles KLL sketches, counts are counts; all of these can be
put together, so the profile of a month, or its drift against another one, reads one row a column, source and day
instead of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import SENTINELS

#: Base-2 logarithm of a distinct sketch's registers (relative standard error 0.83 / sqrt(2 ** LG_K)), and the size of a quantile sketch (rank error about 1.33 % at 200, in proportion).
LG_K, KLL_K = 12, 200
#: Quantiles that stand for a column when shares are asked for.
GRID = 400


def _text(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def sketched(df: DataFrame, by: list[str], columns: list[str], numeric: tuple[str, ...] = ()) -> DataFrame:
    """(<by>, column, rows, nulls, empties, sentinels, distinct_sketch, quantile_sketch): one row for each group and column.

    Every column is read in one pass, each row once a column. Quantiles are those of the columns named in ``numeric``, as doubles; NaN
    isn't a value there. Keep the table by days and sources, and merge what a question needs.
    """
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("text"), (F.col(f"`{c}`").try_cast("double") if c in numeric else F.lit(None).cast("double")).alias("number")) for c in columns])
    rows = df.select(*by, F.explode(each).alias("s")).select(*by, "s.*")
    number = F.when(~F.isnan("number"), F.col("number"))
    return rows.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("text").isNull()).alias("nulls"), F.count_if(_text(F.col("text")) == "").alias("empties"), F.count_if(_text(F.col("text")).isin(*SENTINELS)).alias("sentinels"),
        F.hll_sketch_agg("text", F.lit(LG_K)).alias("distinct_sketch"), F.kll_sketch_agg_double(number, F.lit(KLL_K)).alias("quantile_sketch"),
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The same table for coarser groups: what sketched would give for them, within the sketches' errors."""
    total = lambda c: F.sum(c).alias(c)
    return sketches.groupBy(*by, "column").agg(total("rows"), total("nulls"), total("empties"), total("sentinels"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def profile_of(sketches: DataFrame) -> DataFrame:
    """(..., rows, null_count, empty_count, sentinel_count, distinct_count): a column profile; distinct values within the sketch's error."""
    known = [c for c in sketches.columns if c not in ("rows", "nulls", "empties", "sentinels", "distinct_sketch", "quantile_sketch")]
    return sketches.select(*known, "rows", F.col("nulls").alias("null_count"), F.col("empties").alias("empty_count"), F.col("sentinels").alias("sentinel_count"), F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"))


def _quantiles(shares: list[float]) -> Column:
    """Quantiles of a sketch, whose shares have to be known when planning; null for a sketch without values."""
    return F.when(F.kll_sketch_get_n_double("quantile_sketch") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.array(*[F.lit(x) for x in shares])))


def curve_of(sketches: DataFrame) -> DataFrame:
    """(..., quantile, value): the deciles of columns with numbers; ranks within the sketch's error."""
    known = [c for c in sketches.columns if c not in ("rows", "nulls", "empties", "sentinels", "distinct_sketch", "quantile_sketch")]
    points = sketches.select(*known, _quantiles([q / 10 for q in range(11)]).alias("values")).where("values is not null")
    return points.select(*known, F.posexplode("values").alias("q", "value")).select(*known, (F.col("q") / 10.0).alias("quantile"), "value")


def drift_of(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(column, psi): the stability index between two merged profiles, over ten ranges cut at the base's deciles.

    Shares are those of GRID quantiles of either side at or below a cut; a range's share below 1e-9 counts as that. Both sides of a column meet in
    one row, so cuts and shares come from one reading of its sketch: merging sketches draws at random.
    """
    grid = _quantiles([(k + 0.5) / GRID for k in range(GRID)])
    cuts = _quantiles([q / 10 for q in range(1, 10)])
    both = base.select("column", cuts.alias("cuts"), grid.alias("x")).join(candidate.select("column", grid.alias("y")), "column").where("x is not null and y is not null")
    below = lambda side, cut: F.size(F.filter(side, lambda v: v <= cut)) / F.lit(float(GRID))
    ends = F.concat(F.array(F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))), F.transform("cuts", lambda c: F.struct(below("x", c).alias("p"), below("y", c).alias("q"))), F.array(F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("q"))))
    tiny = lambda x: F.greatest(x, F.lit(1e-9))
    parts = F.zip_with(F.slice(ends, 1, F.size(ends) - 1), F.slice(ends, 2, F.size(ends) - 1), lambda a, b: F.struct(tiny(b["p"] - a["p"]).alias("p"), tiny(b["q"] - a["q"]).alias("q")))
    return both.select("column", F.aggregate(parts, F.lit(0.0), lambda s, x: s + (x["p"] - x["q"]) * F.ln(x["p"] / x["q"])).alias("psi"))
