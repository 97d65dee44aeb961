"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

Each source gets a repetition rate: its share of the target characters over the characters that it
has. Each document draws a uniform number from a hash of the seed and its own key, the Poisson
distribution with its source's rate is inverted at that number, and the row is repeated so many
times. The copies are dealt to tasks and sorted by a second hash, which shuffles the whole result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Without given weights, a source weighs as its characters to this power: small sources are repeated, large ones thinned.
TEMPERATURE = 0.7
SEED = "mix-1"
#: Longest tail of the distribution that is tabled, beyond the rate itself in standard deviations.
TAIL = 12
#: From this rate on the distribution's first term would run under; a draw is then the sum of draws of smaller, equal rates.
PART_RATE = 700
#: Copies of a row are made in blocks of so many, so that no array of one row grows with the rate.
BLOCK = 65_536
#: Up to so many numbers in all sources' tables, these are sent to all tasks; more are joined by shuffling, and Spark splits skewed sources.
FEW_NUMBERS = 1 << 21


def uniform(*parts: Column | str) -> Column:
    """A number above 0 and below 1 from the SHA-256 of the parts, joined by colons; 48 bits of it."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, repetition: float = 1.0) -> DataFrame:
    """(source_key, rate): mean repetitions of a document of each source. One row per source.

    With weights, a source gets its part of the sum of weights; sources without a weight get none.
    ``repetition`` times the characters of the table are the target. A null source counts as "null".
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("null")).alias("source_key")).agg(F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("double")).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(TEMPERATURE)))
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.create_map(F.lit("null"), F.lit(0.0))
        weighed = sizes.withColumn("weight", F.coalesce(F.try_element_at(known, F.col("source_key")), F.lit(0.0)))
    total = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))  # one row
    return weighed.crossJoin(F.broadcast(total)).select("source_key", F.when(F.col("all_weight") > 0, F.lit(repetition) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")).otherwise(0.0).alias("rate"))


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... until the tail is below what 48 bits can meet."""
    last = F.ceil(rate + TAIL * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    grown = F.aggregate(F.sequence(F.lit(1), last), start, lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k)).alias("c")))
    return grown["c"]


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, repetition: float = 1.0, seed: str = SEED, numbered: bool = True) -> DataFrame:
    """Each row as often as its draw says, with ``copy`` (from 0) and ``shuffle_key``, in shuffled order.

    All columns of the rows come back, whatever they are named; only ones called copy or shuffle_key give way to
    the results, and they too stay if the results aren't wanted (``numbered`` is false).

    The draw of a row hangs on the seed, its doc_id and its source's rate alone, so rows that agree in these
    share it; results don't depend on partitions. Null ids and sources count as "null", null texts as one character.
    An empty table stays empty. A rate of ``PART_RATE`` or more is met by several draws, each from a hash of its own,
    whose sum has that rate's distribution.
    """
    rates = source_rates(docs, weights, repetition).withColumn("_parts", F.floor(F.col("rate") / PART_RATE).cast("long") + 1)
    tables = written(rates.select("source_key", "_parts", poisson_table(F.col("rate") / F.col("_parts")).alias("cumulative")), "rates")
    if (tables.agg(F.sum(F.size("cumulative") + 8)).first()[0] or 0) <= FEW_NUMBERS:  # documents then stay where they are, however many one source has
        tables = F.broadcast(tables)
    own = [f"own_{n}" for n in range(len(docs.columns))]  # the caller's columns by place, so that no name clashes
    named = dict(zip(docs.columns, own, strict=True))
    rows = docs.toDF(*own).select(*own, F.col(named["doc_id"]).alias("id"), F.coalesce(named["source"], F.lit("null")).alias("source_key"))
    drawn = rows.join(tables, "source_key").withColumn("u", uniform(seed, F.col("id")))
    count = lambda u: F.size(F.filter("cumulative", lambda c: c <= u)).cast("long")
    several = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_parts")), lambda k: uniform(seed, "part", k, F.col("id")))
    counted = drawn.withColumn("copies", F.when(F.col("_parts") == 1, count(F.col("u"))).otherwise(F.aggregate(several, F.lit(0).cast("long"), lambda n, u: n + count(u))))
    blocks = counted.where("copies > 0").drop("cumulative", "u", "source_key", "_parts").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BLOCK).cast("long"))))
    copies = blocks.withColumn("copy", F.explode(F.sequence("_block", F.least(F.col("_block") + (BLOCK - 1), F.col("copies") - 1)))).drop("copies", "_block")
    keyed = copies.withColumn("shuffle_key", F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("copy")), 256), 1, 15), 16, 10).cast("long"))
    dealt = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    added = ["copy", "shuffle_key"] if numbered else []
    return dealt.select(*[F.col(x).alias(c) for c, x in named.items() if c not in added], *added)


MIXING_SQL = f"""
with sizes as (
    select coalesce(source, 'null') as source, sum(greatest(coalesce(length(text), 0), 1)::double) as size from documents group by 1
), weighed as (
    select source, size, pow(size, {TEMPERATURE}) as weight from sizes
), rates as (
    select source, sum(size) over () * weight / sum(weight) over () / size as rate from weighed
), terms(source, rate, k, p, c) as (
    with recursive t(source, rate, k, p, c) as (
        select source, rate, 0, exp(-rate), exp(-rate) from rates
        union all
        select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from t where k < ceil(rate + {TAIL} * sqrt(rate) + 20)
    ) select * from t
), drawn as (
    select *, (('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / {float(2**48)} as u from documents
), counted as (
    select d.doc_id, count(*) as copies from drawn d join terms t on coalesce(d.source, 'null') = t.source and t.c <= d.u group by d.doc_id
)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, copy,
    ('0x' || substr(sha256('{SEED}:order:' || d.doc_id || ':' || copy), 1, 15))::bigint as shuffle_key
from documents d join (select doc_id, unnest(range(copies)) as copy from counted) using (doc_id)
"""
