"""Document fingerprints by spot signatures, in DataFrame expressions only.

A signature starts at an anchor, one of the most common short words, and is the chain of content words
that follow it, anchors skipped. A document's fingerprint is the set of its signatures. Sets are compared
by Jaccard similarity, and only if their sizes allow the similarity asked for: sets are partitioned by
length so that a set meets those of its own and the next longer partition alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .rules import bound

#: Common words of English, German, French and Spanish.
ANCHORS = tuple(
    "the of and to a in is that it for was on are as with be by this at from or have an they which "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur "
    "el y los se del las con no por su para al lo como".split()
)
#: Content words in a chain, and how far ahead of its anchor it may reach, in words.
CHAIN, AHEAD = 2, 8
#: Consecutive documents that are put side by side: those whose doc_id agrees but for so many low bits.
SIDE_BITS, LEVEL_BITS = 8, 12
#: Up to so many groups, where the first of each goes is sent to all tasks; more are joined by shuffling.
FEW_GROUPS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")


def signatures(text: Column) -> Column:
    """The sorted distinct 40-bit signatures of a text (never null here).

    A text without a chain after an anchor takes every word for an anchor; one with a single word has that
    word's signature; one without words has none.
    """
    name = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit((1 << 40) - 1))

    def chains(w: Column, start) -> Column:
        def after(i: Column) -> Column:
            ahead = F.filter(F.array(*[F.get(w, i + k) for k in range(1, AHEAD + 1)]), lambda x: x.isNotNull() & ~x.isin(*ANCHORS))
            return bound(ahead, lambda c: F.when(F.size(c) >= CHAIN, name(F.get(w, i), *[F.get(c, F.lit(k)) for k in range(CHAIN)])))

        return F.array_compact(F.transform(F.filter(F.transform(w, lambda x, i: F.when(start(x), i)), lambda i: i.isNotNull()), after))

    def of_words(w: Column) -> Column:
        spots = chains(w, lambda x: x.isin(*ANCHORS))
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: name(F.get(w, i), F.get(w, i + 1)))
        rest = F.when(F.size(w) > 0, pairs).otherwise(F.array().cast("array<bigint>"))
        return bound(spots, lambda s: F.array_sort(F.array_distinct(F.when(F.size(s) > 0, s).otherwise(rest))))

    return bound(words(text), of_words)


def fingerprint(sigs: Column) -> Column:
    """The set as text: hexadecimal signatures in ascending order, joined by commas."""
    return F.array_join(F.transform(sigs, lambda x: F.hex(x)), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total > 0, both / (total - both)).otherwise(1.0).cast("double")


def _neighbours(keys: DataFrame, bits: int = LEVEL_BITS, levels: int = 3) -> DataFrame:
    """(key, before): the next smaller key of each; null for the least. Each key comes once.

    Keys are compared within groups that agree but for the low bits; the groups' own neighbours are found
    in the same way one level up, so no task holds all keys.
    """
    if not levels:
        return keys.withColumn("before", F.lag("key").over(Window.orderBy("key")))
    group = F.shiftright("key", bits)
    within = keys.withColumn("group", group).withColumn("before", F.lag("key").over(Window.partitionBy("group").orderBy("key")))
    ends = keys.groupBy(group.alias("group")).agg(F.max("key").alias("last"))
    above = _neighbours(ends.select(F.col("group").alias("key")), bits, levels - 1)
    bridge = above.join(ends.withColumnRenamed("group", "before"), "before").select(F.col("key").alias("group"), "last")
    return within.join(bridge, "group", "left").select("key", F.coalesce("before", "last").alias("before"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the next document by doc_id; after the last comes the first.

    Documents that are near by doc_id are put into one group, and the first of each group also into the
    group before, as a guest: every document is moved once. Rows that share a doc_id follow one another by
    their texts; a null doc_id comes before all others.
    """
    keyed = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_group", F.shiftright("_id", SIDE_BITS))
    groups = written(docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_id")).groupBy(F.shiftright("_id", SIDE_BITS).alias("_group")).agg(F.min("_id").alias("_first")), "groups")
    before = _neighbours(groups.select(F.col("_group").alias("key")))
    last = groups.agg(F.max("_group").alias("_last"))  # one row
    host = written(before.crossJoin(F.broadcast(last)).select(F.col("key").alias("_group"), F.coalesce("before", "_last").alias("_host")).join(groups, "_group"), "hosts")
    placed = keyed.join(F.broadcast(host) if host.count() <= FEW_GROUPS else host, "_group").withColumn("_place", F.explode(F.when(F.col("_id") == F.col("_first"), F.array(F.struct(F.lit(0).alias("guest"), F.col("_group").alias("group")), F.struct(F.lit(1).alias("guest"), F.col("_host").alias("group")))).otherwise(F.array(F.struct(F.lit(0).alias("guest"), F.col("_group").alias("group"))))))
    order = Window.partitionBy("_place.group").orderBy("_place.guest", "_id", "text")
    led = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where("_place.guest = 0").drop("_id", "_group", "_first", "_host", "_place")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last quarter of code points replaced by the first as many (or all) of the next
    document. Null texts count as empty. An empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = with_next(plain.withColumn("sigs", signatures(F.col("text"))), ["text", "sigs"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    both = signed.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    return both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_copies(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of documents whose fingerprints are alike enough, between classes of equal fingerprints.

    ``a`` and ``b`` are the least doc_ids of their classes. Sets are partitioned by length (bounds grow by
    1 / similarity); candidates share a signature of their prefixes in order of rarity, lie in the same or
    neighbouring partitions, and sizes too far apart are pruned before sets are intersected.
    """
    sets = docs.where("doc_id is not null").select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs")).where(F.size("sigs") > 0)
    classes = sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id"))
    counts = classes.select(F.explode("sigs").alias("sig")).groupBy("sig").count()
    ranked = classes.select("doc_id", F.explode("sigs").alias("sig")).join(counts, "sig").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("o"))
    n = F.size("o")
    prefix = ranked.select("doc_id", n.alias("n"), F.floor(F.log(n) / math.log(1 / similarity)).alias("part"), F.transform("o", lambda s: s["sig"]).alias("sigs"), F.explode(F.slice("o", F.lit(1), n - F.ceil(n * F.lit(similarity)).cast("int") + 1)).alias("s")).where("s.count > 1").select("doc_id", "n", "part", F.col("s.sig").alias("sig"))
    a, b = prefix.alias("a"), prefix.select("*", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("meets")).alias("b")
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.part") == F.col("b.meets")) & ((F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.doc_id") < F.col("b.doc_id")))).where(F.col("a.n") >= similarity * F.col("b.n")).select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).distinct()
    left, right = classes.select(F.col("doc_id").alias("x"), F.col("sigs").alias("s")), classes.select(F.col("doc_id").alias("y"), F.col("sigs").alias("t"))
    scored = pairs.join(left, "x").join(right, "y").withColumn("likeness", likeness(F.col("s"), F.col("t"))).where(F.col("likeness") >= similarity)
    return scored.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")
