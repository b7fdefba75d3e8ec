"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate, its target share of the output over its share of the input. A document is
repeated by a Poisson count with that mean: the inverse distribution at a number in [0, 1) that is a digest of seed
and doc_id, so the draw is the same on every run, machine and partitioning. The copies are then sorted by a digest of
seed, doc_id and copy number: a global shuffle. Built-in functions only.

Scale: one aggregate with a row per source, and the sort of the copies. The rates are broadcast where they number at
most BROADCAST_SOURCES; beyond that the join is dealt out by source and salt, so no source meets in one task.

Defined results: a null source is a source of its own; null doc_id counts as the text "null" in the digest, so rows
without id in one source are repeated alike, as are repeated rows; null text and other columns pass through; a source
with weight 0 or without a weight goes; an empty table gives an empty result; texts of any length pass as they are.
Input columns named copy, n_copies or mix_key give way to those of the result; with tagged=False the result has the
input's columns only, such ones included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BROADCAST_SOURCES = 20_000
SALTS = 64
#: Means above this are drawn as sums of Poisson counts with smaller means, for exp(-mean) must not vanish.
PIECE = 200.0
ADDED = ("copy", "n_copies", "mix_key")


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict | None = None, temperature: float = 2.0, size_factor: float = 1.0) -> DataFrame:
    """source, n_docs, rate. Target shares are weights, or in proportion to n_docs to the power 1 / temperature."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weight = F.sqrt("n_docs") if temperature == 2.0 else F.pow(F.col("n_docs").cast("double"), F.lit(1.0 / temperature))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = staged(counts.withColumn("weight", weight.cast("double")), "sources")
    n, all_weight = weighed.agg(F.sum("n_docs"), F.sum(F.col("weight").cast("decimal(38, 15)"))).first()  # a sum that no order of rows changes
    wanted = F.lit((n or 0) * float(size_factor)) * F.col("weight") / F.lit(float(all_weight or 1.0))
    return weighed.select("source", "n_docs", F.when(F.col("weight") > 0, wanted / F.col("n_docs")).otherwise(0.0).alias("rate"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _distribution(mean: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... as far as a 52-bit number can tell it from 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    zero = F.exp(-mean)

    def step(s, k):
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.array_append(s["all"], s["c"] + p).alias("all"))

    start = F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step)["all"]


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, temperature: float = 2.0, size_factor: float = 1.0, seed: int = 17, broadcast_sources: int = BROADCAST_SOURCES, tagged: bool = True) -> DataFrame:
    """The copies in shuffled order: columns of docs and, if tagged, copy (from 1), n_copies, mix_key."""
    rates = source_rates(docs, source_col, weights, temperature, size_factor)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")
    rates = rates.select(F.col("source").alias("__source"), pieces.alias("__pieces"), _distribution(F.col("rate") / pieces).alias("__cdf"))
    few = rates.limit(broadcast_sources + 1).count() <= broadcast_sources
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    kept = [c for c in docs.columns if not tagged or c not in ADDED]
    rows = docs.select(F.col(source_col).alias("__source"), ident.alias("__id"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"))
    if few:
        joined = rows.join(F.broadcast(rates), rows["__source"].eqNullSafe(rates["__source"]))
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
        rates = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(rates, rows["__source"].eqNullSafe(rates["__source"]) & (rows["__salt"] == rates["__salt"]))
    draw = lambda i: F.size(F.filter("__cdf", lambda c: c <= uniform(F.lit(str(seed)), F.col("__id"), i.cast("string")))).cast("bigint")
    first = F.size(F.filter("__cdf", lambda c: c <= F.col("__u"))).cast("bigint")
    more = F.when(F.col("__pieces") > 1, F.aggregate(F.sequence(F.lit(2), F.greatest(F.col("__pieces"), F.lit(2))), F.lit(0).cast("bigint"), lambda s, i: s + draw(i))).otherwise(0)
    drawn = joined.withColumn("__u", uniform(F.lit(str(seed)), F.col("__id"), F.lit("1"))).select("__id", "__row", (first + more).alias("n_copies"))
    copies = drawn.filter("n_copies > 0").select("__id", "__row", "n_copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))).alias("copy"))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"shuffle{seed}"), "__id", F.col("copy").cast("string"))))
    return keyed.orderBy("mix_key", "__id", "copy").select("__row.*", *(ADDED if tagged else ()))
