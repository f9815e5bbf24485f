"""Mixing sources to target weights by Poisson replication.

Each source's mean repetition rate is its target share of the output's characters over its share of the input's.  A row's
count is the inverse of the Poisson distribution with that mean at a number hashed from its id and
seed, so the same row always gets the same count and no state is shared.  Rows are exploded by their counts and shuffled
globally: dealt out and sorted by a hash of id, copy and seed.

Rates are not bounded, so a tiny source meets its weight too; a caller may bound them by ``most_rate`` and then misses targets.
Defined cases: a null source is a source of its own; sources without a target weight get ``other`` (0 by default: they go);
null texts have no characters and take their source's rate; a source without characters has rate 0.  Repeated rows of one id
get the same count; null ids share one number.  Texts are only measured and carried, however long.  Input columns called
``copy`` or ``mix_key`` stay as they are; the operator's own are then ``copy_`` or ``mix_key_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, free, small

NO_SOURCE = "\u0000null"


def uniform(*parts: Column | str, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest: the same in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


#: Rates up to which the partial sums start at 0: exp(-rate) underflows near 745.
FROM_ZERO = 500.0


def poisson_count(u: Column, rate: Column) -> Column:
    """The least k with P(Poisson(rate) <= k) > u: the number of partial sums of the distribution that are at most u.

    The sums run to rate + 12 sqrt(rate) + 20, beyond which less than 2**-52 is left.  Above ``FROM_ZERO`` they start at
    rate - 12 sqrt(rate) - 20, below which less than 2**-52 lies, with that term by Stirling's series.
    """
    spread = 12 * F.sqrt(rate) + 20
    large = rate > FROM_ZERO
    low = F.when(large, F.floor(rate - spread)).otherwise(0).cast("int")
    k0 = F.greatest(low, F.lit(1)).cast("double")
    stirling = F.exp(k0 - rate - k0 * F.log1p((k0 - rate) / rate) - 1 / (12 * k0) + 1 / (360 * k0 * k0 * k0)) / F.sqrt(2 * F.pi() * k0)
    first = F.when(large, stirling).otherwise(F.exp(-rate))
    start = F.struct(first.alias("term"), first.alias("total"), low.alias("n"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * rate / k
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"), (acc["n"] + (acc["total"] <= u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(low + 1, F.ceil(rate + spread).cast("int")), start, step, lambda acc: acc["n"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", text_col: str = "text", total: float | None = None, other: float = 0.0, most_rate: float | None = None, work: Workspace | None = None) -> DataFrame:
    """(source_key, rate): one row per source, written once.  Without ``weights`` all sources weigh the same; ``total`` is in characters."""
    spark = docs.sparkSession
    key = F.coalesce(docs[source_col].cast("string"), F.lit(NO_SOURCE))
    have = docs.select(key.alias("source_key"), F.length(docs[text_col]).alias("n")).groupBy("source_key").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chars"))
    work = work or Workspace(spark, "rates")
    have = work.table(have, "characters")
    if weights is None:
        have = have.withColumn("weight", F.lit(1.0))
    else:
        table = small(spark, [(NO_SOURCE if k is None else k, float(v)) for k, v in weights.items()], "source_key string, weight double")
        have = have.join(F.broadcast(table), "source_key", "left").withColumn("weight", F.coalesce("weight", F.lit(float(other))))
    sums = have.agg(F.sum("weight").alias("w"), F.sum("chars").alias("c"))
    # one row of sums against one row per source
    rates = have.crossJoin(F.broadcast(sums)).select("source_key", F.when(F.col("chars") > 0, F.col("weight") / F.col("w") * (F.lit(float(total)) if total else F.col("c")) / F.col("chars")).otherwise(0.0).alias("rate"))
    rates = rates if most_rate is None else rates.withColumn("rate", F.least("rate", F.lit(float(most_rate))))
    return work.table(rates, "rates")


#: Sources up to which their rates are broadcast: a few dozen bytes each.
BROADCAST_SOURCES = 50_000
#: Copies of a row that are listed at once: bounds the arrays that are exploded.
CHUNK = 1 << 16


def mix_sources(docs: DataFrame, rates: DataFrame, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", salts: int = 64) -> DataFrame:
    """``docs`` repeated by their counts, with ``copy`` (from 0) and ``mix_key``; dealt out and sorted by mix_key."""
    names = docs.columns
    copy, mix_key, own, salt, rate, count, begin = (free(c, names) for c in ("copy", "mix_key", "_source", "_salt", "_rate", "_count", "_from"))
    keyed = docs.withColumn(own, F.coalesce(docs[source_col].cast("string"), F.lit(NO_SOURCE)))
    rates = rates.select(F.col("source_key").alias(own), F.col("rate").alias(rate))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(rates), own)
    else:  # hot sources are salted
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(docs[id_col]), F.lit(salts)).cast("int")).join(salted, [own, salt])
    counted = joined.withColumn(count, poisson_count(uniform(id_col, seed=seed), F.col(rate))).where(F.col(count) > 0)
    chunks = counted.withColumn(begin, F.explode(F.sequence(F.lit(0), F.col(count) - 1, F.lit(CHUNK))))
    copies = chunks.withColumn(copy, F.explode(F.sequence(F.col(begin), F.least(F.col(count) - F.col(begin), F.lit(CHUNK)) + F.col(begin) - 1)))
    shuffled = copies.withColumn(mix_key, F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), copy)))
    return shuffled.select(*[F.col(f"`{c}`") for c in (*names, copy, mix_key)]).repartition(mix_key).sortWithinPartitions(mix_key)
