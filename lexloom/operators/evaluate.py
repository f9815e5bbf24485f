"""Retrieval evaluation: ranks of expected answers, hit tables, IR metrics, knob sweeps and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_of_expected(results: DataFrame, queries: DataFrame, hit: Column) -> DataFrame:
    """(qid, hit_rank): the least rank of a row that satisfies ``hit``, 0 if none."""
    best = results.where(hit).groupBy("qid").agg(F.min("rank").alias("hit_rank"))
    return queries.select("qid").distinct().join(best, "qid", "left").select("qid", F.coalesce("hit_rank", F.lit(0)).alias("hit_rank"))


def query_metrics(results: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(qid, n_relevant, hit1..., rr, ndcg, ap, recall) of each query with binary relevance.

    A query without relevant entries scores 0 everywhere and still counts.  Average precision divides by all relevant entries.
    ``results`` has qid, id, rank; ``relevant`` qid, id.
    """
    rel = relevant.select("qid", "id").distinct()
    flagged = results.where(F.col("rank") <= k).join(rel.withColumn("rel", F.lit(True)), ["qid", "id"], "left")
    counted = queries.select("qid").distinct().join(rel.groupBy("qid").agg(F.count("*").alias("n_relevant")), "qid", "left")
    return flagged_metrics(flagged, counted, k)


def flagged_metrics(results: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The same where relevance is a column: ``results`` has qid, rank, rel, ``queries`` qid and n_relevant (0 without it).

    What is relevant by an attribute is counted and compared, so no pairs of queries and relevant entries are written out.
    """
    flagged = results.where(F.col("rank") <= k).withColumn("rel", F.coalesce(F.col("rel").cast("int"), F.lit(0)))
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    flagged = flagged.withColumn("found", F.sum("rel").over(upto))
    per = flagged.groupBy("qid").agg(
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum("rel").alias("hits"),
        F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + F.lit(1.0)))).alias("dcg"), F.sum(F.when(F.col("rel") == 1, F.col("found") / F.col("rank"))).alias("precisions"),
    )
    n_relevant = F.col("n_relevant") if "n_relevant" in queries.columns else F.lit(0)
    # a query without relevant entries has none to divide by
    rows = queries.select("qid", F.when(n_relevant > 0, n_relevant).cast("long").alias("n")).dropDuplicates(["qid"]).join(per, "qid", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n").cast("int"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    hits = [F.coalesce(F.col("first") <= j, F.lit(False)).cast("int").alias(f"hit{j}") for j in (1, 2, 3, 5, 10) if j <= k]
    r6 = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    return rows.select("qid", F.coalesce("n", F.lit(0)).alias("n_relevant"), *hits, r6(1 / F.col("first"), "rr"), r6(F.col("dcg") / ideal, "ndcg"), r6(F.col("precisions") / F.col("n"), "ap"), r6(F.col("hits") / F.col("n"), "recall"))


def averages(metrics: DataFrame, *by: str) -> DataFrame:
    """Macro averages of the metric columns, over all queries or by groups."""
    names = [c for c in metrics.columns if c not in ("qid", "n_relevant", *by)]
    return metrics.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(c) for c in names])


def hit_table(ranks: DataFrame, excluded: str | None = None) -> DataFrame:
    """Hit@1, 2, 5 by category with a total row (category null) that leaves one category out.

    ``ranks`` has category and hit_rank.
    """
    hit = lambda k: F.sum(F.col("hit_rank").between(1, k).cast("int")).alias(f"hit{k}")
    cols = [F.count("*").alias("n"), hit(1), hit(2), hit(5)]
    total = ranks.where(F.col("category") != excluded) if excluded else ranks
    rows = ranks.groupBy("category").agg(*cols)
    return rows.unionByName(total.agg(*cols).withColumn("category", F.lit(None).cast("string")))


def hit_rollup(ranks: DataFrame) -> DataFrame:
    """The same by ROLLUP: the total leaves nothing out."""
    hit = lambda k: F.sum(F.col("hit_rank").between(1, k).cast("int")).alias(f"hit{k}")
    return ranks.rollup("category").agg(F.count("*").alias("n"), hit(1), hit(2), hit(5))


def latency_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Median, least and largest latency."""
    return rows.groupBy(*by).agg(F.percentile("latency_ms", 0.5).alias("median_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"))


def sweep(ranks: DataFrame, variants: list[str]) -> DataFrame:
    """A row for each query with its hit rank under each variant; ``ranks`` has qid, variant, hit_rank."""
    # by the number as a struct: see retrieval.summed
    return ranks.groupBy(F.struct("qid").alias("key")).pivot("variant", variants).agg(F.first("hit_rank")).select("key.qid", *variants)


def best_config(report: DataFrame, default: str) -> DataFrame:
    """The configuration of the best (mrr, hit1); of ties the default, then the fastest."""
    return report.orderBy(F.desc("mrr"), F.desc("hit1"), F.desc((F.col("config") == default).cast("int")), "latency_ms", "config").limit(1)


def gold_relevance(gold: DataFrame, forms: DataFrame) -> DataFrame:
    """(qid, id): entries of which some form is one of a query's expected answers; gold has qid, expected, forms form and id."""
    wanted = gold.select("qid", F.explode("expected").alias("form"))
    return wanted.join(forms.select("form", "id"), "form").select("qid", "id").distinct()


def prompt_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Mean words and jargon, analogy rate, and mean judge scores where there are any."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("words"), 1).alias("avg_words"), F.round(F.avg("jargon"), 1).alias("avg_jargon"), F.round(F.avg(F.col("analogy").cast("int")), 2).alias("analogy_rate"),
        F.round(F.avg("level_fit"), 2).alias("judge_level_fit"), F.round(F.avg("accuracy"), 2).alias("judge_accuracy"),
    )


def verdict(reply: Column) -> Column:
    """struct(level_fit, accuracy, comment) of a judge's reply; null scores and the reply's beginning if it has no JSON."""
    read = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "level_fit double, accuracy double, comment string")
    return F.struct(read["level_fit"].alias("level_fit"), read["accuracy"].alias("accuracy"), F.coalesce(read["comment"], F.substring(F.trim(reply), 1, 200)).alias("comment"))


def resolve_subsets(tokens: list[str], aliases: dict[str, list[str]], known: list[str]) -> list[str]:
    """Subset names with aliases expanded, in order and once; an unknown name is an error."""
    out = [c for t in tokens for c in aliases.get(t, [t])]
    if unknown := [c for c in out if c not in known]:
        raise ValueError(f"unknown subset: {', '.join(unknown)}")
    return list(dict.fromkeys(out))


def evaluation_sentences(gold: DataFrame, results: DataFrame, fallbacks: DataFrame, n: int) -> DataFrame:
    """(japanese, english) of n sentences: first examples of first relevant entries, then the fallbacks; repeated sentences once.

    ``gold`` gives the order (qid); ``results`` has qid, rank, example (struct of japanese, english); ``fallbacks`` has ord and both.
    """
    first = results.where("example is not null").groupBy("qid").agg(F.min_by("example", "rank").alias("e"))
    own = gold.join(first, "qid").select(F.lit(0).alias("tier"), F.col("qid").cast("long").alias("ord"), F.col("e.japanese").alias("japanese"), F.col("e.english").alias("english"))
    rest = fallbacks.select(F.lit(1).alias("tier"), F.col("ord").cast("long").alias("ord"), "japanese", "english")
    best = own.unionByName(rest).groupBy("japanese").agg(F.min(F.struct("tier", "ord", "english")).alias("m"))
    return best.orderBy("m.tier", "m.ord").limit(n).select("japanese", F.col("m.english").alias("english"))
