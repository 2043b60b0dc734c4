"""Problem 9: mixing sources to target weights, by weighted fair queueing.

Each source's records are shuffled (by hash) anew for every pass over them, at most max_repeats passes. A use of a record finishes
at the virtual time: tokens of its source up to and with it, divided by the source's weight. All uses are sorted by finish time and
truncated where the total budget is reached.

Where that is follows from the sources' sums: by the time v a source has used v times its weight, or all it has, less at most one
record. So the time is known at which the uses are surely within the budget, and one at which they surely exceed it; only uses between
the two, at most two records of the greatest size for each source, are sorted to find the last. No more passes over a source are made
than that time needs. Prefix sums are taken in two levels (ranges of the shuffle, then within each), so no source, however large, and
no stretch of time, is sorted by one task.

Source names are compared in one spelling (lower case, trimmed, _ as -). Without a budget the cut is the latest finish time at
which sources with at least REACHABLE of the whole weight still have uses left: these stand in exactly their targets' proportions,
and the others give all they may. The share reached is reported for every source of the targets, also where it has no records at all.

Defined results: records without tokens, without a source or of a source without target are never chosen; weights that are null
or not positive, and max_repeats below 1, choose nothing; targets given twice for one source count once (the greatest); a record
given twice is two records; a share of the budget is rounded down to whole tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.session import materialize

RANGE = 20_000  #: uses in one range of a source's shuffle, about
REACHABLE = 0.8  #: of the weight: sources that must reach their share, if no budget is given
SEED = 5


def spelled(source: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), "[_ ]+", "-"), F.lit(""))


def _time(sources: list[Row], tokens: float) -> float:
    """The virtual time at which the sources have used so many tokens; infinite if they have fewer."""
    lasts = sorted((r["t"] * r["max_repeats"] / r["weight"], r["weight"]) for r in sources)
    spent, v, rate = 0.0, 0.0, sum(w for _, w in lasts)
    for end, w in lasts:
        if spent + (end - v) * rate >= tokens:
            return v + (tokens - spent) / rate
        spent, v, rate = spent + (end - v) * rate, end, rate - w
    return float("inf")


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", budget: int | None = None, budget_share: float | None = None) -> DataFrame:
    """(key, source, use, tokens, finish) of the uses chosen from sized (key, source, tokens), in the order of their finish times.

    budget: tokens in all; budget_share: the same as a share of the tokens of all records that have a target."""
    goal = targets.select(spelled(F.col("source")).alias("source"), F.col("target_share").alias("weight"), "max_repeats").where("weight > 0 and max_repeats >= 1 and source is not null")
    goal = goal.groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("g")).select("source", "g.*")
    rows = sized.where("tokens > 0").select(F.col(key).alias("key"), spelled(F.col("source")).alias("source"), "tokens").join(goal, "source")
    rows = materialize(rows, "sized")
    sources = rows.groupBy("source", "weight", "max_repeats").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("most")).collect()  # a row per target
    if budget_share is not None:
        budget = int(budget_share * sum(r["t"] for r in sources))
    if budget is not None:
        sure, over = _time(sources, budget), _time(sources, budget + sum(r["most"] for r in sources))
    elif sources:
        lasts = sorted(((r["t"] * r["max_repeats"] / r["weight"], r["weight"]) for r in sources), reverse=True)
        need = REACHABLE * goal.agg(F.sum("weight")).head()[0]
        sure = over = next((v for i, (v, _) in enumerate(lasts) if sum(w for _, w in lasts[: i + 1]) >= need - 1e-9), lasts[-1][0]) * (1 + 1e-12)
    else:
        sure = over = 0.0
    passes = {r["source"]: int(min(r["max_repeats"], over * r["weight"] // r["t"] + 1)) for r in sources}
    ranges = max(1, -(-sum(r["n"] * passes[r["source"]] for r in sources) // RANGE))
    needed = F.coalesce(F.create_map(*[F.lit(x) for kv in passes.items() for x in kv])[F.col("source")], F.lit(0)) if passes else F.lit(0)
    use = rows.withColumn("use", F.explode(F.sequence(F.lit(1), needed)))
    use = use.withColumn("h", F.xxhash64("key", "use", F.lit(SEED)))
    # a range holds a stretch of the hash's values, so that ranges are in the shuffle's order
    use = use.withColumn("range", F.floor((F.col("h") / 2.0**64 + 0.5) * ranges).cast("int"))
    sums = use.groupBy("source", "use", "range").agg(F.sum("tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("use", "range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "use", "range", F.coalesce(before, F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "use", "range").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = use.withColumn("c", F.sum("tokens").over(within)).join(sums, ["source", "use", "range"])
    done = cumulated.select("key", "source", "use", "tokens", ((F.col("c") + F.col("before")) / F.col("weight")).alias("finish")).where(F.col("finish") <= over)
    if budget is None:
        return done.withColumnRenamed("key", key).orderBy("finish", "source", key)
    done = materialize(done, "finish")
    first = done.where(F.col("finish") <= sure)
    taken = first.agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0]
    # what is left: bounded by the greatest records of the sources
    order = Window.orderBy("finish", "source", "key").rowsBetween(Window.unboundedPreceding, 0)
    rest = done.where(F.col("finish") > sure).withColumn("c", F.sum("tokens").over(order)).where(F.col("c") <= budget - taken).drop("c")
    return first.unionByName(rest).withColumnRenamed("key", key).orderBy("finish", "source", key)


def shares(chosen: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(source, target_share, tokens, records, most_used, share) for every source of targets."""
    per = chosen.groupBy("source", key).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    got = per.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("n").alias("most_used"))
    goal = targets.select(spelled(F.col("source")).alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    out = goal.join(got, "source", "left").na.fill(0, ["tokens", "records", "most_used"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # a row per source of the targets
    return out.withColumn("share", F.coalesce(F.round(F.col("tokens") / F.nullif(whole, F.lit(0)), 6), F.lit(0.0)))
