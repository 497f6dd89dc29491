"""Mixing sources to target weights by fitting a subset sum.

A source's target is met by a number of copies of each exact length, MOST for
each document at most. The copies by length are lowered in proportion, the
longest lengths first, with what rounding leaves carried on. A dynamic program
over the bounded counts then fits the remaining budget to the nearest sum there
is, above or below: some copies are handed back, the shortest first, until the
rest is a small number of words (ROOMS, one after another until a sum fits), and
a knapsack finds what to take instead. It keeps one number for each sum up to
the rest and at most the longest text more, whatever the number of lengths. A
budget below the last of ROOMS is thus fitted over all documents. Copies of a
length go to its documents evenly, the extra ones to the first by a seeded hash
of their id, so reruns agree.

Only counts by source and length reach the dynamic program, one source at a
time; they are bounded by the number of lengths, not of documents. Ranks within
a length are found in hash ranges, so a third of all rows with one source and
length is no task of its own.

Null text: size 0, taken 0. A null source is a source, the last. Rows without a
doc_id are left out. Texts of no words take part with size 0. Rows that repeat a
doc_id are rows of their own; those that agree in all columns are told apart by
nothing, and the mix has as many of them as all together are taken. An empty
table gives no rows. Extra columns, whatever their names, play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlake.llm.scratch import Scratch, documents

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MOST = 1.5, 2.0
SEED = 20240607
#: Documents of one source, length and hash range, about.
RANGE_ROWS = 5000
#: Words that the knapsack decides about, in turn.
ROOMS = (1 << 10, 1 << 13, 1 << 16)


def _knapsack(weights: list[int], counts: list[int], goal: float, over: int) -> list[int]:
    """How many of each weight to take for the sum nearest to ``goal``, at most ``over`` above it; the lower of two as near."""
    limit = math.floor(goal) + over
    first = np.full(limit + 1, -1, np.int32)  # the step that reached a sum first
    first[0] = 0
    exact = math.floor(goal) if goal - math.floor(goal) <= 0.5 or not over else math.ceil(goal)
    steps: list[tuple[int, int]] = [(0, 0)]
    for i in sorted(range(len(weights)), key=lambda i: weights[i]):
        free, part = (min(counts[i], limit // weights[i]) if weights[i] > 0 else 0), 1
        while free > 0 and first[exact] < 0:  # counts go in as powers of two
            use = min(part, free)
            steps.append((i, use))
            move = use * weights[i]
            new = (first[: limit + 1 - move] >= 0) & (first[move:] < 0)
            first[move:][new] = len(steps) - 1
            free, part = free - use, part * 2
    sums = np.flatnonzero(first >= 0)
    at = int(sums[np.argmin(np.abs(sums - goal))])
    taken = [0] * len(weights)
    while at:  # a sum was reached from one of an earlier step
        i, use = steps[first[at]]
        taken[i] += use
        at -= use * weights[i]
    return taken


def fit(lengths: list[int], counts: list[int], budget: float, above: bool = False) -> list[int]:
    """How many of each length to take so that the words come nearest to ``budget``: from below or, if ``above``, from either side."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    total = sum(n * c for n, c in zip(lengths, counts))
    start = [0] * len(lengths)
    if total <= 0 or budget <= 0:
        return start
    if budget >= total:
        return list(counts)
    due = got = 0
    whole = math.floor(budget)
    for i in order:
        if lengths[i] > 0:
            due += lengths[i] * counts[i]
            want = whole * due // total - got
            start[i] = max(0, min(counts[i], want // lengths[i]))
            got += start[i] * lengths[i]
    best, rest, kept = None, budget - got, list(start)
    for room in ROOMS:
        # Hand copies back, the shortest first, so that the program has room to change the sum.
        while rest <= room and any(kept):
            for i in reversed(order):
                if kept[i] and lengths[i] > 0:
                    back = min(kept[i], max(1, int((room - rest) // lengths[i])))
                    kept[i] -= back
                    rest += back * lengths[i]
                    if rest > room:
                        break
        more = _knapsack(lengths, [c - k for c, k in zip(counts, kept)], rest, min(math.ceil(rest), lengths[order[0]]) if above else 0)
        error = abs(rest - sum(n * c for n, c in zip(lengths, more)))
        if best is None or error < best[0]:
            best = (error, [a + b for a, b in zip(kept, more)])
        if error <= 0.5:
            break
    return best[1]


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    n = rows["n"].tolist()
    copies = fit(rows["size"].tolist(), [int(MOST) * c for c in n], float(rows["target"].iloc[0]), above=True)
    return rows[["source", "size"]].assign(passes=[c // k for c, k in zip(copies, n)], extra=[c % k for c, k in zip(copies, n)])


def targets(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size, weight, target; the excess over MOST times a source's size goes to the others by weight."""
    spark = sources.sparkSession
    # The place of a source in code point order, found by range and without one task for all.
    order = [F.col("source").asc_nulls_last()]  # Spark compares UTF-8 bytes, which is code point order
    ranged = scratch.save(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("part").orderBy(*order)
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    at, starts = 0, []
    for part in sorted(counts):
        starts.append((part, at))
        at += counts[part]
    starts = spark.createDataFrame(starts, "part int, first long")
    place = F.pmod(F.col("first") + F.row_number().over(before) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int"))
    weighted = scratch.save(ranged.join(F.broadcast(starts), "part").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST).alias("most")), "weighted")
    total = weighted.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    share = 0.0
    # Each turn tops out at least one more source, or ends. It is a Newton step on a concave, piecewise linear function:
    # words still to place times the open weight falls to a quarter a turn, so turns grow with the logarithm of the number of sources.
    while True:
        full = (F.col("weight") * share >= F.col("most")) & F.lit(share > 0)
        left = weighted.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        after = (BUDGET * total - left["fixed"]) / left["open"] if left["open"] else share
        if math.isclose(after, share, rel_tol=1e-12, abs_tol=0.0) or not left["open"]:
            break
        share = after
    return weighted.select("source", "source_size", F.least("most", F.col("weight") * share).alias("target"))


def mix(docs: DataFrame, scratch: Scratch, row=None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document; ``row``, a hash of the row, is carried along as such."""
    sized = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long")).alias("draw"), (F.lit(0).cast("long") if row is None else row).alias("row"),
    )
    sized = scratch.save(sized, "sized")
    sources = scratch.save(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    goals = scratch.save(targets(sources, scratch), "targets")
    counts = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    same = counts["source"].eqNullSafe(goals["source"])
    plan = counts.join(goals, same).select(counts["source"], "size", "n", "target").groupBy("source").applyInPandas(_fit_source, "source string, size long, passes long, extra long")
    plan = scratch.save(plan, "plan")
    ranges = max(1, sized.count() // RANGE_ROWS)
    keyed = sized.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source", "size", "draw", F.pmod("draw", F.lit(ranges)).alias("range"), "row")
    keyed = scratch.save(keyed, "keyed")
    per = keyed.groupBy("key", "size", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "size", "passes", "extra")
    room = per.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(plan, ["key", "size"]).select("key", "size", "range", "passes", (F.col("extra") - F.col("first")).alias("room"))
    place = F.row_number().over(Window.partitionBy("key", "size", "range").orderBy("draw", "doc_id", "row"))
    taken = F.col("size") * (F.col("passes") + F.when(place <= F.col("room"), 1).otherwise(0))
    ranked = keyed.join(room, ["key", "size", "range"]).select("doc_id", "source", "size", taken.alias("taken"), "row")
    done = scratch.save(ranked, "ranked")
    scratch.drop("sized", "keyed", "plan")
    out = done.join(goals, done["source"].eqNullSafe(goals["source"]))
    return out.select("doc_id", done["source"], "size", "source_size", "target", "taken", *([] if row is None else ["row"]))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    scratch = Scratch(docs.sparkSession, "mixed")
    taken = mix(docs, scratch, row).where("taken > 0").groupBy("doc_id", "row").agg(F.sum(F.expr("int(taken div size)")).cast("int").alias("times"), F.count("*").alias("rows"))
    taken = scratch.save(taken, "times")
    # The columns of docs travel in a struct, so that none of them can clash.
    packed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.struct(*columns).alias("doc"))
    out = packed.join(taken.where("rows = 1").hint("merge"), ["doc_id", "row"])
    several = taken.where("rows > 1")
    if not several.isEmpty():  # one of each set of equal rows, before anything is sorted
        out = out.unionByName(packed.join(several, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]))
    return out.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select("doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), Scratch(spark, "op8")).drop("source")


QUERIES = {"op8_mixing": op8_mixing}
ORACLE: dict[str, str] = {}
