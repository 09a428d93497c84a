"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks.  With weights w of total W, the i-th block of a source is released at
slot floor((i - 1) * W / w) and due at ceil(i * W / w); earliest deadline first among released blocks
fills every slot, and after any number of slots t a source has had t * w / W blocks, give or take less
than one.  The schedule repeats every W slots, so one period settles all blocks.  When a source runs
out, the others go on in the same way with the weights that are left.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest period that the driver lays out.
MOST_SLOTS = 1_000_000
#: Rows that one ranking group holds, about.
RANKED_ROWS = 4096
#: Most piles of equal rows that are ranked as one row each; this bounds what is sent to every task.
MOST_PILES = 100_000
OTHER = "other"


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source within one period."""
    total = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    released, ready = [(0, s) for s in weights], []
    heapq.heapify(released)
    for t in range(total):
        while released and released[0][0] <= t:
            s = heapq.heappop(released)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // weights[s]), s))
        s = heapq.heappop(ready)[1]
        slots[s].append(t)
        if len(slots[s]) < weights[s]:
            heapq.heappush(released, (len(slots[s]) * total // weights[s], s))
    return slots


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[tuple]:
    """(source, first block, block after the last, first slot, period, its slots in a period) of each
    source between two ends of sources."""
    left = {s: n for s, n in blocks.items() if n}
    done, start, laid = dict.fromkeys(left, 0), 0, []
    while left:
        now = {s: weights[s] for s in left}
        total, slots = sum(now.values()), period(now)
        ends = {s: (n - 1) // now[s] * total + slots[s][(n - 1) % now[s]] + 1 for s, n in left.items()}
        length = min(ends.values())
        for s in now:
            had = length // total * now[s] + sum(x < length % total for x in slots[s])
            if had:
                laid.append((s, done[s], done[s] + had, start, total, slots[s]))
            done[s] += had
            left[s] -= had
        left, start = {s: n for s, n in left.items() if n}, start + length
    return laid


def shared_weights(docs: DataFrame, weights: dict[str, int], source_col: str = "source") -> dict[str, int]:
    """weights with a weight of its own for every source of docs.

    The sources that weights does not name share the weight of 'other' equally, in the ratio to the
    named ones that weights give; a null source, with one named 'other', is one of them.  The driver
    counts and lays out all sources: their number is meant to be in the hundreds at most.
    """
    named = {s: w for s, w in weights.items() if s != OTHER}
    present = {r[0] for r in docs.select(F.coalesce(F.col(source_col), F.lit(OTHER))).distinct().collect()}
    rest = sorted(present - named.keys())
    if not rest:
        return dict(weights)
    spread = {s: w * len(rest) for s, w in named.items()} | dict.fromkeys(rest, weights.get(OTHER, 1))
    least = math.gcd(*spread.values())
    return {s: w // least for s, w in spread.items()}


def mix_sources(docs: DataFrame, weights: dict[str, int], other_weight: int = 1, block_rows: int = 64, source_col: str = "source") -> DataFrame:
    """docs with mix_slot, the block's place in the mix, and mix_row, the row's place in its block.

    weights are positive integers by source; their number bounds what the driver counts and lays out.
    Sources not named, and a null source, share one queue of weight other_weight, called 'other'; a
    source named so joins it.  Rows of a queue stand in the order of xxhash64 of all their columns, so
    the order is fixed and no order of the input shows through; equal rows stand side by side.  Every
    row comes back once, repeated rows included; the last block of a queue may be short.  An empty table gives an empty result.
    Columns of docs called mix_slot or mix_row are replaced.
    """
    weights = {s: w for s, w in weights.items() if s != OTHER} | {OTHER: weights.get(OTHER, other_weight)}
    if any(not isinstance(w, int) or w < 1 for w in weights.values()) or sum(weights.values()) > MOST_SLOTS:
        raise ValueError(f"weights must be positive integers that sum to {MOST_SLOTS} at most")
    kept = [c for c in docs.columns if c == source_col or c not in ("mix_slot", "mix_row")]
    named = [s for s in weights if s != OTHER]
    queue = F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)
    rows = docs.select(F.struct(*kept).alias("row"), queue.alias("queue"), F.xxhash64(*kept).alias("order"))

    sizes = {r["queue"]: r["n"] for r in rows.groupBy("queue").agg(F.count("*").alias("n")).collect()}
    lots = max(1, math.ceil(sum(sizes.values()) / RANKED_ROWS))
    rows = rows.withColumn("lot", F.floor((F.col("order") / 2.0**64 + 0.5) * lots))
    # equal rows share one order: their rows are told apart by a bare count, not ranked in one window
    copies = rows.groupBy("queue", "lot", "order").agg(F.count("*").alias("n"))
    many = copies.filter(F.col("n") > max(RANKED_ROWS, sum(sizes.values()) // MOST_PILES))
    if many.isEmpty():
        ranked = _ranked(rows, lots)
    else:
        # one row stands for each pile of equal ones
        piled = F.broadcast(many.select("order", F.col("n").alias("pile")).groupBy("order").agg(F.sum("pile").alias("pile")))
        apart = rows.join(piled, "order", "left")
        one = rows.join(piled, "order").dropDuplicates(["queue", "order"]).select("row", "queue", "order", "lot", "pile")
        ranked = _ranked(apart.filter("pile is null").unionByName(one), lots, F.coalesce("pile", F.lit(1)))
        ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.coalesce("pile", F.lit(1)) - 1)))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_rows))

    laid = phases(weights, {s: -(-n // block_rows) for s, n in sizes.items()})
    plan = docs.sparkSession.createDataFrame(laid, "p_queue string, first long, stop long, base long, total long, slots array<long>")
    # as many rows as sources times ends of sources, which the weights bound
    placed = ranked.join(F.broadcast(plan), (F.col("queue") == F.col("p_queue")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("stop")))
    nth, own = F.col("block") - F.col("first"), F.size("slots")
    slot = F.col("base") + F.floor(nth / own) * F.col("total") + F.get("slots", (nth % own).cast("int"))
    return placed.select(*[F.col("row")[c].alias(c) for c in kept], slot.cast("long").alias("mix_slot"), (F.col("rank") % block_rows).cast("long").alias("mix_row"))


def _ranked(rows: DataFrame, lots: int, weight: Column | None = None) -> DataFrame:
    """rows with rank: how many rows of the queue stand before, by lots and within the own one."""
    weight = F.lit(1) if weight is None else weight
    before = Window.partitionBy("queue").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    lot = rows.groupBy("queue", "lot").agg(F.sum(weight).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("queue", "lot").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    # as many partitions as lots: a task ranks a bounded number of rows at any size
    dealt = rows.repartition(max(lots, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "queue", "lot")
    placed = dealt.withColumn("place", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(lot, ["queue", "lot"])
    return placed.withColumn("rank", F.col("before") + F.col("place"))
