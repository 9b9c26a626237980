"""Chains of pages, each with one successor (next links, redirects), by pointer doubling:
every page knows the one 2^k steps ahead, so a chain of n pages takes log2(n) rounds. A round
joins the table of jumps with itself by key; no chain is ever one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds, materialize


def _successors(pairs: DataFrame) -> DataFrame:
    """(at, to) of pairs (at, to): one successor for each page, the least if several are given."""
    return pairs.where("at is not null and to is not null").groupBy("at").agg(F.min("to").alias("to"))


def _doubled(jumps: DataFrame) -> DataFrame:
    further = jumps.select(F.col("at").alias("to"), F.col("to").alias("further"))
    return jumps.join(further, "to").select("at", F.col("further").alias("to"))


def walk(pairs: DataFrame, starts: DataFrame, most: int = 1 << 40) -> DataFrame:
    """(start, url, step): the pages that lead on from each start (start), by pairs (at, to), in
    order; a page met again ends a walk. A walk of over `most` steps raises.

    After round k the pages of the first 2^k steps are known; those 2^k ahead of them are the
    next ones. The walk is over when a round finds no page that its start didn't have.
    """
    jumps_kept, kept = Rounds("jumps"), Rounds("walk")
    jumps = jumps_kept.write(_successors(pairs))
    found = kept.write(starts.where("start is not null").select("start", F.col("start").alias("url"), F.lit(0).cast("long").alias("step")).distinct())
    count, ahead = found.count(), 1
    while True:
        more = found.join(jumps, found["url"] == jumps["at"]).select("start", F.col("to").alias("url"), (F.col("step") + ahead).alias("step"))
        found = kept.write(found.unionByName(more).groupBy("start", "url").agg(F.min("step").alias("step")))
        before, (count, longest) = count, found.agg(F.count("*"), F.coalesce(F.max("step"), F.lit(0))).first()
        if longest > most:
            raise RuntimeError(f"a walk goes on after {most} steps")
        if count == before:
            return found
        jumps, ahead = jumps_kept.write(_doubled(jumps)), 2 * ahead


def chain_ends(pairs: DataFrame) -> DataFrame:
    """(url, final, hops, loop): where the chain of each page that has a successor ends, after
    how many steps; loop is true, and final the least page of the loop, where it never does."""
    state_kept = Rounds("chains")
    state = _successors(pairs).select(F.col("at").alias("url"), F.col("to").alias("final"), F.lit(1).cast("long").alias("hops"), F.col("to").alias("least"))
    state, reach = state_kept.write(state), 1
    n = state.count()
    while True:
        # A page whose jump ends at one without a successor has its end; the others jump on.
        ahead = state.select(F.col("url").alias("final"), F.col("final").alias("on"), F.col("hops").alias("more"), F.col("least").alias("other"))
        on = state.join(ahead, "final", "left")
        going = F.col("on").isNotNull()
        state = on.select(
            "url", F.coalesce("on", "final").alias("final"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.least("least", F.coalesce("other", F.col("least"))).alias("least"), going.alias("going"),
        )
        state = state_kept.write(state)
        reach *= 2
        open_ended = state.where("going").limit(1).count()
        if not open_ended or reach > 2 * n:  # with over n steps behind it, what goes on is in a loop
            break
        state = state.drop("going")
    loops = state.where("going").select(F.col("url").alias("final"), F.col("least").alias("of_loop")) if open_ended else state.limit(0).select(F.col("url").alias("final"), F.col("least").alias("of_loop"))
    ended = state.where("not going").select("url", "final", "hops", F.lit(False).alias("loop"))
    looped = state.where("going").join(loops, "final").select("url", F.col("of_loop").alias("final"), F.lit(None).cast("long").alias("hops"), F.lit(True).alias("loop"))
    return materialize(ended.unionByName(looped), "chains")
