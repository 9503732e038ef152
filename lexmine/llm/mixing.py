"""Mixing sources to target weights: subset-sum budget fitting.

Sources, in code point order with null last, weigh ``weights`` repeating and share ``total`` times all
sizes; no source gets more than ``repeat`` times its size, the excess is reshared by weight.  Of each
source every document is taken ``floor(target / size)`` times (capped), and the remaining budget is filled
by once-more documents: documents are counted by exact length, every length first gives its proportional
share, then bounded-knapsack dynamic programming over the lengths fits what is left.  Which documents of a
length are taken follows a seeded hash.

Defined results: null and empty texts have size 0 and are never taken; an empty source has target 0; fully
equal rows are interchangeable; no document is taken more than ``repeat`` times; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lexmine.llm.common import documents, prepare, staged, word_array


@dataclass(frozen=True)
class Params:
    """``slots``: hash cells that a (source, length) group is cut into when documents are picked."""

    weights: tuple = (5, 2, 1)
    total: float = 1.5
    repeat: int = 2
    seed: int = 29
    slots: int = 4096
    window: int = 8192


def targets(sizes: list[tuple[str | None, int]], p: Params = Params()) -> dict[str | None, float]:
    """Target words of each source; ``sizes`` is (source, words)."""
    order = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    weight = {s: p.weights[i % len(p.weights)] for i, s in enumerate(order)}
    size = dict(sizes)
    out: dict[str | None, float] = {}
    free, left = set(order), p.total * sum(size.values())
    while free:
        whole = sum(weight[s] for s in order if s in free)
        full = [s for s in order if s in free and left * weight[s] / whole >= p.repeat * size[s]]
        if not full:
            out.update({s: left * weight[s] / whole for s in order if s in free})
            break
        for s in full:
            out[s] = float(p.repeat * size[s])
            free.discard(s)
        left -= sum(out[s] for s in full)
    return out


def fit_counts(lengths: dict[int, int], budget: int, window: int) -> dict[int, int]:
    """How many documents of each length make up ``budget`` words, as near as can be.

    Proportional floors, then long to short down to ``window`` words, then a bitset knapsack over bounded
    counts (split in powers of two) for the rest.
    """
    total = sum(n * c for n, c in lengths.items())
    if budget >= total:
        return dict(lengths)
    take = {n: c * budget // total for n, c in lengths.items()} if total else {}
    rest = budget - sum(n * c for n, c in take.items())
    for n in sorted(lengths, reverse=True):
        more = min(lengths[n] - take[n], max(0, rest - window) // n)
        take[n] += more
        rest -= more * n
    reach, steps = 1, []
    mask = (1 << (rest + 1)) - 1
    for n in sorted(lengths):
        spare, k = min(lengths[n] - take[n], rest // n), 1
        while spare > 0:
            c = min(k, spare)
            new = (reach | (reach << (c * n))) & mask
            if new != reach:
                steps.append((n, c, reach))
                reach = new
            spare -= c
            k *= 2
        if (reach >> rest) & 1:
            break
    at = reach.bit_length() - 1
    for n, c, before in reversed(steps):
        if not (before >> at) & 1:
            at -= c * n
            take[n] += c
    return take


def plan(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(rows, picks): narrow rows with their hash, and per (source, size) how many get one copy more."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"),
        F.xxhash64(F.lit(p.seed), "doc_id", "text").alias("u"))
    hist = staged(rows.groupBy("source", "size").agg(F.count("*").alias("docs")), "mix-lengths")
    per_source = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("words")).collect()  # a row a source
    goal = targets([(r["source"], r["words"]) for r in per_source], p)
    plan_rows = []
    for r in per_source:
        t, s = goal[r["source"]], r["words"]
        base = min(p.repeat, int(t // s)) if s else 0
        plan_rows.append((r["source"], s, t, base, int(round(t - base * s)) if base < p.repeat else 0))
    budgets = spark.createDataFrame(plan_rows, "source string, source_size long, target double, base int, budget long")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        lengths = {int(n): int(c) for n, c in zip(group["size"], group["docs"])}
        got = fit_counts(lengths, int(group["budget"].iloc[0]), p.window)
        return pd.DataFrame({"source": group["source"], "size": group["size"], "pick": [got[int(n)] for n in group["size"]]})

    # a group holds the distinct lengths of a source, not its documents
    need = hist.where("size > 0").join(F.broadcast(budgets).withColumnRenamed("source", "b_source"), F.col("source").eqNullSafe(F.col("b_source")))
    picks = need.groupBy("source").applyInPandas(fit, "source string, size long, pick long")
    return rows.join(F.broadcast(budgets.withColumnRenamed("source", "b_source")), F.col("source").eqNullSafe(F.col("b_source"))).drop("b_source", "budget"), picks


def mix(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, u) of every row."""
    rows, picks = plan(docs, p)
    rows = rows.withColumn("slot", F.pmod("u", F.lit(p.slots)))
    # documents of a length are taken slot by slot; only the slot in which the count is reached is ranked
    cells = rows.where("size > 0").groupBy("source", "size", "slot").agg(F.count("*").alias("n"))
    up = W.partitionBy("source", "size").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0)))
    named = picks.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "pick")
    cells = cells.join(named, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    part = cells.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("slot").alias("c_slot"),
                        F.greatest(F.lit(0), F.col("pick") - F.col("before")).alias("quota"))
    got = rows.join(part, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("slot") == F.col("c_slot")), "left")
    rank = F.row_number().over(W.partitionBy("source", "size", "slot").orderBy("u", "doc_id"))
    more = (rank <= F.coalesce("quota", F.lit(0))).cast("int")
    copies = F.when(F.col("size") > 0, F.least(F.lit(p.repeat), F.col("base") + more)).otherwise(0)
    return got.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "u")


def mixed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` (all columns) with every row as often as the mix takes it (0, 1 or ``repeat`` times)."""
    plan_ = mix(docs, p).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("u").alias("__u"), "copies")
    plan_ = plan_.groupBy("__id", "__u").agg(F.array_sort(F.collect_list("copies")).alias("__c"), F.count("*").alias("__n"))
    hit = docs.join(plan_, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.lit(p.seed), "doc_id", "text") == F.col("__u")))
    nth = F.row_number().over(W.partitionBy("__id", "__u").orderBy(F.lit(1)))
    return hit.withColumn("__k", F.get("__c", nth - 1)).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("__k"))).alias("__r")).drop("__r")


def op6_budget_mix(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("u")
