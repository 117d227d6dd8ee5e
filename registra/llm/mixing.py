"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target is a multiple of its size: each document is taken that many whole times, and once more with the
fractional rest as its inclusion probability. The flight phase moves three probabilities at a time along the null
space of the balancing constraints (number of documents, number of words) until one of them is 0 or 1. It runs in
blocks of at most about BLOCK documents of one source, so a large source is many tasks; what is left fractional of
each block, two documents at most, meets in the blocks of the next level, until one block of each source is left.
That block takes its large documents first, so the last two, the landing problem, are small ones as a rule: they are
taken or left as whole documents, whichever comes nearest to the target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from registra.llm.common import shuffle_partitions, written

BLOCK = 2048
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Of all words, to be taken; and times that a document may be taken.
SHARE, MOST = 1.5, 2.0
WORD = "[^\\x20\\x09-\\x0D]+"

_EDGE = 1e-9


def flight(p: np.ndarray, x: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Move probabilities p until at most two are fractional, keeping sum(p) and sum(p * x). draws: uniform, one for each step."""
    p, x = p.tolist(), x.tolist()
    active, k = [], 0
    for i in range(len(p)):
        if not _EDGE < p[i] < 1 - _EDGE:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for j, v in zip(active, u):
                if v > 0:
                    up, down = min(up, (1 - p[j]) / v), min(down, p[j] / v)
                elif v < 0:
                    up, down = min(up, -p[j] / v), min(down, (p[j] - 1) / v)
            step = up if draws[k] * (up + down) < down else -down
            k += 1
            for j, v in zip(active, u):
                p[j] = min(1.0, max(0.0, p[j] + step * v))
                if p[j] < _EDGE or p[j] > 1 - _EDGE:
                    p[j] = float(round(p[j]))
            active = [j for j in active if 0 < p[j] < 1]
    return np.array(p)


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The whole choice for the last fractional documents that is nearest in words, then in documents."""
    at = np.flatnonzero((p > 0) & (p < 1))
    best = None
    for code in range(1 << len(at)):
        s = np.array([code >> j & 1 for j in range(len(at))], dtype=float)
        cost = (abs(float((s - p[at]) @ x[at])), abs(float((s - p[at]).sum())), code)
        if best is None or cost < best[0]:
            best = (cost, s)
    out = p.copy()
    out[at] = best[1]
    return out


def sources(sizes: DataFrame) -> DataFrame:
    """(source, rank, source_size, n, target) from (source, size): one row for each source, in any number of them.

    Ranks come from a range-partitioned order. Targets share SHARE of all words by weight, weight * level, but for
    sources whose cap, MOST * size, is below that: the level rises by what they leave, until no more of them stop."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = F.col("source").asc_nulls_last()
    ordered = totals.repartitionByRange(shuffle_partitions(spark), by_name).sortWithinPartitions(by_name).withColumn("at", F.monotonically_increasing_id())
    table = written(ordered.select("source", "source_size", "n", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("local")), "sources")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, table.groupBy("part").agg(F.count("*")).collect())):
        offsets += [F.lit(part), F.lit(before)]
        before += n
    rank = F.element_at(F.create_map(*offsets), F.col("part")) + F.col("local") + 1 if offsets else F.col("local")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(rank - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    ranked = table.select("source", rank.alias("rank"), "source_size", "n", weight.alias("weight"), (MOST * F.col("source_size")).alias("cap"))
    words, weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    level = SHARE * words / weights
    while True:
        stops = F.col("cap") <= level * F.col("weight")
        capped, rest = ranked.agg(F.coalesce(F.sum(F.when(stops, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0.0))).first()
        higher = (SHARE * words - capped) / rest if rest else level
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return ranked.select("source", "rank", "source_size", "n", F.least("cap", level * F.col("weight")).alias("target"))


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `copy`, which counts the rows of equal keys from 0. No task gets all rows of a key: they are counted
    by the partitions that they lie in, and the partitions' counts are summed up."""
    parted = written(rows.withColumn("part", F.spark_partition_id()), "parted")
    counts = parted.groupBy(*keys, "part").agg(F.count("*").alias("held")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "held"))).alias("parts")).where("size(parts) > 1")
    named = [F.col(k).alias(f"k_{k}") for k in keys]
    counts = counts.select(*named, "parts")
    same = [parted[k].eqNullSafe(counts[f"k_{k}"]) for k in keys]
    local = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*keys)) - 1
    met = parted.withColumn("local", local).join(counts, same, "left")
    offset = F.aggregate(F.filter("parts", lambda x: x["part"] < F.col("part")), F.lit(0).cast("long"), lambda a, x: a + x["held"])
    return met.select(*rows.columns, (F.col("local") + F.coalesce(offset, F.lit(0))).cast("long").alias("copy"))


def _flight_of(level: int, last: bool, names: list[str]):
    """The flight, and of the last block of a source the landing. Rows are ordered by their hashes, in the last block
    by size first; the seed is the block's."""

    def fly(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        size = group["size"].to_numpy()
        by = np.lexsort((group["copy"].to_numpy(), size, group["order"].to_numpy(), -size if last else np.zeros(len(size))))
        group = group.iloc[by]
        x = group["size"].to_numpy(dtype=float)
        p = flight(group["p"].to_numpy(), x, np.random.default_rng([level, int(key[0]), int(key[1])]).random(len(group) + 1))
        return group.assign(p=landing(p, x) if last else p)[names]

    return fly


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, copies) for each row of docs.

    size: words of the whole text (null: 0). copies: whole times that the document is taken, 0 to 2; taken: words that
    this gives. A source's words differ from its target by less than the larger of the last two documents. Null sources
    are one source, the last. Draws depend on ids and texts alone, so reruns agree; equal rows are interchangeable."""
    words = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), words.alias("size"), F.xxhash64(docs[text_col]).alias("digest"))
    sizes = written(numbered(sizes, ["id", "source", "size", "digest"]), "sizes")
    table = written(sources(sizes), "targets")
    times = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    times = F.when(F.abs(times - F.round(times)) < _EDGE, F.round(times)).otherwise(times)
    rows = sizes.alias("d").join(table.alias("s"), F.expr("d.source <=> s.source")).select("id", "size", "digest", "copy", "rank", "n", "source_size", "target", times.alias("times"))
    rows = rows.withColumn("base", F.floor("times").cast("double")).withColumn("p", F.col("times") - F.col("base")).drop("times")
    schema, names = rows.schema, rows.columns
    most = table.agg(F.max("n")).first()[0] or 0
    done, level = None, 0
    while True:
        blocks = f"cast(ceil(n / {BLOCK // 2} / pow({BLOCK // 4}, {level})) as int)"
        last = most / (BLOCK // 2) / (BLOCK // 4) ** level <= 1
        dealt = rows.withColumn("order", F.xxhash64("id", "digest", "copy", F.lit(level))).withColumn("block", F.expr(f"cast(pmod(xxhash64(id, digest, copy, 17), {blocks}) as int)"))
        flown = written(dealt.groupBy("rank", "block").applyInPandas(_flight_of(level, last, names), schema), "flown")
        settled = flown if last else flown.where("p <= 0 or p >= 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        rows, level = flown.where("p > 0 and p < 1"), level + 1
    copies = F.col("base") + F.col("p")
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as many times as the mix takes it (0, 1 or 2). Same columns."""
    row, times = "__row", "__times"
    while row in docs.columns or times in docs.columns:
        row, times = "_" + row, "_" + times
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    keyed = rows.select(F.col(row).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    taken = mix(keyed, "id", "text", "source").select(F.col("id").alias(row), F.col("copies").alias(times)).where(F.col(times) > 0)
    # Sorted on both sides at every size: what is broadcast at one size and shuffled at another grows by leaps.
    return rows.join(taken.hint("merge"), row).withColumn(times, F.explode(F.expr(f"sequence(1, `{times}`)"))).select(*docs.columns)
