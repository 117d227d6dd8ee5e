"""Approximate nearest neighbours with a permutation index.

Every vector is represented by the order of its LENGTH nearest pivots and posted under each of them in the inverted
files of its block of the index: a list for each pivot of the block's rows and their ranks there. The inverted files
are made once and written as a table. A query walks the lists of its own nearest ASKED pivots and no others, and sums
up what the footrule distance of its order to each row's falls by for a shared pivot (rows without the pivot count
as rank LENGTH there). The block's best share by footrule is reranked with exact cosines in double precision, and the
best k of all blocks win.

Queries and blocks meet in tasks of one block and at most about QUERIES queries, whatever the data; each returns k
rows for each query. Vectors of another length than most have an index of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from registra.llm.common import written

#: Pivots, taken from a bounded sample (SAMPLE rows with the smallest hashes) and with cosines below APART to each
#: other, so that near copies give one pivot.
PIVOTS, SAMPLE, APART = 1024, 4096, 0.9
#: Nearest pivots that a row is posted under, and those whose lists a query walks.
LENGTH, ASKED = 64, 24
#: Rows of a block and queries that meet it in one task, about.
BLOCK, QUERIES = 8192, 8192
#: Of a block's rows that are reranked, and rows at least.
RERANK, LEAST = 0.12, 256
#: A pivot that is the nearest of more than so many times the mean number of rows, and of so many, has a crowd.
CROWD, MANY = 6, 24
#: Lengths of vectors, the most frequent ones, that have pivots of their own; of the others every row is reranked.
LENGTHS = 16

INDEX = "size int, block int, ids binary, rows binary, vectors binary, ends binary, posted binary, ranks binary, crowded binary"


def clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector that is not zero, null or empty and holds neither null nor non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(rows[id_col].cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    return kept.where(~odd).where(F.exists("v", lambda x: x != 0))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1: squares neither overflow nor vanish, and
    cosines stay what they are."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _unit(v: np.ndarray) -> np.ndarray:
    near_one = scaled(v)
    return near_one / np.sqrt((near_one * near_one).sum(axis=1, keepdims=True))


def pivots(rows: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """Unit pivots for rows (row, id, v) of one length: of at most SAMPLE rows, ordered by a hash, the first n whose
    cosines to each other are below APART."""
    sample = rows.orderBy(F.xxhash64("id", "v"), "row").limit(SAMPLE).select("v").toPandas().v
    unit = _unit(np.stack(sample.to_numpy()))
    found, k = np.empty((min(n, len(unit)), unit.shape[1])), 0
    for x in unit:
        if k < len(found) and (not k or (found[:k] @ x).max() < APART):
            found[k] = x
            k += 1
    return found[:k]


def orders(v: np.ndarray, pivot: np.ndarray, length: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first."""
    near = -(_unit(v) @ pivot.T)
    length = min(length, len(pivot))
    if length < len(pivot):
        some = np.argpartition(near, length - 1, axis=1)[:, :length]
        some.sort(axis=1)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)
    return np.argsort(near, axis=1, kind="stable")


def inverted(own: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lists of all pivots one behind the other: where they end, their rows and the ranks of the pivot there, by rank."""
    n, length = own.shape
    pivot, rank = own.ravel(), np.tile(np.arange(length), n)
    order = np.lexsort((np.repeat(np.arange(n), length), rank, pivot))
    ends = np.cumsum(np.bincount(pivot, minlength=n_pivots))
    return ends, (order // length).astype(np.int32), rank[order].astype(np.int16)


def crowds(own: np.ndarray, n_pivots: int) -> np.ndarray:
    """Whether each row is in the crowd of its nearest pivot, as near copies of one vector are."""
    nearest = np.bincount(own[:, 0], minlength=n_pivots)[own[:, 0]]
    return nearest > max(CROWD * len(own) / max(n_pivots, 1), MANY)


def footrule(asked: np.ndarray, ends: np.ndarray, posted: np.ndarray, ranks: np.ndarray, n: int, length: int) -> np.ndarray:
    """By how much each row's footrule distance to the query's order is below that of a row without any of its pivots."""
    at, gain = [], []
    for r, p in enumerate(asked.tolist()):
        a, b = (ends[p - 1] if p else 0), ends[p]
        at.append(posted[a:b])
        gain.append((length - r) - np.abs(ranks[a:b] - r))
    return np.bincount(np.concatenate(at), weights=np.concatenate(gain), minlength=n)


def best_of(saved: np.ndarray, crowd: np.ndarray, keep: int) -> np.ndarray:
    """The rows to rerank. Crowds don't count towards the share, or they would crowd out all others; of a crowd every
    row is reranked that is as near as the share's last."""
    calm = saved[~crowd]
    bar = np.partition(calm, len(calm) - keep)[len(calm) - keep] if keep < len(calm) else -1.0
    return np.flatnonzero(saved >= bar)


def _index_of(pivot_of: dict[int, np.ndarray], length: int):
    """One row of the index from the rows of one block."""

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "row"])
        v = scaled(np.stack(group.v.to_numpy()))
        ends, posted, ranks, crowd = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int16), np.zeros(0, bool)
        if key[0] in pivot_of:
            own = orders(v, pivot_of[key[0]], length)
            ends, posted, ranks = inverted(own, len(pivot_of[key[0]]))
            crowd = crowds(own, len(pivot_of[key[0]]))
        arrays = (group.id.to_numpy(), group.row.to_numpy(), v, ends.astype(np.int64), posted, ranks, crowd)
        return pd.DataFrame([[*key, *(x.tobytes() for x in arrays)]], columns=INDEX.replace(",", "").split()[::2])

    return build


def _meet(k: int, length: int, share: float, least: int):
    def meet(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in index.itertuples():
            ids, rows = np.frombuffer(x.ids, np.int64), np.frombuffer(x.rows, np.int64)
            v, n = np.frombuffer(x.vectors).reshape(len(ids), -1), len(ids)
            ends, posted, ranks, crowd = np.frombuffer(x.ends, np.int64), np.frombuffer(x.posted, np.int32), np.frombuffer(x.ranks, np.int16), np.frombuffer(x.crowded, bool)
            norms, keep = np.sqrt((v * v).sum(axis=1)), max(least, int(np.ceil(share * n)), 4 * k)
            for query, own, vector, near in zip(asked.id, asked.row, asked.v, asked.near):
                at = np.arange(n)
                if len(near) and keep < n:
                    at = best_of(footrule(np.asarray(near), ends, posted, ranks, n, min(length, len(ends))), crowd, keep)
                q = scaled(np.asarray(vector)[None, :])[0]
                score = (v[at] @ q) / (norms[at] * np.sqrt((q * q).sum()))
                score[rows[at] == own] = -2.0
                if len(at) > 4 * k:  # a block's ties and its best k are among these
                    some = np.flatnonzero(score >= np.partition(score, len(at) - k)[len(at) - k] - 1e-12)
                    at, score = at[some], score[some]
                score = (v[at] * q).sum(axis=1) / (norms[at] * np.sqrt((q * q).sum()))
                score[rows[at] == own] = -2.0
                best = np.lexsort((rows[at], ids[at], -score))[:k]
                out += [(own, query, r, i, s) for r, i, s in zip(rows[at[best]].tolist(), ids[at[best]].tolist(), score[best].tolist()) if s > -1.5]
        return pd.DataFrame(out, columns=["query_row", "query_id", "row", "id", "score"]).astype({"query_row": "int64", "query_id": "int64", "row": "int64", "id": "int64", "score": "float64"})

    return meet


def nearest(rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", share: float = RERANK, least: int = LEAST, length: int = LENGTH, asked: int = ASKED) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the largest cosine found for each row whose id is divisible by
    `every`, among all other rows; ties to the smaller id. share 1 reranks every row: exact, at a higher price.

    Rows that can't take part (see clean) are neither queries nor candidates. Vectors are compared with those of their
    own length. Rows of one id are apart, as queries (each has its ranks) and as candidates, of each other too. No rows
    give an empty result."""
    valid = written(clean(rows, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.size("v")), "vectors")
    sizes = {r["size"]: r["n"] for r in valid.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(LENGTHS).collect()}
    pivot_of = {s: pivots(valid.where(F.col("size") == s)) for s, n in sizes.items() if n > least and share < 1}
    total = max([valid.count(), 1])
    count_of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("size")), F.lit(total)) if sizes else F.lit(total)
    blocks = F.ceil(count_of / BLOCK).cast("int")
    groups = max(1, -(-(total // every + 1) // QUERIES))
    placed = valid.withColumn("block", F.expr("xxhash64(row, 1)")).withColumn("block", F.pmod(F.col("block"), blocks).cast("int"))
    index = written(placed.groupBy("size", "block").applyInPandas(_index_of(pivot_of, length), INDEX), "index")

    def with_order(batches):
        for b in batches:
            near = [orders(np.asarray(v)[None, :], pivot_of[s], asked)[0].tolist() if s in pivot_of else [] for v, s in zip(b.v, b["size"])]
            yield b.assign(near=near)

    queries = valid.where(F.col("id") % every == 0).mapInPandas(with_order, "id long, v array<double>, row long, size int, near array<int>")
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("part", F.expr(f"cast(pmod(xxhash64(row, 2), {groups}) as int)")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keys = ["size", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_meet(k, length, share, least), "query_row long, query_id long, row long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
