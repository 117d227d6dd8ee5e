"""Periodic runs of words, by a dictionary of basic factors.

Words are named by number, and so is every factor whose length is a power of two: a factor of length 2L is the pair of
the names of its halves. Occurrences of a factor of length L that follow each other at the same distance q twice form
an arithmetic progression. With L/2 < q <= L, that is within a window of 2L, the progression proposes the period q, and
no shorter period is possible, since then a nearer occurrence would exist. Positions side by side that propose the same
period are one run; it extends beyond them to the end of the progression's last factor. As each q belongs to one L,
no run comes out twice. Only factors that occur twice in their text go on to the next length.

All texts of a slice are named together with numpy; no shuffle, and memory for one slice (a few MB of text, or one
longer text) at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.llm.common import in_slices

#: Least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
SCHEMA = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of all texts in one array, and the number of the first word of each text (with the total at the end)."""
    found = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets, every = found.offsets.to_numpy().astype(np.int64), found.values
    every, offsets = every.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
    some = pc.greater(pc.binary_length(every), 0)  # white space at either end leaves an empty word
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return every.filter(some), before[offsets]


def runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, by start and then period. names: a number for each word; first: where each
    text begins in it, and its end. Runs don't cross texts."""
    total, size = len(names), np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    last = np.repeat(first[1:], size)  # where the text of a word ends
    at, key, length = np.arange(total), names.astype(np.int64), 1
    named = np.full(total, -1, np.int64)
    found = []
    while len(at):
        order = np.argsort(key, kind="stable")
        where, sorted_key = at[order], key[order]
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        follows = ~fresh[1:] & (text[where[1:]] == text[where[:-1]])
        gap = np.where(follows, where[1:] - where[:-1], 0)
        even = np.flatnonzero((gap[:-1] == gap[1:]) & (2 * gap[:-1] > length) & (gap[:-1] <= length))
        if len(even):
            p, q = where[even], gap[even]
            by = np.argsort(p)
            p, q = p[by], q[by]
            cut = np.flatnonzero((p[1:] != p[:-1] + 1) | (q[1:] != q[:-1]) | (text[p[1:]] != text[p[:-1]]))
            head, tail = p[np.concatenate([[0], cut + 1])], p[np.concatenate([cut, [len(p) - 1]])]
            period = q[np.concatenate([[0], cut + 1])]
            end = tail + 2 * period + length
            fit = end - head >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append((head[fit], end[fit], period[fit]))
        twice = np.zeros(len(at), bool)
        twice[1:] |= follows
        twice[:-1] |= follows
        named[:] = -1
        named[where[twice]] = np.cumsum(fresh)[twice]
        # a period above `length`, four times in a text, is the least that the next length can find
        left = np.sort(where[twice])
        left = left[(left + 2 * length <= last[left]) & (size[text[left]] > LEAST_PERIODS * length)]
        left = left[named[left + length] >= 0]
        at, key = left, named[left] * (total + 1) + named[left + length]
        length *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def shaped(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): from word a on, the text repeats its next p words; None for texts that stay as they are. A tenth of all
    ids, chosen by their crc32, is shaped so."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    return None if h % 10 else ((a := g % n), 1 + (n - a) // (3 + g % 8))


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _found(ids: list, texts: pa.Array, planted: bool) -> dict[str, list]:
    every, first = words(texts)
    source = np.arange(len(every))
    for k, doc_id in enumerate(ids if planted else []):
        n = int(first[k + 1] - first[k])
        if (at := shaped(doc_id, n)) is not None:
            a, p = int(first[k]) + at[0], at[1]
            source[a : first[k + 1]] = a + np.arange(first[k + 1] - a) % p
    names = every.dictionary_encode().indices.to_numpy() if len(every) else np.zeros(0, np.int64)
    start, end, period = runs(names[source], first)
    owner = np.searchsorted(first, start, side="right") - 1
    n_runs = np.bincount(owner, minlength=len(ids))
    # words from the second period of any run on are dropped
    change = np.bincount(start + period, minlength=len(every) + 1) - np.bincount(end, minlength=len(every) + 1)
    stay = np.flatnonzero(np.cumsum(change[: len(every)]) == 0)
    offsets = np.searchsorted(stay, first).astype(np.int32)
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), every.take(pa.array(source[stay]))), " ")
    best = np.lexsort((period, start, start - end, owner))
    best = dict(zip(owner[best][::-1].tolist(), best[::-1].tolist(), strict=True))  # the first of each text stays
    out = {name.split()[0]: [] for name in SCHEMA.split(", ")}
    from_run = np.concatenate([[0], np.cumsum(n_runs)])
    for k in range(len(ids)):
        out["n_runs"].append(int(n_runs[k]))
        own = slice(from_run[k], from_run[k + 1])
        lines = [f"{s},{e - s},{q}\n" for s, e, q in zip((start[own] - first[k]).tolist(), (end[own] - first[k]).tolist(), period[own].tolist(), strict=True)]
        out["runs_sha256"].append(_digest("".join(lines).encode()))
        out["collapsed_sha256"].append(_digest(kept[k].as_py().encode()))
        x = best.get(k)
        size, q = (None, None) if x is None else (int(end[x] - start[x]), int(period[x]))
        for name, value in (("start", None if x is None else int(start[x] - first[k])), ("length", size), ("period", q), ("exponent_milli", None if x is None else 1000 * size // q)):
            out[name].append(value)
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for each row of docs.

    A run is a stretch of words with smallest period q and a length of at least max(6, 4 q) that no neighbouring word
    extends; start, length, period and exponent_milli (floor of 1000 length / period) are those of the longest (ties:
    smallest start, then period), null without a run. runs_sha256 is of all runs as `start,length,period` lines,
    collapsed_sha256 of the words that no run holds after its first period, joined by one space. planted: texts whose
    id falls into a tenth by its crc32 are first made periodic (see shaped()).

    A null or blank text has no words and no run, and both digests are of the empty string. Each row counts for itself,
    repeated rows too; a null id is never planted. Columns of other names aren't read."""
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(found, "text"):
            out = _found(part.column("id").to_pylist(), part.column("text"), planted)
            kinds = [pa.string() if name.endswith("sha256") else pa.int64() for name in out]
            yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], ["id", *out])

    return rows.mapInArrow(batches, f"id bigint, {SCHEMA}").select(F.col("id").alias(id_col), *[name.split()[0] for name in SCHEMA.split(", ")])
