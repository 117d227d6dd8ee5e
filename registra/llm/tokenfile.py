"""Token-id files of patched frame-of-reference blocks.

Documents are range-partitioned by id and sorted; each task encodes its shard and writes segments of whole
documents as rows of a Parquet table in the shared folder. A segment's ids are cut into blocks of 128: the block's
minimum is subtracted, the rest packed at the width of one of its percentiles, the cheapest of them, and values
that are wider are patched from the block's exception list. `starts` indexes the first word of every block, so any
document's ids can be decoded from its blocks alone. Segments don't depend on each other: the reader's tasks decode
them in any order, and a lost task costs its own segments.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from registra.llm.bpe import AT_SPACES, Units
from registra.llm.common import in_slices, shuffle_partitions
from registra.sources.shared import shared_dir

BLOCK = 128
#: Ids of a segment, about: a segment ends with the document that reaches it.
SEGMENT = 1 << 19
#: Percentiles of the residuals' widths that a block may be packed at.
PERCENTILES = (50, 75, 90, 95, 98, 100)
#: Bytes of an exception: its place in the block and its residual.
EXCEPTION = 5

#: Units that are given to the library as one text, and what they are.
TOGETHER, WORD = 64, re.compile(r" ?\S+")
#: Units of texts that a worker keeps encoded: the library takes longer for one than the memory of it is worth.
MEMO = 1_000_000
#: Bytes and rows of texts that are encoded together: a unit is looked up once for each slice that has it.
SLICE, ROWS = 8_000_000, 4_000

FILE = "shard int, segment int, first long, doc_ids array<long>, sizes array<int>, minima array<int>, widths array<tinyint>, starts array<int>, packed binary, exceptions array<tinyint>, places binary, residuals binary"


def pack(ids: np.ndarray) -> dict:
    """Blocks of the ids (unsigned 32-bit)."""
    n = -(-len(ids) // BLOCK)
    padded = np.full(n * BLOCK, ids[-1] if len(ids) else 0, dtype=np.uint32)
    padded[: len(ids)] = ids
    blocks = padded.reshape(n, BLOCK)
    minima = blocks.min(axis=1)
    rest = blocks - minima[:, None]
    bits = np.frexp(rest.astype(np.float32))[1].astype(np.uint8)
    ordered = np.sort(bits, axis=1)
    choices = ordered[:, [-(-BLOCK * p // 100) - 1 for p in PERCENTILES]].astype(np.int64)
    costs = np.stack([choices[:, k] * (BLOCK // 8) + EXCEPTION * (bits > choices[:, k : k + 1]).sum(axis=1) for k in range(len(PERCENTILES))], axis=1)
    widths = choices[np.arange(n), costs.argmin(axis=1)]
    starts = np.concatenate([[0], np.cumsum(2 * widths)])
    words = np.zeros(int(starts[-1]), dtype=np.uint64)
    for w in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == w)
        low = np.ascontiguousarray(rest[at].T).astype(np.uint64) & np.uint64((1 << w) - 1)
        out = np.zeros((2 * w, len(at)), dtype=np.uint64)
        for j in range(BLOCK):
            a, s = divmod(j * w, 64)
            out[a] |= low[j] << np.uint64(s)
            if s + w > 64:
                out[a + 1] |= low[j] >> np.uint64(64 - s)
        words[starts[at][:, None] + np.arange(2 * w)] = out.T
    wide = bits > widths[:, None]
    row, place = np.nonzero(wide)
    return {
        "minima": minima.astype(np.int32),
        "widths": widths.astype(np.int8),
        "starts": starts[:-1].astype(np.int32),
        "packed": words.astype("<u8").tobytes(),
        "exceptions": np.bincount(row, minlength=n).astype(np.int8),
        "places": place.astype(np.uint8).tobytes(),
        "residuals": rest[wide].astype("<u4").tobytes(),
    }


def unpack(x: dict, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive; all of them by default), padding included."""
    minima, widths, starts = (np.asarray(x[k])[first:last].astype(np.int64) for k in ("minima", "widths", "starts"))
    counts = np.asarray(x["exceptions"]).astype(np.int64)
    before = int(counts[:first].sum())
    counts = counts[first:last]
    words = np.frombuffer(x["packed"], dtype="<u8")
    rest = np.zeros((BLOCK, len(widths)), dtype=np.uint64)
    for w in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == w)
        own = np.ascontiguousarray(words[starts[at][:, None] + np.arange(2 * w)].T)
        mask = np.uint64((1 << w) - 1)
        for j in range(BLOCK):
            a, s = divmod(j * w, 64)
            value = own[a] >> np.uint64(s)
            if s + w > 64:
                value |= own[a + 1] << np.uint64(64 - s)
            rest[j, at] = value & mask
    total = int(counts.sum())
    row = np.repeat(np.arange(len(widths)), counts)
    place = np.frombuffer(x["places"], dtype=np.uint8)[before : before + total]
    rest[place, row] = np.frombuffer(x["residuals"], dtype="<u4")[before : before + total]
    return (rest.T + minima[:, None].astype(np.uint64)).astype(np.uint32).ravel()


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str, plain: bool):
    """Encodes texts with the tokenizers library: cut at spaces, each new unit once, where the tokenizer splits texts
    by a pattern that allows it; texts that hold the string of an added token, and other tokenizers' texts, whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(new: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    line = tokenizer.encode("\n", add_special_tokens=False).ids

    def by_lines(new: list[str]) -> list[bytes]:
        """encode() of units, many to a text: a line break between units without white space of their own is a match of
        the pattern by itself, and one id that nothing else gives."""
        fits = [k for k, u in enumerate(new) if WORD.fullmatch(u)]
        groups = [fits[k : k + TOGETHER] for k in range(0, len(fits), TOGETHER)]
        out: list[bytes | None] = [None] * len(new)
        for group, e in zip(groups, tokenizer.encode_batch_fast(["\n".join([new[k] for k in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = [*np.flatnonzero(ids == line[0]).tolist(), len(ids)]
            if len(ends) != len(group):
                raise ValueError("the tokenizer doesn't split texts by the given pattern")
            packed, start = ids.tobytes(), 0
            for k, end in zip(group, ends):
                out[k] = packed[4 * start : 4 * end]
                start = end + 1
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, encode([new[k] for k in rest])):
            out[k] = x
        return out

    by_units = Units(by_lines if len(line) == 1 and tokenizer.normalizer is None else encode, MEMO) if pattern == AT_SPACES else encode

    def run(texts: list[str]) -> list[bytes]:
        whole = [any(a in t for a in added) for t in texts]
        some = [iter(f([t for t, w in zip(texts, whole) if w == k])) for k, f in enumerate((by_units, encode))]
        return [next(some[w]) for w in whole]

    return run


def _segments(batches: Iterator[pa.RecordBatch], path: str, pattern: str, end_id: int, plain: bool) -> Iterator[dict]:
    encode, shard = _encoder(path, pattern, plain), TaskContext.get().partitionId()
    end = np.array([end_id], dtype="<u4").tobytes()
    ids, sizes, parts, held, first, k = [], [], [], 0, 0, 0

    def segment():
        return {"shard": shard, "segment": k, "first": first, "doc_ids": ids, "sizes": sizes} | pack(np.frombuffer(b"".join(parts), dtype="<u4"))

    for batch in in_slices(batches, "text", SLICE, ROWS):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for i, packed in zip(batch.column("id").to_pylist(), encode(texts)):
            ids.append(i)
            parts += [packed, end]
            sizes.append(len(packed) // 4 + 1)
            held += sizes[-1]
            if held >= SEGMENT:
                yield segment()
                ids, sizes, parts, held, first, k = [], [], [], 0, first + held, k + 1
    if ids:
        yield segment()


def write_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", plain: bool = False) -> str:
    """Write the ids of every whole text, end_id after each, in ascending order of id_col (long; nulls first, rows of
    the same id by text). Gives the path, by default a new one in the shared folder. A null text counts as empty.

    pattern: what the tokenizer splits texts by. plain: strings of special tokens in a text (like <|endoftext|>) are
    ordinary text; by default they are the special token, as the library gives them."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", F.xxhash64("text"))
    kinds = spark.createDataFrame([], FILE).schema
    arrow = pa.schema([
        ("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
        ("minima", pa.list_(pa.int32())), ("widths", pa.list_(pa.int8())), ("starts", pa.list_(pa.int32())), ("packed", pa.binary()),
        ("exceptions", pa.list_(pa.int8())), ("places", pa.binary()), ("residuals", pa.binary()),
    ])

    def run(batches):
        for x in _segments(batches, tokenizer_path, pattern, end_id, plain):
            yield pa.RecordBatch.from_arrays([pa.array([x[f.name]], f.type) for f in arrow], schema=arrow)

    ordered.mapInArrow(run, kinds).write.option("compression", "none").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Read the files back: id, start (ids of all documents before it), n_tokens, ids_crc32, and `ids` if asked for."""
    file = spark.read.schema(FILE).parquet(path)
    totals = file.groupBy("shard").agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")).alias("total"))
    offsets = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("offset"))

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                ids, sizes = unpack(x), np.array(x["sizes"], dtype=np.int64)
                ends = np.cumsum(sizes)
                parts = [ids[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                columns = [
                    pa.array([x["shard"]] * len(sizes), pa.int32()), pa.array(x["doc_ids"], pa.int64()), pa.array(x["first"] + ends - sizes),
                    pa.array(sizes), pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                ]
                names = ["shard", "id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = file.mapInArrow(run, "shard int, id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    out = [F.col("id").alias(id_col), (F.col("local") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return rows.join(offsets, "shard").select(*out)
