"""Threshold-scaled document fingerprints: every shingle hash below a fixed fraction of the range.

The sketch of a union is the union of the sketches (`below`), and containment and likeness can be estimated between very
unequal documents, since both keep the same fraction. A fingerprint must tell texts apart that have no hash below, too:
there it keeps the smallest one (`sketch`), which is no part of the sketch of a union.

Each document is also compared with an edited text, which needs the next document in descending order of ids. Ids
are cut at approximate quantiles into buckets, buckets are sorted by themselves, and the first document of each
bucket is dealt to the bucket before it as well: one shuffle of the texts, no global order in one task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.llm.common import in_slices, shuffle_partitions

WORDS = 5
#: One in so many hashes is kept.
SCALE = 4
#: Bytes of a kept hash in a fingerprint.
WIDTH = 6

_LEAST = -(1 << 63)


def hashes(words: list[bytes], n: int = WORDS, start: int = 0) -> np.ndarray:
    """XXH64 of the shingles that begin at word `start` or later; of the whole sequence if it is shorter than a shingle."""
    if len(words) < n:
        found = [xxhash.xxh64_intdigest(b" ".join(words))] if words and not start else []
    else:
        words = words[start:]
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = [0, *ends[: max(0, len(words) - n)].tolist()]
        digest = xxhash.xxh64_intdigest
        found = [digest(joined[a:b]) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())]
    return np.array(found, dtype=np.uint64)


def below(found: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sorted distinct hashes below 2**64 / scale, cut to WIDTH bytes. Mergeable: of a union the union."""
    kept = found[found < np.uint64((1 << 64) // scale)] if scale > 1 else found
    return np.unique(kept >> np.uint64(64 - 8 * WIDTH))


def sketch(found: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The hashes below, or the smallest one of all if there is none below."""
    kept = below(found, scale)
    return kept if len(kept) or not len(found) else np.array([found.min() >> np.uint64(64 - 8 * WIDTH)], dtype=np.uint64)


def text_of(sketched: np.ndarray) -> str:
    raw = sketched.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :]
    return base64.b64encode(raw.tobytes()).decode()


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets; of two empty ones 1."""
    both = shared(a, b)
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that are in b; of an empty a 1."""
    return shared(a, b) / len(a) if len(a) else 1.0


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def _bucketed(rows: DataFrame, n: int) -> DataFrame:
    """rows (id, text) with `bucket`, and the first of each bucket (largest id) again with the bucket before it and
    `copy`; the first of all follows the last. The bounds and heads that pass the driver are n numbers at most."""
    at = F.coalesce(F.col("id"), F.lit(_LEAST))
    cuts = rows.agg(F.percentile_approx(at, [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    step = max(1, int(len(cuts) ** 0.5))
    bounds, coarse = F.array(*map(F.lit, cuts)).cast("array<bigint>"), F.array(*map(F.lit, cuts[step - 1 :: step])).cast("array<bigint>")
    skip = F.size(F.filter(coarse, lambda b: b < F.col("at"))) * step
    bucket = skip + F.size(F.filter(F.slice(bounds, skip + 1, F.lit(step)), lambda b: b < F.col("at")))
    keyed = rows.withColumn("at", at).withColumn("bucket", bucket)
    heads = sorted(tuple(r) for r in keyed.groupBy("bucket").agg(F.max("at")).collect())
    pairs = [(head, heads[k + 1][0] if k + 1 < len(heads) else heads[0][0]) for k, (_, head) in enumerate(heads)]
    small = rows.sparkSession.createDataFrame(pairs, "at long, before int")
    met = keyed.join(F.broadcast(small), "at", "left")
    own, copy = F.struct(F.col("bucket"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copy"))
    return met.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy)))).select("id", "at", "text", "to.bucket", "to.copy")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_in_edited) for each row.

    The edited text is the text with its last half (rounded down, code points) replaced by the first as many of the
    next document in descending order of id (long; null ids last, rows of the same id by the text's hash), or all of
    it; after the last comes the first. A null text counts as empty: an empty fingerprint, like only to another one."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n = 4 * shuffle_partitions(docs.sparkSession)
    dealt = _bucketed(rows, n).repartition("bucket").sortWithinPartitions("bucket", "copy", F.col("at").desc(), F.xxhash64("text"))
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_in_edited"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

    def compare(own, other):
        i, text, found, mine = own
        half = len(text) // 2
        head = text[: len(text) - half]
        edited = head + other[1][:half]
        same = max(0, len(_words(head)) - WORDS)  # shingles that end before the last word of the head
        again = sketch(np.concatenate([found[:same], hashes(_words(edited), start=same)]))
        return i, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), text_of(mine), text_of(again), likeness(mine, again), likeness(mine, other[3]), containment(mine, again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, at = None, None
        for batch in in_slices(batches, "text"):
            out = []
            for i, text, bucket, copy in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "bucket", "copy"))):
                found = hashes(_words(text))
                own = (i, text, found, sketch(found))
                if before is not None and bucket == at:
                    out.append(compare(before, own))
                before, at = (None if copy else own), bucket
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=names)

    done = dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_in_edited double")
    return done.withColumnRenamed("id", id_col)
