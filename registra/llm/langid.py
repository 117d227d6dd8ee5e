"""Language identification by mixture inference.

Byte trigrams, hashed into a fixed number of buckets, are counted per language over all training rows by a grouped
sum; the table of languages times buckets is all that reaches the driver, whatever the corpus. Each document is a
mixture: expectation-maximisation estimates the proportions of its languages from the trigrams' likelihoods, and the
set of languages is the one with the smallest BIC on the way from all languages to one. The prediction is the
language with the largest share of that set; the score is its share among all languages.

The pipeline's stage judges every document by its mixture: see keep_identified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.llm.common import in_slices, written

UNKNOWN = "und"
#: Buckets of trigrams, a power of two.
BUCKETS = 1 << 13
#: Added to each count.
SMOOTH = 0.5
#: Expectation-maximisation ends when no share changes by more.
TOLERANCE = 1e-3
#: Languages that are learned: those with the most training texts, a bound on the table that reaches the driver.
LANGUAGES = 512
#: Each byte is in three trigrams: their counts weigh a third, so that the penalty meets independent evidence.
WEIGHT = 1 / 3
#: A text fits no language if trigrams spread evenly over the buckets explain it better than its mixture does, by more
#: than this log likelihood for each trigram and by more than the BIC's price of a language for the whole text.
MISFIT = 1.0

_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def buckets(text: str) -> np.ndarray:
    """The buckets of the trigrams of the whole text: lower case, all but letters as single spaces."""
    raw = _LETTERS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])].astype(np.uint32)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(33 - BUCKETS.bit_length())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learn(rows: DataFrame, most: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """rows: (text, lang). The languages in order, and log probabilities (buckets, languages). Null texts and languages
    are skipped; of more than `most` languages, those with the most texts are learned, ties to the smaller name."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}

        def counted():
            for lang, counts in seen.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])
            seen.clear()

        for batch in in_slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in seen:
                    if len(seen) >= 256:
                        yield from counted()
                    seen[lang] = np.zeros(BUCKETS + 1, dtype=np.int64)
                seen[lang][:BUCKETS] += np.bincount(buckets(text), minlength=BUCKETS)
                seen[lang][BUCKETS] += 1  # texts
        yield from counted()

    known = rows.select("text", "lang").where("text is not null and lang is not null")
    total = written(known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    first = total.where(F.col("bucket") == BUCKETS).orderBy(F.desc("n"), "lang").limit(most).select("lang")
    table = total.where(F.col("bucket") < BUCKETS).join(first, "lang", "left_semi").toPandas()
    langs = sorted(r.lang for r in first.collect())
    counts = np.full((BUCKETS, max(1, len(langs))), SMOOTH)
    if langs:
        at = {x: i for i, x in enumerate(langs)}
        counts[table.bucket, table.lang.map(at).to_numpy(dtype=np.int64)] += table.n
    return langs, np.log(counts / counts.sum(axis=0))


def _mixture(p: np.ndarray, c: np.ndarray, n: float) -> tuple[np.ndarray, float]:
    share = np.full(p.shape[1], 1 / p.shape[1])
    while True:
        new = share * ((c / (p @ share)) @ p) / n
        change = np.abs(new - share).max()
        share = new
        if not change >= TOLERANCE:
            break
    return share, float(c @ np.log(p @ share))


def judged(text: str, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Shares of all languages, shares within the selected set (0 outside it), and whether the text fits that set (see MISFIT)."""
    codes, counts = np.unique(buckets(text), return_counts=True)
    lp = logp[codes]
    c = counts * WEIGHT
    n, size = c.sum(), lp.shape[1]
    penalty = np.log(max(n, 2.0))
    p = np.exp(lp - lp.max(axis=1, keepdims=True))
    base = float(c @ lp.max(axis=1))
    shares, fit = _mixture(p, c, n)
    single = c @ lp
    best = int(single.argmax())
    chosen, least = np.zeros(size), -2 * single[best] + penalty
    chosen[best] = 1.0

    def fits() -> bool:
        gap = (np.count_nonzero(chosen) * penalty - least) / -2 - n * np.log(len(logp))
        return not (gap > MISFIT * n and 2 * gap > penalty)

    if -2 * (fit + base) + 2 * penalty >= least:  # no set of two or more can be better
        return shares, chosen, fits()
    keep, now, value = np.arange(size), shares, fit
    while len(keep) > 1:
        cost = -2 * (value + base) + len(keep) * penalty
        if cost < least:
            least, chosen = cost, np.zeros(size)
            chosen[keep] = now
        keep = np.delete(keep, now.argmin())
        now, value = _mixture(p[:, keep], c, n)
    return shares, chosen, fits()


def proportions(text: str, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of all languages, and shares within the selected set (0 outside it)."""
    return judged(text, logp)[:2]


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, text_col: str = "text") -> DataFrame:
    """Columns of docs but text_col, with lang_pred, score, lang_shares (map of the selected set)."""
    names = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, text_col):
            pred, score, mix = [], [], []
            for text in batch.column(text_col).to_pylist():
                if not langs or not has_letter(text):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    mix.append([])
                    continue
                shares, chosen = proportions(text, logp)
                k = int(chosen.argmax())
                pred.append(langs[k])
                score.append(min(1.0, max(0.0, float(shares[k]))))
                mix.append([(langs[i], float(chosen[i])) for i in np.flatnonzero(chosen)])
            columns = [*(batch.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score), pa.array(mix, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", "lang_shares"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != text_col)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, lang_shares map<string,double>")


def held_out(id_col: str = "doc_id"):
    """True for the fold that is never learned from: crc32 of the id as text, modulo 3, is 1. False for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, lang_shares) for each row. Learns from rows of the other folds with an id (a null
    id is in no fold, so nothing is learned from it), a text and a language. Texts that are null or have no letter, or all of them if there is nothing to learn from,
    are `und` with score 0."""
    rows = docs.select(docs[id_col], docs[text_col].alias("text"), docs[lang_col].alias("lang")).withColumn("held_out", held_out(id_col))
    langs, logp = learn(rows.where(~F.col("held_out") & F.col(id_col).isNotNull()))
    return predict(rows.select(id_col, "held_out", "text"), langs, logp)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs, each judged by its mixture. Texts that are null, have no letter or fit no language (see MISFIT) go. The others
    get the prediction of identify as their label; a label that no training row has can't be judged and stays. If there
    is nothing to learn from, every text with a letter stays as it is. Same columns."""
    learned = docs.where(~held_out(id_col) & F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    langs, logp = learn(learned)
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, text_col):
            keep, filled = [], []
            for text, lang in zip(batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist()):
                keep.append(has_letter(text))
                if keep[-1] and langs:
                    _, chosen, keep[-1] = judged(text, logp)
                    if lang is None or lang in langs:
                        lang = langs[int(chosen.argmax())]
                filled.append(lang)
            columns = [pa.array(filled, pa.string()) if c == lang_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
