"""Lines that many documents share, dropped from all of them but one, on DataFrame functions alone.

Lines are exploded with their position, normalised and hashed; the distinct documents of each hash are counted; the
positions of lines whose hash is over the threshold go back to their document, which is put together again from the
lines at other positions.

Only hashes, ids and positions meet by hash: a line that a third of all documents hold is counted by partial
aggregates over (hash, document), and its positions meet the one row of its hash in a join that Spark can split.
Texts are shuffled once, to the positions of their own row, known by id and digest; without a hash over the threshold
in them, they meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.llm.common import written

#: Code points of a key, and documents that hold it, from which a line counts as shared.
LEAST_CHARS, LEAST_DOCS = 40, 5
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(text: Column) -> Column:
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))  # never null, so joins need not look


def key_of(bare: Column) -> Column:
    """A line without white space at its ends, with small letters for A to Z alone."""
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.withColumn("digest", _digest(F.col("text")))


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(id, digest, pos, hash) of every line long enough, and (hash, docs, last) of the hashes that at least so many
    documents hold; last is the largest id."""
    each = _rows(docs, id_col, text_col).select("id", "digest", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = each.withColumn("bare", F.btrim("line", F.lit(BLANKS))).where(F.length("bare") >= least_chars)
    lines = lines.select("id", "digest", "pos", _digest(key_of(F.col("bare"))).alias("hash"))
    counted = lines.groupBy("hash").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("last"))
    # written, so that it meets the lines from a scan: a join of two shuffles is one that Spark can split at a hot hash
    return lines, written(counted.where(F.col("docs") >= least_docs), "shared_lines")


def _without(text: Column, dropped: Column) -> Column:
    """struct<n_lines, kept>: the lines of text at other positions than those of the sorted array dropped, joined. The
    flags run from gap to gap between these positions, so it takes time with the number of lines alone."""
    before = F.concat(F.array(F.lit(-1)), dropped)  # one more, without a partner: its gap is null
    gaps = F.transform(F.arrays_zip(dropped.alias("to"), before.alias("after")), lambda x: F.when(x["to"].isNotNull(), F.concat(F.array_repeat(F.lit(False), x["to"] - x["after"] - 1), F.array(F.lit(True)))))
    flags = F.flatten(F.array_compact(gaps))
    both = F.arrays_zip(F.split(text, "\n", -1).alias("line"), flags.alias("gone"))
    kept = lambda zipped: F.array_join(F.transform(F.filter(zipped, lambda x: ~F.coalesce(x["gone"], F.lit(False))), lambda x: x["line"]), "\n")
    return F.transform(F.array(both), lambda zipped: F.struct(F.size(zipped).alias("n_lines"), kept(zipped).alias("kept")))[0]


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(id, text, n_lines, n_dropped) for each row of docs, repeated rows included: text without the lines whose key is
    shared, but in the document of the largest id, where all of them stay.

    A null or empty text is one empty line. Rows of one id are one document when holders are counted. A null id is no
    document: it adds nothing to the count, and its shared lines go. Columns of other names aren't read."""
    lines, shared = shared_lines(docs, id_col, text_col, least_chars, least_docs)
    gone = lines.join(shared, "hash").where(F.col("id").isNull() | (F.col("id") < F.col("last")))
    # rows with the same id and text give the same positions, so a set holds them once
    gone = gone.groupBy("id", "digest").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    gone = gone.select(F.col("id").alias("of"), F.col("digest").alias("text_digest"), "dropped")
    rows = _rows(docs, id_col, text_col)
    met = rows.join(gone, (F.col("digest") == F.col("text_digest")) & F.col("id").eqNullSafe(F.col("of")), "left")
    done = F.when(F.col("dropped").isNull(), F.struct(F.size(F.split("text", "\n", -1)).alias("n_lines"), F.col("text").alias("kept"))).otherwise(_without(F.col("text"), F.col("dropped")))
    out = met.select("id", "dropped", done.alias("done"))
    return out.select(F.col("id").alias(id_col), F.col("done.kept").alias(text_col), F.col("done.n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) for each row of docs, see deduplicated()."""
    found = deduplicated(docs, id_col, text_col)
    return found.select(id_col, "n_lines", "n_dropped", F.sha2(F.col(text_col).cast("binary"), 256).alias("kept_sha256"))
