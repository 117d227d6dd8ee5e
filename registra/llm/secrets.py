"""Secret scan with multipart credential linking, on DataFrame functions alone.

Base kinds (assign, access, hex) are reported wherever they match. Weak parts are reported only beside their
complement: a named identifier beside a secret, a long mixed blob beside an access or other identifier, an endpoint
beside a base part. Beside means that they start within SCOPE code points of one text: an interval join, evaluated
as a window with a range frame, which can't hold more parts than fit into the scope. Weak parts that overlap a base
span are no parts.

Texts are known by a digest, so copies are linked once, and the text itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.llm import spans
from registra.llm.common import written

KINDS = ["assign", "access", "hex", "identifier", "blob", "endpoint"]
#: Code points between the starts of parts that belong together.
SCOPE = 200

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = r"""(?i:access_?key_?id|access_?key|client_?id|key_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
BLOB = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]{32})(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]++=*"
ENDPOINT = r"""(?i:(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{4,})"""


def _base(text: Column) -> Column:
    assign = F.filter(spans.matches(text, ASSIGN, ASSIGN[:-2] + "{6,})", group=2), lambda x: F.length(x["hit"]) >= 6)
    kinds = [assign, spans.matches(text, ACCESS), spans.matches(text, HEX)]
    return F.array_sort(F.concat(*[spans.numbered(x, k) for k, x in enumerate(kinds)]))


def _weak(text: Column) -> Column:
    return F.concat(*[spans.numbered(spans.matches(text, p), k) for k, p in ((3, IDENTIFIER), (4, BLOB), (5, ENDPOINT))])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for each row of docs, repeated rows included.

    A null text counts as empty: no spans, and the digest of the empty string. Positions are code points, end
    exclusive; spans are ordered by start, then kind. Columns of other names aren't read."""
    text = F.coalesce(docs[text_col], F.lit(""))
    found = docs.select(docs[id_col].alias("id"), F.md5(text.cast("binary")).alias("key"), text.alias("text"))
    found = found.select("id", "key", _base(F.col("text")).alias("base"), _weak(F.col("text")).alias("weak"))
    found = written(found, "secrets")

    parts = found.where("size(weak) > 0").dropDuplicates(["key"]).select("key", F.explode(F.concat("base", "weak")).alias("p")).select("key", "p.*")
    parts = spans.apart(parts, F.col("k") < 3)
    near = Window.partitionBy("key").orderBy("start").rangeBetween(-scope, scope)

    def beside(*ks: int) -> Column:
        return F.max(F.col("k").isin(*ks)).over(near)

    complement = F.when(F.col("k") == 3, beside(0, 2, 4)).when(F.col("k") == 4, beside(1, 3)).when(F.col("k") == 5, beside(0, 1, 2))
    linked = parts.withColumn("linked", complement).where("linked")
    extra = written(linked.groupBy("key").agg(F.collect_list(F.struct("start", "k", "end")).alias("extra")), "linked")
    both = found.select("id", "key", "base").join(extra, "key", "left")
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,k:int,end:int>>"))))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    return both.select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans.text_of(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        spans.text_of(every, KINDS).alias("spans"),
        (F.size(every) - F.size("base")).cast("long").alias("n_linked"),
    )
