"""Personal data with bootstrapped contextual extraction, on DataFrame functions alone.

Base kinds (email, ip, card, phone) are reported wherever they match and are the seeds. Their contexts induce
lexical patterns: the two words before and the word after, and a label before (a word that ends in : = or #).
Identifier-like strings that no base rule covers are the candidates. Over the graph of patterns and values, each
round scores patterns by the share of their values that is known, and values by the patterns that hold them
(noisy or); patterns of high confidence and enough distinct values pass their kind on to candidates.

The graph has a row for each distinct (pattern, value). Texts are known by a digest, so copies add no support.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.llm import spans
from registra.llm.common import written

KINDS = ["email", "ip", "card", "phone", "ctx_email", "ctx_ip", "ctx_card", "ctx_phone"]
#: Distinct known values that a pattern needs, and the confidence from which patterns and values count as known.
SUPPORT, CONFIDENT = 3, 0.8

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
# Identifier-like strings (letters, digits and hyphens; five digits or more are asked for below) and masked addresses.
CANDIDATE = (
    r"(?:(?<![A-Za-z0-9.+@-])(?=[A-Za-z-]*+[0-9])[A-Za-z0-9][A-Za-z0-9-]{5,}+(?![A-Za-z0-9@-])"
    r"|(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++\x20?[(\[](?i:at)[)\]]\x20?[A-Za-z0-9.-]++(?:\x20?[(\[](?i:dot)[)\]]\x20?[A-Za-z0-9-]++)*+(?![A-Za-z0-9@-]))"
)
#: Code points before and after a value in which its contexts' words are looked for first. Where a word is cut there, it
#: is looked for in so many more, and then in the whole text: contexts are of whole words.
CONTEXT = (60, 40)
WIDER = 1000


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        c = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, c).otherwise(2 * c - F.when(c > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _found(text: Column) -> list[Column]:
    """The base matches of each kind, failing ones dropped."""
    n = lambda x: F.length(_digits(x["hit"]))
    return [
        spans.matches(text, EMAIL, r"@[A-Za-z0-9-]+\."),
        F.filter(spans.matches(text, IP, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), lambda x: x["hit"].rlike(OCTETS)),
        F.filter(spans.matches(text, CARD, r"[0-9](?:[\x20-]?[0-9]){15}"), lambda x: F.when(n(x).between(16, 19), _luhn(_digits(x["hit"]))).otherwise(False)),
        F.filter(spans.matches(text, PHONE, r"\+[0-9]"), lambda x: n(x).between(8, 15)),
    ]


def base_spans(text: Column) -> Column:
    """Array of struct<k, start, end> by kind, then start."""
    return F.concat(*[spans.numbered(x, k, "ksb") for k, x in enumerate(_found(text))])


def _mentions(cut: Column, found: Column, k: int | None, context: tuple[int, int]) -> Column:
    """Array of struct<k, start, end, value, patterns>; k is null for candidates. cut: the text's pieces."""
    fold = lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), "[0-9]", "0"), r"\s+", " ")

    def widened(near: Column, is_cut: Column, wider: Column, still_cut: Callable[[Column], Column], whole: Column) -> Column:
        more = F.transform(F.array(wider), lambda w: F.when(still_cut(w), whole).otherwise(w))[0]
        return F.when(is_cut, more).otherwise(near)

    def one(x):
        begin = lambda n: spans.between(cut, F.greatest(F.lit(0), x["start"] - n), x["start"])
        end = lambda n: spans.between(cut, x["end"], x["end"] + n)
        # at most two words fit: the first of them may be cut, unless the text begins there
        few = lambda w, n: (x["start"] > n) & ~w.rlike(r"\s\S+\s+\S+\s*$")
        before = F.transform(F.array(begin(context[0])), lambda w: widened(w, few(w, context[0]), begin(WIDER), lambda v: few(v, WIDER), begin(x["start"])))[0]
        long = lambda w, n: (F.length(w) == n) & w.rlike(r"^\s*\S+$")
        after = F.transform(F.array(end(context[1])), lambda w: widened(w, long(w, context[1]), end(WIDER), lambda v: long(v, WIDER), end(F.lit(2**31 - 1) - x["end"])))[0]
        before, after = fold(before), F.regexp_extract(fold(after), r"^ ?(\S+)", 1)
        two, label = F.regexp_extract(before, r"(\S+ \S+) ?$", 1), F.regexp_extract(before, r"(\S*\w\S*[:=#]) ?$", 1)
        patterns = F.array_compact(F.array(F.when((two != "") & (after != ""), F.concat(two, F.lit(" _ "), after)), F.when(label != "", F.concat(label, F.lit(" _")))))
        return F.struct(F.lit(k).cast("int").alias("k"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["hit"]).alias("value"), patterns.alias("patterns"))

    return F.transform(found, one)


def _candidates(text: Column) -> Column:
    found = spans.matches(text, CANDIDATE, r"[0-9](?:[A-Za-z-]*+[0-9]){4}|(?i)[(\[]at[)\]]")
    return F.filter(found, lambda x: (F.length(_digits(x["hit"])) >= 5) | x["hit"].rlike(r"(?i)[(\[]at[)\]]"))


def discovered(mentions: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(value, k): candidates that patterns of high confidence give a kind. mentions: (k, value, patterns), k null for
    candidates. Rounds go on until one finds no new pattern and no new confident value; both only grow."""
    graph = mentions.select("value", "k", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.min("k").alias("seed"))
    graph = written(graph, "graph")
    known = graph.where("seed is not null").select("value", F.col("seed").alias("k"), F.lit(1.0).alias("score")).distinct()
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    seeds, before = known, None
    while True:
        held = graph.join(known, "value").groupBy("pattern", "k").agg(F.sum("score").alias("held"), F.count_if(F.col("score") >= confident).alias("sure"))
        scored = held.join(sizes, "pattern").withColumn("conf", F.col("held") / (F.col("n") + 0.5))
        patterns = written(scored.where((F.col("sure") >= support) & (F.col("conf") >= confident)).select("pattern", "k", "conf"), "patterns")
        noisy = (1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score")
        passed = written(graph.where("seed is null").join(patterns, "pattern").groupBy("value", "k").agg(noisy), "values")
        now = (patterns.count(), passed.where(F.col("score") >= confident).count())
        if not now[1] or before and now[0] <= before[0] and now[1] <= before[1]:
            break
        before = now
        known = seeds.unionByName(passed)
    best = passed.where(F.col("score") >= confident).groupBy("value").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"))
    return best


def _extra(docs: DataFrame, context: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The rows' ids, digests and base spans, written; and for each digest the spans that contexts discover."""
    text = F.col("text")
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    kinds = rows.withColumns({f"f{k}": x for k, x in enumerate([*_found(text), _candidates(text)])})
    some = sum((F.size(f"f{k}") for k in range(1, 5)), F.size("f0")) > 0
    kinds = kinds.select("id", F.md5(text.cast("binary")).alias("key"), *[f"f{k}" for k in range(5)], F.when(some, spans.pieces(text)).alias("cut"))
    base = F.concat(*[spans.numbered(F.col(f"f{k}"), k, "ksb") for k in range(4)])
    every = F.concat(*[_mentions(F.col("cut"), F.col(f"f{k}"), k if k < 4 else None, context) for k in range(5)])
    found = written(kinds.select("id", "key", base.alias("base"), every.alias("mentions")), "pii")
    mentions = found.where("size(mentions) > 0").dropDuplicates(["key"]).select("key", F.explode("mentions").alias("m")).select("key", "m.*")
    mentions = spans.apart(mentions, F.col("k").isNotNull())
    values = discovered(mentions)
    hits = mentions.where("k is null").drop("k").join(values, "value")
    extra = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct((F.col("k") + 4).alias("k"), "start", "end"))).alias("extra"))
    return found, written(extra, "extra")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: tuple[int, int] = CONTEXT) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context) for each row of docs, repeated rows included.

    A null text counts as empty: no spans, and the digest of the empty string. Positions are code points, end
    exclusive; spans are ordered by kind, then start. context: see CONTEXT. Columns of other names aren't read."""
    found, extra = _extra(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), context)
    both = found.select("id", "key", "base").join(extra, "key", "left")
    every = F.concat("base", F.coalesce("extra", F.array().cast("array<struct<k:int,start:int,end:int>>")))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    return both.select(
        F.col("id").alias(id_col),
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(spans.text_of(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        spans.text_of(every, KINDS).alias("spans"),
        (F.size(every) - F.size("base")).cast("long").alias("n_context"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets, and length_col, if there is one,
    set to the new length. Null texts stay null; all other columns and all rows stay."""
    key, extra_col = "__key", "__extra"
    while key in docs.columns or extra_col in docs.columns:
        key, extra_col = "_" + key, "_" + extra_col
    _, extra = _extra(docs.select(F.lit(None).cast("int").alias("id"), docs[text_col].alias("text")), CONTEXT)
    extra = extra.select(F.col("key").alias(key), F.col("extra").alias(extra_col))
    rows = docs.withColumn(key, F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary"))).join(extra, key, "left")
    text = F.col(text_col)
    every = F.concat(base_spans(F.coalesce(text, F.lit(""))), F.coalesce(F.col(extra_col), F.array().cast("array<struct<k:int,start:int,end:int>>")))
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["k"].alias("k"))))
    names = F.array(*[F.lit(f"<{k.removeprefix('ctx_').upper()}>") for k in KINDS])

    def clean_of(both):
        def step(at, x):
            fresh = F.concat(spans.between(both["cut"], at, x["start"]), F.element_at(names, x["k"] + 1))
            return F.greatest(at, -x["less"]), F.when(x["start"] >= at, fresh).otherwise("")

        done = spans.running(both["found"], F.lit(0), step, "string")
        return F.transform(F.array(done), lambda s: F.concat(F.array_join(s["out"], ""), spans.between(both["cut"], s["at"], F.length(text))))[0]

    bound = lambda found: F.transform(F.array(F.struct(found.alias("found"), spans.pieces(text).alias("cut"))), clean_of)[0]
    clean = F.transform(F.array(ordered), lambda found: F.when(F.size(found) > 0, bound(found)).otherwise(text))[0]
    clean = F.when(text.isNotNull(), clean)
    out = rows.withColumn(text_col, clean)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(dict(docs.dtypes)[length_col]))
    return out.select(*docs.columns)
