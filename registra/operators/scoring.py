"""Scores by rule: URL candidates, consultation indicators, totals and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions import scalars as S
from registra.functions import vocab
from registra.operators import predicates as P
from registra.operators.aggs import consultation_counts
from registra.operators.joins import evidence_rows, latest_primary
from registra.operators.windows import keep_first

TIERS = [(90, "Excellent"), (75, "Good"), (60, "Moderate"), (40, "Weak")]


def rule_points(text: Column, rules: list[tuple[str, int]]) -> Column:
    """Sum of the points of all rules whose pattern is in text."""
    out = F.lit(0)
    for pattern, points in rules:
        out = out + F.when(text.rlike(pattern), points).otherwise(0)
    return out


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    return rule_points(text, [(k, 1) for k in keywords])


def candidate_score(candidates: DataFrame, keywords: list[str], paths: list[tuple[str, int]] = vocab.CONSULTATION_PATHS, phrases: list[tuple[str, int]] = vocab.CONSULTATION_PHRASES, methods: dict[str, int] = vocab.CANDIDATE_METHODS, per_hit: int = 16) -> DataFrame:
    """Adds score to candidates (text, href, url, method): keyword hits, path, phrases and how they were found."""
    both = S.fold_text(F.concat_ws(" ", "text", "href", "url"))
    return candidates.withColumn("score", keyword_hits(both, keywords) * per_hit + rule_points(S.fold_text(F.col("url")), paths) + rule_points(both, phrases) + method_points(methods))


def method_points(methods: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, points in methods.items():
        out = out + F.when(F.col("method") == name, points).otherwise(0)
    return out


def decision_score(candidates: DataFrame) -> DataFrame:
    """Adds score to candidates (text, href, url, method) of decision pages, by the rules on all of it and on each part."""
    text, href, url = (F.lower(F.coalesce(c, F.lit(""))) for c in ("text", "href", "url"))
    both = F.concat_ws(" ", text, href, url)
    score = rule_points(both, vocab.DECISION_ALL) + rule_points(url, vocab.DECISION_URL) + rule_points(text, vocab.DECISION_TEXT) + rule_points(href, vocab.DECISION_HREF)
    return candidates.withColumn("score", score + method_points(vocab.DECISION_METHODS))


def generic_score(candidates: DataFrame, keywords: list[tuple[str, int]] = vocab.PROCUREMENT_KEYWORDS) -> DataFrame:
    """Adds score and keyword_hits to candidates (text, href, url, method): points for each keyword, 8 more for a second
    and a third mention, 20 for two different keywords and 12 for three, and the general rules."""
    url = S.fold_text(F.col("url"))
    both = F.trim(F.concat_ws(" ", S.fold_text(F.col("text")), S.fold_text(F.col("href")), url))
    score, hits = rule_points(both, vocab.GENERIC_ALL) + rule_points(url, vocab.GENERIC_URL) + method_points(vocab.GENERIC_METHODS), F.lit(0)
    for pattern, points in keywords:
        n = F.regexp_count(both, F.lit(pattern))
        hits = hits + F.when(n > 0, 1).otherwise(0)
        score = score + F.when(n > 0, points + (F.least(n, F.lit(3)) - 1) * 8).otherwise(0)
    score = score + F.when(hits >= 2, 20).otherwise(0) + F.when(hits >= 3, 12).otherwise(0)
    return candidates.withColumn("keyword_hits", hits).withColumn("score", score)


def confirmed_score(scored: DataFrame, pages: DataFrame, pattern: str, points: int) -> DataFrame:
    """Scored candidates (page_id) with `points` more if their page (http_status, html) is there and holds the pattern:
    100 for decision pages, 52 for others. Adds valid and confidence."""
    seen = pages.select("page_id", (F.coalesce(F.col("http_status") == 200, F.lit(False)) & S.fold_text(F.col("html")).rlike(pattern)).alias("valid"))
    met = scored.join(seen, "page_id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    return met.withColumn("score", F.col("score") + F.when(F.col("valid"), points).otherwise(0)).withColumn("confidence", S.confidence_from_score(F.col("score")))


def fill_urls(registry: DataFrame, best: DataFrame, columns: dict[str, str]) -> DataFrame:
    """registry with the null URLs of its columns (category to column) filled from best (source_id, category, url)."""
    wide = best.groupBy("source_id").agg(*[F.min(F.when(F.col("category") == k, F.col("url"))).alias(f"__{c}") for k, c in columns.items()])
    met = registry.join(wide, "source_id", "left")
    return met.withColumns({c: F.coalesce(c, f"__{c}") for c in columns.values()}).select(*registry.columns)


def verified_score(scored: DataFrame, pages: DataFrame, signals: DataFrame, keywords: list[str]) -> DataFrame:
    """Adds page points to scored candidates (page_id): keywords on the page, +18 for any, list signals; valid needs status 200 and a hit."""
    text = pages.select("page_id", "http_status", S.fold_text(F.col("html")).alias("t"))
    hits = text.select("page_id", "http_status", keyword_hits(F.col("t"), keywords).alias("hits"))
    met = scored.join(hits, "page_id", "left").join(signals.select("page_id", F.col("score").alias("list_score")), "page_id", "left")
    n = F.coalesce("hits", F.lit(0))
    total = F.col("score") + n * 6 + F.when(n > 0, 18).otherwise(0) + F.coalesce("list_score", F.lit(0))
    return met.withColumn("valid", F.coalesce(F.col("http_status") == 200, F.lit(False)) & (n > 0)).withColumn("score", total).withColumn("confidence", S.confidence_from_score(F.col("score")))


def repeat_boost(scored: DataFrame, each: int = 8, most: int = 3) -> DataFrame:
    """One row for each (page_id, url): the best score, raised for repeats of the URL."""
    return scored.groupBy("page_id", "url").agg((F.max("score") + F.least(F.count("*") - 1, F.lit(most)) * each).alias("score"), F.min("pos").alias("pos"))


def link_categories(links: DataFrame, categories: dict[str, list[str]], least: int = 6) -> DataFrame:
    """(page_id, category, url, score, confidence): the best link for each category, with 5 points for each keyword
    in the text and 4 in the URL, if it has at least `least`."""
    score = lambda x, words: keyword_hits(x["text"], words) * 5 + keyword_hits(x["url"], words) * 4
    every = lambda x: F.array(*[F.struct(F.lit(name).alias("category"), score(x, words).alias("score")) for name, words in categories.items()])
    folded = F.struct(S.fold_text(F.col("text")).alias("text"), S.fold_text(F.col("abs_url")).alias("url"))
    rows = links.select("page_id", "pos", F.col("abs_url").alias("url"), F.inline(S.bound(folded, lambda x: F.filter(every(x), lambda s: s["score"] >= least))))
    best = keep_first(rows, ["page_id", "category"], [F.desc("score"), "pos"]).select("page_id", "category", "url", "score", "pos")
    return best.withColumn("confidence", F.least(F.lit(1.0), F.col("score") / 20.0)).drop("pos")


def best_pdf(links: DataFrame) -> DataFrame:
    score = F.when(F.lower("abs_url").rlike(r"\.pdf([?#]|$)"), 20).otherwise(0) + F.when(F.contains(S.fold_text(F.col("text")), F.lit("vendim")), 10).otherwise(0) + F.when(F.lower("abs_url").rlike("vendim"), 15).otherwise(0)
    return keep_first(links.withColumn("score", score), ["page_id"], [F.desc("score"), "pos"])


def pick_evidence(evidence: DataFrame, keep: Column, rank: Column | None = None) -> DataFrame:
    """One evidence row for each municipality: by rank, then newest, title and URL."""
    order = ([rank.desc()] if rank is not None else []) + [F.col("published_date").desc_nulls_last(), "title", F.col("attachment_url").asc_nulls_last(), "attachment_id"]
    return keep_first(evidence.where(keep), ["municipality_id"], order)


def calendar_rank(item: Column, document: Column, date: Column, year: int = 2026) -> Column:
    has = P.has_phrase
    return (
        F.when(has(document, ["plani i konsultimeve publike"]), 30).otherwise(0) + F.when(has(document, ["kalendari vjetor"]), 25).otherwise(0)
        + F.when(has(item, ["kalendari vjetor"]), 20).otherwise(0) + F.when(F.year(date) == year, 5).otherwise(0)
    )


def document_name(url: Column, file_name: Column) -> Column:
    """A document as arguments name it: the last part of its URL's path, else its file's name, and the URL behind."""
    part = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "([^/]+)/*$", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)
    name = S.clean_text(F.coalesce(S.nonblank(decoded), S.nonblank(file_name), F.lit("archived document")), 180)
    link = S.clean_text(F.coalesce(url, F.lit("")), 320)
    return F.when(link == "", name).otherwise(F.concat(name, F.lit(" ("), link, F.lit(")")))


def argument(kind: str, *values: Column) -> Column:
    """The fixed text of a kind with the values in it."""
    out = F.lit(vocab.ARGUMENTS[kind])
    for k, v in enumerate(values):
        out = F.replace(out, F.lit(f"{{{k}}}"), v.cast("string"))
    return out


def indicator_scores(municipality: DataFrame, registry: DataFrame, items: DataFrame, attachments: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """ind1..5 (automatic score, confidence, argument) of every municipality, in one pass over items and attachments: the
    best evidence of each kind is picked by one aggregation (see pick_evidence for the order).

    failed: (municipality_id) of those whose inputs could not be read; they get zeros and the text that asks for review."""
    evidence = evidence_rows(items, attachments)
    i, d = F.col("item_text"), F.col("document_text")
    kinds = {"annual": P.annual_calendar(i, d), "draft": P.draft_act(d), "response": P.response_document(i, d)}
    ranks = {"annual": calendar_rank(i, d, F.col("published_date"))}
    order = [F.col("published_date").isNull(), -F.unix_date(F.col("published_date").cast("date")), F.col("title"), F.col("attachment_url").isNull(), F.col("attachment_url"), F.col("attachment_id")]
    best = [F.min_by(document_name(F.col("attachment_url"), F.col("file_name")), F.when(k, F.struct(-ranks.get(n, F.lit(0)), *order))).alias(n) for n, k in kinds.items()]
    m = municipality.select(F.col("id").alias("municipality_id"), "name_key")
    url = latest_primary(registry).select("municipality_id", S.clean_text(F.coalesce("konsultime_url", F.lit("")), 240).alias("register_url"))
    all_ = m.join(consultation_counts(items, attachments), "municipality_id", "left").join(evidence.groupBy("municipality_id").agg(*best), "municipality_id", "left").join(url, "municipality_id", "left")
    n, files, with_files = (F.coalesce(c, F.lit(0)) for c in ("items", "attachments", "items_with_attachment"))
    found = {c: F.col(c).isNotNull() for c in kinds}
    has_register = F.coalesce("register_url", F.lit("")) != ""
    low, medium = F.lit("low"), F.lit("medium")
    rows = {
        1: (F.when(found["annual"], 10).otherwise(0), F.when(found["annual"], medium).otherwise(low), F.when(found["annual"], argument("annual", F.col("annual"))).otherwise(argument("no_annual"))),
        2: (F.when(has_register, 10).otherwise(0), F.when(has_register, medium).otherwise(low), F.when(has_register, argument("register", F.col("register_url"))).otherwise(argument("no_register"))),
        3: (
            F.when(found["draft"], 10).when((files > 0) | (n > 0), 5).otherwise(0), F.when(found["draft"], medium).otherwise(low),
            F.when(found["draft"], argument("draft", F.col("draft"))).when(files > 0, argument("documents", n, files, with_files)).when(n > 0, argument("items", n)).otherwise(argument("no_items")),
        ),
        4: (F.lit(0), low, argument("timeframe")),
        5: (F.when(found["response"], 10).otherwise(0), F.when(found["response"], medium).otherwise(low), F.when(found["response"], argument("response", F.col("response"))).otherwise(argument("no_response"))),
    }
    lost = F.lit(False)
    if failed is not None:
        all_ = all_.join(failed.select("municipality_id").distinct().withColumn("__failed", F.lit(True)), "municipality_id", "left")
        lost = F.coalesce("__failed", F.lit(False))
    columns = []
    for k, (score, confidence, text) in rows.items():
        columns += [F.when(lost, 0).otherwise(score).alias(f"ind{k}_auto"), F.when(lost, low).otherwise(confidence).alias(f"ind{k}_confidence"), F.when(lost, F.lit(vocab.PENDING_REVIEW)).otherwise(S.clean_text(text)).alias(f"ind{k}_argument")]
    return all_.select("municipality_id", "name_key", *columns)


def effective_scores(scores: DataFrame, indicators: int = 5) -> DataFrame:
    """Adds ind1..5 (final, else automatic), total and tier."""
    out = scores
    for k in range(1, indicators + 1):
        out = out.withColumn(f"ind{k}", F.coalesce(f"ind{k}_final", f"ind{k}_auto", F.lit(0)))
    total = sum((F.col(f"ind{k}") for k in range(2, indicators + 1)), F.col("ind1"))
    tier = F.lit("Critical")
    for least, name in reversed(TIERS):
        tier = F.when(F.col("total") >= least, name).otherwise(tier)
    return out.withColumn("total", total).withColumn("tier", tier)


def preview(stored: DataFrame, fresh: DataFrame, indicators: int = 5) -> DataFrame:
    """Stored final and automatic values, else the fresh automatic ones, with the total they give."""
    f = fresh.select("municipality_id", *[F.col(f"ind{k}_auto").alias(f"fresh{k}") for k in range(1, indicators + 1)])
    s = stored.select("municipality_id", *[F.coalesce(f"ind{k}_final", f"ind{k}_auto").alias(f"stored{k}") for k in range(1, indicators + 1)])
    met = f.join(s, "municipality_id", "left")
    cols = [F.coalesce(f"stored{k}", f"fresh{k}").alias(f"ind{k}") for k in range(1, indicators + 1)]
    out = met.select("municipality_id", *cols)
    return out.withColumn("total", sum((F.col(f"ind{k}") for k in range(2, indicators + 1)), F.col("ind1")))


def indicators_long(scores: DataFrame, indicators: int = 5) -> DataFrame:
    each = F.array(*[F.struct(F.lit(k).alias("indicator"), F.col(f"ind{k}_auto").alias("auto"), F.col(f"ind{k}_final").alias("final"), F.col(f"ind{k}_overridden").alias("overridden")) for k in range(1, indicators + 1)])
    return scores.select("municipality_id", F.explode(each).alias("x")).select("municipality_id", "x.*")
