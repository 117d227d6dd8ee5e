"""Joins: dimensions, keys and aliases, authorities, export rows, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.functions import scalars as S
from registra.functions import vocab


def with_municipality(df: DataFrame, municipality: DataFrame) -> DataFrame:
    """Inner join with the dimension; Spark broadcasts it as long as its size allows."""
    names = municipality.select(F.col("id").alias("municipality_id"), "name_sq", "name_key", "county")
    return df.join(names, "municipality_id")


def resolve_keys(keys: DataFrame, municipality: DataFrame, alias: DataFrame) -> DataFrame:
    """(key, municipality_id, matched_by): by name key, else by alias, else null. One row for each distinct key."""
    known = municipality.select(F.col("name_key").alias("key"), F.lit(0).alias("rank"), F.col("id").alias("municipality_id"))
    known = known.unionByName(alias.select(F.col("alias_key").alias("key"), F.lit(1).alias("rank"), "municipality_id"))
    first = known.groupBy("key").agg(F.min(F.struct("rank", "municipality_id")).alias("best"))
    by = F.when(F.col("best.rank") == 0, "name_key").when(F.col("best.rank") == 1, "alias")
    return keys.select("key").distinct().join(first, "key", "left").select("key", F.col("best.municipality_id").alias("municipality_id"), by.alias("matched_by"))


def resolve_names(names: DataFrame, municipality: DataFrame, collation: str = "UNICODE_CI_AI") -> DataFrame:
    """(name, municipality_id) of each distinct name as it is written: the smallest id whose name is equal in the collation,
    else null. One equi-join on the collation's keys. By default neither case nor marks count (in `sq`, ë is a letter)."""
    asked, known = names.select("name").distinct(), municipality.select("name_sq", "id")
    met = asked.join(known, F.collate("name", collation) == F.collate("name_sq", collation), "left")
    return met.groupBy("name").agg(F.min("id").alias("municipality_id"))


def authority_terms(municipality: DataFrame, alias: DataFrame, suffixes: list[str] = vocab.GENITIVE_SUFFIXES) -> DataFrame:
    """(municipality_id, name_key, term): names, keys and aliases, with genitive endings on last words of four letters or more."""
    alias = alias.groupBy("municipality_id").agg(F.collect_list("alias_key").alias("aliases"))
    m = municipality.select(F.col("id").alias("municipality_id"), "name_sq", "name_key").join(alias, "municipality_id", "left")
    texts = F.concat(F.array("name_sq", "name_key"), F.coalesce("aliases", F.array().cast("array<string>")))
    base = m.select("municipality_id", "name_key", F.explode(texts).alias("t")).select("municipality_id", "name_key", S.normalize_authority(F.col("t")).alias("t")).where("t <> ''")
    last = F.element_at(F.split("t", " "), -1)
    forms = F.when(F.length(last) >= 4, F.array("t", *[F.concat("t", F.lit(s)) for s in suffixes])).otherwise(F.array("t"))
    return base.select("municipality_id", "name_key", F.explode(forms).alias("term")).distinct()


def _grams(tokens: Column, longest: int) -> Column:
    """All runs of up to `longest` tokens, as text."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.when(k <= n, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(tokens, i, k), " "))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(runs))


def longest_term(terms: DataFrame) -> int:
    """Tokens of the longest term."""
    return terms.agg(F.coalesce(F.max(F.size(F.split("term", " "))), F.lit(1))).first()[0]


def match_authorities(rows: DataFrame, terms: DataFrame, overrides: dict[str, str] = vocab.EXACT_AUTHORITIES, prefixes: list[str] = vocab.OPERATOR_PREFIXES) -> DataFrame:
    """(id, authority, municipality_id, match_mode, matched_prefix, reason, matched_term) for each row (id, authority).

    Exact names first; then the tail after BASHKIA or MUNICIPALITY OF, which holds a term on token boundaries (first
    municipality by key, longest term); then allowlisted operators whose name ends in a term of exactly one
    municipality. Runs of tokens, as long as the longest term, meet the terms in equi-joins. Each distinct name is
    matched once; its outcome goes back to its rows."""
    longest = longest_term(terms)
    text = S.normalize_authority(F.col("authority"))
    marked = rows.select("authority").distinct().select(F.col("authority").alias("id"), "authority", text.alias("text"))
    bashkia = F.regexp_replace(F.trim(F.regexp_extract("text", r"\bBASHKIA\b(.*)$", 1)), r"^E\s+", "")
    unit = F.trim(F.regexp_extract("text", r"\bMUNICIPALITY\s+OF\b(.*)$", 1))
    marked = marked.withColumn("b", bashkia).withColumn("u", unit).withColumn("marker", F.col("text").rlike(r"\bBASHKIA\b|\bMUNICIPALITY\s+OF\b"))
    prefix = F.lit(None).cast("string")
    for p in reversed(prefixes):
        prefix = F.when((F.col("text") == p) | F.startswith("text", F.lit(p + " ")), p).otherwise(prefix)
    marked = marked.withColumn("prefix", prefix)

    exact = [(k, v) for k, v in overrides.items()]
    spark = rows.sparkSession
    exact = spark.createDataFrame(exact or [("", "")], "text string, name_key string")
    ids = terms.select("name_key", "municipality_id").distinct()
    exact = exact.join(ids, "name_key").select("text", F.col("municipality_id").alias("exact_id"))

    words = lambda c: F.split(c, " ")
    tails = marked.where("marker").select("id", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("b").alias("tail")), F.struct(F.lit(1).alias("way"), F.col("u").alias("tail")))).alias("x")).select("id", "x.*").where("tail <> ''")
    grams = tails.select("id", "way", F.explode(_grams(words(F.col("tail")), longest)).alias("term"))
    primary = grams.join(terms, "term").groupBy("id").agg(F.min(F.struct("name_key", (-F.length("term")).alias("len"), "term", "way", "municipality_id")).alias("p"))

    ends = marked.where(F.col("prefix").isNotNull()).select("id", words(F.col("text")).alias("w"))
    suffix = F.transform(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(longest))), lambda k: F.array_join(F.slice("w", F.size("w") - k + 1, k), " "))
    met = ends.select("id", F.explode(suffix).alias("term")).join(terms, "term")
    fallback = met.groupBy("id").agg(F.count_distinct("municipality_id").alias("n"), F.min("municipality_id").alias("one"), F.max_by("term", F.struct(F.length("term"), "term")).alias("fterm"))

    all_rows = marked.join(exact, "text", "left").join(primary, "id", "left").join(fallback, "id", "left")
    mode = F.when(F.col("exact_id").isNotNull(), "exact_override").when(F.col("p").isNotNull(), "primary").when(F.col("n") == 1, "operator_suffix")
    reason = (
        F.when(F.col("text") == "", "missing_authority")
        .when(F.col("exact_id").isNotNull(), "exact_override")
        .when(F.col("p").isNotNull(), F.when(F.col("p.way") == 0, "matched_bashkia").otherwise("matched_municipality_of"))
        .when(F.col("n") == 1, "matched_operator_suffix")
        .when(F.col("n") > 1, "ambiguous_operator_suffix")
        .when(F.col("prefix").isNotNull(), "operator_suffix_not_unique")
        .when(F.col("marker"), "unclear_authority_name")
        .otherwise("missing_municipality_marker")
    )
    found = all_rows.select(
        F.col("authority").alias("name"), F.coalesce("exact_id", "p.municipality_id", F.when(F.col("n") == 1, F.col("one"))).alias("municipality_id"), mode.alias("match_mode"),
        F.when(mode == "operator_suffix", F.col("prefix")).alias("matched_prefix"), reason.alias("reason"),
        F.when(mode == "primary", F.col("p.term")).when(mode == "operator_suffix", F.col("fterm")).alias("matched_term"),
    )
    return rows.select("id", "authority").join(found, F.col("authority").eqNullSafe(F.col("name")), "left").drop("name")


def mention_gap(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(municipality_id, mentions): rows (id, authority) that hold a term of the municipality anywhere."""
    grams = rows.select("id", F.explode(_grams(F.split(S.normalize_authority(F.col("authority")), " "), longest_term(terms))).alias("term"))
    return grams.join(terms, "term").select("id", "municipality_id").distinct().groupBy("municipality_id").agg(F.count("*").alias("mentions"))


def latest_primary(registry: DataFrame) -> DataFrame:
    """One primary registry row for each municipality: the last updated, ties to the larger id."""
    best = registry.where("is_primary").groupBy("municipality_id").agg(F.max_by(F.struct(*registry.columns), F.struct("updated_at", "id")).alias("r"))
    return best.select("r.*")


def with_attachments(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """items with `attachments`, an ordered array of structs (empty if none), n_attachments and primary_attachment."""
    parts = attachments.groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("created_at", "id", "file_name", "size_bytes"))).alias("attachments"), F.count("*").alias("n_attachments"), F.min_by("id", F.struct("created_at", "id")).alias("primary_attachment")
    )
    met = items.join(parts.withColumnRenamed("item_id", "id"), "id", "left")
    empty = F.array().cast("array<struct<created_at:timestamp_ntz,id:bigint,file_name:string,size_bytes:bigint>>")
    return met.withColumn("attachments", F.coalesce("attachments", empty)).withColumn("n_attachments", F.coalesce("n_attachments", F.lit(0)))


def match_export_rows(items: DataFrame, rows: DataFrame, scope: str | None = None, more: tuple[str, ...] = (), payload: Column | None = None) -> DataFrame:
    """(id, row_index, reason, candidates) for items (id, procedure_id, published_date, title) against export rows
    (row_index, procedure_id, published_date, title): by procedure id, first row wins; else by date and title if unique.
    scope: a column of both; an item meets only rows of its own scope. more: columns of items that are kept. payload: of
    the row that is matched, given as `row`."""
    within, held = F.col(scope) if scope else F.lit(""), F.lit(None) if payload is None else payload
    own = items.select("id", F.struct(F.col("id").alias("__id"), *more).alias("item"), within.alias("scope"), S.nonblank(S.normalize_procedure_id(F.col("procedure_id"))).alias("pid"), "published_date", S.normalize_title(F.col("title")).alias("t"))
    there = rows.select("row_index", held.alias("held"), within.alias("scope"), S.nonblank(S.normalize_procedure_id(F.col("procedure_id"))).alias("pid"), "published_date", S.normalize_title(F.col("title")).alias("t"))
    by_id = there.where("pid is not null").groupBy("scope", "pid").agg(F.min("row_index").alias("first_row"), F.min_by("held", "row_index").alias("first_held"), F.count("*").alias("id_rows"))
    by_title = there.where("published_date is not null and t <> ''").groupBy("scope", "published_date", "t").agg(F.min("row_index").alias("title_row"), F.min_by("held", "row_index").alias("title_held"), F.count("*").alias("title_rows"))
    met = own.join(by_id, ["scope", "pid"], "left").join(by_title, ["scope", "published_date", "t"], "left")
    comparable = F.col("published_date").isNotNull() & (F.col("t") != "")
    reason = (
        F.when(F.col("first_row").isNotNull(), "matched_procedure_id")
        .when(~comparable, F.when(F.col("pid").isNotNull(), "procedure_not_found").otherwise("missing_fallback_identifiers"))
        .when(F.col("title_rows") == 1, "matched_title_date_fallback")
        .when(F.col("title_rows") > 1, "ambiguous_title_date_fallback")
        .otherwise("no_export_row_match")
    )
    row = F.when(F.col("first_row").isNotNull(), F.col("first_row")).when(F.col("title_rows") == 1, F.col("title_row"))
    count = F.coalesce(F.col("id_rows"), F.when(comparable, F.coalesce("title_rows", F.lit(0))), F.lit(0))
    found = F.when(F.col("first_row").isNotNull(), F.col("first_held")).when(F.col("title_rows") == 1, F.col("title_held"))
    return met.select("id", *[F.col(f"item.{c}").alias(c) for c in more], row.alias("row_index"), reason.alias("reason"), count.alias("candidates"), *([] if payload is None else [found.alias("row")]))


def missing_and_extra(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, side): expected members that aren't found, and found ones that aren't expected."""
    missing = expected.select(key).distinct().join(found, key, "left_anti").withColumn("side", F.lit("missing"))
    extra = found.select(key).distinct().join(expected, key, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    fresh = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*incoming.columns))).where("__n = 1").drop("__n")
    return target.unionByName(fresh.join(target, keys, "left_anti"), allowMissingColumns=True)


def evidence_rows(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """Published consultation items with their attachments, and the normalised texts that rules look into."""
    own = items.where("status = 'published' and category = 'Konsultime publike'")
    a = attachments.select(F.col("id").alias("attachment_id"), F.col("item_id").alias("id"), "file_name", F.col("source_url").alias("attachment_url"))
    met = own.join(a, "id")
    return met.withColumn("item_text", S.normalize_title(F.concat_ws(" ", "title", "summary", "source_url"))).withColumn("document_text", S.normalize_title(F.concat_ws(" ", "attachment_url", "file_name")))


def reconcile(stored: DataFrame, served: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(municipality_id, stored, served, reason): totals that differ or are on one side only."""
    met = stored.select("municipality_id", F.col("total").alias("stored")).join(served.select("municipality_id", F.col("total").alias("served")), "municipality_id", "full")
    diff = F.abs(F.col("stored") - F.col("served"))
    return met.withColumn("reason", F.when(F.col("served").isNull(), "missing_served").when(F.col("stored").isNull(), "missing_stored").when(diff <= tolerance, "match").otherwise("total_mismatch"))


def visible_attachments(attachments: DataFrame, items: DataFrame) -> DataFrame:
    live = items.where("status = 'published'").select(F.col("id").alias("item_id"))
    return attachments.join(live, "item_id", "left_semi")


def canonical_urls(registry: DataFrame, overrides: DataFrame, template: str) -> DataFrame:
    """Registry rows whose URL changes: to the override of their key, else to the template with the key in it."""
    wanted = F.coalesce("override_url", F.format_string(template, "name_key"))
    met = registry.join(overrides.select("name_key", F.col("url").alias("override_url")), "name_key", "left").withColumn("new_url", wanted)
    return met.where(~F.col("new_url").eqNullSafe(F.col("vendime_url"))).drop("override_url")
