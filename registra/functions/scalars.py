"""Column functions: normalisation, URLs, dates, amounts, keys. All are expressions; only nfkd_fold runs Python."""

from __future__ import annotations

import unicodedata
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from registra.functions import vocab

BLANK = r"^\s*$"


def _fold_table() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one base letter and marks, and these base letters."""
    found = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not "̀" <= c <= "ͯ")
        if len(base) == 1 and base != chr(code):
            found[chr(code)] = base
    return "".join(found), "".join(found.values())


FOLD_FROM, FOLD_TO = _fold_table()


def bound(value: Column, of) -> Column:
    """of(value) with the value computed once, wherever `of` names it. Spark shares equal expressions only within one
    projection's generated code, not in filters, branches or functions of arrays."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, of)


def beyond_ascii(c: Column, of) -> Column:
    """of(c) for texts with letters that ASCII lacks; others, which are most, have nothing to change and stay."""
    return bound(c, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(of(t)))


def fold(c: Column) -> Column:
    """Drop accents: letters with marks become base letters, combining marks go."""
    return beyond_ascii(c, lambda t: F.regexp_replace(F.translate(t, FOLD_FROM, FOLD_TO), "[̀-ͯ]", ""))


@F.pandas_udf(StringType())
def nfkd_fold(texts: pd.Series) -> pd.Series:
    """Exact NFKD fold, for text beyond the table of fold()."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ"))


def nonblank(c: Column) -> Column:
    """Null for blank text, else trimmed."""
    return F.nullif(F.trim(c), F.lit(""))


def normalize_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def normalized(text: str) -> str:
    """normalize_title of one string, on the driver."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not "\u0300" <= c <= "\u036f")
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())


def fold_text(c: Column) -> Column:
    """Lower case without accents and marks of any script, runs of white space as one space."""
    plain = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.lower(beyond_ascii(plain, lambda t: F.regexp_replace(fold(t), r"\p{M}+", "")))


def normalize_authority(c: Column) -> Column:
    return F.upper(normalize_title(c))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def legacy_key(c: Column) -> Column:
    """Only e-diaeresis and c-cedilla are folded; all other characters outside a-z and 0-9 are deleted."""
    return F.regexp_replace(F.translate(F.lower(c), "ëç", "ec"), "[^a-z0-9]", "")


def normalize_procedure_id(c: Column) -> Column:
    return F.upper(slugify(c))


def normalize_decision_number(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(fold(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]", ""), F.lit("")), F.lit("n"))


def clean_text(c: Column, most: int = 600) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]+", " "), r"\s+", " "))
    return F.when(F.length(plain) > most, F.concat(F.trim(F.substring(plain, 1, most - 1)), F.lit("..."))).otherwise(plain)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def compare_host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r"\.$", "")


def parse_http_url(url: Column) -> Column:
    trimmed = F.trim(url)
    return F.when(F.lower(F.try_parse_url(trimmed, F.lit("PROTOCOL"))).isin("http", "https"), trimmed)


def normalize_url(url: Column) -> Column:
    return F.when(F.try_parse_url(F.trim(url), F.lit("HOST")).isNotNull(), F.split_part(F.trim(url), F.lit("#"), F.lit(1)))


def base_parts(base: Column) -> Column:
    """What absolute links need of a page's URL: struct<scheme, origin, plain, folder>."""
    root = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)"

    def parts(plain):
        folder = F.regexp_extract(plain, root[:-1] + "(?:/.*/|/)?)", 1)
        closed = bound(folder, lambda f: F.when(F.endswith(f, F.lit("/")), f).otherwise(F.concat(f, F.lit("/"))))
        return F.struct(F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1).alias("scheme"), F.regexp_extract(plain, root, 1).alias("origin"), plain.alias("plain"), closed.alias("folder"))

    return bound(F.regexp_replace(base, r"[?#].*$", ""), parts)


def resolved(b: Column, href: Column) -> Column:
    """href against the parts of a page's URL; null for fragments, scripts and mail or phone links."""

    def joined(h):
        return (
            F.when(h.isNull() | (h == "") | h.rlike(r"(?i)^(#|\*|mailto:|tel:|javascript:|data:)"), None)
            .when(F.startswith(h, F.lit("//")), F.concat(b["scheme"], h))
            .when(F.startswith(h, F.lit("/")), F.concat(b["origin"], h))
            .when(F.startswith(h, F.lit("?")), F.concat(b["plain"], h))
            .when(h.rlike("(?i)^[a-z][a-z0-9+.-]*://"), h)
            .otherwise(F.concat(b["folder"], h))
        )

    dotted = lambda u: F.contains(u, F.lit("/.")) & u.rlike(r"/\.\.?(/|[?#]|$)")
    return bound(bound(F.trim(href), joined), lambda u: F.when(dotted(u), without_dots(u)).otherwise(u))


def absolute_url(base: Column, href: Column) -> Column:
    """href against base; null for fragments, scripts and mail or phone links."""
    return bound(base_parts(base), lambda b: resolved(b, href))


def without_dots(url: Column) -> Column:
    """A URL whose path has no . and .. segments any more; .. above the root goes."""
    origin, path, rest = (F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))

    def step(kept, part):
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    return F.concat(origin, F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"), rest)


def is_document_url(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).rlike(r"\.(pdf|doc|docx|rtf|xls|xlsx)(\?|#|$)|[?&](download|file|attachment_id)=|/download/?")


ASSETS = r"\.(png|jpe?g|webp|gif|svg|ico|css|js|map|woff2?|ttf|otf|eot|mp4|webm|mov|avi|mp3|wav)(\?|#|$)"


def looks_like_document(url: Column) -> Column:
    """The page scan's rule: assets are no documents; then extensions, archives too, and download addresses."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return ~u.rlike(ASSETS) & (u.rlike(r"\.(pdf|docx?|rtf|xlsx?|zip|rar)(\?|#|$)") | u.rlike(r"[?&](download|file|attachment_id)=") | u.rlike("/download/?"))


def is_attachment_url(url: Column) -> Column:
    """The attachments' rule: http only; an allowed extension in path or query, a download path or a download parameter."""
    raw = parse_http_url(url)
    path = F.lower(F.coalesce(F.try_url_decode(F.try_parse_url(raw, F.lit("PATH"))), F.lit("")))
    query = F.lower(F.coalesce(F.try_parse_url(raw, F.lit("QUERY")), F.lit("")))
    found = attachment_ext(raw).isNotNull() | path.rlike("/(downloads?|files?|attachments?)(/|$)") | query.rlike("(^|&)(download|file|attachment|attachment_id|document)(=|&|$)")
    return F.coalesce(raw.isNotNull() & (found | F.lower(raw).rlike(r"\.(pdf|docx?|zip)(\?|#|$)")), F.lit(False))


def is_office_url(url: Column) -> Column:
    """The candidate search's rule: any office or archive extension."""
    return F.lower(F.coalesce(url, F.lit(""))).rlike(r"\.(pdf|docx?|xlsx?|zip|rar|7z|pptx?|rtf|od[tsp])(\?|#|$)")


def attachment_ext(url: Column) -> Column:
    """Extension from the path, else from any value of the query; only pdf, doc, docx and zip."""
    path = F.lower(F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("PATH"))), F.lit("")))
    query = F.lower(F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"))), F.lit("")))
    return F.coalesce(nonblank(F.regexp_extract(path, r"\.(pdf|docx|doc|zip)$", 1)), nonblank(F.regexp_extract(query, r"\.(pdf|docx|doc|zip)(?:&|$)", 1)))


def ext_from_content_type(c: Column) -> Column:
    kinds = {
        "application/pdf": "pdf",
        "application/msword": "doc",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
        "application/zip": "zip",
        "application/x-zip-compressed": "zip",
    }
    pairs = [x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.trim(F.lower(F.split_part(c, F.lit(";"), F.lit(1)))))


def detect_attachment_type(content: Column, declared: Column) -> Column:
    """The type by its first bytes where the declared one agrees or is missing; null on disagreement."""
    magic = F.hex(F.substring(content, 1, 8))
    seen = (
        F.when(F.startswith(magic, F.lit("255044462D")), F.array(F.lit("pdf")))
        .when(F.startswith(magic, F.lit("504B0304")), F.array(F.lit("zip"), F.lit("docx")))
        .when(F.startswith(magic, F.lit("D0CF11E0A1B11AE1")), F.array(F.lit("doc")))
    )
    return F.when(seen.isNull(), None).when(declared.isNull(), F.when(seen[0] != "doc", seen[0])).when(F.array_contains(seen, declared), declared)


def strict_iso_date(c: Column) -> Column:
    return bound(F.trim(c), lambda t: F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date")))


def _dmy(c: Column, pattern: str, order: tuple[int, int, int] = (1, 2, 3)) -> Column:
    """yyyy-mm-dd text of a pattern's groups (day, month, year); null where it doesn't match. The text is searched once;
    the groups are taken from what is found."""

    def text(y, m, d):
        year = F.when(F.length(y) == 2, F.concat(F.when(y.try_cast("int") <= 30, F.lit("20")).otherwise(F.lit("19")), y)).when(F.length(y) == 5, F.substring(y, 1, 4)).otherwise(y)
        return F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))

    def of(found):
        d, m, y = (F.regexp_extract(found, pattern, k) for k in order)
        return F.when(found != "", bound(y, lambda own: text(own, m, d)))

    return bound(F.regexp_extract(c, pattern, 0), of)


def export_date(c: Column) -> Column:
    """ISO, or day, month and year with . / or -; real dates only."""
    t = F.trim(c)
    return F.coalesce(strict_iso_date(F.substring(t, 1, 10)), _dmy(t, r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:\D|$)").try_cast("date"))


def numeric_date(c: Column) -> Column:
    """First d.m.y of a text; years of two digits turn at 30, of five lose the last; real dates only."""
    return _dmy(c, r"(?:^|\D)(\d{1,2})[./-](\d{1,2})[./-](20\d{3}|\d{4}|\d{2})(?:\D|$)").try_cast("date")


def free_text_date(c: Column) -> Column:
    """First d.m.y, else y.m.d, as text and unchecked; strict_iso_date nulls what is no date."""
    return F.coalesce(_dmy(c, r"(?:^|\D)(\d{1,2})[./-](\d{1,2})[./-](\d{4})"), _dmy(c, r"(?:^|\D)(\d{4})[./-](\d{1,2})[./-](\d{1,2})", (3, 2, 1)))


def month_name_date(c: Column) -> Column:
    """'Mon d, yyyy' in English, 'd Month, yyyy' in Albanian."""
    t = fold_text(c)

    def month(names: list[str], name: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, n in enumerate(names, 1):
            out = F.when(F.startswith(name, F.lit(n)), F.lpad(F.lit(str(k)), 2, "0")).otherwise(out)
        return out

    en, sq = rf"\b({'|'.join(vocab.MONTHS_EN)})[a-z]*\.? (\d{{1,2}}),? (\d{{4}})", rf"\b(\d{{1,2}}) ({'|'.join(vocab.MONTHS_SQ)})[a-z]*,? (\d{{4}})"
    first = F.concat_ws("-", F.regexp_extract(t, en, 3), month(vocab.MONTHS_EN, F.regexp_extract(t, en, 1)), F.lpad(F.regexp_extract(t, en, 2), 2, "0"))
    second = F.concat_ws("-", F.regexp_extract(t, sq, 3), month(vocab.MONTHS_SQ, F.regexp_extract(t, sq, 2)), F.lpad(F.regexp_extract(t, sq, 1), 2, "0"))
    return F.coalesce(F.when(t.rlike(en), first.try_cast("date")), F.when(t.rlike(sq), second.try_cast("date")))


def labelled_date(c: Column, label: str, within: int = 260) -> Column:
    t = fold_text(c)
    at = F.instr(t, label)
    return F.when(at > 0, numeric_date(F.substring(t, at + len(label), F.lit(within))))


def url_date(url: Column) -> Column:
    """/yyyy/mm/dd/ of a permalink, else the latest of stamps yyyymmddhhmmss_ and ddmmyyyyhhmm."""
    permalink = _dmy(url, r"/(\d{4})/(\d{2})/(\d{2})/", (3, 2, 1)).try_cast("date")
    stamp = _dmy(url, r"(?:^|\D)(\d{4})(\d{2})(\d{2})\d{6}_", (3, 2, 1)).try_cast("date")
    uploads = F.transform(F.regexp_extract_all(url, F.lit(r"(?<!\d)(\d{12})(?!\d)"), F.lit(1)), lambda x: F.concat_ws("-", F.substring(x, 5, 4), F.substring(x, 3, 2), F.substring(x, 1, 2)).try_cast("date"))
    return F.coalesce(permalink, stamp, F.array_max(uploads))


def parse_amount(c: Column) -> Column:
    """DECIMAL(18,2). With both separators the last one is decimal; one kind is decimal only before one or two last digits.

    Plain string functions throughout: they stay in generated code, which evaluates what they share once."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9,.\-]", "")
    clean = F.translate(kept, "-", "")
    comma, point = F.instr(F.reverse(clean), ","), F.instr(F.reverse(clean), ".")  # from the end, 0 if there is none
    digits, tail = F.translate(clean, ",.", ""), F.greatest(comma, point) - 1
    mixed = F.when(comma < point, F.translate(clean, ",.", ".")).otherwise(F.translate(clean, ".,", "."))
    split = F.concat(F.substring(digits, F.lit(1), F.length(digits) - tail), F.lit("."), F.substring(digits, F.length(digits) - tail + 1, tail))
    plain = F.when((comma > 0) & (point > 0), F.substring_index(mixed, ".", 2)).when(tail.between(1, 2), split).otherwise(digits)
    value = F.concat(F.when(F.startswith(kept, F.lit("-")), F.lit("-")).otherwise(F.lit("")), plain).try_cast("decimal(30,8)")
    return F.floor(value * 100 + F.lit("0.5").cast("decimal(2,1)")).cast("decimal(20,0)").__truediv__(F.lit(100)).cast("decimal(18,2)")


def _currency_in(t: Column) -> Column:
    return F.when(t.rlike("eur|€"), F.lit("EUR")).when(t.rlike(r"usd|\$"), F.lit("USD")).when(t.rlike("all|lek"), F.lit("ALL"))


def detect_currency(amount: Column, currency: Column) -> Column:
    given = normalize_title(currency)
    text = F.lower(F.concat_ws(" ", F.coalesce(F.trim(currency), F.lit("")), F.coalesce(amount, F.lit(""))))
    return (
        F.when(given == "", F.coalesce(_currency_in(text), F.lit("ALL")))
        .when(F.contains(given, F.lit("eur")), "EUR")
        .when(F.contains(given, F.lit("usd")), "USD")
        .when((given == "all") | F.contains(given, F.lit("lek")), "ALL")
        .otherwise(_currency_in(text))
    )


def storage_currency(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)).isin(vocab.CURRENCIES), F.upper(F.trim(c)))


def effective_currency(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.upper(c)), F.lit("")), F.lit("ALL"))


def cpv_group(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\d{8}-\d$"), F.substring(F.trim(c), 1, 2))


def cpv_codes(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d{8}-\d)"), F.lit(1)))


def without_cpv(c: Column) -> Column:
    """A label without CPV codes and the commas and spaces that they leave behind."""
    plain = F.regexp_replace(c, r"\d{8}-\d\s*[-:;,]*\s*", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\s+,", ","), r",\s*,", ", "), r"\s{2,}", " "))
    return F.regexp_replace(F.regexp_replace(plain, r"^,\s*", ""), r",\s*$", "")


def cpv_display(code: Column, label: Column, names: dict[str, str] = vocab.CPV_NAMES) -> Column:
    """struct<title, secondary, is_other> of a spend bucket: the label without codes, or the name for the rest or for
    an unknown one; and the source label where the title differs from it, else the distinct codes."""
    c, t = F.trim(F.coalesce(code, F.lit(""))), F.trim(F.coalesce(label, F.lit("")))
    other = (F.lower(c) == "other") | (F.lower(t) == "other")
    best = F.coalesce(nonblank(t), c)
    unknown = (best == "") | (F.upper(best) == "UNKNOWN")
    title = F.coalesce(nonblank(without_cpv(best)), best)
    codes = cpv_codes(F.concat_ws(" ", c, t))
    by_code = F.when(F.size(codes) > 0, F.concat(F.lit(names["code"]), F.array_join(codes, ", "))).otherwise(names["no_code"])
    by_label = lambda x: F.concat(F.lit(names["label"]), x)
    secondary = F.when(other, F.when(t != "", by_label(t)).otherwise(names["others"])).when(~unknown & (title != best), by_label(best)).otherwise(by_code)
    return F.struct(F.when(other, names["other"]).when(unknown, names["unknown"]).otherwise(title).alias("title"), secondary.alias("secondary"), other.alias("is_other"))


def decision_number(c: Column) -> Column:
    t = fold_text(c)
    forms = [r"\bnr\.? ?[.:\- ]?(\d{1,4})\b", r"vendim(?:i)?[ _-]+(?:nr[ ._-]*)?(\d{1,4})\b", r"\bv(?:endim)?[._-](\d{1,4})\b", r"^(\d{1,4})[ ._-]"]
    return F.coalesce(*[nonblank(F.regexp_extract(t, p, 1)) for p in forms])


def canonical_category(c: Column) -> Column:
    key = F.lower(F.regexp_replace(F.trim(F.regexp_replace(c, "^[\"']+|[\"']+$", "")), "-", " "))
    pairs = [x for k in vocab.CATEGORIES for x in (F.lit(k.lower()), F.lit(k))]
    return F.element_at(F.create_map(*pairs), key)


def flag(c: Column, default: bool = False) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("1", "true", "yes", "y", "on"), True).when(t.isin("0", "false", "no", "n", "off"), False).otherwise(F.lit(default))


def apply_year_template(template: Column, year: Column) -> Column:
    return F.regexp_replace(template, F.lit(r"^(.*?)\{year\}"), F.concat(F.lit("$1"), year.cast("string")))


def filename_title(url: Column) -> Column:
    name = F.element_at(F.split(F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("PATH"))), F.lit("")), "/"), -1)
    return nonblank(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), r"[_\-\s]+", " "))


def slug_title(url: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("PATH"))), F.lit("")), "/"), lambda x: x != "")
    return nonblank(F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"[_\-\s]+", " "))


def invalid_title(title: Column, municipality: Column | None = None) -> Column:
    t = normalize_title(title)
    bad = (F.length(t) < 4) | F.trim(F.coalesce(title, F.lit(""))).rlike(r"(?i)^(https?://|www\.)") | t.isin(vocab.ACTION_LABELS + vocab.GENERIC_LABELS)
    return bad if municipality is None else bad | (t == F.concat(F.lit("bashkia "), normalize_title(municipality)))


def generic_title(title: Column) -> Column:
    """Titles of links that say nothing about the document behind them."""
    t = normalize_title(title)
    return (t == "") | t.isin(vocab.GENERIC_TITLES) | F.trim(F.coalesce(title, F.lit(""))).rlike(r"(?i)^(https?://|www\.)")


def hour_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")


def export_url_parts(url: Column) -> Column:
    """struct<host, path, procedure, page>: the procedure hint of the fragment, and the URL without it."""
    ref = F.coalesce(F.try_parse_url(url, F.lit("REF")), F.lit(""))
    return F.struct(host(url).alias("host"), F.try_parse_url(url, F.lit("PATH")).alias("path"), nonblank(F.try_url_decode(F.regexp_extract(ref, r"(?:^|&)procedure=([^&]*)", 1))).alias("procedure"), normalize_url(url).alias("page"))


def is_export_url(url: Column, host_suffix: str = vocab.EXPORT_HOST, path: str = vocab.EXPORT_PATH) -> Column:
    parts = export_url_parts(F.trim(url))
    return F.coalesce(F.endswith(parts["host"], F.lit(host_suffix)) & (F.lower(parts["path"]) == path), F.lit(False))


def _sha1(c: Column, n: int) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, n)


def decision_key(municipality: Column, date: Column, number: Column, title_normalized: Column) -> Column:
    return F.concat_ws("|", municipality.cast("string"), F.coalesce(date.cast("string"), F.lit("unknown")), normalize_decision_number(number), _sha1(title_normalized, 12))


def document_key(municipality: Column, category: Column, date: Column, title_normalized: Column, url: Column) -> Column:
    return F.concat_ws("|", municipality.cast("string"), category, F.coalesce(date.cast("string"), F.lit("unknown")), _sha1(title_normalized, 12), _sha1(F.coalesce(url, F.lit("")), 12))


def procurement_key(municipality: Column, procedure_id: Column, date: Column, title_normalized: Column) -> Column:
    own = nonblank(normalize_procedure_id(procedure_id))
    return F.when(own.isNotNull(), F.concat_ws("|", municipality.cast("string"), F.lit("proc"), own)).otherwise(F.concat_ws("|", municipality.cast("string"), F.coalesce(date.cast("string"), F.lit("unknown")), _sha1(title_normalized, 12)))


def manual_key(*parts: Column) -> Column:
    return _sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 20)


def kind(text: Column) -> Column:
    return F.when(F.contains(fold_text(text), F.lit("degjes")), "hearing").otherwise("consultation_notice")


def source_weight(origin: Column, hosts: list[str] = vocab.AGGREGATOR_HOSTS) -> Column:
    return F.when(F.lower(F.coalesce(origin, F.lit(""))).isin(hosts), 50).otherwise(100)


def confidence_from_score(score: Column) -> Column:
    return F.when(score <= 0, F.lit(0.0)).otherwise(F.round(F.least(F.greatest(score / 220.0, F.lit(0.05)), F.lit(0.99)), 2))


def mojibake(c: Column) -> Column:
    return c.rlike("Ã.|Â.|�")


def mid_hyphen(key: Column) -> Column:
    return key.rlike("(^|-)[a-z]{1,2}-[a-z]{1,2}(-|$)")


def file_path(prefix: str, item: Column, attachment: Column) -> Column:
    return F.when(item.isNotNull() & attachment.isNotNull(), F.concat(F.lit(prefix.rstrip("/") + "/"), item.cast("string"), F.lit("/"), attachment.cast("string")))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def error_class(error_type: Column, cause: Column) -> Column:
    e, c = F.upper(F.coalesce(error_type, F.lit(""))), F.upper(F.coalesce(cause, F.lit("")))
    out = F.when(e.rlike(r"^HTTP_\d{3}$"), e).when((e == "TIMEOUT") | (c == "TIMEOUT"), "TIMEOUT").when(e.isin(vocab.NETWORK_CODES) | c.isin(vocab.NETWORK_CODES), "UPSTREAM_DOWN")
    for code, name in vocab.TLS_CODES.items():
        out = out.when(c == code, name)
    return out.otherwise("SCRAPE_ERROR")


def is_skippable(status: Column, error_type: Column, message: Column) -> Column:
    """Failures after which a run goes on with the next source: timeouts, blocks and server errors; not bad requests,
    missing rights, rate limits or a server that isn't set up."""
    known = F.coalesce(status > 0, F.lit(False)) & ~F.coalesce(status.isin(400, 401, 429), F.lit(False))
    own = F.coalesce(status, F.lit(0))
    text = F.lower(F.coalesce(message, F.lit("")))
    setup = (own == 503) & (F.trim(text) == "server_misconfigured")
    slow = (own == 504) | F.upper(F.coalesce(error_type, F.lit(""))).isin("TIMEOUT", "HTTP_504") | F.contains(text, F.lit("timeout"))
    blocked = (own == 403) | (F.upper(F.coalesce(error_type, F.lit(""))) == "HTTP_403") | F.contains(text, F.lit("http_403"))
    return known & ~setup & (slow | blocked | own.between(500, 599))


def is_timeout(error_type: Column, message: Column) -> Column:
    return (F.upper(F.coalesce(error_type, F.lit(""))) == "TIMEOUT") | F.lower(F.coalesce(message, F.lit(""))).rlike("timeout|timed out|aborted")


def is_blocked(error_type: Column, status: Column, message: Column) -> Column:
    return F.coalesce(status.isin(401, 403, 429, 503), F.lit(False)) | F.upper(F.coalesce(error_type, F.lit(""))).isin("HTTP_403", "BLOCKED") | F.lower(F.coalesce(message, F.lit(""))).rlike("captcha|cloudflare|blocked|challenge")
