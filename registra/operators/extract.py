"""Jobs over page tables (page_id, url, html): links, documents, rows, dates. All by regular expressions on columns."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions import scalars as S
from registra.operators.windows import keep_first, top_k, with_duplicates

ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: A value with its quotes: double, single or none.
VALUE = r"""("[^"]*+"|'[^']*+'|[^\s"'>]++)"""


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


def unquoted(value: Column) -> Column:
    """An attribute's value without its quotes, & decoded."""
    return F.trim(F.replace(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, in any of its quotes; null if there is none."""
    return S.bound(unquoted(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{VALUE}", 1)), lambda v: F.nullif(v, F.lit("")))


def computed(df: DataFrame, *kept: str, **columns: Column) -> DataFrame:
    """The kept columns and new ones, as a generator's row: filters on them read the values and don't compute them again."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def anchor_array(html: Column) -> Column:
    """Array of struct<href, text>: every a element with an href in page order, its text without tags. An element that
    isn't closed ends where the next one begins."""

    def anchor(p, tag):
        body = F.regexp_extract(F.substring(p, F.length(tag) + 1, F.length(p)), r"(?is)^(.*?)(?:</a\b|\z)", 1)
        return F.when(tag.rlike(r"(?is)\shref\s*="), F.struct(F.coalesce(attribute(tag, "href"), F.lit("")).alias("href"), strip_tags(body).alias("text")))

    parts = F.split(html, r"(?i)(?=<a[\s/>])")
    return F.array_compact(F.transform(parts, lambda p: S.bound(F.regexp_extract(p, rf"(?is)^<a\b{ATTRIBUTES}>", 0), lambda tag: anchor(p, tag))))


def link_array(html: Column, url: Column) -> Column:
    """Array of struct<pos, href, text, abs_url>: anchor_array with absolute URLs."""
    of = lambda b: F.transform(anchor_array(html), lambda a, i: F.struct(i.alias("pos"), a["href"].alias("href"), a["text"].alias("text"), S.resolved(b, a["href"]).alias("abs_url")))
    return S.bound(S.base_parts(url), of)


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, text, abs_url): every link of every page, in page order."""
    return pages.select("page_id", "url", F.inline(link_array(F.col("html"), F.col("url"))))


def document_array(html: Column, url: Column) -> Column:
    """Array of struct<branch, pos, link>: document URLs of anchors, embeds, data attributes and onclick handlers, in this
    order; where a page has none, of its raw text. Viewer URLs are unwrapped."""
    branches = [
        rf"(?is)<(?:iframe|embed|source)\s[^>]*?\bsrc\s*=\s*{VALUE}",
        rf"(?is)<object\s[^>]*?\bdata\s*=\s*{VALUE}",
        rf"(?is)\sdata-(?:href|url|src|file|download)\s*=\s*{VALUE}",
        rf"(?is)\sonclick\s*=\s*{VALUE}",
    ]
    # a handler's URL is its first quoted string
    link_of = lambda b, x: F.regexp_extract(unquoted(x), "[\"']([^\"']+)[\"']", 1) if b == 4 else unquoted(x)
    viewed = lambda href: F.coalesce(S.nonblank(F.try_url_decode(F.regexp_extract(href, r"[?&](?:url|file|src)=(https?[^&]+)", 1))), href)
    inner = lambda href: F.when(href.rlike("[?&](?:url|file|src)=http"), viewed(href)).otherwise(href)

    def of_branch(b: int, hrefs: Column, base: Column) -> Column:
        return F.transform(hrefs, lambda x, i: F.struct(F.lit(b).alias("branch"), i.alias("pos"), S.resolved(base, inner(x)).alias("link")))

    values = [F.transform(F.regexp_extract_all(html, F.lit(p), F.lit(1)), partial(link_of, b)) for b, p in enumerate(branches, 1)]
    hrefs = [F.transform(anchor_array(html), lambda a: a["href"]), *values]
    found = S.bound(S.base_parts(url), lambda base: F.filter(F.flatten(F.array(*[of_branch(b, x, base) for b, x in enumerate(hrefs)])), lambda x: S.is_document_url(x["link"])))
    raw = F.regexp_extract_all(html, F.lit(r"(https?://[^\s\"'<>]+\.(?:pdf|docx?|xlsx?|rtf))"), F.lit(1))
    rest = F.transform(raw, lambda x, i: F.struct(F.lit(len(branches) + 1).alias("branch"), i.alias("pos"), x.alias("link")))
    return S.bound(found, lambda own: F.when(F.size(own) > 0, own).otherwise(rest))


def document_links(pages: DataFrame) -> DataFrame:
    """(page_id, branch, pos, url): the documents of each page (see document_array). The first of repeated URLs stays."""
    every = pages.select("page_id", F.inline(document_array(F.col("html"), F.col("url"))))
    return keep_first(every, ["page_id", "link"], ["branch", "pos"]).withColumnRenamed("link", "url")


def row_array(html: Column, url: Column) -> Column:
    """Array of struct<row, cells, title, href, date>: rows of tables; the title is the longest cell that is no date."""

    def of_row(b, tr, cells, i):
        fit = F.filter(cells, lambda c: ~S.invalid_title(c) & S.free_text_date(c).isNull())
        best = F.array_max(F.transform(fit, lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))["c"]
        href = S.nonblank(unquoted(F.regexp_extract(tr, rf"(?is)\bhref\s*=\s*{VALUE}", 1)))
        date = F.array_min(F.array_compact(F.transform(cells, S.numeric_date)))
        return F.struct(i.alias("row"), cells.alias("cells"), best.alias("title"), S.resolved(b, href).alias("href"), date.alias("date"))

    cells = lambda tr: F.transform(F.regexp_extract_all(tr, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_tags)
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return S.bound(S.base_parts(url), lambda b: F.transform(rows, lambda tr, i: S.bound(cells(tr), lambda own: of_row(b, tr, own, i))))


def table_rows(pages: DataFrame, *kept: str) -> DataFrame:
    """(page_id, row, cells, title, href, date): rows of tables with the longest cell that is no date as title; and the
    kept columns of their page."""
    return pages.select("page_id", *kept, F.inline(row_array(F.col("html"), F.col("url")))).where("title is not null")


def post_links(pages: DataFrame, pattern: str = "vendim|konsultim") -> DataFrame:
    """Links of the page's own host that look like posts, first of each URL."""
    links = anchors(pages)
    own = S.compare_host(F.col("abs_url")) == S.compare_host(F.col("url"))
    asset = F.lower("abs_url").rlike(r"\.(css|js|png|jpe?g|gif|svg|ico|zip|pdf)([?#]|$)|/(category|tag|feed|author|wp-json)/")
    return keep_first(links.where(own & ~asset & S.fold_text(F.concat_ws(" ", "text", "abs_url")).rlike(pattern)), ["page_id", "abs_url"], ["pos"])


def next_page(pages: DataFrame) -> DataFrame:
    """(page_id, next_url): rel=next, else the link of the smallest page number above the current one."""
    tags = F.filter(F.regexp_extract_all("html", F.lit(rf"(?is)<(?:a|link)\b{ATTRIBUTES}>"), F.lit(0)), lambda t: F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))).rlike(r"\bnext\b"))
    rel = F.get(F.filter(F.transform(tags, lambda t: attribute(t, "href")), lambda h: h.isNotNull()), 0)
    number = lambda c: F.coalesce(F.regexp_extract(c, r"[?&/](?:page|paged|p)[=/](\d+)", 1).try_cast("int"), F.lit(1))
    links = anchors(pages).where(F.col("abs_url").rlike(r"[?&/](?:page|paged|p)[=/]\d+") & (S.host(F.col("abs_url")) == S.host(F.col("url"))))
    numbered = links.where(number(F.col("abs_url")) > number(F.col("url"))).groupBy("page_id").agg(F.min_by("abs_url", F.struct(number(F.col("abs_url")), "pos")).alias("numbered"))
    return pages.select("page_id", S.absolute_url(F.col("url"), rel).alias("rel")).join(numbered, "page_id", "left").select("page_id", F.coalesce("rel", "numbered").alias("next_url"))


def page_date(html: Column) -> Column:
    """Meta tags, time elements, elements with a date class, headings: the first that holds a date."""
    meta = F.regexp_extract(html, r'(?i)<meta[^>]*(?:article:published_time|datePublished|"date")[^>]*content="(\d{4}-\d{2}-\d{2})', 1)
    time = F.regexp_extract(html, r'(?i)<time[^>]*datetime="(\d{4}-\d{2}-\d{2})', 1)
    marked = S.numeric_date(F.regexp_extract(html, r'(?i)class="[^"]*date[^"]*"[^>]*>([^<]*)<', 1))
    heading = S.numeric_date(F.regexp_extract(html, r"(?i)<h[12][^>]*>([^<]*)<", 1))
    return F.coalesce(S.strict_iso_date(meta), S.strict_iso_date(time), marked, heading)


def same_host_links(pages: DataFrame, pattern: str, most: int = 6) -> DataFrame:
    """Links of the page's own host whose decoded href holds a keyword; no documents, no fragments; first `most`."""
    href = F.lower(F.coalesce(F.try_url_decode(F.col("abs_url")), F.col("abs_url")))
    links = anchors(pages).where((S.compare_host(F.col("abs_url")) == S.compare_host(F.col("url"))) & href.rlike(pattern) & ~S.is_document_url(F.col("abs_url")) & ~F.contains("href", F.lit("#")))
    return top_k(keep_first(links, ["page_id", "abs_url"], ["pos"]), ["page_id"], ["pos"], most)


def year_export_link(pages: DataFrame, year: int) -> DataFrame:
    """(page_id, abs_url, score): the best export link; only links with the year in text or URL can win."""
    token = rf"(^|\D){year}(\D|$)"
    links = anchors(pages)
    has_year = F.col("abs_url").rlike(token) | F.col("text").rlike(token)
    text = S.fold_text(F.col("text"))
    score = F.when(has_year, 200).otherwise(0) + F.when(F.lower("abs_url").rlike(r"\.csv([?#]|$)"), 120).otherwise(0) + F.when(F.lower("abs_url").rlike("export|eksport"), 80).otherwise(0) + F.when(text.rlike("csv|eksport|export"), 40).otherwise(0) + F.when(text.rlike("shkarko|download"), 20).otherwise(0)
    return top_k(links.withColumn("score", score).where(has_year & (F.col("score") > 0)), ["page_id"], [F.desc("score"), "pos"], 1).select("page_id", "abs_url", "score")


def list_signals(pages: DataFrame) -> DataFrame:
    """(page_id, li, articles, row_nodes, title_links, score): signs that a page lists documents."""
    n = lambda p: F.regexp_count("html", F.lit(p))
    titles = F.size(F.filter(anchor_array(F.col("html")), lambda a: F.length(a["text"]).between(18, 260)))
    found = pages.select("page_id", n("<li[ >]").alias("li"), n("<article[ >]").alias("articles"), n('class="[^"]*(?:row|list|post)[^"]*"').alias("row_nodes"), titles.alias("title_links"))
    points = F.when(F.col("li") >= 8, 8).otherwise(0) + F.when(F.col("articles") >= 2, 8).otherwise(0) + F.when(F.col("row_nodes") >= 3, 8).otherwise(0) + F.when(F.col("title_links") >= 5, 10).otherwise(0)
    return found.withColumn("score", points)


def post_items(pages: DataFrame, pattern: str = "konsultim|vendim") -> DataFrame:
    """One item for each page: its first document if it has any, else the page itself if title or URL hold a keyword."""
    title = strip_tags(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    first = F.get(document_array(F.col("html"), F.col("url")), 0)["link"]
    rows = computed(pages, "page_id", "url", title=title, published_date=page_date(F.col("html")), document_url=first)
    keep = F.col("document_url").isNotNull() | (F.col("published_date").isNotNull() & S.fold_text(F.concat_ws(" ", "title", "url")).rlike(pattern))
    return rows.where(keep).withColumn("source_url", F.coalesce("document_url", "url"))


def year_categories(pages: DataFrame, year: int, fallback: int = 3) -> DataFrame:
    """Links with the year in text or URL; pages without one give their first `fallback` links."""
    token = rf"(^|\D){year}(\D|$)"
    hits = lambda links: F.filter(links, lambda a: a["text"].rlike(token) | a["abs_url"].rlike(token))
    of = lambda links: S.bound(hits(links), lambda own: F.when(F.size(own) > 0, own).otherwise(F.slice(links, 1, fallback)))
    return pages.select("page_id", "url", F.inline(S.bound(link_array(F.col("html"), F.col("url")), of)))


def pdf_items(pages: DataFrame) -> DataFrame:
    hits = anchors(pages).where(F.lower("abs_url").rlike(r"\.pdf([?#]|$)"))
    return hits.select("page_id", "pos", F.coalesce(S.nonblank(F.col("text")), S.filename_title(F.col("abs_url"))).alias("title"), F.col("abs_url").alias("source_url"), S.numeric_date(F.col("text")).alias("published_date"))


def page_summary(html: Column, least: int = 20) -> Column:
    texts = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), strip_tags)
    return F.try_element_at(F.filter(texts, lambda t: F.length(t) >= least), F.lit(1))


def dated_by_precedence(pages: DataFrame, listing: DataFrame, years: tuple[int, int] = (2000, 2100)) -> DataFrame:
    """(page_id, published_date): the date of the page's heading, else of its first PDF on the page's own host whose URL
    holds one, else the one that the listing (page_id, listed_date) has. Dates of other years than `years` don't count."""
    fit = lambda c: S.bound(c, lambda d: F.when(F.year(d).between(*years), d))
    own = lambda a, host: F.lower(a["abs_url"]).rlike(r"\.pdf([?#]|$)") & (S.compare_host(a["abs_url"]) == host)
    files = S.bound(S.compare_host(F.col("url")), lambda host: F.filter(link_array(F.col("html"), F.col("url")), lambda a: own(a, host)))
    first = F.get(F.array_compact(F.transform(files, lambda a: fit(S.url_date(a["abs_url"])))), 0)
    heading = fit(S.numeric_date(strip_tags(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))))
    found = pages.select("page_id", F.coalesce(heading, first).alias("own_date"))
    return found.join(listing.select("page_id", "listed_date"), "page_id", "left").select("page_id", F.coalesce("own_date", "listed_date").alias("published_date"))


def challenge_page(url: Column, html: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).rlike("/cdn-cgi/|challenge") | F.lower(F.coalesce(html, F.lit(""))).rlike("cf-challenge|just a moment|attention required|captcha")


def item_documents(pages: DataFrame) -> DataFrame:
    """(page_id, documents): distinct document links with labels, in page order."""
    links = keep_first(anchors(pages).where(S.is_document_url(F.col("abs_url"))), ["page_id", "abs_url"], ["pos"])
    return links.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("abs_url").alias("url"), F.col("text").alias("label")))), lambda x: F.struct(x["url"].alias("url"), x["label"].alias("label"))).alias("documents"))


def json_ld(pages: DataFrame) -> DataFrame:
    """(page_id, title, date): of the nodes of a page's JSON-LD (objects, arrays, graphs), those with title and date first, in page order."""
    bodies = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    node = "struct<headline:string,name:string,datePublished:string,`@graph`:array<struct<headline:string,name:string,datePublished:string>>>"
    each = pages.select("page_id", F.posexplode(bodies).alias("pos", "body")).select("page_id", "pos", F.from_json(F.when(F.startswith(F.ltrim("body"), F.lit("[")), F.col("body")).otherwise(F.concat(F.lit("["), "body", F.lit("]"))), f"array<{node}>").alias("many"))
    own = each.select("page_id", "pos", F.posexplode("many").alias("k", "n"))
    flat = own.select("page_id", "pos", "k", F.explode(F.concat(F.array(F.struct("n.headline", "n.name", "n.datePublished")), F.coalesce("n.@graph", F.array().cast("array<struct<headline:string,name:string,datePublished:string>>")))).alias("x"))
    rows = flat.select("page_id", "pos", "k", F.coalesce("x.headline", "x.name").alias("title"), S.strict_iso_date(F.substring("x.datePublished", 1, 10)).alias("date"))
    full = F.col("title").isNotNull() & F.col("date").isNotNull()
    return keep_first(rows.where("title is not null or date is not null"), ["page_id"], [full.desc(), "pos", "k", "title"]).select("page_id", "title", "date")


def profile_items(pages: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listing rows by site profile: (host, path_pattern, number_cell, date_cell, title_cell, title_template, year_floor, kind).

    Gives items and rejected rows with a reason (missing number, date or URL, or before the floor)."""
    hosted = pages.select("page_id", "url", "html", S.compare_host(F.col("url")).alias("host"))
    met = table_rows(hosted, "url", "host").drop("title").join(profiles, "host").where(F.expr("path_pattern is null or url rlike path_pattern"))
    cell = lambda k: F.try_element_at("cells", F.col(k) + 1)
    number = S.nonblank(F.regexp_extract(cell("number_cell"), r"(\d{1,4})", 1))
    date = F.coalesce(S.numeric_date(cell("date_cell")), S.strict_iso_date(cell("date_cell")))
    found = computed(met, "page_id", "row", "kind", "href", "year_floor", "title_template", number=number, published_date=date, own_title=cell("title_cell"))
    title = F.coalesce(F.when(F.col("title_template").isNotNull(), F.replace(F.replace(F.col("title_template"), F.lit("{number}"), F.col("number")), F.lit("{date}"), F.col("published_date").cast("string"))), "own_title")
    reason = F.when(F.col("number").isNull(), "missing_number").when(F.col("published_date").isNull(), "missing_date").when(F.col("href").isNull(), "missing_url").when(F.year("published_date") < F.col("year_floor"), "before_floor")
    out = found.withColumn("reason", reason)
    keep = out.where("reason is null").select("page_id", "row", "kind", "number", "published_date", title.alias("title"), F.col("href").alias("source_url"))
    return keep, out.where("reason is not null").select("page_id", "row", "reason")


def page_items(pages: DataFrame, *parts: DataFrame, year: int | None = None, limit: int | None = None) -> DataFrame:
    """Union of item tables (title, published_date, source_url, ...) in order of precedence, first of each URL, newest first.
    Rows without a URL are left out."""
    return counted_items(*parts, year=year, limit=limit)[0]


def counted_items(*parts: DataFrame, year: int | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """page_items of the parts, and (precedence, duplicates): how many rows of each part come under a URL that an earlier
    row has, whatever the year and the limit."""
    every = None
    for k, part in enumerate(parts):
        own = part.select("title", "published_date", "source_url").withColumn("precedence", F.lit(k))
        every = own if every is None else every.unionByName(own)
    ranked = with_duplicates(every.where(S.nonblank(F.col("source_url")).isNotNull()), ["source_url"], ["precedence", "title"])
    duplicates = ranked.groupBy("precedence").agg(F.count_if(F.col("duplicate_rank") > 1).alias("duplicates"))
    out = ranked.where("duplicate_rank = 1").drop("duplicate_rank")
    if year is not None:
        out = out.where(F.year("published_date") == year)
    out = out.orderBy(F.col("published_date").desc_nulls_last(), "source_url", "title")
    return (out if limit is None else out.limit(limit)), duplicates
