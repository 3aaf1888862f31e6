"""Page enrichment: from a table of collected pages to contact details per site and lead.

Expects pages as ``(page_id, url, html)`` with an optional ``page_order`` inside a site and
optional crawl columns ``status_code`` and ``content_type``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contactmill.functions import columns as C
from contactmill.functions import emails as E
from contactmill.functions import features as X
from contactmill.functions import fixed_values as fv
from contactmill.functions.hidden_emails import decode_cf, hidden_emails
from contactmill.operators.htmlpass import parse_pages

CANDIDATE = "array<struct<email:string,context:string>>"
PLACES = "array<struct<spelled:string,written:string,about_spelled:string,about_written:string>>"


def site_of(url: Column) -> Column:
    """The host of a page or website, with and without ``www.`` being the same site."""
    return F.regexp_replace(X.host_of(url), r"\Awww\.", "")


def usable_pages(pages: DataFrame) -> DataFrame:
    """Drop failed fetches, other content types, empty bodies and bot-protection pages."""
    out = pages.filter((F.length("html") > 0) & ~X.is_bot_page(F.col("html")))
    if "status_code" in pages.columns:
        out = out.filter(F.col("status_code") == 200)
    if "content_type" in pages.columns:
        kind = F.lower("content_type")
        out = out.filter(kind.contains("text/html") | kind.contains("application/xhtml"))
    return out


def with_site(pages: DataFrame) -> DataFrame:
    """Add ``site`` and, where it is missing, ``page_order`` (the page id)."""
    out = pages.withColumn("site", site_of(F.col("url"))).filter(F.col("site").isNotNull())
    return out if "page_order" in pages.columns else out.withColumn("page_order", F.col("page_id"))


def first_pages_per_site(pages: DataFrame, limit: int) -> DataFrame:
    """Keep the first pages of each site, without ranking or moving the page bodies.

    For callers that want a limit; nothing else here cuts a site. The cut-off page is found on three
    narrow columns, one row for each site that is over the limit. The bodies are then filtered by a left
    join with that table, which Spark broadcasts when it is small and otherwise shuffles, splitting a
    site that holds too many pages.
    """
    cut = (
        C.top_per_key(
            pages.select("site", "page_order", "page_id"),
            ["site"], [F.col("page_order"), F.col("page_id")], limit + 1,
        )
        .groupBy("site")
        .agg(
            F.count("*").alias("_n"),
            F.max(F.struct("page_order", "page_id")).alias("_cut"),
        )
        .filter(F.col("_n") > limit)
        .select("site", "_cut")
    )
    position = F.struct("page_order", "page_id")
    return (
        pages.join(cut, "site", "left")
        .filter(F.col("_cut").isNull() | (position < F.col("_cut")))
        .drop("_cut")
    )


def read_pages(pages: DataFrame, tools: Sequence[str] = tuple(fv.SCHEDULING_TOOLS)) -> DataFrame:
    """Visible text (raw and squeezed), links, address hints and sections of each page, and its tool.

    The tool is searched in the page source and the text. The source is searched before the
    HTML pass and only its position in the list and its last letters are carried along, so the
    source itself is not shipped back.
    """
    tail = max(len(t) for t in tools)
    # Lower-cased texts get a projection of their own: inside the search each of them would be
    # computed once for every word.
    prepared = (
        pages.withColumn("_low", F.lower("html"))
        .withColumn("_tool_in_html", _first_position(F.col("_low"), tools))
        .withColumn("_html_tail", F.right("_low", F.lit(tail)))
        .drop("_low")
    )
    return (
        parse_pages(prepared)
        .withColumnRenamed("text", "raw_text")
        .withColumn("text", C.squeeze(F.col("raw_text")))
        .withColumn("_low", F.lower(F.concat_ws(" ", "_html_tail", "text")))
        .withColumn("_tool", F.least("_tool_in_html", _first_position(F.col("_low"), tools)))
        .withColumn("scheduling_tool", F.get(F.array(*[F.lit(t) for t in tools]), F.col("_tool")))
        .drop("_tool_in_html", "_html_tail", "_low", "_tool")
    )


def _first_position(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(text.contains(w), F.lit(i)) for i, w in enumerate(words)])


def _candidates() -> Column:
    """Every address on a page in search order, lower-cased, unchecked.

    Marked-up places come first (the HTML pass delivers them in order), then footers, contact
    sections, input fields and the whole text. All texts go through one search expression.
    """

    def pair(email: Column, context: Column) -> Column:
        return F.struct(
            F.regexp_replace(F.lower(email), r"\.\z", "").alias("email"),
            C.squeeze_ends(context).alias("context"),
        )

    def hinted(hint: Column) -> Column:
        kind, value = hint["kind"], hint["value"]
        target = F.substring_index(F.regexp_replace(value, r"\Amailto:", ""), "?", 1)
        unescaped = F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B")))
        address = (
            F.when(kind == "mailto", F.trim(unescaped))
            .when(kind == "cf", decode_cf(value))
            .when(kind == "form", F.trim(target))
            .when(kind.isin("itemprop", "recipient"), F.trim(value))
            .otherwise(value)
        )
        return pair(address, hint["context"])

    def place(spelled: Column, written: Column, about_spelled: Column, about_written: Column) -> Column:
        return F.struct(
            spelled.alias("spelled"),
            written.alias("written"),
            about_spelled.alias("about_spelled"),
            about_written.alias("about_written"),
        )

    def text_of(section: Column) -> Column:
        return F.substring("raw_text", section["text_from"] + 1, section["text_length"])

    def contact(rank: Column) -> Column:
        parts = F.filter("sections", lambda s: (s["kind"] == "contact") & (s["rank"] == rank))
        whole = F.array_join(F.transform(parts, text_of), "")
        about = F.lit("contact section")
        return place(whole, whole, about, about)

    def footer(section: Column) -> Column:
        markup = F.substring("markup", section["markup_from"] + 1, section["markup_length"])
        both = F.concat(text_of(section), F.lit(" "), markup)
        return place(text_of(section), both, F.lit("footer"), F.lit("footer"))

    def search(spot: Column) -> Column:
        spelled = F.transform(hidden_emails(spot["spelled"]), lambda e: F.struct(e, spot["about_spelled"]))
        written = F.transform(E.find_emails(spot["written"]), lambda e: F.struct(e, spot["about_written"]))
        both = F.concat(spelled.cast(CANDIDATE), written.cast(CANDIDATE))
        return F.transform(both, lambda c: pair(c["email"], c["context"]))

    def field(hint: Column) -> Column:
        first = F.coalesce(F.get(E.find_emails(hint["value"]), F.lit(0)), F.lit(""))
        return place(F.lit(""), first, hint["context"], hint["context"])

    ranks = F.sequence(F.lit(0), F.lit(len(fv.CONTACT_REGIONS) - 1))
    unset = F.lit(None).cast("string")
    places = F.concat(
        F.transform(F.filter("sections", lambda s: s["kind"] == "footer"), footer).cast(PLACES),
        # On most pages no section outlives the HTML pass; skip the look-ups then.
        F.when(F.size("sections") > 0, F.transform(ranks, contact).cast(PLACES)).otherwise(
            F.array().cast(PLACES)
        ),
        F.transform(F.filter("hints", lambda h: h["kind"] == "input"), field).cast(PLACES),
        F.array(place(F.col("text"), F.col("text"), F.lit("obfuscated in text"), unset)).cast(PLACES),
    )
    marked = F.transform(F.filter("hints", lambda h: h["kind"] != "input"), hinted)
    return F.concat(marked.cast(CANDIDATE), F.flatten(F.transform(places, search)).cast(CANDIDATE))


def page_emails(
    parsed: DataFrame,
    max_emails: int | None = None,
    blocked: Sequence[str] = tuple(fv.BLOCKED_DOMAINS),
    context_length: int | None = None,
) -> DataFrame:
    """Add ``emails``: the first distinct valid addresses of a page with context and role.

    Works inside the row, so nothing is exploded or shuffled. ``max_emails`` and ``context_length`` cut
    where they are given.
    """

    def cut(text: Column) -> Column:
        return text if context_length is None else F.substring(text, 1, context_length)

    def around(email: Column) -> Column:
        near = F.concat(F.lit(r"(?i).{0,50}\Q"), email, F.lit(r"\E.{0,50}"))
        return cut(C.squeeze_ends(F.regexp_substr("text", near)))

    def described(hit: Column) -> Column:
        context = F.coalesce(cut(hit["context"]), around(hit["email"]))
        return F.struct(hit["email"].alias("email"), context.alias("context"))

    def with_role(hit: Column) -> Column:
        role = E.email_role(hit["email"], hit["context"])
        return F.struct(hit["email"].alias("email"), hit["context"].alias("context"), role.alias("role"))

    return (
        parsed.withColumn("_all", _candidates())
        .withColumn("_valid", F.filter("_all", lambda c: E.is_valid_email(c["email"], blocked)))
        .withColumn(
            "_first",
            C.first_items(F.array_distinct(F.transform("_valid", lambda c: c["email"])), max_emails),
        )
        .withColumn(
            "_hits",
            F.transform(
                "_first",
                lambda e: F.get(F.filter("_valid", lambda c: c["email"] == e), F.lit(0)),
            ),
        )
        .withColumn("_hits", F.transform("_hits", described))
        .withColumn("emails", F.transform("_hits", with_role))
        .drop("_all", "_valid", "_first", "_hits", "raw_text", "markup", "sections")
    )


def social_links(parsed: DataFrame) -> DataFrame:
    """Add the last company link and the last profile link of a page that is no share button."""

    def last(test) -> Column:
        return F.try_element_at(F.filter("links", lambda a: test(a["href"])), F.lit(-1))["href"]

    return parsed.withColumn(
        "linkedin_url", last(lambda h: h.contains("linkedin.com/company"))
    ).withColumn(
        "facebook_url",
        last(
            lambda h: h.contains("facebook.com") & ~h.contains("sharer") & ~h.contains("share.php")
        ),
    )


def page_features(
    pages: DataFrame,
    tools: Sequence[str] = tuple(fv.SCHEDULING_TOOLS),
    staff_phrases: Sequence[str] = tuple(fv.STAFF_PHRASES),
    words: Sequence[str] = tuple(fv.SPECIALTIES),
    blocked: Sequence[str] = tuple(fv.BLOCKED_DOMAINS),
    max_emails: int | None = None,
) -> DataFrame:
    """One narrow row per page: addresses, tool, staff flag, social links, specialty bits."""
    parsed = read_pages(pages, tools)
    found = social_links(page_emails(parsed, max_emails, blocked)).withColumn("_low", F.lower("text"))
    return found.select(
        *[c for c in ("page_id", "url", "site", "page_order") if c in found.columns],
        "emails",
        "scheduling_tool",
        C.contains_any(F.col("_low"), staff_phrases).alias("has_multiple_tutors"),
        "linkedin_url",
        "facebook_url",
        C.contained_mask(F.col("_low"), words).alias("specialty_bits"),
        F.length("text").alias("text_length"),
    )


def merge_sites(features: DataFrame, words: Sequence[str] = tuple(fv.SPECIALTIES)) -> DataFrame:
    """Pages of a site to one row: first value in page order wins, flags and words add up.

    One shuffle of narrow rows, combined before it. The addresses of a site are rows of their own, see
    :func:`site_emails`.
    """
    position = F.struct("page_order", "page_id")

    def first(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), position)).alias(column)

    return (
        features.groupBy("site")
        .agg(
            F.count("*").alias("pages_read"),
            first("scheduling_tool"),
            F.bool_or("has_multiple_tutors").alias("has_multiple_tutors"),
            first("linkedin_url"),
            first("facebook_url"),
            *C.mask_unions(words),
        )
        .withColumn("specialties", C.words_of_mask(F.col("specialty_bits"), words))
        .drop("specialty_bits")
    )


def site_emails(features: DataFrame, limit: int | None = None) -> DataFrame:
    """The distinct addresses of each site, one row each, with where they were first found.

    Columns ``site``, ``email``, ``context``, ``role`` and ``first_at`` (page order, page, place on the
    page). One shuffle, combined before it, so a site with very many pages stays spread over tasks;
    ``limit`` keeps the first ones of each site.
    """
    # Of an inner explode Spark infers a filter by the size of the array, and finds all addresses again for it.
    each = features.select("site", "page_order", "page_id", F.posexplode_outer("emails").alias("pos", "e")).where("pos is not null")
    met = F.struct("page_order", "page_id", "pos", F.col("e.context").alias("context"), F.col("e.role").alias("role"))
    rows = (
        each.groupBy("site", F.col("e.email").alias("email"))
        .agg(F.min(met).alias("m"))
        .select(
            "site", "email", "m.context", "m.role",
            F.struct("m.page_order", "m.page_id", "m.pos").alias("first_at"),
        )
    )
    return rows if limit is None else C.top_per_key(rows, ["site"], [F.col("first_at")], limit)


def site_pages(pages: DataFrame, page_limit: int | None = None, **options) -> DataFrame:
    """Features of the usable pages with their sites, all of them or the first ones of each site."""
    sited = with_site(usable_pages(pages))
    return page_features(sited if page_limit is None else first_pages_per_site(sited, page_limit), **options)


def site_features(pages: DataFrame, page_limit: int | None = None, **options) -> DataFrame:
    """Collected pages to one row per site."""
    merge = {k: v for k, v in options.items() if k == "words"}
    return merge_sites(site_pages(pages, page_limit, **options), **merge)


def contact_links(
    pages: DataFrame, strict: str = fv.CONTACT_LINK_WORDS, broad: str = fv.NAV_LINK_WORDS
) -> DataFrame:
    """Links that probably lead to contact details, with their ``rank`` (from 1) inside each page.

    Social links and other hosts are dropped; a strict word is needed, or a broad one inside the
    navigation. A URL met several times keeps its best score and first position.
    """
    sited = with_site(pages)
    links = parse_pages(sited.select("page_id", "site", "url", "html")).select(
        "page_id", "site", F.explode("links").alias("a")
    )
    text, href = C.squeeze_ends(F.lower("a.text")), F.col("a.href")

    def either(words: str) -> Column:
        # Spelled out, as the meaning of \\b for other letters differs between Java versions.
        pattern = rf"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"
        return text.rlike(pattern) | href.rlike(pattern)

    def points(flag: Column, value: int) -> Column:
        return F.when(flag, F.lit(value)).otherwise(F.lit(0))

    score = reduce(
        add,
        [points(F.col("a.in_nav"), fv.NAV_POINTS), points(F.col("a.in_footer"), fv.FOOTER_POINTS)]
        + [points(text.rlike(p), n) for p, n in fv.LINK_TEXT_POINTS]
        + [points(href.rlike("(?i)" + p), n) for p, n in fv.LINK_TARGET_POINTS],
    )
    target = F.substring_index(F.regexp_replace("a.url", r"/\z", ""), "?", 1)
    best_first = W.partitionBy("page_id").orderBy(F.desc("score"), "first_pos", "link")
    return (
        links.filter(~href.rlike("(?i)" + fv.SOCIAL_LINK))
        .filter(either(strict) | (F.col("a.in_nav") & either(broad)))
        .filter(site_of(F.col("a.url")) == F.col("site"))
        .select("page_id", "site", target.alias("link"), score.alias("score"), F.col("a.pos").alias("pos"))
        .groupBy("page_id", "site", "link")
        .agg(F.max("score").alias("score"), F.min("pos").alias("first_pos"))
        .withColumn("rank", F.row_number().over(best_first))
    )


def sitemap_links(sitemaps: DataFrame, limit: int | None = None) -> DataFrame:
    """Contact-like URLs of ``(site, xml)`` sitemaps; the first ``limit`` per sitemap where it is given."""
    found = F.transform(
        F.regexp_extract_all("xml", F.lit("(?i)<loc>(.*?)</loc>"), F.lit(1)), C.squeeze_ends
    )
    wanted = F.filter(found, lambda u: u.rlike("(?i)" + fv.SITEMAP_LINK))
    return sitemaps.select("site", F.posexplode(C.first_items(wanted, limit)).alias("pos", "link"))


def emails_in_texts(
    texts: DataFrame, text: str = "text", blocked: Sequence[str] = tuple(fv.BLOCKED_DOMAINS)
) -> DataFrame:
    """Every valid address in plain texts, exploded with its position, role and rank."""
    found = F.filter(
        F.transform(E.find_emails(F.col(text)), F.lower), lambda e: E.is_valid_email(e, blocked)
    )
    others = [c for c in texts.columns if c != text]
    role = E.email_role(F.col("email"), F.lit(""))
    return (
        texts.select(*others, F.posexplode(found).alias("pos", "email"))
        .withColumn("role", role)
        .withColumn("contact_rank", E.contact_rank(F.col("email"), F.col("role")))
    )


def enrich_leads(leads: DataFrame, sites: DataFrame) -> DataFrame:
    """Attach site features to the leads of an enrichment queue.

    Leads without a site row keep empty features; large franchises are left out of the search
    and get empty features too, as they count as attempted.
    """
    skipped = X.is_skipped_lead(F.col("business_name"), F.col("website"))
    keyed = leads.select(
        F.col("id").alias("lead_id"),
        F.when(~skipped, site_of(X.base_url(F.col("website")))).alias("site"),
    )
    return (
        keyed.join(sites, "site", "left")
        .withColumn("has_multiple_tutors", F.coalesce("has_multiple_tutors", F.lit(False)))
        .withColumnRenamed("scheduling_tool", "existing_scheduling_tool")
    )


def lead_addresses(enriched: DataFrame, addresses: DataFrame) -> DataFrame:
    """Addresses of the leads of :func:`enrich_leads`: ``(lead_id, pos, email, role)``, rows of :func:`site_emails`."""
    return enriched.select("lead_id", "site").join(addresses, "site").select(
        "lead_id", F.col("first_at").alias("pos"), "email", "role"
    )


def new_lead_emails(found: DataFrame, lead_emails: DataFrame, as_of: datetime | str) -> DataFrame:
    """Addresses to add to the e-mail table, from ``(lead_id, pos, email, role)``: known ones are dropped.

    The best contact of a lead is its primary one. It is found by an aggregation, so the addresses of one
    lead never have to meet in a task.
    """
    known = lead_emails.select("lead_id", F.lower("email").alias("email")).distinct()
    fresh = found.join(known, ["lead_id", "email"], "left_anti")
    ranked = fresh.withColumn("_place", F.struct(-E.contact_rank(F.col("email"), F.col("role")), "pos", "email"))
    best = ranked.groupBy("lead_id").agg(F.min("_place").alias("_best"))
    return (
        ranked.join(best, "lead_id")
        .withColumn("is_primary", F.col("_place") == F.col("_best"))
        .select(
            F.xxhash64("lead_id", "email").cast("string").alias("id"),
            "lead_id",
            "email",
            F.lit(None).cast("string").alias("contact_name"),
            "role",
            F.lit("unverified").alias("verification_status"),
            F.lit("scraped").alias("source"),
            "is_primary",
            C.moment(as_of).alias("created_at"),
        )
    )


def counted(enriched: DataFrame, added: DataFrame) -> DataFrame:
    """Features of attempted leads with the number of addresses that :func:`new_lead_emails` added, 0 for none."""
    n = added.groupBy("lead_id").agg(F.count("*").cast("int").alias("emails_found_count"))
    return enriched.drop("emails_found_count").join(n, "lead_id", "left").withColumn(
        "emails_found_count", F.coalesce("emails_found_count", F.lit(0))
    )


def upsert_enrichment(current: DataFrame, found: DataFrame, as_of: datetime | str) -> DataFrame:
    """The next enrichment snapshot: new features replace old ones and the attempts go up by one.

    ``found`` has one row per lead with any of the feature columns. Features absent from it are
    overwritten with null, as a repeated attempt overwrites the whole row; a missing count of added
    addresses is 0, and an empty list of specialties is stored as null.
    """
    found = found.withColumn(
        "emails_found_count",
        F.coalesce("emails_found_count", F.lit(0)) if "emails_found_count" in found.columns else F.lit(0),
    )
    if "specialties" in found.columns:
        found = found.withColumn("specialties", F.when(F.size("specialties") > 0, F.col("specialties")))
    features = [c for c in current.columns if c not in _UPSERT_OWN]
    new = found.select(
        "lead_id",
        F.lit(True).alias("_new"),
        *[
            (F.col(c) if c in found.columns else F.lit(None)).cast(current.schema[c].dataType).alias("_" + c)
            for c in features
        ],
    )
    is_new = F.coalesce(F.col("_new"), F.lit(False))
    now = C.moment(as_of)
    joined = current.join(new, "lead_id", "full_outer")
    values = {
        **{c: F.when(is_new, F.col("_" + c)).otherwise(F.col(c)) for c in features},
        "enrichment_attempts": F.when(
            is_new, F.coalesce("enrichment_attempts", F.lit(0)) + 1
        ).otherwise(F.col("enrichment_attempts")),
        "last_enrichment_attempt_at": F.when(is_new, now).otherwise(
            F.col("last_enrichment_attempt_at")
        ),
        "enriched_at": F.when(is_new, now).otherwise(F.col("enriched_at"))
        if "enriched_at" in current.columns
        else None,
        "id": F.coalesce(F.col("id"), F.xxhash64("lead_id").cast("string"))
        if "id" in current.columns
        else None,
    }
    return joined.select(
        *[
            (F.col(c) if c == "lead_id" else values[c]).cast(current.schema[c].dataType).alias(c)
            for c in current.columns
        ]
    )


_UPSERT_OWN = {"id", "lead_id", "enrichment_attempts", "last_enrichment_attempt_at", "enriched_at"}
