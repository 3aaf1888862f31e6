"""Features read from names, sites and page texts, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactmill.functions import fixed_values as fv
from contactmill.functions.columns import all_contained, contains_any, first_contained


def business_type(name: Column, types: Column | None = None) -> Column:
    """franchise / online_platform / agency / solo_tutor from a name and its place types."""
    low = F.lower(name)
    out = (
        F.when(contains_any(low, fv.FRANCHISE_WORDS), "franchise")
        .when(contains_any(low, fv.ONLINE_WORDS), "online_platform")
        .when(contains_any(low, fv.AGENCY_WORDS), "agency")
    )
    if types is not None:
        out = out.when(
            F.array_contains(types, "establishment") & F.array_contains(types, "point_of_interest"),
            "agency",
        )
    return out.otherwise("solo_tutor")


def is_skipped_lead(name: Column, website: Column) -> Column:
    """Leads of the large franchises are not enriched."""
    return contains_any(F.lower(F.coalesce(name, F.lit(""))), fv.SKIPPED_FRANCHISES) | contains_any(
        F.lower(F.coalesce(website, F.lit(""))), fv.SKIPPED_FRANCHISES
    )


# The three searches below take lower-cased text. Lower-case a text in a projection of its own
# (``withColumn``): written inside the search it would be computed anew for every word.
def scheduling_tool(low: Column, tools: Sequence[str] = tuple(fv.SCHEDULING_TOOLS)) -> Column:
    return first_contained(low, tools)


def has_staff(low: Column, phrases: Sequence[str] = tuple(fv.STAFF_PHRASES)) -> Column:
    return contains_any(low, phrases)


def specialties(
    low: Column, words: Sequence[str] = tuple(fv.SPECIALTIES), limit: int | None = None
) -> Column:
    return all_contained(low, words, limit)


def base_url(website: Column) -> Column:
    """Add ``https://`` where no http prefix is given and drop one closing slash."""
    full = F.when(website.startswith("http"), website).otherwise(F.concat(F.lit("https://"), website))
    return F.regexp_replace(full, r"/\z", "")


def host_of(url: Column) -> Column:
    """Lower-cased host of an http(s) URL, without user, port or path; null when there is none."""
    host = F.regexp_extract(url, r"(?i)\Ahttps?://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.lower(F.nullif(host, F.lit("")))


def root_domain(host: Column, suffixes: Sequence[str] = tuple(fv.SHARED_SUFFIXES)) -> Column:
    """The part of a host that one owner registers: one label more than its public suffix or platform.

    ``suffixes`` lists those of two labels; any other suffix has one.
    """
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(suffixes)), F.substring_index(host, ".", -3)).otherwise(two)


def is_bot_page(html: Column) -> Column:
    return contains_any(html, fv.BOT_PAGE_MARKERS)


def strip_html(html: Column) -> Column:
    """Plain text of a rendered mail body."""
    text = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</p>", "\n\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")
