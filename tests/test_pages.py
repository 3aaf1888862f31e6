from __future__ import annotations

import html as html_lib
import re

import pytest
from pyspark.sql import functions as F

from contactmill.functions import columns as C
from contactmill.operators import pages as P
from contactmill.operators.htmlpass import read_page
from contactmill.plans import queries as Q
from tests.test_emails import coded

# One page per place an address may be written: (html, address, context)
PLACES = {
    "mail link": ('<a href="mailto:jo%2Bx@s.org?subject=a@b.org">Jo</a>', "jo+x@s.org", "Jo"),
    "plus in a mail link": ('<a href="mailto:jo+x@s.org">Jo</a>', "jo+x@s.org", "Jo"),
    "empty mail link": ('<a href="mailto:jo@s.org"> </a>', "jo@s.org", "mailto link"),
    "coded": (f'<span data-cfemail="{coded("jo@s.org")}">x</span>', "jo@s.org", "cloudflare protected"),
    "data-email": ('<p data-email="jo@s.org">x</p>', "jo@s.org", "data attribute"),
    "data-mail": ('<p data-email="" data-mail="jo@s.org">x</p>', "jo@s.org", "data attribute"),
    "data-contact-email": ('<p data-contact-email="jo@s.org">x</p>', "jo@s.org", "data attribute"),
    "structured data": (
        '<script type="application/ld+json">{"@graph": [{"a": {"workEmail": "mailto:jo@s.org"}}]}</script>',
        "jo@s.org", "structured data",
    ),
    "structured link": (
        '<script type="application/ld+json">[{"sameAs": "mailto:jo@s.org?x"}]</script>', "jo@s.org",
        "structured data",
    ),
    "meta name": ('<meta name="email" content="jo@s.org">', "jo@s.org", "meta tag"),
    "meta property": ('<meta property="og:email" content="jo@s.org">', "jo@s.org", "meta tag"),
    "meta contact": ('<meta name="contact:email" content="jo@s.org">', "jo@s.org", "meta tag"),
    "itemprop text": ('<span itemprop="email"> jo@s.org </span>', "jo@s.org", "schema.org itemprop"),
    "itemprop link": ('<a itemprop="email" href="mailto:jo@s.org">mail</a>', "jo@s.org", "mail"),
    "form": ('<form action="mailto:jo@s.org?x=1"></form>', "jo@s.org", "form action mailto"),
    "recipient": ('<input name="_replyto" value=" jo@s.org ">', "jo@s.org", "form recipient field"),
    "footer": ("<footer>Write to jo@s.org</footer>", "jo@s.org", "footer"),
    "footer class": ('<div class="a site-footer">jo (at) s (dot) org</div>', "jo@s.org", "footer"),
    "footer markup": ('<div role="contentinfo"><b title="jo@s.org">us</b></div>', "jo@s.org", "footer"),
    "contact id": ('<div id="contact">jo@s.org</div>', "jo@s.org", "contact section"),
    "contact part of a class": ('<div class="my-contacts">jo at s dot org</div>', "jo@s.org", "contact section"),
    "email part of an id": ('<p id="the-email">jo@s.org</p>', "jo@s.org", "contact section"),
    "reach": ('<p class="reachus">jo@s.org</p>', "jo@s.org", "contact section"),
    "field": ('<input type="hidden" value="to=jo@s.org;cc=al@s.org">', "jo@s.org", "hidden input"),
    "spelled text": ("<p>jo [at] s [dot] org</p>", "jo@s.org", "obfuscated in text"),
    "plain text": ("<p>our owner is  jo@s.org. Hello</p>", "jo@s.org", "our owner is jo@s.org. Hello"),
}


def features(spark, pages, **options):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return P.page_features(P.with_site(df), **options).orderBy("page_id").collect()


def test_every_place(spark):
    names = list(PLACES)
    pages = [(i, "https://s.org/", f"<html><body>{PLACES[n][0]}</body></html>") for i, n in enumerate(names)]
    got = {names[r.page_id]: [tuple(e)[:2] for e in r.emails] for r in features(spark, pages, max_emails=1)}
    assert got == {n: [PLACES[n][1:]] for n in names}


def test_search_order_and_limit(spark):
    html = (
        "<body>text@s.org <footer>foot@s.org</footer> <div id=contact>con@s.org</div> "
        '<input type="text" value="field@s.org"><meta name="email" content="meta@s.org">'
        '<p data-email="data@s.org"></p><a href="mailto:LINK@s.org.">x</a><a href="mailto:link@s.org">y</a></body>'
    )
    (row,) = features(spark, [(1, "https://s.org", html)])
    assert [e.email for e in row.emails] == [
        "link@s.org", "data@s.org", "meta@s.org", "foot@s.org", "con@s.org", "field@s.org", "text@s.org",
    ]
    (row,) = features(spark, [(1, "https://s.org", html)], max_emails=2)
    assert [e.email for e in row.emails] == ["link@s.org", "data@s.org"]


def test_hidden_parts_are_not_read(spark):
    html = (
        "<head><title>t@s.org</title><style>a@s.org</style></head><body>x<script>b@s.org</script>"
        "<noscript>c@s.org</noscript><svg><text>d@s.org</text></svg><!-- e@s.org --></body>"
    )
    (row,) = features(spark, [(1, "https://s.org", html)])
    assert row.emails == [] and row.text_length == 1


def test_text_of_broken_markup():
    reader = read_page("<p>one<p><b>two<br>&amp; <i>three</b></div> four<![x</p>&nbsp;five")
    assert " ".join(reader.text.split()).startswith("onetwo& three four")
    reader = read_page('<div class="contact">a@s.org<p>b</div><p>c@s.org')
    texts = [reader.text[s["text_from"] :][: s["text_length"]] for s in reader.sections if s["rank"] == 1]
    assert texts == ["a@s.orgb"]
    assert read_page(None).text == ""
    unclosed = read_page("<a href=x>one <b><a href=y>two <a href=z>three")
    assert [link["text"] for link in unclosed.links] == ["one ", "two ", "three"]


def test_text_of_the_sample_pages(spark, small):
    """The sample pages are plain enough for their text to be had by stripping."""
    rows = P.read_pages(P.with_site(spark.read.parquet(f"{small}/pages.parquet"))).select("page_id", "text")
    sources = dict(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html").collect())
    drop = re.compile(r"(?s)<script.*?</script>|<style.*?</style>|<title>.*?</title>|<!--.*?-->|<[^>]+>")
    for page_id, text in rows.collect():
        assert text == " ".join(html_lib.unescape(drop.sub("", sources[page_id])).split())


def test_open_comment_hides_the_rest():
    assert read_page("a<!-- x -->b<!-- c@s.org <p>d").text == "ab"


def test_deeply_nested_sections_stay_small():
    reader = read_page('<div class="contact">x@s.org ' * 3000)
    assert len(reader.sections) == 2 * 3000  # by class and by part of a class
    assert len(reader.text) == 8 * 3000


def test_tool_staff_topics_and_social_links(spark):
    html = (
        '<body><script src="https://calendly.com/x.js"></script>Meet OUR TEAM of math and SAT teachers'
        '<a href="https://linkedin.com/in/jo">p</a><a href="https://linkedin.com/company/a">a</a>'
        '<a href="https://linkedin.com/company/b">b</a><a href="https://facebook.com/one">1</a>'
        '<a href="https://facebook.com/sharer?u">s</a></body>'
    )
    (row,) = features(spark, [(1, "https://s.org", html)])
    assert row.scheduling_tool == "calendly" and row.has_multiple_tutors
    assert row.linkedin_url == "https://linkedin.com/company/b"
    assert row.facebook_url == "https://facebook.com/one"


def test_tool_in_list_order_over_source_and_text(spark):
    pages = [
        (1, "https://s.org", "<i title='doodle'>use acuity</i>"),
        (2, "https://s.org", "<b>square</b> <i>appointments</i>"),
        (3, "https://s.org", "none"),
    ]
    assert [r.scheduling_tool for r in features(spark, pages)] == ["acuity", "square appointments", None]


def test_bot_pages_and_failed_fetches(spark):
    rows = [
        (1, "ok", 200, "text/html"), (2, "Just a moment...", 200, "text/html"), (3, "", 200, "text/html"),
        (4, "ok", 404, "text/html"), (5, "ok", 200, "application/pdf"), (6, "Captcha", 200, "application/xhtml+xml"),
        (7, "x captcha", 200, "text/html"),
    ]
    df = spark.createDataFrame(rows, "page_id long, html string, status_code int, content_type string")
    assert [r.page_id for r in P.usable_pages(df).orderBy("page_id").collect()] == [1, 6]


def test_sites_merge_in_page_order(spark):
    pages = [
        (i, f"https://{'www.' if i % 2 else ''}s.org/{i}", html)
        for i, html in enumerate(
            ["<p>nothing", "<p>b@s.org c@s.org acuity", "<p>b@s.org a@s.org calendly staff math", "<p>d@s.org"]
        )
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    (row,) = P.site_features(df).collect()
    found = P.site_emails(P.site_pages(df)).orderBy("first_at").collect()
    assert [e.email for e in found] == ["b@s.org", "c@s.org", "a@s.org", "d@s.org"]
    first = P.site_emails(P.site_pages(df), limit=2).orderBy("first_at").collect()
    assert [e.email for e in first] == ["b@s.org", "c@s.org"]
    assert (row.pages_read, row.scheduling_tool, row.has_multiple_tutors) == (4, "acuity", True)
    assert row.specialties == ["math"]


def test_only_the_first_pages_of_a_site_count(spark):
    pages = [(i, "https://big.org/", f"<p>u{i}@s.org") for i in range(30)] + [(99, "https://small.org", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    kept = P.first_pages_per_site(P.with_site(df), 12).groupBy("site").agg(F.max("page_id"), F.count("*"))
    assert sorted(map(tuple, kept.collect())) == [("big.org", 11, 12), ("small.org", 99, 1)]


def test_contact_links(spark):
    html = (
        '<nav><a href="/our-story">Meet Sarah</a></nav><a href="/our-story">Our story</a>'
        '<a href="/contact/">Contact</a><a href="https://www.s.org/team?x=1">the team</a>'
        '<a href="https://else.org/contact">Contact</a><a href="https://facebook.com/contact">Contact</a>'
        '<a href="/contacts">list</a><footer><a href="about#us">About</a></footer><a href="mailto:contact@s.org">contact</a>'
    )
    df = spark.createDataFrame([(1, "https://s.org/", html)], "page_id long, url string, html string")
    rows = P.contact_links(df).orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2, 3, 4]
    got = {r.link: r.score for r in rows}
    assert list(got.values()) == sorted(got.values(), reverse=True)
    assert got == {
        "https://s.org/our-story": 50,
        "https://s.org/contact": 45,
        "https://www.s.org/team": 30,
        "https://s.org/about#us": 35,
    }


def test_sitemap_links_and_their_limit(spark):
    urls = "".join(f"<LOC> https://s.org/about/{i} </LOC><loc>https://s.org/x{i}</loc>" for i in range(8))
    df = spark.createDataFrame([("s.org", urls)], "site string, xml string")
    links = [f"https://s.org/about/{i}" for i in range(8)]
    assert [r.link for r in P.sitemap_links(df).orderBy("pos").collect()] == links
    assert [r.link for r in P.sitemap_links(df, 5).orderBy("pos").collect()] == links[:5]


def test_enrichment_of_leads(spark):
    leads = spark.createDataFrame(
        [("1", "A", "s.org/"), ("2", "Kumon North", "https://s.org"), ("3", "C", None), ("4", "D", "http://www.s.org")],
        "id string, business_name string, website string",
    )
    pages = spark.createDataFrame(
        [(1, "https://s.org/", "<p>info@s.org ann.lee@s.org staff")], "page_id long, url string, html string"
    )
    enriched = P.enrich_leads(leads, P.site_features(pages))
    flags = {r.lead_id: r.has_multiple_tutors for r in enriched.collect()}
    assert flags == {"1": True, "2": False, "3": False, "4": True}
    known = spark.createDataFrame([("1", "INFO@s.org")], "lead_id string, email string")
    addresses = P.site_emails(P.site_pages(pages))
    added = P.new_lead_emails(P.lead_addresses(enriched, addresses), known, "2024-01-01")
    rows = added.collect()
    assert {r.lead_id: r.emails_found_count for r in P.counted(enriched, added).collect()} == {"1": 1, "2": 0, "3": 0, "4": 2}
    got = sorted((r.lead_id, r.email, r.role, r.is_primary) for r in rows)
    assert got == [
        ("1", "ann.lee@s.org", "owner", True), ("4", "ann.lee@s.org", "owner", True), ("4", "info@s.org", "info", False),
    ]


def test_upsert_counts_attempts(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    old = spark.createDataFrame(
        [("1", True, "acuity", 2, 1), ("2", False, None, 1, 0)],
        "lead_id string, has_multiple_tutors boolean, existing_scheduling_tool string, enrichment_attempts int, emails_found_count int",
    ).withColumn("last_enrichment_attempt_at", now)
    new = spark.createDataFrame([("1", False, 0), ("3", True, 2)], "lead_id string, has_multiple_tutors boolean, emails_found_count int")
    rows = P.upsert_enrichment(old, new, "2024-02-01").orderBy("lead_id").collect()
    got = [(r.lead_id, r.has_multiple_tutors, r.existing_scheduling_tool, r.enrichment_attempts, r.emails_found_count, r.last_enrichment_attempt_at.month) for r in rows]
    assert got == [("1", False, None, 3, 0, 2), ("2", False, None, 1, 0, 1), ("3", True, None, 1, 2, 2)]


@pytest.mark.parametrize(
    ("text", "want"), [(" a  b ", "a b"), ("a \n b　", "a b"), ("a b", "a b"), ("\t", "")]
)
def test_squeeze(one, text, want):
    assert one(C.squeeze(F.lit(text))) == want


def test_only_the_first_meta_of_a_kind_counts(spark):
    html = '<meta name="email"><meta name="email" content="jo@s.org"><body>x</body>'
    (row,) = features(spark, [(1, "https://s.org", html)])
    assert row.emails == []


def test_full_width_addresses_in_contact_sections(spark):
    html = '<div class="contact">jo \uff08\uff41\uff54\uff09 s \uff08\uff44\uff4f\uff54\uff09 org </div><p>other@s.org</p>'
    (row,) = features(spark, [(1, "https://s.org", html)])
    assert [e.email for e in row.emails] == ["jo@s.org", "other@s.org"]


def test_deep_structured_data_is_read():
    import json

    tree = {"email": "deep@s.org"}
    for _ in range(40):
        tree = {"in": [tree]}
    reader = read_page(f'<script type="application/ld+json">{json.dumps(tree)}</script>')
    assert [h["value"] for h in reader.hints] == ["deep@s.org"]


def test_addresses_are_found_once(spark, small):
    """No filter above the search repeats it; pages without an address still give no row."""
    pages = spark.createDataFrame([(1, "https://a.org/", "<p>jo@a.org x</p>"), (2, "https://b.org/", "<p>none</p>")], "page_id long, url string, html string")
    found = P.site_emails(P.page_features(P.with_site(pages)))
    assert [(r.site, r.email) for r in found.collect()] == [("a.org", "jo@a.org")]
    for df in (found, Q.registered()["markup_places"](spark, small)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line.split("(")[0] and "regexp_extract_all" in line]
