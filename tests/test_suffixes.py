import pytest

from contactmill.operators.ingest import drop_same_contact
from contactmill.operators.suffixes import suffix_rules, with_registered_domain

LINES = ["// comment", "com", "co.uk note", "uk", "", " *.ck", "!www.ck", "*.kobe.jp", "jp", "!city.kobe.jp", "com", "blog.com", None]


@pytest.fixture(scope="module")
def rules(spark):
    return suffix_rules(spark.createDataFrame([(x,) for x in LINES], "value string"))


def naive(host):
    """The rule of the list, label by label."""
    plain, wild, no = {"com", "co.uk", "uk", "jp", "blog.com"}, {"ck", "kobe.jp"}, {"www.ck", "city.kobe.jp"}
    labels = host.split(".")
    size = 1
    for k in range(1, len(labels) + 1):
        tail = ".".join(labels[-k:])
        if tail in no:
            size = k - 1
            break
        if tail in plain:
            size = max(size, k)
        if tail in wild:
            size = max(size, min(k + 1, len(labels)))
    return ".".join(labels[-size:]), ".".join(labels[-size - 1 :]) if len(labels) > size else None


def test_lines_become_rules(rules):
    kinds = {(r.rule, r.kind) for r in rules.collect()}
    assert kinds == {
        ("com", "plain"), ("co.uk", "plain"), ("uk", "plain"), ("ck", "wildcard"), ("www.ck", "exception"),
        ("kobe.jp", "wildcard"), ("jp", "plain"), ("city.kobe.jp", "exception"), ("blog.com", "plain"),
    }


def test_longest_rule_wildcards_and_exceptions(spark, rules):
    tails = ["com", "a.com", "co.uk", "uk", "ck", "x.ck", "www.ck", "kobe.jp", "city.kobe.jp", "c.kobe.jp", "jp", "blog.com", "unknown"]
    hosts = [prefix + t for t in tails for prefix in ("", "b.", "a.b.")]
    rows = [(i, h) for i, h in enumerate(hosts + hosts[:5])]
    out = with_registered_domain(spark.createDataFrame(rows, "id long, host string"), rules).collect()
    assert len(out) == len(rows)
    assert {r.host: (r.suffix, r.domain) for r in out} == {h: naive(h) for h in hosts}


def test_null_empty_and_capital_hosts(spark, rules):
    hosts = spark.createDataFrame([(None,), ("",), ("A.Shop.CO.UK.",)], "host string")
    out = {r.host: (r.suffix, r.domain) for r in with_registered_domain(hosts, rules).collect()}
    assert out == {None: (None, None), "": (None, None), "A.Shop.CO.UK.": ("co.uk", "shop.co.uk")}
    assert {r.suffix for r in with_registered_domain(hosts, rules.limit(0)).collect()} == {None, "uk"}


def test_leads_of_one_registered_domain(spark, rules):
    sites = ["https://a.x.ck", "https://b.x.ck", "https://c.a.x.ck", "https://www.ck/1", "https://s.www.ck", None, None]
    leads = spark.createDataFrame([(i, None, s) for i, s in enumerate(sites)], "id long, phone string, website string")
    out = drop_same_contact(leads, suffixes=rules)
    assert out.columns == leads.columns
    assert sorted(r.id for r in out.collect()) == [0, 1, 3, 5, 6]
