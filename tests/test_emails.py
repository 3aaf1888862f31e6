from __future__ import annotations

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contactmill.functions import emails as E
from contactmill.functions import fixed_values as fv
from contactmill.functions.columns import around
from contactmill.functions.hidden_emails import SPELLED_FORMS, decode_cf, hidden_emails, to_ascii_forms

VALID = [
    ("jo@site.org", True),
    ("first.last+x@sub.site.co.uk", True),
    ("no-at.site.org", False),
    ("nodot@site", False),
    ("@site.org", False),
    ("jo@", False),
    ("a" * 64 + "@site.org", True),
    ("a" * 65 + "@site.org", False),
    ("jo@" + "d" * 250 + ".org", False),
    ("jo@site.toolong", False),
    ("jo@site.o", False),
    ("jo@si_te.org", False),
    ("jo@example.com", False),
    ("jo@mail.example.com", False),
    ("jo@notexample.com", True),
    ("jo/x@site.org", False),
    ("jo\\x@site.org", False),
    ("logo@2x.png", False),
    ("photo@site.webp", False),
    (".jo@site.org", False),
    ("jo-@site.org", False),
    ("120px@site.org", False),
    ("120pixels@site.org", True),
    ("a--b@site.org", False),
    ("jö@site.org", False),
    ("jo@site.org\n", False),
    (None, False),
]


def test_validity(spark):
    df = spark.createDataFrame(VALID, "email string, want boolean")
    got = df.withColumn("got", E.is_valid_email(F.col("email"))).filter("got <> want").collect()
    assert got == []


def test_blocked_list_is_a_parameter(one):
    assert one(E.is_valid_email(F.lit("jo@example.com"), ["other.org"]))


@pytest.mark.parametrize(
    ("email", "context", "role", "rank"),
    [
        ("x9@site.org", "The Founder of it", "owner", 30),
        ("x9@site.org", "office Manager", "admin", 20),
        ("info@site.org", "", "info", 15),
        ("office@site.org", "", "info", 10),
        ("jane.doe@site.org", "", "owner", 55),
        ("bob@site.org", "", "owner", 50),
        ("sales@site.org", "", "owner", 10),
        ("no-reply@site.org", "", "unknown", -20),
        ("x9@site.org", "", "unknown", 0),
        ("contact@site.org", "ceo", "owner", 35),
    ],
)
def test_role_and_rank(one, email, context, role, rank):
    got = E.email_role(F.lit(email), F.lit(context))
    assert one(got, E.contact_rank(F.lit(email), got)) == (role, rank)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab.@-_ %c", max_size=30), min_size=1, max_size=30))
def test_find_emails_equals_the_plain_pattern(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", E.find_emails(F.col("t")))
    for text, found in df.collect():
        assert found == re.findall(fv.EMAIL_PATTERN, text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("jo (at) site (dot) org", ["jo@site.org"]),
        ("jo ( AT ) site ( DOT ) org", ["jo@site.org"]),
        ("jo [at] site [dot] org", ["jo@site.org"]),
        ("jo {at} site {dot} org", ["jo@site.org"]),
        ("jo <at> site <dot> org", ["jo@site.org"]),
        ("Jo at site dot org", ["jo@site.org"]),
        ("jo-at-site-dot-org", ["jo@site.org"]),
        ("jo AT site DOT org", ["jo@site.org"]),
        ("jo&#64;site.org", ["jo@site.org"]),
        ("jo&#x40;site.org", ["jo@site.org"]),
        ("jo&commat;site.org", ["jo@site.org"]),
        ("jo[at]site[dot]org", ["jo@site.org"]),
        ("ｊｏ (at) ｓｉｔｅ (dot) ｏｒｇ", ["jo@site.org"]),
        ("jo@site.org", []),
        ("meet at noon", []),
        ("", []),
    ],
)
def test_hidden(one, text, found):
    assert list(dict.fromkeys(one(hidden_emails(F.lit(text))))) == found


def test_forms_found_around_their_dot_are_those_of_the_whole_text(spark):
    rng = random.Random(5)
    signs = ["(", ")", "[", "]", "at", "dot", "AT", "DOT", "(at)", "(dot)", "[ dot ]", "-at-", "-dot-", "<at>", "<Dot>", "{at}", "{dot}"]
    gaps, words = [" ", " ", "  ", "\n", "\u00a0", "", ", "], ["jo", "a.b", "org", "com2", "x@y.org", "dotted", "\U0001f600", "it's"]
    texts = []
    for share in (0.02, 0.2, 0.6, 0.9):
        texts += ["".join(rng.choice(signs if rng.random() < share else words) + rng.choice(gaps) for _ in range(120)) for _ in range(150)]
    forms = "jo (at) site (dot) org|jo ( at ) site ( DOT ) org2 [at] b [dot] com|jo at dot dot org|jo-at-site-dot-org|JO AT b DOT org"
    texts += [" x ".join(rng.choice(["", "w " * 30]) + f for f in forms.split("|")) + " y" * 20 for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [
        F.struct(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in SPELLED_FORMS]) for text in (F.col("t"), around(F.col("t"), "(?i:dot)"))
    ]
    rows = df.select(*[f.alias(n) for f, n in zip(found, "ab")]).collect()
    assert all(r.a == r.b for r in rows)
    assert all(any(r.a[i] for r in rows) for i in range(len(SPELLED_FORMS)))


def test_only_the_surroundings_of_a_sign_are_searched(one):
    text = "w " * 500 + "jo at site dot org" + " w" * 500
    assert one(around(F.lit(text), "(?i:dot)")) == f"{'w ' * 8}w\0{'w ' * 5}jo at site dot org{' w' * 7}\0w{' w' * 8}"
    assert one(hidden_emails(F.lit(text))) == ["jo@site.org"]
    assert one(around(F.lit("a b"), "@")) == "a b"


def test_ascii_forms(one):
    assert one(to_ascii_forms(F.lit("ａ＠ｂ。ｃ．d"))) == "a@b.c.d"


def coded(email: str, key: int = 0x5B) -> str:
    return f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in email)


@pytest.mark.parametrize(
    ("value", "plain"),
    [(coded("jo@site.org"), "jo@site.org"), (coded("nothing"), None), ("5b", None), ("", None), ("zz", None)],
)
def test_cf(one, value, plain):
    assert one(decode_cf(F.lit(value))) == plain
