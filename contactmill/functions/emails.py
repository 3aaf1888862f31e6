"""Address checks, roles and ranks as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactmill.functions import fixed_values as fv
from contactmill.functions.columns import around

# The same language as EMAIL_PATTERN, written so that a long run of letters without an "@"
# is read once: a match starts at the start of a run, or where the last match ended.
_FAST_EMAIL = (
    r"(?:(?<![a-zA-Z0-9._%+-])|\G)[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
)


def local_part(email: Column) -> Column:
    return F.get(F.split(email, "@"), F.lit(0))


def domain_part(email: Column) -> Column:
    """The piece after the first ``@``; null when there is none."""
    return F.get(F.split(email, "@"), F.lit(1))


def find_emails(text: Column) -> Column:
    """All addresses in a text, in order of appearance. No address holds a blank."""
    return F.when(
        text.contains("@"), F.regexp_extract_all(around(text, "@"), F.lit(_FAST_EMAIL), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))


def is_valid_email(email: Column, blocked: Sequence[str] = tuple(fv.BLOCKED_DOMAINS)) -> Column:
    """Shape, length, character, blocked-domain and file-name checks."""
    local, domain = local_part(email), domain_part(email)
    is_blocked = reduce(
        or_, [(domain == d) | domain.endswith("." + d) for d in blocked], F.lit(False)
    )
    ok = (
        email.contains("@")
        & email.contains(".")
        & (F.length(local) > 0)
        & (F.length(local) <= 64)
        & (F.length(domain) <= 253)
        & domain.rlike(r"\.[A-Za-z]{2,6}\z")
        & domain.rlike(r"\A[A-Za-z0-9.-]+\z")
        & ~is_blocked
        & ~email.rlike(r"[/\\]")
        & ~email.rlike(r"(?i)\.(" + "|".join(fv.ASSET_EXTENSIONS) + r")\z")
        & ~local.rlike(r"\A[.\-]|[.\-]\z")
        & ~local.rlike(r"\A[0-9]+px")
        & ~local.contains("--")
        & local.rlike(r"\A[A-Za-z0-9._%+-]+\z")
    )
    return F.coalesce(ok, F.lit(False))


def email_role(email: Column, context: Column) -> Column:
    """owner / admin / info / unknown, from the words around the address, then its prefix."""
    prefix = local_part(F.lower(email))
    words = F.lower(F.coalesce(context, F.lit("")))
    return (
        F.when(words.rlike(fv.OWNER_CONTEXT), "owner")
        .when(words.rlike(fv.ADMIN_CONTEXT), "admin")
        .when(prefix.isin(fv.INFO_PREFIXES), "info")
        .when(prefix.rlike(r"\A[a-z]+(\.[a-z]+)?\z"), "owner")
        .otherwise("unknown")
    )


def contact_rank(email: Column, role: Column) -> Column:
    """How promising an address is as a contact; higher is better."""
    prefix = F.lower(local_part(email))

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    return reduce(
        add,
        [
            points(role == "owner", 30),
            points(role == "admin", 20),
            points(role == "info", 10),
            points(prefix.rlike(r"\A[a-z]+\.[a-z]+\z"), 25),
            points(
                prefix.rlike(r"\A[a-z]{2,15}\z") & ~prefix.isin(fv.RANK_GENERIC_PREFIXES), 20
            ),
            points(prefix.isin(fv.RANK_FRONT_DESK_PREFIXES), 5),
            points(prefix.isin(fv.RANK_FUNCTIONAL_PREFIXES), -20),
        ],
    )
