"""Addresses written so that simple harvesters miss them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactmill.functions.columns import SPACE, around, contains_any, let
from contactmill.functions.emails import find_emails

# Full-width forms U+FF01..U+FF5E stand for ASCII 0x21..0x7E; U+3002 is the ideographic stop.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3002"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "."


def to_ascii_forms(text: Column) -> Column:
    """Full-width letters, digits and signs to their ASCII forms."""
    return F.when(text.rlike(r"[\uff01-\uff5e\u3002]"), F.translate(text, _WIDE, _NARROW)).otherwise(text)


def decode_cf(encoded: Column) -> Column:
    """Undo the XOR coding of ``data-cfemail``: the first byte is the key. Null without an @."""

    def byte(code: Column, start: Column) -> Column:
        return F.conv(F.substring(code, start, F.lit(2)), 16, 10).cast("int")

    def decoded(code: Column) -> Column:
        starts = F.sequence(F.lit(3), F.length(code), F.lit(2))

        def letters(key: Column) -> Column:
            return F.transform(starts, lambda i: F.char(byte(code, i).bitwiseXOR(key)))

        plain = F.array_join(let(byte(code, F.lit(1)), letters), "")
        return F.when(F.length(code) >= 3, plain)

    return let(let(encoded, decoded), lambda plain: F.when(plain.contains("@"), plain))


def _spelled(user: str, at: str, dot: str, ignore_case: bool = True) -> str:
    """user <at> host <dot> tld; starts only at the start of a run of user characters."""
    flag = "(?i)" if ignore_case else ""
    return (
        rf"{flag}(?:(?<!{user})|\G)({user}++){at}([a-zA-Z0-9.-]+){dot}([a-zA-Z]{{2,}})"
    )


def _wrapped(left: str, right: str) -> tuple[str, str]:
    s = SPACE + "*"
    return tuple(f"{s}{left}{s}{word}{s}{right}{s}" for word in ("at", "dot"))


_USER = "[a-zA-Z0-9._%+-]"
_GAP = SPACE + "+"
SPELLED_FORMS = [
    _spelled(_USER, *_wrapped(r"\(", r"\)")),
    _spelled(_USER, *_wrapped(r"\[", r"\]")),
    _spelled(_USER, *_wrapped(r"\{", r"\}")),
    _spelled(_USER, *_wrapped("<", ">")),
    _spelled(_USER, f"{_GAP}at{_GAP}", f"{_GAP}dot{_GAP}"),
    _spelled(_USER, f"{_GAP}AT{_GAP}", f"{_GAP}DOT{_GAP}", ignore_case=False),
    _spelled("[a-zA-Z0-9._]", "-at-", "-dot-"),
]
# Each sign starts with one character or class, which a search skips to.
_SIGNS = [
    ("&(?:#64|#x40|commat);", "@"),
    (r"(?i)[(\[{](?:(?<=\()dot\)|(?<=\[)dot\]|(?<=\{)dot\})", "."),
    (r"(?i)[(\[{](?:(?<=\()at\)|(?<=\[)at\]|(?<=\{)at\})", "@"),
]


def hidden_emails(text: Column) -> Column:
    """Lower-cased addresses from spelled-out forms, then from coded signs; not yet validated.

    Nearly all texts hold none of the words and signs; one search tells so. Every spelled form holds a "dot"
    with at most six words of the form before it and two after it, so only the text around these is searched.
    """
    nothing = F.array().cast("array<string>")

    def in_words(plain: Column) -> Column:
        def spelled(pattern: str) -> Column:
            return F.transform(
                F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)),
                lambda m: F.lower(F.regexp_replace(m, pattern, "$1@$2.$3")),
            )

        return F.concat(*[spelled(p) for p in SPELLED_FORMS])

    def in_signs(plain: Column) -> Column:
        decoded = plain
        for pattern, sign in _SIGNS:
            decoded = F.regexp_replace(decoded, pattern, sign)

        def found(d: Column) -> Column:
            return F.when(d != plain, F.transform(find_emails(d), F.lower)).otherwise(nothing)

        return let(decoded, found)

    def traced(t: Column) -> Column:
        def spelled_out(p: Column) -> Column:
            return F.when(p.rlike("(?i)dot"), let(around(p, "(?i:dot)"), in_words)).otherwise(nothing)

        searched = let(to_ascii_forms(t), lambda p: F.concat(spelled_out(p), in_signs(p)))
        return F.when(_any_trace(t), searched).otherwise(nothing)

    return let(text, traced)


_TRACES = ["dot", "(at", "[at", "{at", "&#64;", "&#x40;", "&commat;"]


def _any_trace(text: Column) -> Column:
    """Whether a text may hold a hidden address. Full-width letters may spell any of the words."""
    wide = (F.octet_length(text) != F.length(text)) & text.rlike(r"[\uff01-\uff5e\u3002]")
    return let(F.lower(text), lambda low: contains_any(low, _TRACES)) | wide
