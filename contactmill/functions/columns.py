"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# White space as browsers define it; Java's \s covers the ASCII part only.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def moment(as_of: datetime | str) -> Column:
    """The "now" of a query as a timestamp literal."""
    return F.lit(str(as_of)).cast("timestamp")


def half_up(value: Column, digits: int = 0) -> Column:
    """Round halves towards plus infinity, like ``floor(x * 10^d + 0.5) / 10^d``."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale if digits else F.floor(value + 0.5)


def share(part: Column, total: Column) -> Column:
    """``part`` of ``total`` in percent with one decimal; 0 when there is nothing to divide."""
    return F.when(total > 0, half_up(part / total * 100, 1)).otherwise(F.lit(0.0))


def norm(value: Column) -> Column:
    return F.lower(F.trim(value))


def squeeze(value: Column) -> Column:
    """Collapse white space and trim. Single blanks, the usual case, are not rewritten."""
    return F.trim(F.regexp_replace(value, f" {SPACE}+|[{SPACE}&&[^ ]]{SPACE}*", " "))


def squeeze_ends(value: Column) -> Column:
    """Trim all kinds of white space."""
    return F.regexp_replace(value, rf"\A{SPACE}+|{SPACE}+\z", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_WORD = "[^" + SPACE[1:] + "*+"


def around(text: Column, sign: str, words: int = 8) -> Column:
    """The parts of a text around each match of a sign (a regular expression), with ``words`` words on either side.

    A NUL stands for what is left out. So a pattern that holds the sign, goes over fewer blanks before and after
    it, and matches no NUL finds the same in the parts as in the text. The search for the sign costs much less.
    """
    near = rf"\A(?:{_WORD}{SPACE}++){{0,{words}}}+{_WORD}"

    def ends(part: Column) -> Column:
        head = F.regexp_extract(part, near, 0)
        tail = F.reverse(F.regexp_extract(F.reverse(part), near, 0))
        both = F.struct(head.alias("head"), tail.alias("tail"))

        def joined(b: Column) -> Column:
            whole = F.length(b["head"]) + F.length(b["tail"]) >= F.length(part)
            return F.when(whole, part).otherwise(F.concat(b["head"], F.lit("\0"), b["tail"]))

        return let(both, joined)

    return F.array_join(F.transform(F.split(text, f"(?={sign})"), ends), "")


def contains_any(value: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [value.contains(w) for w in words], F.lit(False))


def first_contained(value: Column, words: Sequence[str]) -> Column:
    """The first word of the list found in the text, or null."""
    return F.coalesce(*[F.when(value.contains(w), F.lit(w)) for w in words])


def all_contained(value: Column, words: Sequence[str], limit: int | None = None) -> Column:
    """The words of the list found in the text, in list order; the first ``limit`` where it is given."""
    hits = [F.when(value.contains(w), F.lit(w)) for w in words]
    return first_items(F.array_compact(F.array(*hits)), limit)


WORDS_PER_MASK = 60


def contained_mask(value: Column, words: Sequence[str]) -> Column:
    """Which words occur, as bits of an array of longs with ``WORDS_PER_MASK`` words each."""

    def part(start: int) -> Column:
        bits = [
            F.when(value.contains(w), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
            for i, w in enumerate(words[start : start + WORDS_PER_MASK])
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return F.array(*[part(i) for i in range(0, len(words), WORDS_PER_MASK)])


def mask_unions(words: Sequence[str], mask: str = "specialty_bits") -> list[Column]:
    """The union of masks over a group, as an aggregate of the same name."""
    parts = range(-(-len(words) // WORDS_PER_MASK))
    return [F.array(*[F.bit_or(F.get(mask, F.lit(i))) for i in parts]).alias(mask)]


def words_of_mask(mask: Column, words: Sequence[str], limit: int | None = None) -> Column:
    """The words of a mask. ``mask`` should be a plain column, as it is read once per word."""

    def bit(i: int) -> Column:
        return F.get(mask, F.lit(i // WORDS_PER_MASK)).bitwiseAND(F.lit(1 << i % WORDS_PER_MASK)) != 0

    return first_items(F.array_compact(F.array(*[F.when(bit(i), F.lit(w)) for i, w in enumerate(words)])), limit)


def first_items(items: Column, limit: int | None) -> Column:
    """The first items of an array, or all of them."""
    return items if limit is None else F.slice(items, 1, limit)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key, the lowest in ``order``.

    Planned with a per-task group limit ahead of the shuffle, so a key that holds a large
    part of all rows sends one row per task and not the whole group.
    """
    return top_per_key(df, keys, order, 1)


def top_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int
) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def top(df: DataFrame, order: Sequence[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Order, skip and take. Without a limit the whole result is ordered."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def beside(df: DataFrame, *rows: DataFrame) -> DataFrame:
    """Add the columns of one-row DataFrames, as scalar subqueries; nothing is joined."""
    for i, row in enumerate(rows):
        name = f"_row{i}"
        whole = row.select(F.struct(*row.columns).alias(name)).scalar()
        df = df.withColumn(name, whole).select("*", f"{name}.*").drop(name)
    return df
