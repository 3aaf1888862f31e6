"""Registered domains by the longest matching rule of a table of public suffixes.

The rules are those of the public list format: a suffix, ``*.`` before one where every label in that place is part of
it, and ``!`` before a host that a wildcard does not cover. A host is registered one label below its suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffix_rules(lines: DataFrame) -> DataFrame:
    """Rules ``(rule, kind)`` from lines ``value`` of the public list format, e.g. of ``spark.read.text``.

    A rule ends at the first white space; empty lines, comments and repeated rules are left out. ``rule`` is the
    suffix without its mark, ``kind`` is plain, wildcard or exception.
    """
    text = F.lower(F.regexp_extract("value", r"\A\s*(\S+)", 1)).alias("text")
    kind = F.when(F.col("text").startswith("*."), "wildcard").when(F.col("text").startswith("!"), "exception").otherwise("plain")
    rules = lines.select(text).where("text <> '' and not startswith(text, '//')")
    return rules.select(F.regexp_replace("text", r"\A(?:\*\.|!)", "").alias("rule"), kind.alias("kind")).distinct()


def with_registered_domain(rows: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """Rows with ``suffix`` and ``domain`` of their host, in lower case and without a dot at its end.

    An exception rule wins, then the rule with most labels; a host that no rule matches has its last label as
    suffix. A host that is itself a suffix has a null domain; null and empty hosts have neither. Every row is
    kept. Hosts are looked up once each: their tails, as many as they have labels, are joined with the rules.
    Spark broadcasts these while they are small; beyond that adaptive execution splits the rows of a common tail.
    """
    name = F.regexp_replace(F.lower(F.col(host)), r"\.\z", "")
    labels = F.split("_name", r"\.")
    hosts = rows.select(name.alias("_name")).where("_name <> ''").distinct().withColumn("_labels", labels)
    n = F.size("_labels")
    tails = hosts.select(
        "_name", "_labels", F.explode(F.sequence(F.lit(1), n)).alias("_k")
    ).select("_name", "_labels", "_k", F.array_join(F.slice("_labels", n - F.col("_k") + 1, F.col("_k")), ".").alias("rule"))
    # How many labels the suffix has beyond those of the rule's text.
    more = F.when(F.col("kind") == "wildcard", 1).when(F.col("kind") == "exception", -1).otherwise(0)
    known = rules.groupBy("rule").agg(
        F.max(F.col("kind") == "exception").alias("_exception"), F.max(F.when(F.col("kind") != "exception", more)).alias("_more")
    )
    met = tails.join(known, "rule")
    longest = F.max(F.when(F.col("_more").isNotNull(), F.least(F.col("_k") + F.col("_more"), n)))
    found = met.groupBy("_name").agg(F.max(F.when(F.col("_exception"), F.col("_k") - 1)).alias("_except"), longest.alias("_long"))
    size = F.coalesce("_except", "_long", F.lit(1))
    tail = F.array_join(F.slice("_labels", n - F.col("_size") + 1, F.col("_size")), ".")
    own = F.array_join(F.slice("_labels", n - F.col("_size"), F.col("_size") + 1), ".")
    named = hosts.join(found, "_name", "left").withColumn("_size", size).select(
        "_name", tail.alias("suffix"), F.when(n > F.col("_size"), own).alias("domain")
    )
    return rows.withColumn("_name", name).join(named, "_name", "left").select(*rows.columns, "suffix", "domain")
