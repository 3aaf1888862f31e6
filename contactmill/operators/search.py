"""Leads by a part of their name, city or website, from an index of trigrams.

Two tables kept by hash bucket lie below a path: ``leads`` by id, and ``grams`` with one row ``(gram, id)`` for each
three adjacent characters that occur in a searched column. A search reads the rows of the rarest grams of its term,
then the leads of the ids that hold them all, and checks these exactly. What the index finds is a superset, so a
row of ``grams`` that is no longer due does no harm.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill.session import stored
from contactmill.sources.buckets import BucketedTable

SEARCHED = ("business_name", "city", "website")
GRAM = 3
#: How many of a term's grams are met with each other; the exact check does the rest.
RAREST = 3

# Matches of no length, so that grams overlap; a dot is a whole character.
_OVERLAPPING = f"(?s)(?=(.{{{GRAM}}}))"


def matches(term: str) -> Column:
    """The term in a searched column, in any case. It has no wildcards, and the empty term is everywhere."""
    low = term.lower()
    if not low:
        return F.lit(True)
    return reduce(or_, [F.coalesce(F.lower(c).contains(low), F.lit(False)) for c in SEARCHED])


def grams_of(leads: DataFrame) -> DataFrame:
    """``(gram, id)``, each once per lead. Columns that are null or shorter than a gram give none."""
    found = [F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(_OVERLAPPING), F.lit(1)) for c in SEARCHED]
    return leads.select(F.explode(F.array_distinct(F.concat(*found))).alias("gram"), "id")


class LeadIndex:
    """A searchable copy of the leads below a path, made by :meth:`create`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.leads = BucketedTable(spark, f"{path}/leads")
        self.grams = BucketedTable(spark, f"{path}/grams")

    @classmethod
    def create(cls, leads: DataFrame, path: str, buckets: int) -> LeadIndex:
        """Write the leads, which have unique ids, and their grams. Buckets of frequent grams become several files."""
        BucketedTable.create(leads, f"{path}/leads", ["id"], buckets)
        BucketedTable.create(grams_of(leads), f"{path}/grams", ["gram"], buckets)
        return cls(leads.sparkSession, path)

    def _rows(self, grams: list[str]) -> DataFrame:
        wanted = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        return self.grams.read(self.grams.touched(wanted)).where(F.col("gram").isin(grams))

    def candidates(self, term: str) -> DataFrame | None:
        """Ids with the rarest grams of the term, each once; None where the term is shorter than a gram."""
        low = term.lower()
        grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not grams:
            return None
        counted = {r["gram"]: r["n"] for r in self._rows(grams).groupBy("gram").agg(F.count("*").alias("n")).collect()}
        rarest = sorted(grams, key=lambda g: (counted.get(g, 0), g))[:RAREST]
        first, *others = [self._rows([g]).select("id").distinct() for g in rarest]
        return reduce(lambda a, b: a.join(b, "id", "left_semi"), others, first)

    def search(self, term: str) -> DataFrame:
        """The leads that :func:`contactmill.operators.leads.search` gives.

        Terms of one or two characters read all leads, as no gram tells where they are.
        """
        ids = self.candidates(term)
        rows = self.leads.read() if ids is None else self.leads.lookup(ids)
        return rows.where(matches(term))

    def put(self, leads: DataFrame) -> None:
        """Add leads, or replace those with the same id; given twice, a lead's rows must not differ.

        New grams are added first and old ones removed last, so a search is right at any moment, also when a
        writer is lost; putting the same leads again then finishes the work.
        """
        leads = stored(leads.dropDuplicates(["id"]))
        fresh = grams_of(leads)
        stale = stored(grams_of(self.leads.lookup(leads)).join(fresh, ["gram", "id"], "left_anti"))
        self.grams.merge(fresh, lambda rows, new: rows.unionByName(new).distinct())
        self.leads.merge(leads, lambda rows, new: rows.join(new, "id", "left_anti").unionByName(new.select(*rows.columns)))
        self.grams.merge(stale, lambda rows, gone: rows.join(gone, ["gram", "id"], "left_anti"))

    def remove(self, ids: DataFrame) -> None:
        """Take out the leads with the ids of ``ids``."""
        gone = stored(grams_of(self.leads.lookup(ids)))
        self.leads.delete(ids)
        self.grams.merge(gone, lambda rows, old: rows.join(old, ["gram", "id"], "left_anti"))
