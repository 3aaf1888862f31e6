"""Rule-based scoring: JSON rules become one Column expression over the leads."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.functions import columns as C
from contactmill.functions import fixed_values as fv

ENRICHMENT = "enrichment."


def score_context(leads: DataFrame, lead_emails: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Leads with everything a rule can ask for, one row per lead.

    Enrichment columns are prefixed ``en_``; unused ones are pruned down to the scans. E-mails
    are reduced to one flag per lead before the join.
    """
    flags = lead_emails.groupBy(F.col("lead_id").alias("id")).agg(
        F.bool_or(F.col("verification_status") == "valid").alias("_valid")
    )
    features = enrichment.select(
        F.col("lead_id").alias("id"),
        *[F.col(c).alias("en_" + c) for c in enrichment.columns if c not in ("id", "lead_id")],
    )
    links = [f"en_{c}" for c in ("linkedin_url", "facebook_url") if c in enrichment.columns]
    social = reduce(
        lambda a, b: a | b, [F.coalesce(F.length(c) > 0, F.lit(False)) for c in links], F.lit(False)
    )
    return (
        leads.join(flags, "id", "left")
        .join(features, "id", "left")
        .withColumn("has_verified_email", F.coalesce("_valid", F.lit(False)))
        .withColumn("has_social_presence", social)
        .drop("_valid")
    )


def field_column(context: DataFrame, field: str) -> tuple[Column, T.DataType]:
    """The column a rule names and its type; an unknown field is null."""
    name = "en_" + field[len(ENRICHMENT) :] if field.startswith(ENRICHMENT) else field
    if name in context.columns:
        return F.col(name), context.schema[name].dataType
    return F.lit(None).cast("string"), T.NullType()


def condition_column(context: DataFrame, condition: Mapping) -> Column:
    """A rule condition as a boolean Column that is never null.

    Comparisons are strict on types: a number never equals a string, and the ordering operators
    hold for numbers only. Flags stored as 0/1 are read as booleans.
    """
    value, kind = field_column(context, condition["field"])
    wanted = condition.get("value")
    operator = condition["operator"]
    numeric = isinstance(kind, T.NumericType)

    def equals() -> Column:
        if wanted is None:
            return value.isNull()
        if isinstance(wanted, bool):
            if isinstance(kind, T.BooleanType) or numeric:
                return value.cast("boolean").eqNullSafe(F.lit(wanted))
            return F.lit(False)
        if isinstance(wanted, (int, float)):
            return value.eqNullSafe(F.lit(wanted)) if numeric else F.lit(False)
        return value.eqNullSafe(F.lit(wanted)) if isinstance(kind, T.StringType) else F.lit(False)

    def ordered(compare) -> Column:
        # A bound that is no number is met by nothing.
        if not numeric or isinstance(wanted, bool) or not isinstance(wanted, (int, float)):
            return F.lit(False)
        return F.coalesce(compare(value, F.lit(float(wanted))), F.lit(False))

    if operator == "equals":
        return equals()
    if operator == "not_equals":
        return ~equals()
    if operator in ("gt", "gte", "lt", "lte"):
        compare = {
            "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
            "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
        }[operator]
        return ordered(compare)
    if operator == "is_null":
        return value.isNull()
    if operator == "not_null":
        return value.isNotNull()
    if operator == "contains" and isinstance(kind, T.StringType):
        return F.coalesce(F.lower(value).contains(str(wanted).lower()), F.lit(False))
    return F.lit(False)


def tier_column(score: Column, labels: bool = False) -> Column:
    pick = 2 if labels else 0
    out = None
    for tier in fv.TIERS:
        out = (F if out is None else out).when(score >= tier[1], tier[pick])
    return out.otherwise(fv.LOWEST_TIER[1 if labels else 0])


def with_scores(context: DataFrame, config: Mapping) -> DataFrame:
    """Add ``total_score``, ``tier``, ``tier_label`` and ``applied_rules`` in rule order."""
    rules = config["rules"]
    hits = context.select(
        "*",
        *[condition_column(context, r["condition"]).alias(f"_rule{i}") for i, r in enumerate(rules)],
    )

    def if_hit(i: int, value: Column) -> Column:
        return F.when(F.col(f"_rule{i}"), value)

    raw = reduce(
        add,
        [F.coalesce(if_hit(i, F.lit(r["points"])), F.lit(0)) for i, r in enumerate(rules)],
        F.lit(0),
    )
    applied = F.array_compact(
        F.array(
            *[
                if_hit(
                    i,
                    F.struct(
                        F.lit(r["id"]).alias("rule_id"),
                        F.lit(r["name"]).alias("rule_name"),
                        F.lit(r["points"]).alias("points"),
                    ),
                )
                for i, r in enumerate(rules)
            ]
        )
    )
    total = F.greatest(F.lit(0), F.least(F.lit(config["maxScore"]), raw))
    return (
        hits.withColumn("total_score", total)
        .withColumn("tier", tier_column(F.col("total_score")))
        .withColumn("tier_label", tier_column(F.col("total_score"), labels=True))
        .withColumn("applied_rules", applied)
        .drop(*[f"_rule{i}" for i in range(len(rules))])
    )


def score_leads(
    leads: DataFrame, lead_emails: DataFrame, enrichment: DataFrame, config: Mapping
) -> DataFrame:
    scored = with_scores(score_context(leads, lead_emails, enrichment), config)
    return scored.select("id", "business_name", "total_score", "tier", "tier_label", "applied_rules")


def explanation(scored: DataFrame) -> DataFrame:
    """Add a readable account of the score."""
    line = F.transform(
        "applied_rules",
        lambda r: F.concat(
            F.lit("  - "), r["rule_name"], F.lit(": "),
            F.when(r["points"] >= 0, "+").otherwise(""), r["points"].cast("string"),
            F.lit(" points\n"),
        ),
    )
    lines = F.when(
        F.size("applied_rules") > 0, F.array_join(line, "")
    ).otherwise(F.lit("  - No scoring rules matched\n"))
    head = F.concat(
        F.lit('Score for "'), F.col("business_name"), F.lit('": '),
        F.col("total_score").cast("string"), F.lit("/100 ("), F.col("tier_label"),
        F.lit(")\n\nApplied Rules:\n"),
    )
    return scored.withColumn("explanation", F.concat(head, lines))


def score_summary(scored: DataFrame) -> DataFrame:
    """Leads scored, average score and leads per tier."""
    tiers = [t[0] for t in fv.TIERS] + [fv.LOWEST_TIER[0]]
    return scored.agg(
        F.count("*").alias("scored"),
        F.coalesce(C.half_up(F.avg("total_score"), 1), F.lit(0.0)).alias("avg_score"),
        *[C.count_where(F.col("tier") == t).alias(t) for t in tiers],
    )


def rescored_leads(
    leads: DataFrame, lead_emails: DataFrame, enrichment: DataFrame, config: Mapping
) -> DataFrame:
    """Score and save in one go: the next lead snapshot, without joining the scores back."""
    scored = with_scores(score_context(leads, lead_emails, enrichment), config)
    kind = leads.schema["score"].dataType
    return (
        scored.withColumn("score", F.col("total_score").cast(kind))
        .withColumn("pipeline_stage", _stage_after_scoring())
        .select(*leads.columns)
    )


def _stage_after_scoring() -> Column:
    return F.when(F.col("pipeline_stage") == "new", "scored").otherwise(F.col("pipeline_stage"))


def save_scores(leads: DataFrame, scored: DataFrame) -> DataFrame:
    """The next lead snapshot: scores written, and the stage moved on from ``new`` only.

    For scores of some of the leads; :func:`rescored_leads` does all of them with less work.
    """
    new = scored.select("id", F.col("total_score").alias("_total"))
    stage = F.when(F.col("_total").isNotNull(), _stage_after_scoring()).otherwise(
        F.col("pipeline_stage")
    )
    return (
        leads.join(new, "id", "left")
        .withColumn("pipeline_stage", stage)
        .withColumn("score", F.coalesce("_total", "score").cast(leads.schema["score"].dataType))
        .select(*leads.columns)
    )
