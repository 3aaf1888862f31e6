"""Replies to sent mails: what their class means for leads and enrolments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.functions import columns as C

# Reply class -> (lead stage, enrolment status, flag for a person, reschedule)
REPLY_EFFECTS = {
    "interested": ("qualified", "replied", False, False),
    "not_interested": ("lost", "completed", False, False),
    "question": ("replied", "replied", True, False),
    "out_of_office": (None, None, False, True),
    "unsubscribe": ("unsubscribed", "unsubscribed", False, False),
}


def reply_effects(replies: DataFrame, send_log: DataFrame) -> DataFrame:
    """Match ``(reply_id, ses_message_id, reply_class, received_at)`` to sends and look up effects.

    The latest send of a message id counts. Replies to unknown messages are left out. The log is
    cut down to the messages replied to before anything of it is grouped.
    """
    asked = replies.select("ses_message_id").filter("ses_message_id IS NOT NULL").distinct()
    sends = (
        send_log.join(asked, "ses_message_id", "left_semi")
        .groupBy("ses_message_id")
        .agg(
            F.max_by(F.struct("lead_id", "sequence_id"), F.struct("sent_at", "id")).alias("_send")
        )
    )
    cases = {i: name for i, name in enumerate(("stage", "enrollment_status", "needs_person", "reschedule"))}
    out = replies.join(sends, "ses_message_id").select(
        "reply_id", "ses_message_id", "reply_class", "received_at", "_send.lead_id", "_send.sequence_id"
    )
    for i, name in cases.items():
        kind = "string" if i < 2 else "boolean"
        effect = F.lit(None).cast(kind) if i < 2 else F.lit(False)
        for reply_class, effects in REPLY_EFFECTS.items():
            effect = F.when(
                F.col("reply_class") == reply_class, F.lit(effects[i]).cast(kind)
            ).otherwise(effect)
        out = out.withColumn(name, effect)
    return out


def lead_stages(effects: DataFrame) -> DataFrame:
    """Stage per lead after all its replies: an unsubscription stands, otherwise the last one."""
    decided = effects.filter("stage IS NOT NULL")
    order = F.struct((F.col("stage") == "unsubscribed").alias("final"), "received_at", "reply_id")
    return decided.groupBy(F.col("lead_id").alias("id")).agg(
        F.max_by("stage", order).alias("pipeline_stage")
    )


def apply_to_enrollments(
    enrollments: DataFrame, effects: DataFrame, as_of: datetime | str, wait_days: int = 7
) -> DataFrame:
    """Stop, end or postpone enrolments. An unsubscription ends all enrolments of the lead.

    Only the latest effect per enrolment counts. Postponed sends wait ``wait_days`` from the reply.
    """
    order = F.struct("received_at", "reply_id")
    decided = F.when(F.col("enrollment_status").isNotNull(), order)
    per_sequence = effects.groupBy("lead_id", "sequence_id").agg(
        F.max_by("enrollment_status", decided).alias("_status"),
        F.max(F.when(F.col("reschedule"), F.col("received_at"))).alias("_away_at"),
    )
    left = effects.groupBy("lead_id").agg(
        F.bool_or(F.col("stage") == "unsubscribed").alias("_left")
    )
    rows = enrollments.join(per_sequence, ["lead_id", "sequence_id"], "left").join(
        left, "lead_id", "left"
    )
    running = F.col("status").isin("active", "paused")
    new_status = F.when(F.col("_left"), F.lit("unsubscribed")).otherwise(F.col("_status"))
    postponed = F.col("_away_at") + F.make_dt_interval(F.lit(wait_days))
    status = F.when(running & new_status.isNotNull(), new_status).otherwise(F.col("status"))
    next_send = F.when(
        running & new_status.isNull() & F.col("_away_at").isNotNull(),
        F.greatest("next_send_at", postponed),
    ).otherwise(F.col("next_send_at"))
    values = {"status": status, "next_send_at": next_send}
    if "completed_at" in enrollments.columns:
        values["completed_at"] = F.when(
            running & new_status.isNotNull(), C.moment(as_of)
        ).otherwise(F.col("completed_at"))
    return rows.select(
        *[(values[c] if c in values else F.col(c)).alias(c) for c in enrollments.columns]
    )
