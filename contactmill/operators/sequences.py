"""Mailing sequences: enrolment, due steps, advancing and the send plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contactmill.functions import columns as C
from contactmill.functions import fixed_values as fv
from contactmill.operators import leads as L
from contactmill.operators import sendlog as S
from contactmill.operators.running import numbered, sum_ahead
from contactmill.operators.snapshots import patch


@dataclass(frozen=True)
class SendingRules:
    """Limits of a sender. ``warmup_start`` of None means no warm-up."""

    daily_limit: int = fv.BASE_DAILY_LIMIT
    min_delay_ms: int = fv.MIN_DELAY_MS
    max_delay_ms: int = fv.MAX_DELAY_MS
    window_start_hour: int = fv.WINDOW_START_HOUR
    window_end_hour: int = fv.WINDOW_END_HOUR
    timezone: str = fv.SENDING_TIMEZONE
    warmup_start: date | str | None = None
    warmup_schedule: Sequence[tuple[int, int]] = field(default=tuple(fv.WARMUP_SCHEDULE))


def _hours(hours: Column) -> Column:
    return F.make_dt_interval(F.lit(0), hours.cast("int"))


# -- look-ups ------------------------------------------------------------------------------
def sequence_by_name(sequences: DataFrame, name: str) -> DataFrame:
    return sequences.filter(F.col("name") == name)


def active_sequences(sequences: DataFrame) -> DataFrame:
    return sequences.filter(F.col("status") == "active")


def newest_sequences(sequences: DataFrame) -> DataFrame:
    return sequences.orderBy(F.desc("created_at"), F.col("id"))


def steps_of(steps: DataFrame, sequence_id: object) -> DataFrame:
    return L.by_id(steps, sequence_id, "sequence_id").orderBy("step_number")


def set_sequence_status(sequences: DataFrame, changes: DataFrame, as_of: datetime | str) -> DataFrame:
    stamped = changes.select("id", "status").withColumn("updated_at", C.moment(as_of))
    columns = [c for c in ("status", "updated_at") if c in sequences.columns]
    return patch(sequences, stamped, "id", columns)


def enrollment_of(enrollments: DataFrame, lead_id: object, sequence_id: object) -> DataFrame:
    return L.by_id(L.by_id(enrollments, lead_id, "lead_id"), sequence_id, "sequence_id")


def active_enrollments_of(enrollments: DataFrame, lead_id: object) -> DataFrame:
    return L.by_id(enrollments, lead_id, "lead_id").filter(F.col("status") == "active")


def enrollment_counts(enrollments: DataFrame) -> DataFrame:
    return L.counts_by(enrollments, "status", fv.ENROLMENT_STATUSES)


# -- enrolment -------------------------------------------------------------------------------
def eligible_for_enrollment(
    leads: DataFrame, lead_emails: DataFrame, enrollments: DataFrame, sequence_id: object,
    limit: int | None = None,
) -> DataFrame:
    """Leads with a deliverable e-mail and a good score that are not in the sequence yet.

    The filters on leads reach the scan and the e-mails are reduced to one per lead first.
    """
    fit = leads.filter(
        (F.col("score") >= fv.ENROL_MIN_SCORE) & F.col("pipeline_stage").isin("new", "scored")
    )
    mail = L.best_email(lead_emails).select(
        F.col("lead_id").alias("id"), F.col("id").alias("email_id"), "email"
    )
    already = (
        enrollments.filter(F.col("sequence_id") == F.lit(sequence_id))
        .select(F.col("lead_id").alias("id"))
        .distinct()
    )
    rows = fit.join(already, "id", "left_anti").join(mail, "id")
    return C.top(rows, [F.desc("score"), F.col("id")], limit)


def enroll(
    eligible: DataFrame, sequences: DataFrame, steps: DataFrame, sequence_id: object,
    as_of: datetime | str,
) -> DataFrame:
    """Enrolment rows to append. Nothing is enrolled in a sequence that is not active."""
    active = active_sequences(sequences).filter(F.col("id") == F.lit(sequence_id))
    first = steps.filter((F.col("sequence_id") == F.lit(sequence_id)) & (F.col("step_number") == 1))
    found = active.select(F.max("id").alias("found")).scalar()
    delay = F.coalesce(first.select(F.max("delay_hours")).scalar(), F.lit(0))
    now = C.moment(as_of)
    return eligible.filter(found.isNotNull()).select(
        F.xxhash64("id", F.lit(sequence_id)).alias("id"),
        F.col("id").alias("lead_id"),
        F.lit(sequence_id).alias("sequence_id"),
        "email_id",
        F.lit(0).alias("current_step"),
        F.lit("active").alias("status"),
        (now + _hours(delay)).alias("next_send_at"),
        now.alias("enrolled_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )


def stage_changes(enrolled: DataFrame) -> DataFrame:
    """Stage rows for newly enrolled leads, for ``snapshots.set_stage``."""
    return enrolled.select(
        F.col("lead_id").alias("id"), F.lit("contacted").alias("pipeline_stage")
    ).distinct()


def due_enrollments(
    enrollments: DataFrame, leads: DataFrame, lead_emails: DataFrame, sequences: DataFrame,
    as_of: datetime | str, limit: int | None = None,
) -> DataFrame:
    """Active enrolments of active sequences whose next send is due, oldest first.

    An enrolment whose lead or e-mail is missing takes nobody's place: the joins come before ``limit``.
    """
    order = [F.asc("next_send_at"), F.col("id")]
    due = enrollments.filter(
        (F.col("status") == "active") & (F.col("next_send_at") <= C.moment(as_of))
    )
    lead_parts = ["business_name", "website", "city", "state_province"]
    due = due.join(
        active_sequences(sequences).select(
            F.col("id").alias("sequence_id"), F.col("name").alias("sequence_name"), "total_steps"
        ),
        "sequence_id",
    )
    rows = (
        due.join(leads.select(F.col("id").alias("lead_id"), *lead_parts), "lead_id")
        .join(
            lead_emails.select(F.col("id").alias("email_id"), F.col("email").alias("email_address")),
            "email_id",
        )
    )
    return C.top(rows, order, limit)


def nest_due(due: DataFrame) -> DataFrame:
    """The due list with lead, e-mail and sequence as structs."""
    return due.select(
        "id", "lead_id", "sequence_id", "email_id", "current_step", "status", "next_send_at",
        F.struct(
            F.col("lead_id").alias("id"), "business_name", "website", "city", "state_province"
        ).alias("lead"),
        F.struct(F.col("email_address").alias("email")).alias("email"),
        F.struct(F.col("sequence_name").alias("name"), "total_steps").alias("sequence"),
    )


# -- progress ----------------------------------------------------------------------------------
def advance(
    enrollments: DataFrame, sent: DataFrame, sequences: DataFrame, steps: DataFrame,
    as_of: datetime | str,
) -> DataFrame:
    """The next snapshot after ``(id, step_number)`` was sent: one step on, or completed.

    ``current_step`` is the last step sent. The next one is due after its delay, 24 hours when it
    has no row; after the last step the enrolment is complete.
    """
    now = C.moment(as_of)
    totals = sequences.select(F.col("id").alias("sequence_id"), F.col("total_steps").alias("_total"))
    following = steps.select(
        "sequence_id",
        (F.col("step_number") - 1).alias("_sent"),
        F.col("delay_hours").alias("_delay"),
    )
    marks = sent.select("id", F.col("step_number").alias("_sent"))
    rows = (
        enrollments.join(marks, "id", "left")
        .join(totals, "sequence_id", "left")
        .join(following, ["sequence_id", "_sent"], "left")
    )
    was_sent = F.col("_sent").isNotNull()
    last = was_sent & (F.col("_sent") + 1 > F.col("_total"))
    later = now + _hours(F.coalesce("_delay", F.lit(fv.DEFAULT_STEP_DELAY_HOURS)))
    values = {
        "current_step": F.coalesce("_sent", "current_step"),
        "status": F.when(last, "completed").otherwise(F.col("status")),
        "next_send_at": F.when(last, F.lit(None)).when(was_sent, later).otherwise(F.col("next_send_at")),
        "completed_at": F.when(last, now).otherwise(F.col("completed_at"))
        if "completed_at" in enrollments.columns
        else None,
    }
    return rows.select(
        *[(values[c] if c in values else F.col(c)).alias(c) for c in enrollments.columns]
    )


def set_enrollment_status(
    enrollments: DataFrame, changes: DataFrame, as_of: datetime | str, key: str = "id"
) -> DataFrame:
    """Set the status from ``(key, status)`` rows; terminal ones are stamped as completed."""
    terminal = F.col("status").isin(fv.TERMINAL_ENROLMENT_STATUSES)
    stamped = changes.select(key, "status").withColumn(
        "completed_at", F.when(terminal, C.moment(as_of))
    )
    columns = [c for c in ("status", "completed_at") if c in enrollments.columns]
    return patch(enrollments, stamped, key, columns)


# -- limits ------------------------------------------------------------------------------------
def daily_limit(at: Column, rules: SendingRules) -> Column:
    """The limit in force at a moment: a look-up of its day in the warm-up schedule.

    No warm-up gives the base limit, a moment ahead of it 0, and one after its last entry the base
    limit again. A schedule has a few entries, so it is compiled into the expression.
    """
    base = F.lit(rules.daily_limit)
    if rules.warmup_start is None:
        return base
    schedule = sorted(rules.warmup_schedule)
    start = F.lit(str(rules.warmup_start)).cast("timestamp")
    seconds = F.unix_micros(at.cast("timestamp")) - F.unix_micros(start)
    day = F.floor(seconds / 86_400_000_000) + 1
    if not schedule:
        return F.when(day < 1, 0).otherwise(base)
    out = F.when(day < 1, 0).when(day > schedule[-1][0], base)
    for entry_day, limit in reversed(schedule):
        out = out.when(day >= entry_day, limit)
    return out.otherwise(schedule[0][1])


def in_sending_window(at: Column, rules: SendingRules) -> Column:
    hour = F.hour(F.from_utc_timestamp(at, rules.timezone))
    return (hour >= rules.window_start_hour) & (hour < rules.window_end_hour)


def send_delay_ms(rules: SendingRules, *key: Column) -> Column:
    """A delay between the bounds that leans to their middle; the same key gives the same delay."""

    def uniform(seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_000)) / 1_000_000

    middle = (uniform(1) + uniform(2)) / 2
    return F.floor(rules.min_delay_ms + middle * (rules.max_delay_ms - rules.min_delay_ms))


def budget(send_log: DataFrame, as_of: datetime | str, rules: SendingRules) -> DataFrame:
    """One row: limit, sent today, remaining, pause with reason, inside the window."""
    now = C.moment(as_of)
    sent = S.sent_today(send_log, as_of).select("sent_today")
    row = C.beside(sent, S.breaker(send_log, as_of).select("pause", "reason"))
    limit = daily_limit(now, rules).cast("int")
    return row.select(
        limit.alias("daily_limit"),
        "sent_today",
        F.greatest(F.lit(0), limit - F.col("sent_today")).alias("remaining"),
        "pause",
        "reason",
        in_sending_window(now, rules).alias("in_window"),
    )


#: Rows of a plan that one task orders and sums. Longer plans, and plans without a limit, are numbered by ranges.
ONE_TASK = 100_000


def _in_one_task(limit: int | None) -> bool:
    return limit is not None and limit <= ONE_TASK


def _ranked(rows: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """The first rows of a plan with their ``rank`` from 1; the same ranks whatever the way."""
    if _in_one_task(limit):
        first = C.top(rows, order, limit)
        return first.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))
    ranked = numbered(rows, order)
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def _gate() -> Column:
    """Why nothing may be sent at all; null when sending is open."""
    return (
        F.when(~F.col("in_window"), "outside sending window")
        .when(F.col("pause"), F.concat(F.lit("paused: "), F.col("reason")))
        .when(F.col("remaining") == 0, "daily limit reached")
    )


def _paced(plan: DataFrame, rules: SendingRules, as_of: datetime | str, limit: int | None) -> DataFrame:
    """Planned time of each send: the delays of all planned sends ahead of it add up."""
    goes_out = F.col("outcome") == "send"
    delay = F.when(goes_out, send_delay_ms(rules, F.col("id"), F.col("rank"))).otherwise(0)
    plan = plan.withColumn("delay_ms", delay)
    if _in_one_task(limit):
        ahead = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
        plan = plan.withColumn("_wait", F.coalesce(F.sum("delay_ms").over(ahead), F.lit(0)))
    else:
        plan = sum_ahead(plan, F.col("delay_ms"), "_wait")
    planned = F.timestamp_micros(F.unix_micros(C.moment(as_of)) + F.col("_wait") * 1000)
    return plan.withColumn("planned_at", F.when(goes_out, planned)).drop("_wait")


def send_plan(
    enrollments: DataFrame, leads: DataFrame, lead_emails: DataFrame, sequences: DataFrame,
    steps: DataFrame, send_log: DataFrame, as_of: datetime | str,
    rules: SendingRules = SendingRules(), *, limit: int | None,
) -> DataFrame:
    """What a queue run would do with the due enrolments, and when.

    ``outcome`` is ``send``, ``complete`` (no further step exists) or ``hold`` with a ``reason``.
    The due list is cut to ``limit`` by a distributed top-k before it is numbered. Without a limit the whole
    list is planned: it is numbered by ranges of its order, and delays are summed in blocks.
    """
    due = due_enrollments(enrollments, leads, lead_emails, sequences, as_of)
    ranked = _ranked(due, [F.asc("next_send_at"), F.col("id")], limit)
    next_steps = steps.select(
        "sequence_id",
        (F.col("step_number") - 1).alias("current_step"),
        "step_number",
        *[c for c in ("subject_template", "body_template") if c in steps.columns],
    )
    rows = C.beside(
        ranked.join(next_steps, ["sequence_id", "current_step"], "left"),
        budget(send_log, as_of, rules),
    ).withColumn("gate", _gate())
    inside = F.col("rank") <= F.col("remaining")
    outcome = (
        F.when(F.col("gate").isNotNull() | ~inside, "hold")
        .when(F.col("step_number").isNull(), "complete")
        .otherwise("send")
    )
    hold_reason = F.coalesce("gate", F.when(~inside, F.lit("beyond daily budget")))
    plan = rows.withColumn("outcome", outcome).withColumn("hold_reason", hold_reason)
    return _paced(plan, rules, as_of, limit).drop(
        "daily_limit", "sent_today", "remaining", "pause", "reason", "in_window", "gate"
    )


def outreach_plan(
    leads: DataFrame, lead_emails: DataFrame, send_log: DataFrame, enrollments: DataFrame,
    as_of: datetime | str, rules: SendingRules = SendingRules(), *, limit: int | None,
) -> DataFrame:
    """The plan of single outreach mails within the remaining daily budget, of any length as in :func:`send_plan`."""
    rows = S.outreach_eligible(leads, lead_emails, send_log, enrollments)
    ranked = _ranked(rows, [F.desc("score"), F.col("id")], limit)
    gated = C.beside(ranked, budget(send_log, as_of, rules)).withColumn("gate", _gate())
    inside = F.col("rank") <= F.col("remaining")
    plan = gated.withColumn(
        "outcome", F.when(F.col("gate").isNull() & inside, "send").otherwise("hold")
    ).withColumn("hold_reason", F.coalesce("gate", F.when(~inside, F.lit("beyond daily budget"))))
    return _paced(plan, rules, as_of, limit).drop(
        "daily_limit", "sent_today", "remaining", "pause", "reason", "in_window", "gate"
    )


# -- after sending -------------------------------------------------------------------------------
def book_results(
    plan: DataFrame, outcomes: DataFrame, enrollments: DataFrame, sequences: DataFrame,
    steps: DataFrame, as_of: datetime | str,
) -> tuple[DataFrame, DataFrame]:
    """Log rows to append and the next enrolment snapshot.

    ``outcomes`` has ``(id, success, message_id, error)`` per planned send. A success is logged as
    sent and advances the enrolment; a failure is logged as bounced, and ends the enrolment when
    its text speaks of a bounce or an invalid address. Planned completions are carried out. The
    plan is used several times: pass the stored one that was sent, see ``session.stored``.
    """
    now = C.moment(as_of)
    done = plan.filter(F.col("outcome") == "send").join(outcomes, "id")
    log = done.select(
        F.xxhash64("id", "step_number").alias("id"),
        "lead_id", "email_id", "sequence_id", "step_number",
        F.when(F.col("success"), F.col("message_id")).alias("ses_message_id"),
        F.when(F.col("success"), "sent").otherwise("bounced").alias("status"),
        now.alias("sent_at"),
    )
    moved = advance(
        enrollments, done.filter("success").select("id", "step_number"), sequences, steps, as_of
    )
    hard = F.col("error").contains("bounce") | F.col("error").contains("invalid")
    ended = (
        done.filter(~F.col("success") & hard)
        .select("id", F.lit("bounced").alias("status"))
        .unionByName(
            plan.filter(F.col("outcome") == "complete").select("id", F.lit("completed").alias("status"))
        )
    )
    return log, set_enrollment_status(moved, ended, as_of)


def engine_status(
    send_log: DataFrame, enrollments: DataFrame, as_of: datetime | str,
    rules: SendingRules = SendingRules(),
) -> DataFrame:
    """One row: budget, enrolments per status and the sends of the last seven days."""
    enrolled = L.status_counts_wide(enrollments, "status", fv.ENROLMENT_STATUSES)
    enrolled = enrolled.select(*[F.col(c).alias("enrolled_" + c) for c in enrolled.columns])
    sends = S.send_stats(send_log, as_of).drop("total")
    sends = sends.select(*[F.col(c).alias("week_" + c) for c in sends.columns])
    return C.beside(budget(send_log, as_of, rules), enrolled, sends)


def outreach_status(
    leads: DataFrame, lead_emails: DataFrame, send_log: DataFrame, enrollments: DataFrame,
    as_of: datetime | str, rules: SendingRules = SendingRules(),
) -> DataFrame:
    row = S.outreach_eligible_count(leads, lead_emails, send_log, enrollments)
    total = S.outreach_stats(send_log, as_of).select(F.col("total").alias("outreach_total"))
    money = budget(send_log, as_of, rules).select(
        "daily_limit", "sent_today", "remaining", "in_window"
    )
    return C.beside(row, total, money).withColumn(
        "can_send", F.col("in_window") & (F.col("eligible") > 0)
    )
