"""Mail templates: variables, conditional blocks, opening lines and checks, all as Columns.

The template is a column like any other, so one plan renders any number of templates and no
template table is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactmill.functions import fixed_values as fv
from contactmill.functions.columns import let, squeeze_ends
from contactmill.operators.sendlog import plain_number

_VARIABLE = r"\{\{(\w+)\}\}"


def _block(word: str) -> str:
    return rf"\{{\{{#{word}\s+(\w+)\}}\}}([\s\S]*?)\{{\{{/{word}\}}\}}"


def _rewrite(text: Column, pattern: str, replacement, trace: str = "{{") -> Column:
    """Replace every match by ``replacement(match)`` in a single pass over texts that hold the trace of one."""

    def rewritten(t: Column) -> Column:
        pieces = F.zip_with(
            F.split(t, pattern),
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
            lambda plain, match: F.concat(
                plain, F.when(match.isNull(), F.lit("")).otherwise(replacement(match))
            ),
        )
        return F.when(t.contains(trace), F.array_join(pieces, "")).otherwise(t)

    return let(text, rewritten)


def render(template: Column, variables: Column) -> Column:
    """Fill a template from a ``map<string,string>``.

    Variables come first and unknown ones stay as they are; then ``#if`` blocks are kept or
    dropped, then ``#unless`` blocks; the result is trimmed. Blocks do not nest.
    """

    def value(match: Column, pattern: str) -> Column:
        return F.try_element_at(variables, F.regexp_extract(match, pattern, 1))

    def conditional(text: Column, word: str, keep_if_set: bool) -> Column:
        pattern = _block(word)

        def kept(match: Column) -> Column:
            is_set = F.coalesce(F.length(value(match, pattern)) > 0, F.lit(False))
            keep = is_set if keep_if_set else ~is_set
            return F.when(keep, F.regexp_extract(match, pattern, 2)).otherwise("")

        return _rewrite(text, pattern, kept, "{{#" + word)

    filled = _rewrite(template, _VARIABLE, lambda m: F.coalesce(value(m, _VARIABLE), m))
    return squeeze_ends(conditional(conditional(filled, "if", True), "unless", False))


_TOKEN = r"\{\{(?:#(?:if|unless)\s+\w+|/(?:if|unless)|\w+)\}\}"
SEGMENTS = "array<struct<text: string, name: string, guard: string, negated: boolean>>"


def compiled(template: Column) -> Column:
    """A template as segments, to be worked out once per template instead of once per rendered row.

    A segment is a piece of text or, with a ``name``, a variable whose text is what stays where it is unknown. One
    inside a block has the block's variable as its ``guard``. Null where only the rendered text tells what the
    braces mean: braces that belong to no variable or block, blocks that are not closed or lie within others.
    Such templates are rendered by :func:`render`.
    """

    def segment(text, name=None, guard=None, negated=None) -> Column:
        none = F.lit(None)
        parts = {"text": text, "name": none if name is None else name, "guard": none if guard is None else guard,
                 "negated": none if negated is None else negated}
        kinds = {"text": "string", "name": "string", "guard": "string", "negated": "boolean"}
        return F.struct(*[v.cast(kinds[k]).alias(k) for k, v in parts.items()])

    def step(state: Column, piece: Column) -> Column:
        """Take one pair of a text and the token after it. ``kind`` is the word of the open block."""
        token, kind, guard = piece["token"], state["kind"], state["guard"]
        word = F.regexp_extract(token, r"^\{\{[#/](if|unless)", 1)
        opens, closes = token.startswith("{{#"), token.startswith("{{/")
        negated = F.when(kind.isNotNull(), kind == "unless")
        plain = segment(piece["text"], None, guard, negated)
        name = F.regexp_extract(token, r"^\{\{(\w+)\}\}$", 1)
        variable = segment(token, name, guard, negated)
        more = F.when(token.isNull() | opens | closes, F.array(plain)).otherwise(F.array(plain, variable))
        sound = (
            state["sound"] & ~piece["text"].rlike(r"[{}]")
            & F.coalesce(F.when(opens, kind.isNull()).when(closes, kind == word).otherwise(True), F.lit(False))
        )
        return F.struct(
            F.concat(state["out"], more).alias("out"),
            F.when(opens, word).when(~closes | token.isNull(), kind).alias("kind"),
            F.when(opens, F.regexp_extract(token, r"\s(\w+)\}\}$", 1)).when(~closes | token.isNull(), guard).alias("guard"),
            sound.alias("sound"),
        )

    pieces = F.zip_with(
        F.split(template, _TOKEN, -1), F.regexp_extract_all(template, F.lit(_TOKEN), F.lit(0)),
        lambda text, token: F.struct(text.alias("text"), token.alias("token")),
    )
    start = F.struct(
        F.array().cast(SEGMENTS).alias("out"), F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("string").alias("guard"), F.lit(True).alias("sound"),
    )

    def useful(found: Column) -> Column:
        return F.filter(found, lambda s: s["name"].isNotNull() | (F.length(s["text"]) > 0))

    end = let(F.aggregate(pieces, start, step), lambda s: F.when(s["sound"] & s["kind"].isNull(), useful(s["out"])))
    return F.when(template.isNotNull(), end)


def has_braces(variables: Column) -> Column:
    """Whether a value holds a brace, which may make up new variables or blocks."""
    return F.exists(F.map_values(variables), lambda v: v.contains("{") | v.contains("}"))


def render_compiled(segments: Column, template: Column, variables: Column, braces: Column | None = None) -> Column:
    """Fill a template from its segments in one pass.

    Rows with a brace in a value (``braces``, if that is known already), and templates without segments, are
    rendered from the template itself.
    """

    def shown(s: Column) -> Column:
        text = F.when(s["name"].isNull(), s["text"]).otherwise(F.coalesce(F.try_element_at(variables, s["name"]), s["text"]))
        given = F.coalesce(F.length(F.try_element_at(variables, s["guard"])) > 0, F.lit(False))
        return F.when(s["guard"].isNull() | (given != s["negated"]), text).otherwise("")

    direct = segments.isNotNull() & ~(has_braces(variables) if braces is None else braces)
    return F.when(direct, squeeze_ends(F.array_join(F.transform(segments, shown), ""))).otherwise(render(template, variables))


def compile_steps(steps: DataFrame) -> DataFrame:
    """Add ``subject_segments`` and ``body_segments`` to a table of sequence steps."""
    return steps.withColumns({f"{part}_segments": compiled(F.col(f"{part}_template")) for part in ("subject", "body")})


def _specialty_list(df: DataFrame, column: str = "specialties") -> Column:
    """Specialties as an array, whether stored as an array or as JSON text; null if absent."""
    if column not in df.columns:
        return F.lit(None).cast("array<string>")
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.from_json(column, "array<string>")
    return F.col(column)


def first_name(business_type: Column, business_name: Column) -> Column:
    """The leading first name of a solo tutor's business name, or null."""
    found = F.regexp_extract(business_name, fv.FIRST_NAME_PATTERN, 1)
    return F.when(business_type == "solo_tutor", F.nullif(found, F.lit("")))


def with_variables(leads: DataFrame, opening: Column | None = None) -> DataFrame:
    """Add the ``variables`` map of a lead row that carries its enrichment columns.

    Empty values count as absent. ``opening`` adds ``personalized_opening`` where it is not null.
    """
    blank = F.lit("")
    top_three = F.array_join(F.slice(_specialty_list(leads), 1, 3), ", ")
    values = {
        "business_name": F.col("business_name"),
        "first_name": first_name(F.col("business_type"), F.col("business_name")),
        "city": F.nullif("city", blank),
        "state": F.nullif("state_province", blank),
        "website": F.nullif("website", blank),
        "specialties": F.nullif(top_three, blank),
    }
    if opening is not None:
        values["personalized_opening"] = opening
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    given = F.filter(pairs, lambda p: p["value"].isNotNull())
    return leads.withColumn("variables", F.map_from_entries(given))


def openings(df: DataFrame) -> Column:
    """All opening lines that fit a lead, at least one."""

    def filled(text: str, **parts: Column) -> Column:
        out = F.lit(text)
        for name, part in parts.items():
            out = F.replace(out, F.lit("{" + name + "}"), part)
        return out

    def known(column: str) -> Column:
        return F.coalesce(F.length(column) > 0, F.lit(False))

    words = _specialty_list(df)
    rating, reviews = F.col("google_rating"), F.col("google_review_count")
    staff = F.col("has_multiple_tutors") if "has_multiple_tutors" in df.columns else F.lit(False)
    fitting = F.array_compact(
        F.array(
            F.when(known("city") & known("state_province"), filled(fv.OPENING_PLACE, city=F.col("city"))),
            F.when(F.size(words) > 0, filled(fv.OPENING_SPECIALTY, specialty=F.get(words, F.lit(0)))),
            F.when(
                (rating >= fv.OPENING_MIN_RATING) & (reviews >= fv.OPENING_MIN_REVIEWS),
                filled(
                    fv.OPENING_REVIEWS,
                    rating=plain_number(rating),
                    reviews=reviews.cast("string"),
                ),
            ),
            F.when(staff.cast("boolean"), F.lit(fv.OPENING_STAFF)),
        )
    )
    fallback = F.array(filled(fv.OPENING_OTHER, name=F.coalesce("business_name", F.lit(""))))
    return F.when(F.size(fitting) > 0, fitting).otherwise(fallback)


def chosen_opening(df: DataFrame, *key: Column) -> Column:
    """One of the fitting opening lines, always the same one for the same key."""
    lines = openings(df)
    return F.get(lines, F.pmod(F.xxhash64(*key), F.size(lines)).cast("int"))


def prepare_leads(leads: DataFrame, key: str = "id") -> DataFrame:
    """Add ``prepared``, all that rendering needs of a lead, worked out once per lead instead of once per step."""
    opening = chosen_opening(leads, F.col(key), F.lit(1))
    maps = with_variables(with_variables(leads, opening).withColumnRenamed("variables", "_first"))
    both = F.struct(
        F.col("_first").alias("first"), F.col("variables").alias("later"),
        has_braces(F.col("_first")).alias("first_braces"), has_braces(F.col("variables")).alias("later_braces"),
    )
    return maps.withColumn("prepared", both).drop("_first", "variables")


def render_steps(rows: DataFrame) -> DataFrame:
    """Add ``subject`` and ``body`` to rows of a lead joined with a sequence step.

    Rows carry the lead with its enrichment columns, or one from :func:`prepare_leads`, ``step_number`` and the two
    templates. The opening line is offered to the first step only. Steps from :func:`compile_steps` are rendered by
    their segments.
    """
    first = F.col("step_number") == 1
    if "prepared" in rows.columns:
        filled = rows.withColumn("variables", F.when(first, F.col("prepared.first")).otherwise(F.col("prepared.later")))
        braces = F.when(first, F.col("prepared.first_braces")).otherwise(F.col("prepared.later_braces"))
    else:
        key = F.col("lead_id") if "lead_id" in rows.columns else F.col("id")
        filled = with_variables(rows, F.when(first, chosen_opening(rows, key, F.col("step_number"))))
        braces = None

    def text(part: str) -> Column:
        template, segments = F.col(f"{part}_template"), f"{part}_segments"
        if segments in rows.columns:
            return render_compiled(F.col(segments), template, F.col("variables"), braces)
        return render(template, F.col("variables"))

    out = filled.withColumn("subject", text("subject")).withColumn("body", text("body"))
    return out.drop("variables", "prepared", "subject_segments", "body_segments")


def template_errors(template: Column) -> Column:
    """Messages about unbalanced braces and blocks; an empty array for a sound template."""

    def number(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(template, F.lit(pattern), F.lit(0)))

    def unequal(opens: Column, closes: Column, message: str, first: str, second: str) -> Column:
        text = F.concat(
            F.lit(message + ": "), opens.cast("string"), F.lit(f" {first} vs "),
            closes.cast("string"), F.lit(" " + second),
        )
        return F.when(opens != closes, text)

    checks = [
        unequal(number(r"\{\{"), number(r"\}\}"), "Mismatched braces", "opening", "closing")
    ]
    for word in ("if", "unless"):
        checks.append(
            unequal(
                number(rf"\{{\{{#{word}\s+\w+\}}\}}"), number(rf"\{{\{{/{word}\}}\}}"),
                f"Unclosed {{{{#{word}}}}} blocks", "opens", "closes",
            )
        )
    return F.array_compact(F.array(*checks))
