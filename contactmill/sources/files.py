"""Reading place records, scoring rules and sequence templates from JSON files."""

from __future__ import annotations

import json
from datetime import datetime
from importlib.resources import files
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactmill import schemas
from contactmill.functions.columns import moment
from contactmill.operators.ingest import parse_address

USABLE = ["OK", "ZERO_RESULTS"]


def page_number(file: Column) -> Column:
    """The last number in the name of a file."""
    digits = F.regexp_extract(F.substring_index(file, "/", -1), r"(\d+)\D*\z", 1)
    return F.coalesce(digits.try_cast("long"), F.lit(0))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Search results, one row per place: ``file``, its ``page_no`` and the place's ``pos`` in it.

    The page number is the last number in the file's name (page10 comes after page2), 0 for a name without
    one. Files with another status than OK or ZERO_RESULTS are left out.
    """
    raw = spark.read.schema(schemas.PLACE_SEARCH_FILE).option("multiLine", True).json(path)
    return (
        raw.filter(F.col("status").isin(USABLE))
        .select(F.input_file_name().alias("file"), F.posexplode("results").alias("pos", "r"))
        .select("file", page_number(F.col("file")).alias("page_no"), "pos", "r.*")
    )


def read_place_details(spark: SparkSession, path: str) -> DataFrame:
    """Detail records with city, state and country read from the address components."""
    raw = spark.read.schema(schemas.PLACE_DETAILS_FILE).option("multiLine", True).json(path)
    rows = raw.filter(F.col("status") == "OK").select("result.*")
    return (
        rows.withColumn("_where", parse_address(F.col("address_components")))
        .select("*", "_where.*")
        .drop("_where", "address_components")
    )


def place_records(search: DataFrame, details: DataFrame, run_id: str) -> DataFrame:
    """Search rows joined with their details, ready for ingest. Places without details drop out."""
    known = details.select(
        "place_id",
        "name",
        F.col("formatted_address").alias("address"),
        F.col("formatted_phone_number").alias("phone"),
        "website",
        F.col("rating").alias("google_rating"),
        F.col("user_ratings_total").alias("google_review_count"),
        "types",
        "city",
        "state_province",
        "country",
    )
    arrival = search.select(
        F.lit(run_id).alias("run_id"),
        F.struct("page_no", "file", "pos").alias("seq"),
        "place_id",
        "business_status",
    )
    return arrival.join(known, "place_id")


def load_rules(path: str | Path | None = None) -> dict:
    """The scoring rules, from a file or the shipped set. A few dozen rules: read on the driver."""
    source = Path(path) if path else files("contactmill") / "data" / "scoring_rules.json"
    config = json.loads(source.read_text(encoding="utf-8"))
    for key in ("rules", "maxScore"):
        if key not in config:
            raise ValueError(f"scoring rules lack {key!r}")
    return config


def read_sequence_files(
    spark: SparkSession, path: str, as_of: datetime | str
) -> tuple[DataFrame, DataFrame]:
    """Sequence templates as ``sequences`` and ``sequence_steps`` rows.

    Steps are numbered by their place in the file; a number written there is ignored.
    """
    raw = spark.read.schema(schemas.SEQUENCE_FILE).option("multiLine", True).json(path)
    now = moment(as_of)
    sequence_id = F.xxhash64("name").cast("string")
    sequences = raw.select(
        sequence_id.alias("id"),
        "name",
        F.size("steps").alias("total_steps"),
        F.lit("active").alias("status"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    steps = raw.select(sequence_id.alias("sequence_id"), F.posexplode("steps").alias("pos", "s")).select(
        F.xxhash64("sequence_id", "pos").cast("string").alias("id"),
        "sequence_id",
        (F.col("pos") + 1).alias("step_number"),
        F.coalesce("s.delay_hours", F.lit(0)).alias("delay_hours"),
        "s.subject_template",
        "s.body_template",
        now.alias("created_at"),
    )
    return sequences, steps
