"""The pipeline tables derived from the driver's base tables.

Each view is plain SQL that Spark and DuckDB accept unchanged. No view filters rows: each takes all rows of
its base tables, and what is rare comes from values (a parent lead that holds its neighbour's addresses,
known places under other names), so that queries still find leads without addresses and the like.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from contactmill.session import configure

BASE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Some leads have no address or no enrichment: theirs are kept with the lead before them.
_MAIL_LEAD = "CASE WHEN o_custkey % 5 = 4 THEN o_custkey - 1 ELSE o_custkey END"
_SITE_LEAD = "CASE WHEN o_custkey % 7 = 6 THEN o_custkey - 1 ELSE o_custkey END"

VIEWS = {
    "leads": """
SELECT c.c_custkey AS id, c.c_name AS business_name,
  CASE c.c_mktsegment WHEN 'BUILDING' THEN 'agency' WHEN 'HOUSEHOLD' THEN 'solo_tutor' WHEN 'MACHINERY' THEN 'franchise' WHEN 'AUTOMOBILE' THEN 'online_platform' END AS business_type,
  CASE WHEN c.c_custkey % 5 <> 0 THEN concat('https://site', CAST(c.c_custkey AS STRING), '.example.net') END AS website,
  n.n_name AS city, r.r_name AS state_province, CASE WHEN n.n_regionkey % 2 = 0 THEN 'US' ELSE 'CA' END AS country,
  CASE c.c_custkey % 4 WHEN 0 THEN 'google_maps' WHEN 1 THEN 'yelp' WHEN 2 THEN 'directory' ELSE 'manual' END AS source,
  CAST(c.c_custkey AS STRING) AS source_id,
  CASE WHEN c.c_custkey % 6 <> 0 THEN CAST(30 + c.c_custkey % 21 AS DOUBLE) / 10 END AS google_rating,
  CASE WHEN c.c_custkey % 6 <> 0 THEN CAST(c.c_custkey % 50 AS INT) END AS google_review_count,
  CAST(CASE WHEN c.c_acctbal < 0 THEN 0 ELSE floor(c.c_acctbal / 100) END AS INT) AS score,
  CASE WHEN c.c_custkey % 7 < 3 THEN 'new' WHEN c.c_custkey % 7 < 6 THEN 'scored' ELSE 'contacted' END AS pipeline_stage,
  f.created_at
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS TIMESTAMP) AS created_at FROM {orders} GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey
""",
    "lead_emails": f"""
SELECT o.o_orderkey AS id, f.lead_id, concat('u', CAST(o.o_orderkey AS STRING), '@mail', CAST(o.o_orderkey % 7 AS STRING), '.example.net') AS email,
  CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'owner' WHEN '2' THEN 'admin' WHEN '3' THEN 'info' ELSE 'unknown' END AS role,
  CASE o.o_orderstatus WHEN 'F' THEN CASE WHEN f.lead_id % 3 = 0 THEN 'catch_all' ELSE 'valid' END WHEN 'O' THEN 'unverified' ELSE CASE o.o_orderkey % 3 WHEN 0 THEN 'invalid' WHEN 1 THEN 'catch_all' ELSE 'unknown' END END AS verification_status,
  'scraped' AS source, o.o_orderkey = f.first_key AS is_primary, CAST(o.o_orderdate AS TIMESTAMP) AS created_at
FROM {{orders}} o JOIN (SELECT {_MAIL_LEAD} AS lead_id, min(o_orderkey) AS first_key FROM {{orders}} GROUP BY 1) f ON f.lead_id = {_MAIL_LEAD}
""",
    "lead_enrichment": f"""
SELECT lead_id, lead_id % 2 = 1 AS has_multiple_tutors,
  CASE lead_id % 4 WHEN 1 THEN 'calendly' WHEN 3 THEN 'acuity' END AS existing_scheduling_tool,
  CASE WHEN lead_id % 5 = 1 THEN 'https://linkedin.com/company/x' END AS linkedin_url, CASE WHEN lead_id % 5 = 2 THEN 'https://facebook.com/x' END AS facebook_url,
  CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS INT) AS enrichment_attempts, CAST(max(o_orderdate) AS TIMESTAMP) AS last_enrichment_attempt_at,
  CAST(lead_id % 2 AS INT) AS emails_found_count
FROM (SELECT {_SITE_LEAD} AS lead_id, o_orderpriority, o_orderdate FROM {{orders}}) o GROUP BY lead_id
""",
    "send_log": """
SELECT event_id AS id, user_id AS lead_id, event_id AS email_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 5 END AS sequence_id, CAST(event_id % 3 AS INT) AS step_number,
  concat('m', CAST(event_id % 2000 AS STRING)) AS ses_message_id,
  CASE event_type WHEN 'signup' THEN 'sent' WHEN 'purchase' THEN 'delivered' WHEN 'view' THEN 'opened' WHEN 'click' THEN 'clicked' ELSE CASE WHEN value < 20 THEN 'complained' ELSE 'bounced' END END AS status, CAST(ts AS TIMESTAMP) AS sent_at
FROM {events}
""",
    "sequences": """
SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 3 AS total_steps, CASE WHEN r_regionkey = 4 THEN 'paused' ELSE 'active' END AS status FROM {region}
""",
    "sequence_steps": """
SELECT CAST(r_regionkey AS BIGINT) AS sequence_id, 1 AS step_number, 0 AS delay_hours, concat('Hello {{business_name}} from ', r_name) AS subject_template, 'Hi{{#if first_name}} {{first_name}}{{/if}}, greetings to {{city}}.' AS body_template FROM {region}
UNION ALL SELECT CAST(r_regionkey AS BIGINT), 2, 72, 'Again, {{business_name}}', '{{#unless website}}No site yet? {{/unless}}We wrote to {{state}}.' FROM {region}
UNION ALL SELECT CAST(r_regionkey AS BIGINT), 3, 120, 'Last note {{if}}', 'Bye {{nobody}} {{#if city}}in {{city}}' FROM {region}
""",
    "sequence_enrollments": """
SELECT min(o_orderkey) AS id, o_custkey AS lead_id, o_orderkey % 5 AS sequence_id, CASE WHEN min(o_orderkey) % 11 = 0 THEN -min(o_orderkey) ELSE min(o_orderkey) END AS email_id, CAST(min(o_orderkey) % 4 AS INT) AS current_step,
  CASE substr(max(o_orderpriority), 1, 1) WHEN '1' THEN 'completed' WHEN '2' THEN 'replied' WHEN '3' THEN 'bounced' WHEN '4' THEN 'unsubscribed' ELSE 'active' END AS status, CAST(min(o_orderdate) AS TIMESTAMP) AS next_send_at
FROM {orders} GROUP BY o_custkey, o_orderkey % 5
""",
    "places_raw": """
SELECT concat('run', CAST(p_size % 3 AS STRING)) AS run_id, p_partkey AS seq, concat('P', CAST(p_partkey % 1900 AS STRING)) AS place_id, p_name AS name, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS city, p_type AS state_province,
  CASE WHEN p_size % 13 = 0 THEN 'CLOSED' WHEN p_size % 5 = 0 THEN NULL ELSE 'OPERATIONAL' END AS business_status, CASE WHEN p_size % 17 = 0 THEN 'MX' WHEN p_size % 2 = 0 THEN 'US' ELSE 'CA' END AS country
FROM {part}
""",
    "known_places": """
SELECT p_partkey AS id, CASE WHEN p_size >= 45 THEN p_name ELSE concat('Former ', p_name) END AS business_name, p_brand AS city, p_type AS state_province, 'google_maps' AS source,
  concat(CASE WHEN p_size >= 45 THEN 'P' ELSE 'Q' END, CAST(p_partkey % 1900 AS STRING)) AS source_id
FROM {part}
""",
    "probe_results": """
SELECT l_orderkey AS email_id, min(CASE l_returnflag WHEN 'A' THEN 250 WHEN 'R' THEN 550 ELSE 451 END) AS code, bool_or(l_tax > 0.07) AS catch_all_accepted, bool_or(l_quantity < 2) AS timed_out FROM {lineitem} GROUP BY l_orderkey
""",
    "fetch_log": """
SELECT event_id AS fetch_id, concat('site', CAST(user_id % 100 AS STRING), '.example.net') AS domain, CAST(ts AS TIMESTAMP) AS fetched_at,
  CASE event_type WHEN 'signup' THEN 403 WHEN 'error' THEN NULL ELSE 200 END AS status_code, event_type = 'click' AND value < 5 AS bot_page, event_type = 'error' AS network_error
FROM {events}
""",
    "replies": """
SELECT event_id AS reply_id, concat('m', CAST(event_id % 2000 AS STRING)) AS ses_message_id,
  CASE event_type WHEN 'signup' THEN 'interested' WHEN 'purchase' THEN 'question' WHEN 'view' THEN 'out_of_office' WHEN 'click' THEN 'not_interested' ELSE 'unsubscribe' END AS reply_class, CAST(ts AS TIMESTAMP) AS received_at
FROM {events}
""",
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def base_tables(view: str) -> list[str]:
    return sorted(set(_NAME.findall(VIEWS[view])) & set(BASE))


def for_duckdb(view: str) -> str:
    """The view text with plain table names."""
    return _NAME.sub(lambda m: m.group(1) if m.group(1) in BASE else m.group(0), VIEWS[view])


class Tables:
    """Base tables and views of one data folder as DataFrames, read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self._folder = folder
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._load(name)
        return self._known[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.schema(BASE[name]).parquet(f"{self._folder}/{name}.parquet")
        sources = {t: getattr(self, t) for t in base_tables(name)}
        names = {t: f"contactmill_{t}" for t in sources}
        for table, df in sources.items():
            df.createOrReplaceTempView(names[table])
        text = _NAME.sub(lambda m: names.get(m.group(1), m.group(0)), VIEWS[name])
        return self.spark.sql(text)
