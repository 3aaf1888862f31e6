"""SQL for the registered queries, in the dialect of DuckDB, over the same base tables.

Written independently of the operators. A query whose meaning SQL cannot state, because its values
come from a hash, has no entry and is tested on small examples.
"""

from __future__ import annotations

from contactmill.functions import fixed_values as fv
from contactmill.plans import queries as Q
from contactmill.plans.views import VIEWS, for_duckdb

_SQL: dict[str, str] = {}


def _with(views: str, body: str, more: str = "") -> str:
    parts = [f"{v} AS ({for_duckdb(v)})" for v in views.split()]
    if more:
        parts.append(more)
    return f"WITH {', '.join(parts)} {body}" if parts else body


def add(name: str, views: str, body: str, more: str = "") -> None:
    _SQL[name] = _with(views, body, more)


def _words(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# -- scoring -----------------------------------------------------------------------------------
_SCORED = """
flags AS (SELECT lead_id, bool_or(verification_status = 'valid') AS ok FROM lead_emails GROUP BY lead_id),
hits AS (
  SELECT l.*, (coalesce(business_type = 'agency', false))::INT AS r1, (website IS NOT NULL)::INT AS r2,
    coalesce(has_multiple_tutors, false)::INT AS r3, (existing_scheduling_tool IS NULL)::INT AS r4,
    (existing_scheduling_tool IS NOT NULL)::INT AS r5, coalesce(google_rating >= 4.0, false)::INT AS r6,
    coalesce(google_review_count >= 20, false)::INT AS r7, coalesce(ok, false)::INT AS r8,
    (linkedin_url IS NOT NULL OR facebook_url IS NOT NULL)::INT AS r9,
    coalesce(business_type = 'franchise', false)::INT AS r10
  FROM leads l LEFT JOIN flags f ON f.lead_id = l.id LEFT JOIN lead_enrichment e ON e.lead_id = l.id),
scored AS (
  SELECT *, greatest(0, least(100, 20*r1 + 10*r2 + 15*r3 + 15*r4 + 5*r5 + 5*r6 + 10*r7 + 10*r8 + 5*r9 - 10*r10)) AS total_score
  FROM hits),
tiered AS (
  SELECT *, CASE WHEN total_score >= 70 THEN 'hot' WHEN total_score >= 50 THEN 'warm' WHEN total_score >= 30 THEN 'cool' ELSE 'cold' END AS tier,
    CASE WHEN total_score >= 70 THEN 'Hot Lead' WHEN total_score >= 50 THEN 'Warm Lead' WHEN total_score >= 30 THEN 'Cool Lead' ELSE 'Cold Lead' END AS tier_label
  FROM scored)
"""
_E3 = "leads lead_emails lead_enrichment"
add("score_leads", _E3, "SELECT id, total_score, tier, tier_label FROM tiered", _SCORED)
add(
    "score_summary", _E3,
    """SELECT count(*) AS scored, floor(avg(total_score) * 10 + 0.5) / 10 AS avg_score, count(*) FILTER (tier = 'hot') AS hot,
    count(*) FILTER (tier = 'warm') AS warm, count(*) FILTER (tier = 'cool') AS cool, count(*) FILTER (tier = 'cold') AS cold FROM tiered""",
    _SCORED,
)
_RULES = [
    ("business_type_agency", "Business Type: Agency", 20), ("has_website", "Has Website", 10),
    ("multiple_tutors", "Has Multiple Tutors", 15),
    ("no_scheduling_tool", "No Existing Scheduling Tool", 15),
    ("has_competitor_tool", "Uses Competitor Tool", 5),
    ("high_google_rating", "High Google Rating (4.0+)", 5),
    ("established_reviews", "Established Review Base (20+)", 10),
    ("verified_email", "Has Verified Email", 10),
    ("has_social_presence", "Has Social Media Presence", 5),
    ("franchise_type", "Franchise Location", -10),
]
_APPLIED = _SCORED + ", applied AS (" + " UNION ALL ".join(
    f"SELECT id, business_name, total_score, tier_label, {i} AS rule_no, '{rid}' AS rule_id, '{name}' AS rule_name, {points} AS points FROM tiered WHERE r{i + 1} = 1"
    for i, (rid, name, points) in enumerate(_RULES)
) + ")"
add(
    "score_applied_rules", _E3,
    "SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY rule_no) - 1 AS INT) AS pos, rule_id, rule_name, points FROM applied",
    _APPLIED,
)
add(
    "score_explanations", _E3,
    """SELECT id, 'Score for "' || business_name || '": ' || total_score || '/100 (' || tier_label || ')' || chr(10) || chr(10) || 'Applied Rules:' || chr(10)
    || coalesce((SELECT string_agg('  - ' || rule_name || ': ' || CASE WHEN points >= 0 THEN '+' ELSE '' END || points || ' points' || chr(10), '' ORDER BY rule_no) FROM applied a WHERE a.id = t.id),
      '  - No scoring rules matched' || chr(10)) AS explanation FROM tiered t""",
    _APPLIED,
)
add(
    "save_scores", _E3,
    "SELECT id, total_score AS score, CASE WHEN pipeline_stage = 'new' THEN 'scored' ELSE pipeline_stage END AS pipeline_stage FROM tiered",
    _SCORED,
)

_PREDICATES = [
    ("equals", "business_type = 'agency'"), ("not equals", "source IS DISTINCT FROM 'yelp'"), ("above", "score > 50"),
    ("at least", "google_rating >= 4.5"), ("below", "google_review_count < 10"), ("at most", "score <= 5"),
    ("contains", "contains(lower(city), 'nation_1')"), ("absent", "website IS NULL"), ("present", "linkedin_url IS NOT NULL"),
    ("flag", "has_multiple_tutors"),
]
add(
    "rule_predicates", "leads lead_enrichment",
    "SELECT id, CAST(least(30, 7 * (" + " + ".join(f"coalesce({c}, false)::INT" for _, c in _PREDICATES) + ")) AS INT) AS total_score, concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _PREDICATES)
    + ") AS rules FROM leads l LEFT JOIN lead_enrichment e ON e.lead_id = l.id",
)

# -- lead queries ---------------------------------------------------------------------------------
_LEAD = "id, business_name, score, pipeline_stage"
add("lead_by_id", "leads", f"SELECT {_LEAD} FROM leads WHERE id = {Q.ONE_LEAD}")
add("emails_of_lead", "lead_emails", f"SELECT id, email, is_primary FROM lead_emails WHERE lead_id = {Q.ONE_LEAD}")
add("enrichment_of_lead", "lead_enrichment", f"SELECT lead_id, enrichment_attempts FROM lead_enrichment WHERE lead_id = {Q.ONE_LEAD}")
add("ascii_forms", "lead_emails", "SELECT id, email FROM lead_emails")
add(
    "enrollment_lookups", "sequence_enrollments",
    f"""SELECT 'of sequence' AS kind, id, status FROM sequence_enrollments WHERE lead_id = {Q.ONE_LEAD} AND sequence_id = 4
    UNION ALL SELECT 'active', id, status FROM sequence_enrollments WHERE lead_id = {Q.ONE_LEAD} AND status = 'active'""",
)
add(
    "sequence_lookups", "sequences sequence_steps",
    """SELECT 'named' AS kind, id, 0 AS step FROM sequences WHERE name = 'ASIA' UNION ALL SELECT 'active', id, 0 FROM sequences WHERE status = 'active'
    UNION ALL SELECT 'step', sequence_id, step_number FROM sequence_steps WHERE sequence_id = 3""",
)
add("send_history", "send_log", "SELECT id, status, sent_at FROM send_log WHERE lead_id = 7")
add(
    "address_parts", "",
    """SELECT p_partkey, CASE WHEN p_size > 2 THEN p_name END AS city, CASE WHEN p_size > 2 THEN p_type END AS state_province,
    CASE WHEN p_size > 2 AND p_size % 5 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'US' ELSE 'CA' END END AS country FROM part""",
)
add(
    "place_files", "",
    """SELECT 'P' || p_partkey AS place_id, pos, p_name AS name, CASE WHEN p_size % 5 <> 0 THEN 'OPERATIONAL' END AS business_status, p_size / 10 AS google_rating,
    p_size AS google_review_count, p_brand AS city, 'CA' AS country FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey) - 1 AS INT) AS pos FROM part)
    WHERE (p_partkey // 200) % 5 <> 4 AND p_size % 7 <> 0""",
)
add(
    "sequence_files", "",
    """SELECT n_name AS name, 2 AS total_steps, 'active' AS status, 1 AS step_number, 0 AS delay_hours, 'Hello from ' || n_name AS subject_template FROM nation
    UNION ALL SELECT n_name, 2, 'active', 2, n_regionkey * 24, 'Again' FROM nation""",
)
add(
    "manual_leads", "",
    f"""SELECT s_name AS business_name, CASE WHEN s_nationkey >= 12 THEN 'https://x.org' END AS website, CAST(s_nationkey AS VARCHAR) AS city, 'manual' AS source,
    0 AS score, 'new' AS pipeline_stage, TIMESTAMP '{Q.SEND_AT}' AS created_at FROM supplier WHERE s_acctbal >= 0""",
)
add("lead_by_source_id", "leads", f"SELECT {_LEAD} FROM leads WHERE source = 'yelp' AND source_id = '5'")
add("leads_top_scored", "leads", f"SELECT {_LEAD} FROM leads WHERE score > 0 ORDER BY score DESC NULLS LAST, id LIMIT 100")
add("leads_by_stage", "leads", f"SELECT {_LEAD} FROM leads WHERE pipeline_stage = 'new' ORDER BY score DESC NULLS LAST, id LIMIT 100")
add("leads_newest", "leads", f"SELECT {_LEAD}, created_at FROM leads ORDER BY created_at DESC NULLS LAST, id LIMIT 50 OFFSET 50")
add("leads_count", "", "SELECT count(*) AS n FROM customer")
_LE = "leads lead_emails"
_HAS = "EXISTS (SELECT 1 FROM lead_emails e WHERE e.lead_id = l.id"
add("leads_with_valid_email", _LE, f"SELECT {_LEAD} FROM leads l WHERE {_HAS} AND verification_status = 'valid')")
add("leads_by_email_status", _LE, f"SELECT {_LEAD} FROM leads l WHERE {_HAS} AND verification_status = 'catch_all')")
add("leads_with_emails", _LE, f"SELECT {_LEAD} FROM leads l WHERE {_HAS})")
add("leads_without_emails", _LE, f"SELECT {_LEAD} FROM leads l WHERE NOT {_HAS})")
_STATUSES = "(VALUES ('valid'), ('invalid'), ('catch_all'), ('unknown'), ('unverified')) s(verification_status)"
add(
    "email_status_counts", "lead_emails",
    f"SELECT s.verification_status, count(e.id) AS n FROM {_STATUSES} LEFT JOIN lead_emails e USING (verification_status) GROUP BY 1",
)
_NEVER = "website IS NOT NULL AND id NOT IN (SELECT lead_id FROM lead_enrichment)"
add("leads_not_enriched", "leads lead_enrichment", f"SELECT count(*) AS n FROM leads WHERE {_NEVER}")


def _reenrich(at: str) -> str:
    return f"""SELECT l.* FROM leads l LEFT JOIN lead_enrichment en ON en.lead_id = l.id
      WHERE NOT {_HAS}) AND website IS NOT NULL AND (en.lead_id IS NULL OR (emails_found_count = 0
      AND enrichment_attempts < 3 AND last_enrichment_attempt_at < TIMESTAMP '{at}' - INTERVAL 30 DAY))"""


add("reenrich_queue", _E3, f"SELECT {_LEAD} FROM ({_reenrich(Q.ENRICH_AT)})")
add("primary_email", "lead_emails", "SELECT lead_id, min(id) AS id, min_by(email, id) AS email FROM lead_emails WHERE is_primary GROUP BY lead_id")
_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY CASE verification_status WHEN 'valid' THEN 1 ELSE 2 END,
  is_primary DESC, id) AS rn FROM lead_emails WHERE verification_status IN ('valid', 'catch_all')) WHERE rn = 1)"""
add("best_email_per_lead", "lead_emails", "SELECT lead_id, id, email, verification_status FROM best", _BEST)
add(
    "email_exists", "lead_emails",
    """SELECT o_custkey AS lead_id, 'U' || o_orderkey || '@MAIL' || (o_orderkey % 7) || '.Example.net' AS email FROM orders o
    WHERE EXISTS (SELECT 1 FROM lead_emails e WHERE e.lead_id = o_custkey AND lower(e.email) = lower('U' || o_orderkey || '@MAIL' || (o_orderkey % 7) || '.Example.net'))""",
)
_AVG = "coalesce(floor(avg(score) FILTER (score > 0) * 10 + 0.5) / 10, 0.0)"
_STATS = f"""(SELECT count(*) FROM leads) AS total_leads, (SELECT {_AVG} FROM leads) AS avg_score,
  (SELECT count(DISTINCT lead_id) FROM lead_emails) AS leads_with_emails,
  (SELECT count(*) FROM lead_emails WHERE verification_status = 'valid') AS verified_emails"""
add("lead_stats", _LE, f"SELECT {_STATS}")
add(
    "lead_stats_maps", "leads",
    """SELECT 'stage' AS kind, pipeline_stage AS value, count(*) AS n FROM leads GROUP BY 2
    UNION ALL SELECT 'source', source, count(*) FROM leads GROUP BY 2""",
)
add("stage_counts", "leads", "SELECT pipeline_stage, count(*) AS n FROM leads GROUP BY 1")
add("source_counts", "leads", "SELECT source, count(*) AS n FROM leads GROUP BY 1")
_CHECKS = ", ".join(
    f"(SELECT count(*) FROM lead_emails WHERE verification_status = '{s}') AS {s}" for s in fv.VERIFICATION_STATUSES
)
_L4 = "leads lead_emails lead_enrichment send_log"
add(
    "extended_stats", _L4,
    f"""SELECT *, CAST(floor(leads_with_emails * 100.0 / total_leads + 0.5) AS BIGINT) AS email_success_rate FROM (
    SELECT {_STATS}, (SELECT count(*) FROM ({_reenrich(Q.SEND_AT)})) AS leads_without_emails,
    (SELECT count(*) FROM leads WHERE {_NEVER}) AS not_enriched, {_CHECKS},
    (SELECT count(*) FROM send_log WHERE sequence_id IS NULL) AS outreach_total,
    (SELECT count(*) FROM send_log WHERE sequence_id IS NULL AND sent_at >= TIMESTAMP '2024-01-31') AS outreach_today)""",
)
_SENT = "EXISTS (SELECT 1 FROM send_log s WHERE s.lead_id = l.id AND s.sequence_id IS NULL)"
_FILTERS = {
    "all": "SELECT * FROM leads",
    "with-emails": f"SELECT * FROM leads l WHERE {_HAS})",
    "without-emails": _reenrich(Q.SEND_AT),
    "hot": "SELECT * FROM leads WHERE score >= 70",
    "warm": "SELECT * FROM leads WHERE score BETWEEN 50 AND 69",
    "cold": "SELECT * FROM leads WHERE score > 0 AND score < 50",
    **{
        name: f"SELECT * FROM leads l WHERE {_HAS} AND verification_status = '{status}')"
        for name, status in [
            ("valid", "valid"), ("invalid", "invalid"), ("catch-all", "catch_all"), ("unknown", "unknown"),
            ("unverified", "unverified"), ("verified", "valid"),
        ]
    },
    "outreach-sent": f"SELECT * FROM leads l WHERE {_SENT}",
    "outreach-pending": f"SELECT * FROM leads l WHERE {_HAS} AND verification_status IN ('valid', 'catch_all')) AND NOT {_SENT}",
    "scored": "SELECT * FROM leads WHERE score > 0",
    "warm-or-better": "SELECT * FROM leads WHERE score >= 50",
}
add(
    "listing_filter_counts", _L4,
    " UNION ALL ".join(
        f"SELECT '{name}' AS filter, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM ({rows})" for name, rows in _FILTERS.items()
    ),
)

add(
    "listing_filter_ids", _L4,
    f"""SELECT 'without-emails' AS filter, id FROM ({_reenrich(Q.ENRICH_AT)}) UNION ALL SELECT 'outreach-pending', id FROM ({_FILTERS['outreach-pending']})
    UNION ALL SELECT 'catch-all', id FROM ({_FILTERS['catch-all']})""",
)


def _search(term: str) -> str:
    return f"(contains(lower(business_name), '{term}') OR contains(lower(city), '{term}') OR coalesce(contains(lower(website), '{term}'), false))"


add("lead_search", "leads", f"SELECT {_LEAD}, city FROM leads WHERE {_search('nation_1')}")
_RENAMED = "(SELECT id, CASE WHEN score >= 98 THEN 'Zebra ' || id ELSE business_name END AS business_name, city, website FROM leads WHERE score <> 97 OR score IS NULL)"
add(
    "lead_search_index", "leads",
    " UNION ALL ".join(
        f"SELECT '{term}' AS term, id, business_name FROM {_RENAMED} WHERE {_search(term.lower())}"
        for term in ("Nation_1", "zebra", "SITE1", "#00000012", "a_", "no such lead")
    ),
)
_NUMBERED = "numbered AS (SELECT id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, id) - 1 AS k FROM leads)"
add("listing_deep_page", "leads", "SELECT id, score, CAST(k // 25 + 1 AS INT) AS page FROM numbered WHERE k // 25 + 1 IN (1, 3, 6, 30)", _NUMBERED)
add("listing_page_starts", "leads", "SELECT k // 25 + 1 AS page, score, id FROM numbered WHERE k % 25 = 0", _NUMBERED)
add("outreach_pending", "leads lead_emails send_log", f"SELECT {_LEAD} FROM ({_FILTERS['outreach-pending']})")
add(
    "listing_pagination", "leads",
    f"SELECT 2 AS page, 30 AS \"limit\", count(*) AS total, CAST(ceil(count(*) / 30.0) AS BIGINT) AS total_pages FROM leads WHERE {_search('site1')}",
)
add(
    "listing_page_details", _L4,
    f"""SELECT l.id, l.score, 0 AS part, {_SENT} AS outreach_sent, CAST(coalesce(n, 0) AS INT) AS n_emails, coalesce(mails, '') AS emails,
    coalesce(enrichment_attempts, 0) AS attempts, existing_scheduling_tool AS tool
    FROM (SELECT * FROM leads WHERE {_search('site1')} ORDER BY score DESC NULLS LAST, id LIMIT 30 OFFSET 30) l
    LEFT JOIN (SELECT lead_id, count(*) AS n, string_agg(email, ',' ORDER BY is_primary DESC, id) AS mails FROM lead_emails GROUP BY lead_id) m ON m.lead_id = l.id
    LEFT JOIN lead_enrichment e ON e.lead_id = l.id""",
)
add(
    "added_emails", _LE,
    f"""SELECT id AS lead_id, 'desk@' || source || '.org' AS email, 'unknown' AS role, 'unverified' AS verification_status, 'manual' AS source,
    NOT {_HAS}) AS is_primary FROM leads l""",
)
add(
    "patched_emails", "lead_emails",
    """SELECT id, lead_id, CASE WHEN o_totalprice >= 470000 THEN 'new' || id || '@x.org' ELSE email END AS email,
    CASE WHEN o_totalprice >= 470000 AND o_orderstatus <> 'O' THEN CASE WHEN o_orderstatus = 'F' THEN 'owner' END ELSE role END AS role
    FROM lead_emails JOIN orders ON o_orderkey = id""",
)
add(
    "deleted_emails", "lead_emails sequence_enrollments",
    """SELECT id, 'email' AS kind FROM lead_emails WHERE id IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 470000)
    UNION ALL SELECT id, 'enrollment' FROM sequence_enrollments WHERE email_id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 470000)""",
)
add(
    "stage_updates", "leads lead_enrichment",
    "SELECT id, CASE WHEN id IN (SELECT lead_id FROM lead_enrichment) THEN 'qualified' ELSE pipeline_stage END AS pipeline_stage FROM leads",
)

# -- ingest ---------------------------------------------------------------------------------------
_INGEST = """
f0 AS (SELECT *, row_number() OVER (PARTITION BY run_id, place_id ORDER BY seq) AS rn FROM places_raw),
found AS (SELECT * EXCLUDE (rn) FROM f0 WHERE rn = 1 AND (business_status IS NULL OR business_status = 'OPERATIONAL')),
tagged AS (SELECT f.*, place_id IN (SELECT source_id FROM known_places WHERE source = 'google_maps') AS known_id,
  EXISTS (SELECT 1 FROM known_places k WHERE lower(trim(k.business_name)) = lower(trim(f.name)) AND k.city IS NOT DISTINCT FROM f.city
    AND k.state_province IS NOT DISTINCT FROM f.state_province) AS known_name FROM found f),
c1 AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY seq) AS rn FROM tagged WHERE NOT known_id AND country IN ('US', 'CA') AND NOT known_name),
c2 AS (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY lower(trim(name)), city, state_province ORDER BY seq) AS rn FROM c1 WHERE rn = 1),
fresh AS (SELECT * FROM c2 WHERE rn = 1),
outcome AS (SELECT *, CASE WHEN known_id THEN 'duplicate' WHEN country NOT IN ('US', 'CA') THEN 'skipped'
  WHEN (run_id, seq) IN (SELECT (run_id, seq) FROM fresh) THEN 'new' ELSE 'duplicate' END AS outcome FROM tagged)
"""
_P2 = "places_raw known_places"
add("ingest_dedup", _P2, "SELECT run_id, seq, place_id, name, city, state_province, country FROM fresh", _INGEST)
_COUNTS = "count(*) AS leads_found, count(*) FILTER (outcome = 'new') AS leads_new, count(*) FILTER (outcome = 'duplicate') AS leads_duplicate"
add("ingest_counters", _P2, f"SELECT run_id, {_COUNTS} FROM outcome GROUP BY run_id", _INGEST)
add("metro_rollup", _P2, f"SELECT state_province AS metro, {_COUNTS} FROM outcome GROUP BY ROLLUP (state_province)", _INGEST)


def _type(name: str, extra: str = "") -> str:
    def any_of(words: list[str]) -> str:
        return " OR ".join(f"contains(lower({name}), '{w}')" for w in words)

    return f"""CASE WHEN {any_of(fv.FRANCHISE_WORDS)} THEN 'franchise' WHEN {any_of(fv.ONLINE_WORDS)} THEN 'online_platform'
      WHEN {any_of(fv.AGENCY_WORDS)} THEN 'agency' {extra} ELSE 'solo_tutor' END"""


add(
    "ingest_new_leads", _P2,
    f"""SELECT name AS business_name, {_type('name')} AS business_type, city, country, 'google_maps' AS source, place_id AS source_id, 0 AS score,
    'new' AS pipeline_stage, TIMESTAMP '{Q.SEND_AT}' AS created_at FROM fresh""",
    _INGEST,
)
add(
    "business_type", "",
    f"""SELECT p_partkey, name, {_type('name', "WHEN p_size % 3 = 0 THEN 'agency'")} AS business_type FROM (
    SELECT *, p_name || CASE WHEN p_size % 7 = 0 THEN ' Learning Center' WHEN p_size % 11 = 0 THEN ' Online School' WHEN p_size % 13 = 0 THEN ' of Kumon online' ELSE '' END AS name FROM part)""",
)
add(
    "run_log", _P2,
    f"""SELECT r.run_id AS id, CASE WHEN r.run_id = 'run2' THEN 0 ELSE leads_found END AS leads_found, CASE WHEN r.run_id = 'run2' THEN 0 ELSE leads_new END AS leads_new,
    CASE WHEN r.run_id = 'run2' THEN 0 ELSE leads_duplicate END AS leads_duplicate, CASE WHEN r.run_id = 'run2' THEN 'failed' ELSE 'completed' END AS status,
    TIMESTAMP '{Q.SEND_AT}' AS completed_at, CASE WHEN r.run_id = 'run2' THEN 'quota exceeded' END AS error_message
    FROM (SELECT run_id, {_COUNTS} FROM outcome GROUP BY run_id) r""",
    _INGEST,
)
add(
    "same_contact_dedup", "",
    """WITH firms AS (SELECT p_partkey AS id, CASE WHEN p_type <> 'SMALL' THEN '(555) 0' || CAST(round(p_retailprice) AS BIGINT) END AS phone,
      CASE WHEN p_size <= 25 THEN 'www.shop-' || replace(p_name, ' ', '-') || p_size || '.com/x' END AS website FROM part),
    a AS (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY id) AS rn FROM firms),
    b AS (SELECT id, phone, website, CASE WHEN website IS NOT NULL THEN split_part(substr(website, 5), '/', 1) END AS domain FROM a WHERE phone IS NULL OR rn = 1),
    c AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS rn FROM b)
    SELECT id, phone, website FROM c WHERE domain IS NULL OR rn = 1""",
)
add(
    "checked_rows", "places_raw",
    """SELECT CAST(seq AS VARCHAR) AS id, 0 AS score, 'new' AS pipeline_stage, concat_ws('; ', CASE WHEN city IS NULL THEN 'created_at is missing' END,
    CASE WHEN country NOT IN ('US', 'CA') THEN 'country has an unknown value' END) AS reasons FROM places_raw""",
)

# -- texts ------------------------------------------------------------------------------------------
_LOCAL, _DOMAIN = "split_part(email, '@', 1)", "split_part(email, '@', 2)"


def _valid(blocked: list[str]) -> str:
    refused = " OR ".join(f"{_DOMAIN} = '{d}' OR ends_with({_DOMAIN}, '.{d}')" for d in blocked)
    return rf"""(contains(email, '@') AND contains(email, '.') AND length({_LOCAL}) BETWEEN 1 AND 64 AND length({_DOMAIN}) BETWEEN 1 AND 253
      AND regexp_matches({_DOMAIN}, '\.[A-Za-z]{{2,6}}$') AND regexp_matches({_DOMAIN}, '^[A-Za-z0-9.-]+$') AND NOT ({refused})
      AND NOT regexp_matches(email, '[/\\]') AND NOT regexp_matches(lower(email), '\.(png|jpg|jpeg|gif|svg|webp|css|js|json|xml|pdf|zip)$')
      AND NOT regexp_matches({_LOCAL}, '^[.-]|[.-]$') AND NOT regexp_matches({_LOCAL}, '^[0-9]+px') AND NOT contains({_LOCAL}, '--')
      AND regexp_matches({_LOCAL}, '^[A-Za-z0-9._%+-]+$'))"""


def _role(prefix: str, about: str) -> str:
    return f"""CASE WHEN regexp_matches(lower({about}), '{fv.OWNER_CONTEXT}') THEN 'owner' WHEN regexp_matches(lower({about}), '{fv.ADMIN_CONTEXT}') THEN 'admin'
      WHEN {prefix} IN ({_words(fv.INFO_PREFIXES)}) THEN 'info' WHEN regexp_matches({prefix}, '^[a-z]+([.][a-z]+)?$') THEN 'owner' ELSE 'unknown' END"""


def _rank(prefix: str) -> str:
    return f"""CASE role WHEN 'owner' THEN 30 WHEN 'admin' THEN 20 WHEN 'info' THEN 10 ELSE 0 END
      + CASE WHEN regexp_matches({prefix}, '^[a-z]+[.][a-z]+$') THEN 25 ELSE 0 END
      + CASE WHEN regexp_matches({prefix}, '^[a-z]{{2,15}}$') AND {prefix} NOT IN ({_words(fv.RANK_GENERIC_PREFIXES)}) THEN 20 ELSE 0 END
      + CASE WHEN {prefix} IN ({_words(fv.RANK_FRONT_DESK_PREFIXES)}) THEN 5 ELSE 0 END
      - CASE WHEN {prefix} IN ({_words(fv.RANK_FUNCTIONAL_PREFIXES)}) THEN 20 ELSE 0 END"""


_FOUND = f"""all_found AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{fv.EMAIL_PATTERN}'))) AS email,
    generate_subscripts(regexp_extract_all(text, '{fv.EMAIL_PATTERN}'), 1) AS n FROM documents),
  ok_found AS (SELECT doc_id, email, n FROM all_found WHERE {_valid(Q.BLOCKED)})"""
_BY_DOC = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS pos"
add(
    "emails_in_documents", "",
    f"""WITH {_FOUND}, named AS (SELECT doc_id, {_BY_DOC}, email, {_role(_LOCAL, "''")} AS role FROM ok_found)
    SELECT doc_id, pos, email, role, {_rank(_LOCAL)} AS contact_rank FROM named""",
)
add(
    "hidden_emails_in_documents", "",
    f"""WITH {_FOUND}, once AS (SELECT doc_id, email, min(n) AS n FROM ok_found GROUP BY doc_id, email)
    SELECT doc_id, {_BY_DOC}, email FROM once""",
)
add(
    "email_validity", "",
    f"""SELECT o_orderkey, email, {_valid(fv.BLOCKED_DOMAINS)} AS valid FROM (SELECT o_orderkey, CASE o_orderkey % 10
    WHEN 0 THEN 'u' || o_orderkey || '@' || host || '.org' WHEN 1 THEN '.u' || o_orderkey || '@' || host || '.org' WHEN 2 THEN 'u' || o_orderkey || '@sub.example.com'
    WHEN 3 THEN o_orderkey || 'px@' || host || '.org' WHEN 4 THEN 'u' || o_orderkey || '@2x.png' WHEN 5 THEN 'a--b' || o_orderkey || '@site.org'
    WHEN 6 THEN 'u' || o_orderkey || '.site.org' WHEN 7 THEN 'u' || o_orderkey || '@site.toolong' WHEN 8 THEN 'u/' || o_orderkey || '@site.org'
    ELSE 'First.Last+' || o_orderkey || '@Site-9.co.uk' END AS email FROM (SELECT *, lower(substr(o_orderpriority, 3, 4)) AS host FROM orders))""",
)
add(
    "email_role_rank", "",
    f"""SELECT o_orderkey, role, {_rank('prefix')} AS contact_rank FROM (SELECT *, {_role('prefix', 'about')} AS role FROM (
    SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'info' WHEN '2' THEN 'jane.doe' WHEN '3' THEN 'bob' WHEN '4' THEN 'sales' ELSE 'user' || o_orderkey END AS prefix,
    CASE o_orderstatus WHEN 'F' THEN 'Our Founder' WHEN 'O' THEN 'office manager' ELSE '' END AS about FROM orders))""",
)


def _features(tools: list[str], staff: list[str], topics: list[str]) -> str:
    tool = "coalesce(" + ", ".join(f"CASE WHEN contains(low, '{w}') THEN '{w}' END" for w in tools) + ")"
    people = " OR ".join(f"contains(low, '{w}')" for w in staff)
    return f"""SELECT doc_id, {tool} AS tool, ({people}) AS has_staff,
      array_to_string(list_filter([{_words(topics)}], lambda w: contains(low, w)), ',') AS topics FROM (SELECT doc_id, lower(text) AS low FROM documents)"""


add("document_features", "", _features(Q.TOOL_WORDS, Q.STAFF_WORDS, Q.TOPIC_WORDS))
add("default_features", "", _features(fv.SCHEDULING_TOOLS, fv.STAFF_PHRASES, fv.SPECIALTIES))
add("decoded_cf_emails", "lead_emails", "SELECT id, email FROM lead_emails")
add(
    "lead_sites", "leads",
    """SELECT id, CASE WHEN website IS NOT NULL THEN 'https://site' || id || '.example.net' END AS base_url,
    CASE WHEN website IS NOT NULL THEN 'site' || id || '.example.net' END AS site, CASE WHEN website IS NOT NULL THEN 'example.net' END AS domain,
    id % 6 = 0 AS skipped FROM leads""",
)
add(
    "root_domains", "",
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'shop' || s_nationkey || '.on.ca' WHEN 1 THEN 'shop' || s_nationkey || '.wixsite.com'
    WHEN 2 THEN 'example.org' ELSE 'shop' || s_nationkey || '.co.uk' END AS domain FROM supplier""",
)
add(
    "registered_domains", "",
    """SELECT s_suppkey, 'A.shop' || s_nationkey || '.' || t AS host, CASE k WHEN 0 THEN 'on.ca' WHEN 1 THEN 'shop' || s_nationkey || '.ck' WHEN 2 THEN 'ck'
      WHEN 3 THEN 'co.uk' ELSE 'unknown' END AS suffix, CASE k WHEN 0 THEN 'b.on.ca' WHEN 1 THEN 'a.shop' || s_nationkey || '.ck' WHEN 2 THEN 'www.ck'
      WHEN 3 THEN 'shop' || s_nationkey || '.co.uk' ELSE 'y.unknown' END AS domain
    FROM (SELECT *, s_suppkey % 5 AS k, ['b.on.ca', 'ck', 'www.ck', 'co.uk', 'x.y.unknown'][s_suppkey % 5 + 1] AS t FROM supplier)""",
)
add(
    "markup_places", "",
    """SELECT page_id, 'spot' || page_id || '@site.org' AS email, CASE page_id % 11 WHEN 0 THEN 'Jo' WHEN 1 THEN 'data attribute' WHEN 2 THEN 'structured data'
    WHEN 3 THEN 'meta tag' WHEN 4 THEN 'schema.org itemprop' WHEN 5 THEN 'form action mailto' WHEN 6 THEN 'form recipient field' WHEN 7 THEN 'footer'
    WHEN 8 THEN 'contact section' WHEN 9 THEN 'hidden input' ELSE 'cloudflare protected' END AS context FROM pages""",
)
add("spelled_forms", "", "SELECT doc_id, 'spot' || doc_id || '@site.org' AS email FROM documents")
add(
    "social_links", "",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://linkedin.com/company/c' || page_id END AS linkedin_url,
    CASE WHEN page_id % 3 = 0 THEN 'https://facebook.com/p' || page_id END AS facebook_url FROM pages""",
)
add(
    "strip_html", "",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'),
    '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages""",
)
add(
    "usable_pages", "",
    "SELECT page_id, url FROM pages WHERE length(html) > 0 AND NOT contains(url, '?page=') AND NOT ("
    + " OR ".join(f"contains(html, '{w}')" for w in fv.BOT_PAGE_MARKERS) + ")",
)
_SITE = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '')"
add(
    "site_page_limit", "",
    f"SELECT page_id, site FROM (SELECT page_id, {_SITE} AS site, row_number() OVER (PARTITION BY {_SITE} ORDER BY page_id) AS rn FROM pages) WHERE rn <= 12",
)
add(
    "sitemap_links", "",
    r"""WITH u AS (SELECT page_id AS site, unnest([url || '/about', url, url || '/our-team']) AS link, unnest([1, 2, 3]) AS n FROM pages)
    SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY n) - 1 AS INT) AS pos, link FROM u
    WHERE regexp_matches(lower(link), 'contact|about|team|staff|people|founder|owner')""",
)
_WORD = "(^|[^A-Za-z0-9_])({})([^A-Za-z0-9_]|$)"
_LINK_POINTS = " + ".join(
    f"CASE WHEN regexp_matches(lower({side}), '{p}') THEN {n} ELSE 0 END"
    for side, table in (("text", fv.LINK_TEXT_POINTS), ("href", fv.LINK_TARGET_POINTS))
    for p, n in table
)


def _either(words: str) -> str:
    return f"(regexp_matches(lower(text), '{_WORD.format(words)}') OR regexp_matches(lower(href), '{_WORD.format(words)}'))"


# On the synthetic pages every link is plain, relative to the root and inside the navigation.
add(
    "contact_links", "",
    f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
      unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text FROM pages)
    SELECT page_id, {_SITE} AS site, regexp_extract(url, '^(https?://[^/?#]+)', 1) || split_part(regexp_replace(href, '/$', ''), '?', 1) AS link,
      max(30 + {_LINK_POINTS}) AS score FROM a
    WHERE NOT regexp_matches(lower(href), '{fv.SOCIAL_LINK}') AND ({_either(Q.LINK_STRICT)} OR {_either(Q.LINK_BROAD)}) GROUP BY 1, 2, 3""",
)
_NAV_HREF = "href NOT IN ('/team', '/our-staff')"
add(
    "ranked_contact_links", "",
    f"""WITH menu AS (SELECT page_id, url, replace(html, '<body>', '<body><nav><a href="/contact">Contact us</a><a href="/about-us">About</a><a href="/blog">Blog</a></nav>'
      || '<a href="/team">Meet the team</a>' || CASE WHEN page_id % 3 = 0 THEN '<a href="/our-staff">Staff</a>' ELSE '' END) AS html FROM pages),
    a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
      unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) AS n FROM menu),
    best AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || split_part(regexp_replace(href, '/$', ''), '?', 1) AS link,
      max(CASE WHEN {_NAV_HREF} THEN 30 ELSE 0 END + {_LINK_POINTS}) AS score, min(n) AS n FROM a
      WHERE NOT regexp_matches(lower(href), 'facebook|linkedin|twitter|instagram|youtube|tiktok')
      AND ({_either('contact|about|team|staff|people|connect|reach|get.?in.?touch|inquiry|support|founder|owner|leadership|meet|principal')}
        OR {_NAV_HREF} AND {_either('meet|our|story|approach|learn|tutor|work|welcome|hire|bio|profile')}) GROUP BY 1, 2)
    SELECT page_id, link, score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, n, link) AS INT) AS rank FROM best""",
)
add(
    "new_lead_emails", "leads lead_emails",
    f"""SELECT lead_id, email, role, row_number() OVER (PARTITION BY lead_id ORDER BY rank DESC, n) = 1 AS is_primary FROM (
    SELECT *, {_rank(_LOCAL)} AS rank FROM (
      SELECT id AS lead_id, 'info@site' || id || '.org' AS email, 'info' AS role, 0 AS n FROM leads
      UNION ALL SELECT id, 'ann.lee@site' || id || '.org', 'owner', 2 FROM leads WHERE source = 'yelp'))""",
)
add(
    "upsert_enrichment", "leads lead_enrichment",
    f"""SELECT coalesce(o.lead_id, n.id) AS lead_id, CASE WHEN n.id IS NOT NULL THEN n.score >= 70 ELSE has_multiple_tutors END AS has_multiple_tutors,
    CASE WHEN n.id IS NOT NULL THEN 'doodle' ELSE existing_scheduling_tool END AS existing_scheduling_tool,
    CASE WHEN n.id IS NULL THEN linkedin_url END AS linkedin_url, CASE WHEN n.id IS NULL THEN facebook_url END AS facebook_url,
    CASE WHEN n.id IS NOT NULL THEN coalesce(enrichment_attempts, 0) + 1 ELSE enrichment_attempts END AS enrichment_attempts,
    CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '{Q.SEND_AT}' ELSE last_enrichment_attempt_at END AS last_enrichment_attempt_at,
    CASE WHEN n.id IS NOT NULL THEN 2 ELSE emails_found_count END AS emails_found_count
    FROM lead_enrichment o FULL JOIN (SELECT * FROM leads WHERE score >= 40) n ON n.id = o.lead_id""",
)

# The synthetic pages have no address but in their running text and few kinds of entities, so plain
# stripping gives their visible text. (Other structure is tested on examples.)
_PAGES = rf"""
plain AS (SELECT page_id, url, html, {_SITE} AS site, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(html,
  '(?s)<script.*?</script>|<style.*?</style>|<title>.*?</title>|<!--.*?-->|<[^>]+>', '', 'g'), '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)),
  '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM pages),
written AS (SELECT page_id, lower(unnest(regexp_extract_all(text, '{fv.EMAIL_PATTERN}'))) AS email,
  generate_subscripts(regexp_extract_all(text, '{fv.EMAIL_PATTERN}'), 1) AS n FROM plain),
checked AS (SELECT page_id, email, min(n) AS n FROM written WHERE {_valid(Q.BLOCKED)} GROUP BY 1, 2),
mails AS (SELECT page_id, CAST(count(*) AS INT) AS n_emails, string_agg(email, ',' ORDER BY n) AS emails FROM checked GROUP BY 1),
features AS (SELECT page_id, site, url, html, text, coalesce(n_emails, 0) AS n_emails, coalesce(emails, '') AS emails,
  coalesce({', '.join(f"CASE WHEN contains(lower(html || ' ' || text), '{w}') THEN '{w}' END" for w in fv.SCHEDULING_TOOLS)}) AS scheduling_tool,
  ({' OR '.join(f"contains(lower(text), '{w}')" for w in fv.STAFF_PHRASES)}) AS has_multiple_tutors,
  CAST(NULL AS VARCHAR) AS linkedin_url, CAST(NULL AS VARCHAR) AS facebook_url,
  {' + '.join(f"CASE WHEN contains(lower(text), '{w}') THEN CAST({1 << i} AS BIGINT) ELSE 0 END" for i, w in enumerate(fv.SPECIALTIES))} AS specialty_bits,
  CAST(length(text) AS INT) AS text_length FROM plain LEFT JOIN mails USING (page_id))
"""
_BIT_WORDS = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {{0}} & {1 << i} <> 0 THEN '{w}' END" for i, w in enumerate(fv.SPECIALTIES)
) + "], lambda w: w IS NOT NULL), ',')"
_BOT = " OR ".join(f"contains(html, '{w}')" for w in fv.BOT_PAGE_MARKERS)
_SQL["page_features"] = f"""WITH {_PAGES} SELECT page_id, site, n_emails, emails, scheduling_tool, has_multiple_tutors, linkedin_url, facebook_url,
  {_BIT_WORDS.format('specialty_bits')} AS specialties, text_length FROM features"""
_SQL["site_features"] = f"""WITH {_PAGES}
  SELECT site, count(*) AS pages_read, min_by(scheduling_tool, page_id) FILTER (scheduling_tool IS NOT NULL) AS scheduling_tool,
    bool_or(has_multiple_tutors) AS has_multiple_tutors, CAST(NULL AS VARCHAR) AS linkedin_url, CAST(NULL AS VARCHAR) AS facebook_url,
    {_BIT_WORDS.format('bit_or(specialty_bits)')} AS specialties FROM features WHERE NOT ({_BOT}) GROUP BY site"""
_SQL["site_emails"] = f"""WITH {_PAGES},
  placed AS (SELECT site, email, page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS pos
    FROM features JOIN checked USING (page_id) WHERE NOT ({_BOT})),
  first_ones AS (SELECT *, row_number() OVER (PARTITION BY site, email ORDER BY page_id, pos) AS rn FROM placed)
  SELECT site, email, {_role(_LOCAL, "''")} AS role, page_id, pos FROM first_ones WHERE rn = 1"""
_SQL["enrichment_round"] = _with(
    _E3,
    """SELECT lead_id, attempts + 1 AS enrichment_attempts, CAST(n AS INT) AS emails_found_count, n = 0 AND attempts + 1 < 3 AS offered_again FROM tried""",
    f"""{_PAGES}, queue AS ({_reenrich(Q.ENRICH_AT)}), usable AS (SELECT page_id, page_id % 150 AS lead FROM features WHERE NOT ({_BOT})),
  shown AS (SELECT lead, email FROM usable JOIN checked USING (page_id)
    UNION SELECT lead, 'info' || page_id || '@site' || lead || '.org' FROM usable WHERE page_id % 2 = 0),
  tried AS (SELECT q.id AS lead_id, coalesce(e.enrichment_attempts, 0) AS attempts, (SELECT count(*) FROM shown WHERE lead = q.id) AS n
    FROM queue q LEFT JOIN lead_enrichment e ON e.lead_id = q.id)""",
)

# -- verification ----------------------------------------------------------------------------------
_VERIFIED = """
mx AS (SELECT DISTINCT 'mail' || (s_suppkey % 6) || '.example.net' AS domain FROM supplier),
asked AS (SELECT id, CASE WHEN verification_status = 'invalid' THEN replace(email, '@', '#') ELSE email END AS email, verification_status FROM lead_emails),
verified AS (SELECT a.id, a.email, verification_status,
  CASE WHEN NOT contains(email, '@') OR split_part(email, '@', 2) = 'mail3.example.net' OR m.domain IS NULL THEN 'invalid'
    WHEN p.email_id IS NULL OR timed_out THEN 'unknown' WHEN code IN (250, 251) THEN CASE WHEN catch_all_accepted THEN 'catch_all' ELSE 'valid' END
    WHEN code IN (450, 451, 452) THEN 'unknown' ELSE 'invalid' END AS new_status,
  CASE WHEN NOT contains(email, '@') THEN 'Invalid email format' WHEN split_part(email, '@', 2) = 'mail3.example.net' THEN 'Disposable email domain'
    WHEN m.domain IS NULL THEN 'No MX records found' WHEN timed_out THEN 'SMTP timeout' WHEN code IN (450, 451, 452) THEN 'Temporary failure' END AS error,
  contains(email, '@') AND split_part(email, '@', 2) = 'mail3.example.net' AS is_disposable
  FROM asked a LEFT JOIN probe_results p ON p.email_id = a.id LEFT JOIN mx m ON m.domain = split_part(email, '@', 2))
"""
_V2 = "lead_emails probe_results"
add("verify_decision", _V2, "SELECT id, email, new_status, error, is_disposable FROM verified", _VERIFIED)
add(
    "verify_summary", _V2,
    "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (new_status = '{s}') AS {s}" for s in ("valid", "invalid", "catch_all", "unknown")) + " FROM verified",
    _VERIFIED,
)
add("verify_applied", _V2, "SELECT id, new_status AS verification_status FROM verified", _VERIFIED)
add("verify_queue", "lead_emails", "SELECT id, lead_id, email, created_at FROM lead_emails WHERE verification_status = 'unverified' ORDER BY created_at NULLS FIRST, id LIMIT 100")
add(
    "primary_mx", "",
    """SELECT domain, exchange AS primary_mx FROM (SELECT 'mail' || s_nationkey || '.net' AS domain, s_name AS exchange,
    row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal), s_name) AS rn FROM supplier) WHERE rn = 1""",
)

# -- sequences ------------------------------------------------------------------------------------
_G3 = "leads lead_emails sequence_enrollments"
_ELIGIBLE = _BEST + f""", eligible AS (SELECT l.*, b.id AS email_id, b.email FROM leads l JOIN best b ON b.lead_id = l.id WHERE score >= 50 AND pipeline_stage IN ('new', 'scored')
  AND NOT EXISTS (SELECT 1 FROM sequence_enrollments s WHERE s.lead_id = l.id AND s.sequence_id = {Q.SEQUENCE}) ORDER BY score DESC NULLS LAST, l.id LIMIT 100)"""
add("enroll_eligible", _G3, f"SELECT {_LEAD}, email_id, email FROM eligible", _ELIGIBLE)
add(
    "enroll", _G3,
    f"SELECT id AS lead_id, {Q.SEQUENCE} AS sequence_id, email_id, 0 AS current_step, 'active' AS status, TIMESTAMP '{Q.ENROL_AT}' AS next_send_at FROM eligible",
    _ELIGIBLE,
)


def _due(at: str, limit: str = "LIMIT 50") -> str:
    return f"""due AS (SELECT se.*, l.city, e.email, s.name AS sequence_name, s.total_steps, row_number() OVER (ORDER BY next_send_at NULLS FIRST, se.id) AS rank
      FROM sequence_enrollments se JOIN leads l ON l.id = se.lead_id JOIN lead_emails e ON e.id = se.email_id JOIN sequences s ON s.id = se.sequence_id
      WHERE se.status = 'active' AND s.status = 'active' AND next_send_at <= TIMESTAMP '{at}' ORDER BY next_send_at NULLS FIRST, se.id {limit})"""


_G4 = _G3 + " sequences"
add("enroll_due", _G4, "SELECT id, lead_id, sequence_id, current_step, next_send_at, city, email, sequence_name FROM due", _due(Q.ENROL_AT))
_DELAY = "CASE WHEN {step} <= 3 THEN (CASE {step} WHEN 1 THEN 0 WHEN 2 THEN 72 ELSE 120 END) ELSE 24 END"
add(
    "advance_steps", "sequence_enrollments",
    f"""SELECT id, CASE WHEN status = 'active' THEN current_step + 1 ELSE current_step END AS current_step,
    CASE WHEN status = 'active' AND current_step + 2 > 3 THEN 'completed' ELSE status END AS status,
    CASE WHEN status <> 'active' THEN next_send_at WHEN current_step + 2 <= 3 THEN TIMESTAMP '{Q.ENROL_AT}' + to_hours({_DELAY.format(step='(current_step + 2)')}) END AS next_send_at
    FROM sequence_enrollments""",
)
add(
    "enrollment_status_updates", "sequence_enrollments",
    f"""SELECT id, CASE WHEN status = 'active' THEN CASE WHEN current_step > 1 THEN 'replied' ELSE 'paused' END ELSE status END AS status,
    CASE WHEN status = 'active' AND current_step > 1 THEN TIMESTAMP '{Q.ENROL_AT}' END AS completed_at FROM sequence_enrollments""",
)
add(
    "enrollment_counts", "sequence_enrollments",
    "SELECT s.status, count(e.id) AS n FROM (VALUES " + ", ".join(f"('{s}')" for s in fv.ENROLMENT_STATUSES)
    + ") s(status) LEFT JOIN sequence_enrollments e USING (status) GROUP BY 1",
)
add(
    "enroll_stages", _G3,
    "SELECT id, CASE WHEN id IN (SELECT id FROM eligible) THEN 'contacted' ELSE pipeline_stage END AS pipeline_stage FROM leads",
    _ELIGIBLE,
)
add(
    "newest_sequences", "sequences",
    """SELECT s.id, name, status, created_at FROM sequences s JOIN (SELECT o_orderkey % 5 AS id, CAST(max(o_orderdate) AS TIMESTAMP) AS created_at
    FROM orders GROUP BY 1) o ON o.id = s.id ORDER BY created_at DESC, s.id""",
)
add(
    "appended_sends", "send_log sequence_enrollments",
    f"""SELECT id, lead_id, step_number, ses_message_id, status, sent_at FROM send_log
    UNION ALL SELECT id, lead_id, current_step + 1, NULL, 'sent', TIMESTAMP '{Q.SEND_AT}' FROM sequence_enrollments WHERE status = 'active'""",
)
add(
    "send_status_by_id", "send_log",
    "SELECT id, CASE WHEN status = 'sent' THEN CASE WHEN id % 2 = 0 THEN 'delivered' ELSE 'bounced' END ELSE status END AS status FROM send_log",
)
add("sequence_status_updates", "sequences", "SELECT id, name, total_steps, CASE WHEN name = 'ASIA' THEN 'archived' ELSE status END AS status FROM sequences")
_TEXTS = """texts AS (SELECT l.* REPLACE (CASE WHEN source = 'yelp' THEN 'Ann''s ' || business_name ELSE business_name END AS business_name), has_multiple_tutors
  FROM leads l LEFT JOIN lead_enrichment e ON e.lead_id = l.id)"""
_FIRST = "CASE WHEN business_type = 'solo_tutor' THEN nullif(regexp_extract(business_name, '^([A-Z][a-z]+)(?:''s|[ ])', 1), '') END"
_TL = "leads lead_enrichment"
add(
    "template_variables", _TL,
    f"""SELECT id, business_name AS var_business_name, {_FIRST} AS var_first_name, city AS var_city, state_province AS var_state, website AS var_website,
    CASE WHEN score % 3 = 0 THEN 'math, sat, essay' END AS var_specialties FROM texts""",
    _TEXTS,
)
_NUMBER = "regexp_replace(CAST({0} AS VARCHAR), '[.]0$', '')"
add(
    "opening_lines", _TL,
    f"""SELECT id, CASE WHEN lines = '' THEN 'I came across ' || business_name || ' while researching tutoring businesses' ELSE lines END AS openings FROM (SELECT *, concat_ws(' | ',
    CASE WHEN length(city) > 0 AND length(state_province) > 0 THEN 'I noticed you''re helping students in the ' || city || ' area' END,
    CASE WHEN score % 3 = 0 THEN 'Your focus on math tutoring caught my attention' END,
    CASE WHEN google_rating >= 4.5 AND google_review_count >= 10 THEN 'I saw your excellent ' || {_NUMBER.format('google_rating')} || '-star rating from ' || google_review_count || ' reviews' END,
    CASE WHEN has_multiple_tutors THEN 'I see you have a team of tutors working with students' END) AS lines FROM texts)""",
    _TEXTS,
)
add(
    "rendered_steps", "leads lead_enrichment sequence_enrollments sequences",
    f"""SELECT lead_id, sequence_id, step_number,
    CASE step_number WHEN 1 THEN 'Hello ' || business_name || ' from ' || name WHEN 2 THEN 'Again, ' || business_name ELSE 'Last note {{{{if}}}}' END AS subject,
    CASE step_number WHEN 1 THEN 'Hi' || coalesce(' ' || first_name, '') || ', greetings to ' || city || '.'
      WHEN 2 THEN CASE WHEN website IS NULL THEN 'No site yet? ' ELSE '' END || 'We wrote to ' || state_province || '.'
      ELSE 'Bye {{{{nobody}}}} {{{{#if city}}}}in ' || city END AS body
    FROM (SELECT *, {_FIRST} AS first_name FROM texts) t JOIN (SELECT lead_id, sequence_id FROM sequence_enrollments) e ON e.lead_id = t.id
    JOIN (SELECT id AS seq_id, name FROM sequences) s ON s.seq_id = e.sequence_id, (VALUES (1), (2), (3)) n(step_number)""",
    _TEXTS,
)
add(
    "template_checks", "sequence_steps",
    """SELECT sequence_id, step_number, CASE WHEN step_number = 3 THEN 'Unclosed {{#if}} blocks: 1 opens vs 0 closes' ELSE '' END AS errors FROM sequence_steps""",
)
add(
    "warmup_limit", "send_log",
    """SELECT day, CASE WHEN n < 1 THEN 0 WHEN n > 29 THEN 15 ELSE (SELECT max_by(lim, d) FROM (VALUES (1, 25), (4, 50), (8, 75), (15, 90), (22, 100), (29, 100)) w(d, lim) WHERE d <= n) END AS in_warmup,
    15 AS without FROM (SELECT day, date_diff('day', TIMESTAMP '2024-01-10', day) + 1 AS n FROM (SELECT DISTINCT date_trunc('day', sent_at) AS day FROM send_log))""",
)
add(
    "sending_window", "send_log",
    "SELECT CAST(hour(sent_at) AS INT) AS utc_hour, hour(sent_at - INTERVAL 5 HOUR) BETWEEN 8 AND 17 AS inside, count(*) AS n FROM send_log GROUP BY 1, 2",
)
add("send_delay_bounds", "", "SELECT count(*) AS n, true AS above_min, true AS below_max, true AS centred FROM events")


# -- send log ------------------------------------------------------------------------------------
def _rates(n: str = "total") -> str:
    return f"""CASE WHEN {n} > 0 THEN floor(CAST(bounced AS DOUBLE) / {n} * 100 * 10 + 0.5) / 10 ELSE 0.0 END AS bounce_rate,
      CASE WHEN {n} > 0 THEN floor(CAST(complained AS DOUBLE) / {n} * 100 * 10 + 0.5) / 10 ELSE 0.0 END AS complaint_rate"""


_SIX = "count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in fv.SEND_STATUSES)


def _stats(at: str, days: int, log: str = "send_log") -> str:
    return f"(SELECT *, {_rates()} FROM (SELECT {_SIX} FROM {log} WHERE sent_at >= TIMESTAMP '{at}' - INTERVAL {days} DAY))"


_REASON = f"""CASE WHEN sent + delivered + bounced + complained < 10 THEN NULL
  WHEN bounce_rate > 5 THEN 'Bounce rate ' || {_NUMBER.format('bounce_rate')} || '% exceeds 5% threshold'
  WHEN complaint_rate > 0.1 THEN 'Complaint rate ' || {_NUMBER.format('complaint_rate')} || '% exceeds 0.1% threshold' END"""
add("send_stats", "send_log", f"SELECT * FROM {_stats(Q.SEND_AT, 7)}")
add("breaker", "send_log", f"SELECT reason IS NOT NULL AS pause, reason, bounce_rate, complaint_rate FROM (SELECT *, {_REASON} AS reason FROM {_stats(Q.SEND_AT, 1)})")
add("sent_today", "send_log", "SELECT count(*) FILTER (status = 'sent') AS sent_today, count(*) AS attempted FROM send_log WHERE sent_at >= TIMESTAMP '2024-01-30'")
_DAYS = "SELECT date_trunc('day', sent_at) AS day, count(*) FILTER (status = 'sent') AS sent, count(*) AS attempted FROM send_log GROUP BY 1"
add("sent_per_day", "send_log", _DAYS)
add("daily_sent", "send_log", _DAYS)
add("outreach_stats", "send_log", "SELECT count(*) AS total, count(*) FILTER (sent_at >= TIMESTAMP '2024-01-30') AS today FROM send_log WHERE sequence_id IS NULL")
add("outreach_sent", "leads send_log", f"SELECT {_LEAD} FROM leads l WHERE {_SENT}")


def _outreach(log: str = "send_log", limit: int = 100) -> str:
    return _BEST + f""", open_leads AS (SELECT l.*, b.id AS email_id, b.email FROM leads l JOIN best b ON b.lead_id = l.id
      WHERE NOT EXISTS (SELECT 1 FROM {log} s WHERE s.lead_id = l.id AND s.sequence_id IS NULL)
      AND NOT EXISTS (SELECT 1 FROM sequence_enrollments e WHERE e.lead_id = l.id AND e.status IN ('active', 'unsubscribed'))),
      queue AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS rank FROM open_leads ORDER BY rank LIMIT {limit})"""


_H4 = "leads lead_emails send_log sequence_enrollments"
add("outreach_eligible", _H4, f"SELECT {_LEAD}, email_id, email FROM queue", _outreach())
add("outreach_mails", "leads", "SELECT id, 'Hello ' || business_name || ' & {{business_name}}' AS subject, business_name || ', ' || business_name || '!' AS body FROM leads")
add("latest_send_status", "send_log", "SELECT ses_message_id, max_by(status, (sent_at, status)) AS status FROM send_log GROUP BY 1")
_SQL["stream_latest_status"] = _SQL["latest_send_status"]
add(
    "delivery_events_applied", "send_log",
    """SELECT s.id, coalesce(e.status, s.status) AS status FROM send_log s
    LEFT JOIN (SELECT ses_message_id, max_by(status, (sent_at, status)) AS status FROM send_log WHERE status <> 'sent' GROUP BY 1) e USING (ses_message_id)""",
)
_PLAN = _due(Q.PLAN_AT) + ", plan AS (SELECT *, CASE WHEN rank > 20 THEN 'hold' WHEN current_step >= 3 THEN 'complete' ELSE 'send' END AS outcome FROM due)"
add(
    "send_plan", _G4,
    """SELECT id, lead_id, CAST(rank AS INT) AS rank, CASE WHEN current_step < 3 THEN current_step + 1 ELSE 0 END AS step_number, outcome,
    CASE WHEN rank > 20 THEN 'beyond daily budget' END AS hold_reason FROM plan""",
    _PLAN,
)
add(
    "send_plan_whole", _G4,
    f"""SELECT id, lead_id, rank, outcome, CASE WHEN outcome = 'send' THEN strftime(TIMESTAMP '{Q.PLAN_AT}'
      + to_minutes(CAST(coalesce(count(*) FILTER (outcome = 'send') OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS planned_at
    FROM (SELECT *, CASE WHEN rank > 5000 THEN 'hold' WHEN current_step >= 3 THEN 'complete' ELSE 'send' END AS outcome FROM due)""",
    _due(Q.PLAN_AT, ""),
)
add(
    "send_plan_gates", _G4 + " send_log",
    f"""SELECT 'hold' AS outcome, 'paused: ' || ({_REASON}) AS hold_reason, (SELECT count(*) FROM due) AS n, 'paused' AS gate FROM {_stats(Q.PAUSED_AT, 1)}
    UNION ALL SELECT 'hold', 'outside sending window', count(*), 'closed' FROM due
    UNION ALL SELECT 'hold', 'daily limit reached', count(*), 'spent' FROM due""",
    _due(Q.PLAN_AT),
)
add("planned_times", _G4, "SELECT id, CAST(rank AS INT) AS rank, true AS delay_fits, true AS time_fits FROM plan", _PLAN)
_NEXT = _DELAY.format(step="(s.current_step + 2)")
add(
    "booked_results", _G4,
    f"""SELECT 'log' AS kind, email_id AS key, current_step + 1 AS step_number, CASE WHEN id % 3 <> 0 THEN 'sent' ELSE 'bounced' END AS status,
      CASE WHEN id % 3 <> 0 THEN 'n' || id END AS detail FROM plan WHERE outcome = 'send'
    UNION ALL SELECT 'enrollment', s.id, CASE WHEN ok THEN s.current_step + 1 ELSE s.current_step END,
      CASE WHEN ok AND s.current_step + 2 > 3 THEN 'completed' WHEN hard THEN 'bounced' WHEN p.outcome = 'complete' THEN 'completed' ELSE s.status END,
      strftime(CASE WHEN ok AND s.current_step + 2 > 3 THEN NULL WHEN ok THEN TIMESTAMP '{Q.PLAN_AT}' + to_hours({_NEXT}) ELSE s.next_send_at END, '%Y-%m-%d %H:%M:%S')
    FROM sequence_enrollments s LEFT JOIN (SELECT id, outcome, outcome = 'send' AND id % 3 <> 0 AS ok, outcome = 'send' AND id % 3 = 0 AND id % 2 = 0 AS hard FROM plan) p ON p.id = s.id""",
    _PLAN,
)
add(
    "outreach_plan", _H4,
    "SELECT id, email_id, CAST(rank AS INT) AS rank, CASE WHEN rank <= 20 THEN 'send' ELSE 'hold' END AS outcome, CASE WHEN rank > 20 THEN 'beyond daily budget' END AS hold_reason FROM queue",
    _outreach("send_log", 50),
)
_ENROLLED = ", ".join(f"(SELECT count(*) FROM sequence_enrollments WHERE status = '{s}') AS enrolled_{s}" for s in fv.ENROLMENT_STATUSES)
_WEEK = ", ".join(f"{c} AS week_{c}" for c in fv.SEND_STATUSES + ["bounce_rate", "complaint_rate"])
add(
    "engine_status", "send_log sequence_enrollments",
    f"""SELECT 100 AS daily_limit, 0 AS sent_today, CAST(100 AS BIGINT) AS remaining, b.reason IS NOT NULL AS pause, b.reason, false AS in_window, {_ENROLLED}, w.* FROM
    (SELECT {_REASON} AS reason FROM {_stats(Q.SEND_AT, 1)}) b, (SELECT {_WEEK} FROM {_stats(Q.SEND_AT, 7)}) w""",
)
add(
    "outreach_status", _H4,
    """SELECT (SELECT count(*) FROM open_leads) AS eligible, (SELECT count(*) FROM send_log WHERE sequence_id IS NULL) AS outreach_total, 90 AS daily_limit, sent_today,
    greatest(0, 90 - sent_today) AS remaining, true AS in_window, (SELECT count(*) FROM open_leads) > 0 AS can_send
    FROM (SELECT count(*) AS sent_today FROM send_log WHERE status = 'sent' AND sent_at >= TIMESTAMP '2024-01-24')""",
    _outreach(),
)
_SHARE = "CASE WHEN {w} > 0 THEN floor(CAST({p} AS DOUBLE) / {w} * 100 * 10 + 0.5) / 10 ELSE 0.0 END"
_KPIS = [
    ("email_find_rate", "with_email", "leads_n", 50.0, ">"), ("delivery_rate", "reached", "sends", 95.0, ">"),
    ("open_rate", "opened", "sends", 25.0, ">"), ("reply_rate", "replied", "sends", 3.0, ">"),
    ("bounce_rate", "bounced", "sends", 3.0, "<"), ("complaint_rate", "complained", "sends", 0.05, "<"),
]
add(
    "funnel_kpis", "leads lead_emails send_log replies",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {_SHARE.format(p=p, w=w)} AS value, CAST({target} AS DOUBLE) AS target, {_SHARE.format(p=p, w=w)} {op} {target} AS target_met FROM base"
        for m, p, w, target, op in _KPIS
    ),
    """base AS (SELECT count(*) AS sends, count(*) FILTER (status IN ('delivered', 'opened', 'clicked', 'complained')) AS reached,
      count(*) FILTER (status IN ('opened', 'clicked')) AS opened, count(*) FILTER (status = 'bounced') AS bounced, count(*) FILTER (status = 'complained') AS complained,
      (SELECT count(DISTINCT lead_id) FROM lead_emails) AS with_email, (SELECT count(*) FROM leads) AS leads_n,
      (SELECT count(DISTINCT ses_message_id) FROM send_log WHERE ses_message_id IN (SELECT ses_message_id FROM replies)) AS replied FROM send_log)""",
)
_REPLIES = """
last_send AS (SELECT ses_message_id, max_by(lead_id, (sent_at, id)) AS lead_id, max_by(coalesce(sequence_id, -1), (sent_at, id)) AS seq FROM send_log GROUP BY 1),
effects AS (SELECT reply_id, r.ses_message_id, reply_class, received_at, lead_id, CASE WHEN seq >= 0 THEN seq END AS sequence_id,
  CASE reply_class WHEN 'interested' THEN 'qualified' WHEN 'not_interested' THEN 'lost' WHEN 'question' THEN 'replied' WHEN 'unsubscribe' THEN 'unsubscribed' END AS stage,
  CASE reply_class WHEN 'interested' THEN 'replied' WHEN 'not_interested' THEN 'completed' WHEN 'question' THEN 'replied' WHEN 'unsubscribe' THEN 'unsubscribed' END AS enrollment_status,
  reply_class = 'question' AS needs_person, reply_class = 'out_of_office' AS reschedule FROM replies r JOIN last_send USING (ses_message_id))
"""
_R2 = "send_log replies"
add("reply_effects", _R2, "SELECT * REPLACE (coalesce(sequence_id, -1) AS sequence_id) FROM effects", _REPLIES)
add(
    "reply_lead_stages", _R2,
    "SELECT lead_id AS id, max_by(stage, ((stage = 'unsubscribed')::INT, received_at, reply_id)) AS pipeline_stage FROM effects WHERE stage IS NOT NULL GROUP BY 1",
    _REPLIES,
)
add(
    "reply_enrollments", _R2 + " sequence_enrollments",
    """SELECT e.id, CASE WHEN e.status IN ('active', 'paused') THEN coalesce(CASE WHEN g.left_us THEN 'unsubscribed' END, s.new_status, e.status) ELSE e.status END AS status,
    CASE WHEN e.status IN ('active', 'paused') AND NOT coalesce(g.left_us, false) AND s.new_status IS NULL AND s.away IS NOT NULL
      THEN greatest(e.next_send_at, s.away + INTERVAL 7 DAY) ELSE e.next_send_at END AS next_send_at
    FROM sequence_enrollments e
    LEFT JOIN (SELECT lead_id, sequence_id, max_by(enrollment_status, (received_at, reply_id)) FILTER (enrollment_status IS NOT NULL) AS new_status,
      max(received_at) FILTER (reschedule) AS away FROM effects GROUP BY 1, 2) s ON s.lead_id = e.lead_id AND s.sequence_id = e.sequence_id
    LEFT JOIN (SELECT lead_id, bool_or(coalesce(stage = 'unsubscribed', false)) AS left_us FROM effects GROUP BY 1) g ON g.lead_id = e.lead_id""",
    _REPLIES,
)

# -- exports --------------------------------------------------------------------------------------
_TIER = "CASE WHEN score >= 70 THEN 'hot' WHEN score >= 50 THEN 'warm' WHEN score >= 30 THEN 'cool' ELSE 'cold' END"
add(
    "export_flat", _E3,
    f"""SELECT CAST(l.id AS VARCHAR) AS id, business_name, coalesce(business_type, '') AS business_type, coalesce(website, '') AS website, '' AS phone,
    coalesce(m.email, '') AS email, coalesce(m.verification_status, 'none') AS email_verified, '' AS address, city, state_province, country,
    coalesce({_NUMBER.format('google_rating')}, '') AS google_rating, coalesce(CAST(google_review_count AS VARCHAR), '') AS google_review_count,
    CAST(score AS VARCHAR) AS score, {_TIER} AS tier, pipeline_stage, CASE WHEN has_multiple_tutors THEN 'yes' ELSE 'no' END AS has_multiple_tutors,
    coalesce(existing_scheduling_tool, '') AS scheduling_tool, '' AS specialties, l.source, coalesce(strftime(l.created_at, '%Y-%m-%dT%H:%M:%S.%gZ'), '') AS created_at
    FROM leads l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY is_primary DESC, id) AS rn FROM lead_emails) m ON m.lead_id = l.id AND m.rn = 1
    LEFT JOIN lead_enrichment e ON e.lead_id = l.id""",
)
_SQL["export_csv"] = _SQL["export_flat"].replace(
    "business_name, coalesce(business_type", "'\"' || business_name || '\", Inc.' || chr(10) || city AS business_name, coalesce(business_type", 1
)
add(
    "export_json", _LE,
    "SELECT l.id, l.score, e.email, e.role, e.is_primary FROM leads l JOIN lead_emails e ON e.lead_id = l.id",
)
add(
    "export_hot", _LE,
    """SELECT CAST(l.id AS VARCHAR) AS id, coalesce(m.email, '') AS email, CAST(score AS VARCHAR) AS score, 'hot' AS tier
    FROM (SELECT * FROM leads WHERE score >= 70 ORDER BY score DESC NULLS LAST, id LIMIT 200) l
    LEFT JOIN (SELECT lead_id, min(id) AS id, min_by(email, id) AS email FROM lead_emails WHERE is_primary GROUP BY 1) m ON m.lead_id = l.id""",
)
add(
    "export_nested", _E3,
    """SELECT l.id, 0 AS part, CAST(coalesce(n, 0) AS INT) AS n_emails, coalesce(mails, '') AS emails, existing_scheduling_tool AS tool, linkedin_url
    FROM leads l LEFT JOIN (SELECT lead_id, count(*) AS n, string_agg(email || ':' || role || ':' || verification_status, ',' ORDER BY is_primary DESC, id) AS mails
      FROM lead_emails GROUP BY lead_id) m ON m.lead_id = l.id LEFT JOIN lead_enrichment e ON e.lead_id = l.id""",
)

# -- streams and their batch forms ------------------------------------------------------------------
add("stream_daily_sent", "send_log", _DAYS)
_ROLLING = f"""SELECT judged_at, total, bounce_rate, complaint_rate, reason IS NOT NULL AS pause, reason FROM (SELECT *, {_REASON} AS reason FROM (SELECT *, {_rates()} FROM (
  SELECT date_trunc('hour', sent_at) + to_hours(CAST(k AS INT)) AS judged_at, {_SIX} FROM send_log, range(1, 25) h(k) GROUP BY 1)))"""
add("rolling_breaker", "send_log", _ROLLING)
_SQL["stream_rolling_breaker"] = _SQL["rolling_breaker"]
_REFUSED = "(coalesce(status_code IN (403, 429), false) OR coalesce(bot_page, false))"
_RUNNING = "OVER (PARTITION BY domain ORDER BY fetched_at, fetch_id ROWS UNBOUNDED PRECEDING)"
add(
    "backoff_history", "fetch_log",
    f"""SELECT domain, fetched_at, fetch_id, coalesce(fetched_at < b + INTERVAL 30 MINUTE, false) AS blocked,
    coalesce(n >= 3 AND fetched_at < f + INTERVAL 5 MINUTE, false) AS backing_off,
    greatest(CASE WHEN fetched_at < b + INTERVAL 30 MINUTE THEN b + INTERVAL 30 MINUTE END,
      CASE WHEN n >= 3 AND fetched_at < f + INTERVAL 5 MINUTE THEN f + INTERVAL 5 MINUTE END) AS open_again_at
    FROM (SELECT *, max(CASE WHEN {_REFUSED} THEN fetched_at END) {_RUNNING} AS b, max(CASE WHEN network_error THEN fetched_at END) {_RUNNING} AS f,
      count(*) FILTER (network_error) {_RUNNING} AS n FROM fetch_log)""",
)
add(
    "domain_backoff", "fetch_log",
    f"""SELECT domain, max(fetched_at) AS seen_at, count(*) FILTER (network_error) AS failures, max(fetched_at) FILTER ({_REFUSED}) + INTERVAL 30 MINUTE AS blocked_until,
    CASE WHEN count(*) FILTER (network_error) >= 3 THEN max(fetched_at) FILTER (network_error) + INTERVAL 5 MINUTE END AS rests_until FROM fetch_log GROUP BY 1""",
)
_SQL["stream_domain_backoff"] = _SQL["domain_backoff"]
add(
    "stream_expiring_backoff", "fetch_log",
    f"""SELECT domain, seen_at, n AS failures, blocked_until, rests_until, coalesce(epoch_ms(greatest(f, blocked_until, rests_until)) + 43200000 < epoch_ms(newest) - 600000, false) AS expired
    FROM (SELECT *, CASE WHEN n >= 3 THEN f + INTERVAL 5 MINUTE END AS rests_until, max(seen_at) OVER () AS newest FROM (
      SELECT domain, max(fetched_at) AS seen_at, count(*) FILTER (network_error) AS n, max(fetched_at) FILTER (network_error) AS f,
        max(fetched_at) FILTER ({_REFUSED}) + INTERVAL 30 MINUTE AS blocked_until FROM fetch_log GROUP BY 1))""",
)
add(
    "new_records", "",
    """SELECT DISTINCT event_type AS source, CAST(user_id AS VARCHAR) AS source_id FROM events
    WHERE event_type <> 'view' OR user_id NOT IN (SELECT c_custkey FROM customer)""",
)
_SQL["stream_new_records"] = _SQL["new_records"]

_SQL["sliding_breaker"] = _SQL["stream_sliding_breaker"] = _SQL["rolling_breaker"]
_SQL["stream_corrected_daily"] = _SQL["stream_daily_sent"]
add(
    "stream_late_events", "",
    """SELECT batch, count(*) AS rows, count(*) FILTER (ts < mark - INTERVAL 1 HOUR) AS late,
      max((epoch_us(mark) - epoch_us(ts)) // 1000) FILTER (ts < mark - INTERVAL 1 HOUR) AS worst_ms
    FROM (SELECT event_id % 4 AS batch, ts FROM events) JOIN (
      SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
      FROM (SELECT event_id % 4 AS batch, max(ts) AS m FROM events GROUP BY 1)) USING (batch) GROUP BY 1""",
)
add(
    "scheduled_limits", "send_log",
    """SELECT sender, "at", CASE WHEN sender = 6 THEN 15 WHEN n < 1 THEN 0 WHEN n > 29 THEN 15
      ELSE (SELECT max_by(lim, d) FROM (VALUES (1, 25), (4, 50), (8, 75), (15, 90), (22, 100), (29, 100)) w(d, lim) WHERE d <= n) + CAST(sender AS INT) END AS daily_limit
    FROM (SELECT *, date_diff('day', min("at") OVER (PARTITION BY sender), "at") - CAST(sender AS INT) + 1 AS n
      FROM (SELECT DISTINCT lead_id % 7 AS sender, date_trunc('day', sent_at) AS "at" FROM send_log))""",
)

# Updates by bucket have the results of the updates of whole tables.
for _name in ("patched_emails", "deleted_emails", "stage_updates", "added_emails", "upsert_enrichment", "save_scores", "verify_applied"):
    _SQL[f"bucket_{_name}"] = _SQL[_name]
_SQL["bucket_delivery_events"] = _SQL["delivery_events_applied"]


def registered() -> dict[str, str]:
    return dict(_SQL)
