"""Fixed values.

Everything here has to equal the published behaviour for results to match, and is stated
plainly in its natural order. Order matters in the lists that are searched "first wins".
"""

# --- business type of a raw place record -------------------------------------------
FRANCHISE_WORDS = ["kumon", "mathnasium", "sylvan", "huntington", "tutor doctor", "club z"]
ONLINE_WORDS = ["online", "virtual", "remote"]
AGENCY_WORDS = [
    "center", "centre", "academy", "institute", "learning", "school", "services", "group", "agency",
]

# --- leads that are never enriched ---------------------------------------------------
SKIPPED_FRANCHISES = [
    "kumon", "sylvan", "mathnasium", "huntington", "oxford learning", "tutor doctor", "club z",
]

# --- page features -------------------------------------------------------------------
SCHEDULING_TOOLS = [
    "calendly", "acuity", "schedulicity", "setmore", "square appointments", "booksy", "timely",
    "vcita", "appointy", "picktime", "simplybook", "tutor cruncher", "tutorcruncher", "teachworks",
    "my tutor source", "tutorbird", "youcanbook", "doodle", "book.me", "hubspot meetings",
]
STAFF_PHRASES = [
    "our tutors", "our team", "meet our", "staff", "instructors", "educators", "teachers",
    "specialists", "team members", "our experts", "faculty",
]
SPECIALTIES = [
    "math", "mathematics", "algebra", "geometry", "calculus", "reading", "writing", "english",
    "essay", "science", "physics", "chemistry", "biology", "sat", "act", "gre", "gmat", "lsat",
    "mcat", "spanish", "french", "mandarin", "chinese", "coding", "programming",
    "computer science", "elementary", "middle school", "high school", "college", "test prep",
    "homework help", "study skills",
]
MAX_SPECIALTIES = 10
MAX_EMAILS_PER_SITE = 2
MAX_PAGES_PER_SITE = 12
MAX_SITEMAP_URLS = 5
CONTEXT_LENGTH = 200

BOT_PAGE_MARKERS = [
    "Just a moment...", "Checking your browser", "cf_chl_opt", "challenge-platform", "_cf_chl",
    "Attention Required! | Cloudflare", "Access denied", "Please verify you are a human", "captcha",
]

# --- e-mail addresses ----------------------------------------------------------------
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
BLOCKED_DOMAINS = [
    "example.com", "test.com", "localhost", "domain.com", "email.com", "your-email.com",
    "yoursite.com", "website.com", "company.com", "sentry.io", "wixpress.com", "squarespace.com",
    "wordpress.com", "w3.org", "schema.org", "googleapis.com", "gravatar.com", "cloudflare.com",
]
ASSET_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js", "json", "xml", "pdf", "zip",
]
DISPOSABLE_DOMAINS = [
    "mailinator.com", "guerrillamail.com", "tempmail.com", "10minutemail.com", "throwaway.email",
    "fakeinbox.com", "trashmail.com", "yopmail.com", "getnada.com", "temp-mail.org",
    "dispostable.com", "maildrop.cc",
]
OWNER_CONTEXT = "owner|founder|ceo|director|principal"
ADMIN_CONTEXT = "admin|manager|coordinator|operations"
INFO_PREFIXES = ["info", "hello", "contact", "inquiries", "support", "help", "office"]
RANK_GENERIC_PREFIXES = [
    "info", "hello", "contact", "support", "help", "admin", "office", "sales", "team", "mail", "email",
]
RANK_FRONT_DESK_PREFIXES = ["info", "hello", "contact"]
RANK_FUNCTIONAL_PREFIXES = [
    "support", "help", "sales", "billing", "hr", "jobs", "careers", "noreply", "no-reply",
]

# --- contact links -------------------------------------------------------------------
SOCIAL_LINK = "facebook|linkedin|twitter|instagram|youtube|tiktok"
# Whole words of letters, digits and underscores.
CONTACT_LINK_WORDS = (
    "contact|about|team|staff|people|connect|reach|get.?in.?touch|inquiry|support|founder"
    "|owner|leadership|meet|principal"
)
NAV_LINK_WORDS = "meet|our|story|approach|learn|tutor|work|welcome|hire|bio|profile"
SITEMAP_LINK = "contact|about|team|staff|people|founder|owner"
# (pattern, points) on the lower-cased link text and on the link target
LINK_TEXT_POINTS = [
    ("founder|owner|principal|director", 35),
    ("contact|email|reach", 25),
    ("about|team|staff", 15),
    ("meet", 20),
]
LINK_TARGET_POINTS = [
    ("/contact", 20),
    ("/about", 10),
    ("/team|/staff|/people", 15),
    ("/founder|/owner|/leadership", 30),
]
NAV_POINTS = 30
FOOTER_POINTS = 20

# --- page regions, as (kind, value) selectors in search order --------------------------
NAV_REGIONS = [
    ("tag", "nav"), ("tag", "header"), ("class", "nav"), ("class", "navigation"), ("id", "nav"),
    ("role", "navigation"),
]
LINK_FOOTER_REGIONS = [("tag", "footer"), ("class", "footer"), ("id", "footer"), ("role", "contentinfo")]
FOOTER_REGIONS = [
    ("tag", "footer"), ("id", "footer"), ("class", "footer"), ("role", "contentinfo"),
    ("class", "site-footer"), ("class", "page-footer"),
]
CONTACT_REGIONS = [
    ("id", "contact"), ("class", "contact"), ("class*", "contact"), ("id", "get-in-touch"),
    ("class", "get-in-touch"), ("class*", "email"), ("id*", "email"), ("class*", "reach"),
    ("id*", "contact"),
]
META_EMAIL_SELECTORS = [
    ("name", "email"), ("property", "og:email"), ("name", "contact:email"), ("itemprop", "email"),
]
DATA_EMAIL_ATTRIBUTES = ["data-email", "data-mail", "data-contact-email"]
RECIPIENT_INPUTS = ["_to", "recipient", "_replyto"]

# --- scoring and sending -----------------------------------------------------------------
TIERS = [("hot", 70, "Hot Lead"), ("warm", 50, "Warm Lead"), ("cool", 30, "Cool Lead")]
LOWEST_TIER = ("cold", "Cold Lead")
ENROL_MIN_SCORE = 50
REENRICH_MAX_ATTEMPTS = 3
REENRICH_AFTER_DAYS = 30
DEFAULT_STEP_DELAY_HOURS = 24
WARMUP_SCHEDULE = [(1, 25), (4, 50), (8, 75), (15, 90), (22, 100), (29, 100)]
BASE_DAILY_LIMIT = 15
MIN_DELAY_MS = 45_000
MAX_DELAY_MS = 240_000
WINDOW_START_HOUR = 8
WINDOW_END_HOUR = 18
SENDING_TIMEZONE = "America/New_York"
BREAKER_MIN_SENDS = 10
BREAKER_BOUNCE_PERCENT = 5.0
BREAKER_COMPLAINT_PERCENT = 0.1
BOT_BLOCK_MINUTES = 30
TIMEOUT_BACKOFF_MINUTES = 5
TIMEOUTS_BEFORE_BACKOFF = 3

# --- opening lines; the last one is used when none of the others applies -------------------
OPENING_PLACE = "I noticed you're helping students in the {city} area"
OPENING_SPECIALTY = "Your focus on {specialty} tutoring caught my attention"
OPENING_REVIEWS = "I saw your excellent {rating}-star rating from {reviews} reviews"
OPENING_STAFF = "I see you have a team of tutors working with students"
OPENING_OTHER = "I came across {name} while researching tutoring businesses"
OPENING_MIN_RATING = 4.5
OPENING_MIN_REVIEWS = 10
FIRST_NAME_PATTERN = r"^([A-Z][a-z]+)(?:'s|\s)"

# --- status values -----------------------------------------------------------------------
BUSINESS_TYPES = ["agency", "solo_tutor", "franchise", "online_platform"]
COUNTRIES = ["US", "CA"]
LEAD_SOURCES = ["google_maps", "yelp", "directory", "manual"]
EMAIL_ROLES = ["owner", "admin", "info", "unknown"]
VERIFICATION_STATUSES = ["valid", "invalid", "catch_all", "unknown", "unverified"]
EMAIL_SOURCES = ["scraped", "pattern_guess", "manual"]
SEQUENCE_STATUSES = ["active", "paused", "archived"]
ENROLMENT_STATUSES = ["active", "paused", "completed", "replied", "bounced", "unsubscribed"]
TERMINAL_ENROLMENT_STATUSES = ["completed", "replied", "bounced", "unsubscribed"]
SEND_STATUSES = ["sent", "delivered", "bounced", "complained", "opened", "clicked"]
RUN_STATUSES = ["running", "completed", "failed"]

# --- funnel targets, in percent ------------------------------------------------------------
FUNNEL_TARGETS = {
    "email_find_rate": 50.0,
    "delivery_rate": 95.0,
    "open_rate": 25.0,
    "reply_rate": 3.0,
    "bounce_rate": 3.0,
    "complaint_rate": 0.05,
}

# --- suffixes of two labels under which different owners register names ----------------
SHARED_SUFFIXES = [
    "ab.ca", "bc.ca", "mb.ca", "nb.ca", "nf.ca", "nl.ca", "ns.ca", "nt.ca", "nu.ca", "on.ca", "pe.ca", "qc.ca",
    "sk.ca", "yk.ca", "gc.ca", "co.uk", "org.uk", "me.uk", "com.au", "net.au", "org.au", "co.nz",
    "blogspot.com", "business.site", "github.io", "godaddysites.com", "google.com", "jimdofree.com",
    "myshopify.com", "netlify.app", "square.site", "squarespace.com", "strikingly.com", "tumblr.com",
    "webflow.io", "webnode.com", "weebly.com", "wixsite.com", "wordpress.com",
]
