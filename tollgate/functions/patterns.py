"""Fixed values the operators must share with the service they audit.

Patterns are written once in the subset of regex syntax that Java (Spark) and
RE2 (the DuckDB oracle) read the same way: no look-around, no back-references.
"""

# ---- fixed values: identifiers -------------------------------------------------
# Device ids: 16 to 64 characters of letters, digits and '-'.
DEVICE_ID_RE = r"^[a-zA-Z0-9-]{16,64}$"
# Longest key or device id accepted before any pattern test.
MAX_ID_LENGTH = 64
# Checkout-session ids: this prefix and 20 to 128 characters.
SESSION_ID_PREFIX, SESSION_ID_MIN, SESSION_ID_MAX = "cs_", 20, 128
# Licence-key pattern is a parameter; this is the one the fixture views use.
FIXTURE_KEY_RE = r"^KEY-[0-9]{8}$"

# ---- fixed values: licence domain ----------------------------------------------
STATUS_ACTIVE, STATUS_CANCELLED, STATUS_SUSPENDED, STATUS_EXPIRED = (
    "active", "cancelled", "suspended", "expired")
# Statuses that hold a seat on a node and count as "active" for gauges.
SEAT_STATUSES = ("active", "cancelled")
# Sentinel stored in the key-id column while a key is being created.
PENDING = "pending"
# A pending claim older than this is considered abandoned.
CLAIM_TTL_MINUTES = 5
# Minimum time between two device transfers of one licence.
TRANSFER_COOLDOWN_HOURS = 72
# Processed-event ids are remembered this long.
EVENT_RETENTION_DAYS = 7
# Email retry queue: give up after this many attempts; wait (minutes) after
# attempt 0, 1, and any later one; the first wait, at insert, is 5 minutes.
RETRY_MAX_ATTEMPTS = 3
RETRY_BACKOFF_MINUTES = (15, 60)
RETRY_BACKOFF_DEFAULT_MINUTES = 60
# Consecutive upstream failures that open the breaker.
FAILURE_RUN_THRESHOLD = 5
# Default capacity of a node.
DEFAULT_MAX_KEYS = 1000

# ---- fixed values: metrics -----------------------------------------------------
# Request-duration histogram bucket upper bounds (seconds).
REQUEST_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
# Upstream-call histogram bucket upper bounds (seconds).
UPSTREAM_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
# Rate-limit windows: (name, requests allowed, per seconds).
RATE_LIMITS = (("api", 30, 60), ("license", 10, 60), ("checkout", 5, 60))
# Route label used when no route matched.
UNMATCHED_ROUTE = "unmatched"

# ---- fixed values: site audit --------------------------------------------------
SUPPORTED_LANGS = ("en", "ar", "hi", "fr", "es", "tr", "ru")
RTL_LANGS = ("ar",)
LINK_SKIP_PREFIXES = ("/downloads/", "/api/")
REQUIRED_OG = ("og:title", "og:description", "og:url", "og:type", "og:site_name", "og:image")
REQUIRED_CARD = ("twitter:card", "twitter:title", "twitter:description", "twitter:image")
REQUIRED_JSONLD_TYPES = ("Article", "FAQPage", "BreadcrumbList")
CHECKOUT_PLANS = ("vpn", "security_vpn")
DOWNLOAD_PAGE_SKIP = "vpn-download"
RTL_STYLESHEET = "/css/rtl.css"

# Extraction patterns (case-insensitive where the audit is).
RE_DOCTYPE_PREFIX = "<!doctype html>"
RE_HTML_LANG = r'<html[^>]+lang="[^"]+"'
RE_HTML_LANG_VALUE = r'<html[^>]+lang="([^"]+)"'
RE_HTML_DIR_VALUE = r'<html[^>]+dir="([^"]+)"'
RE_CHARSET = r'(?i)charset="?UTF-8"?'
RE_VIEWPORT = r'<meta[^>]+name="viewport"'
RE_TITLE = r"(?i)<title[^>]*>([^<]*)</title>"
RE_CANONICAL = r'<link rel="canonical"'
RE_CANONICAL_HREF = r'<link rel="canonical" href="([^"]*)"'
RE_HREF = r'(?i)<a[^>]+href="([^"]*)"'
RE_SRC = r'(?i)<(?:img|script|source|iframe)[^>]+src="([^"]*)"'
RE_SRCSET = r'(?i)<(?:img|source)[^>]+srcset="([^"]*)"'
RE_JSONLD = r'(?is)<script type="application/ld\+json">(.*?)</script>'
RE_HREFLANG = r'(?i)<link rel="alternate" hreflang="([^"]*)" href="([^"]*)"\s*/?>'


def checkout_pattern(handler: str) -> str:
    """A call of the button handler, its plan argument captured."""
    return handler + r"""\(['"]([^'"]+)['"]\)"""


CHECKOUT_HANDLER = "startCheckout"
RE_CHECKOUT_PLAN = checkout_pattern(CHECKOUT_HANDLER)
RE_DOWNLOAD_LINK = r'href="/downloads/'
RE_NOINDEX = r'<meta[^>]+name="robots"[^>]+content="[^"]*noindex'
RE_H1 = r"(?i)<h1[\s>]"
RE_H2 = r"(?i)<h2[\s>]"
RE_I18N_KEY = r'data-i18n="([^"]+)"'
RE_ASSET_VERSION = r"\?v=([0-9A-Za-z._-]+)"
RE_SAFE_HREF = r"^(https?://|/)"


def meta_pattern(name: str) -> str:
    """`<meta name|property="NAME" content="...">`, content captured."""
    return r'(?i)<meta\s+(?:name|property)="' + name.replace(".", r"\.") + r'"\s+content="([^"]*)"'
