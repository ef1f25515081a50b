"""Defaults every operator falls back to. All are plain parameters at the call site."""

# Business thresholds that results depend on.
RECENCY_DAYS = 90
UNDATED_RECENCY_DAYS = 14
PACK_RATIO_LOW, PACK_RATIO_HIGH = 0.5, 2.0
MATCHES_KEPT = 5
SIMULATION_MATCHES_KEPT = 10

FUZZY_AUTO, FUZZY_REVIEW, FUZZY_MARGIN = 0.92, 0.70, 0.08

CONFLICT_RECENT_DAYS = 7
AUTHORITY_MARGIN = 0.15
PRICE_TOLERANCE = 0.01
DISCOUNT_TOLERANCE = 1.0
DEFAULT_RELIABILITY = 0.85

CHANGE_IMPACT_DAYS = 7
NOT_LISTED_GRACE_DAYS = 14
STALE_SOURCE_DAYS = 3

SHRINK_DAYS = 180
SHRINK_MIN_DOWNSIZE = 5.0
SHRINK_UNIT_FLOOR = -2.0

ALERT_PRICE_SHOCK = 20.0
ALERT_UNDERCUT_GAP = -15.0

RETENTION_DOCUMENT_DAYS, RETENTION_DOCUMENT_FLOOR = 90, 14
RETENTION_AUDIT_DAYS, RETENTION_RUN_DAYS, RETENTION_ALERT_DAYS = 365, 180, 180

DIGEST_LIMIT = 15
LOOKUP_MAX_TERMS = 8
CARDS_PER_DOCUMENT, CARD_CHARS, CARDS_PER_CHUNK = 300, 1500, 6
DISCOVERY_MAX_PAGES = 10

CATEGORIES = ("BISCUIT", "CRACKER", "COOKIE", "WAFER", "SNACK")
CORE_CATEGORIES = ("BISCUIT", "CRACKER", "COOKIE", "WAFER")
MECHANICS = (
    "DISCOUNT", "BUY_X_GET_Y", "MULTIBUY", "CASHBACK",
    "VOUCHER", "MEMBER_PRICE", "BUNDLE", "OTHER",
)
CONDITIONAL_MECHANICS = ("BUNDLE", "CASHBACK", "VOUCHER", "MEMBER_PRICE", "GIFT_WITH_PURCHASE")
