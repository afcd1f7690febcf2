"""Fixed values that results depend on.

FIXED VALUES: status sets, bucket names and edges, preset offsets and
labels below must equal the reference's for equal results. They are
stated as plain text in natural order; nothing here is derived.
"""

from __future__ import annotations

import datetime as _dt

# -- as-of anchoring (tests and oracle pin these) ---------------------------
AS_OF = _dt.date(2000, 6, 30)
AS_OF_TS = _dt.datetime(2024, 1, 31, 0, 0, 0)

# -- FIXED VALUES: invoice statuses (compared on upper(status)) -------------
EXCLUDED_FROM_SPEND = ("CANCELLED", "REJECTED")
OPEN = "OPEN"
OVERDUE = "OVERDUE"
OPEN_OR_DUE = ("OPEN", "DUE")
UNPAID = ("OPEN", "DUE", "OVERDUE")
DISPUTE = ("DISPUTE", "DISPUTED")
CLEARED = ("PAID", "CLEARED")
ALREADY_PAID = ("PAID", "CLEARED", "CLOSED", "SETTLED")
AUTO_PROCESSED_NOTE = "AUTO PROCESSED"

# -- FIXED VALUES: status groups for the distribution chart -----------------
STATUS_GROUPS = (
    ("Paid", ("PAID", "CLEARED", "CLOSED", "POSTED", "SETTLED")),
    ("Pending", ("OPEN", "PENDING", "ON HOLD", "PARKED", "IN PROGRESS")),
    ("Disputed", ("DISPUTE", "DISPUTED", "BLOCKED", "CONTESTED")),
)
STATUS_GROUP_ELSE = "Other"

# -- FIXED VALUES: cash-flow buckets (days until due, upper edge inclusive) -
CASH_FLOW_BUCKETS = (
    ("OVERDUE_NOW", -1),
    ("DUE_7_DAYS", 7),
    ("DUE_14_DAYS", 14),
    ("DUE_30_DAYS", 30),
    ("DUE_60_DAYS", 60),
    ("DUE_90_DAYS", 90),
)
CASH_FLOW_ELSE = "BEYOND_90_DAYS"
CASH_FLOW_TOTAL = "TOTAL_UNPAID"
CASH_FLOW_ORDER = ("TOTAL_UNPAID", "OVERDUE_NOW", "DUE_7_DAYS", "DUE_14_DAYS",
                   "DUE_30_DAYS", "DUE_60_DAYS", "DUE_90_DAYS", "BEYOND_90_DAYS")
CASH_FLOW_NEAR = ("DUE_7_DAYS", "DUE_14_DAYS", "DUE_30_DAYS")
BUCKET_LABELS = (
    ("TOTAL_UNPAID", "Total Unpaid"),
    ("OVERDUE_NOW", "Overdue Now"),
    ("DUE_7_DAYS", "Due in 7 Days"),
    ("DUE_14_DAYS", "Due in 14 Days"),
    ("DUE_30_DAYS", "Due in 30 Days"),
    ("DUE_60_DAYS", "Due in 60 Days"),
    ("DUE_90_DAYS", "Due in 90 Days"),
    ("BEYOND_90_DAYS", "Beyond 90 Days"),
)

# -- FIXED VALUES: payment timing windows (days after as_of, inclusive) -----
PAYMENT_WINDOWS = (
    ("Due in 0-7 days", 7),
    ("Due in 8-14 days", 14),
    ("Due in 15-30 days", 30),
)
PAYMENT_WINDOW_OVERDUE = "Overdue"
PAYMENT_WINDOW_ELSE = "Due later"

# -- FIXED VALUES: invoice aging buckets ------------------------------------
AGING_BUCKETS = (
    ("Due in 0-7 days", 7),
    ("Due in 8-30 days", 30),
    ("Due in 31-90 days", 90),
)
AGING_OVERDUE = "Overdue"
AGING_ELSE = "Due in >90 days"

# -- FIXED VALUES: early payment ---------------------------------------------
EARLY_PAY_RATE = "0.02"
EARLY_PAY_PRIORITY = (("High", 7), ("Medium", 14))
EARLY_PAY_PRIORITY_ELSE = "Low"

# -- FIXED VALUES: date-range presets (days back from as_of) ----------------
RANGE_PRESETS = (("Last 30 Days", 30), ("QTD", 120), ("YTD", 365))
RANGE_PRESET_DEFAULT_DAYS = 30

# -- FIXED VALUES: needs-attention categories --------------------------------
ATTENTION_OVERDUE = "OVERDUE"
ATTENTION_DISPUTED = "DISPUTED"
ATTENTION_DUE = "DUE"
DUE_SOON_DAYS = 30
PSEUDO_STATUS_DUE_NEXT_30 = "DUE_NEXT_30"

# -- FIXED VALUES: chart pack tags and trend labels --------------------------
CHART_TAGS = ("STATUS", "VENDOR", "TREND")
TREND_TYPE_LABELS = (("actual_spend", "ACTUAL"), ("forecast_spend", "FORECAST"))
FORECAST_LAST_FACTOR = "1.1"
MIN_SHARE_PCT = 3

# -- FIXED VALUES: limits used by the reports --------------------------------
TOP_VENDORS = 10
TOP_DRIVERS = 15
EARLY_PAY_ROWS = 20
GRIR_TREND_ROWS = 24
GRIR_ROOT_ROWS = 6
SEARCH_ROWS = 500
PAGE_SIZE = 8
DEFAULT_TTL_SECONDS = 3600
TRANSCRIPT_TRUNCATE = 600
FAQ_LABEL_CHARS = 55
INSIGHT_TITLE_CHARS = 45

# -- FIXED VALUES: relevance gate (searched in lower(trim(question))) -------
NON_PROCUREMENT_PATTERNS = (
    r"^(hi|hello|hey|howdy|hiya|yo)\b",
    r"^good\s*(morning|afternoon|evening|night|day)\b",
    r"^how are you",
    r"^how('s| is) (it going|everything|life|your day)",
    r"^who are you",
    r"^what (are|is) you\b",
    r"^tell me (a joke|something funny|a story)",
    r"^(crack|tell).*(joke|funny)",
    r"^what('s| is) (the )?weather",
    r"^what('s| is) (your )?(name|favorite|hobby|age)",
    r"^what (do|can) you do\??$",
    r"^(thanks|thank you|thx|ty)\b",
    r"^(bye|goodbye|see you|cya|ttyl)\b",
    r"^are you (a |an )?(ai|bot|robot|human|person|machine)\??$",
    r"^capital of\b",
    r"^who (invented|discovered|created|founded|built)\b",
    r"^what is (the )?(meaning of life|ai|machine learning|blockchain|crypto)",
    r"^(define|explain|what is)\s+(love|life|happiness|success|beauty)",
    r"^(how|what).*(recipe|cook|bake|movie|music|song|book|game|sport|football|cricket)\b",
    r"^(write|compose|create)\s+(a |an )?(poem|story|song|joke|essay)\b",
    r"^(translate|convert)\s+\w+\s+to\b",
    r"^what('s| is) (today's )?(date|time|day)\b",
    r"^\d+\s*[\+\-\*\/]\s*\d+",
)
PROCUREMENT_KEYWORDS = (
    "spend", "vendor", "invoice", "invoices", "purchase order", "payment", "payments",
    "due date", "overdue", "dispute", "disputed", "gr/ir", "grir", "gr ir",
    "cash flow", "forecast", "dashboard", "kpi", "metric", "procurement", "p2p",
    "procure", "accounts payable", "payable", "payables", "accrual", "aging", "aged",
    "processing time", "cycle time", "autoprocess", "first pass", "late payment",
    "on-time payment", "early payment", "duplicate payment", "supplier",
    "working capital", "total spend", "active vendor", "pending invoice",
    "clearing", "reconcil", "goods receipt", "delivery accuracy",
    "days payable", "dpo", "spend analysis", "vendor analysis", "invoice status",
    "po amount", "po number", "po date", "purchase requisition",
)

# -- FIXED VALUES: intent routing -------------------------------------------
GRIR_HOTSPOTS_Q = ("Show GR/IR outstanding balance by month and highlight which recent months "
                   "have the highest GR/IR balance so we can prioritize clearing.")
GRIR_ROOTCAUSE_Q = ("Using GR/IR aging and outstanding balance data, explain the likely root-cause "
                    "buckets (missing goods receipt, invoice not posted, price or quantity mismatch) "
                    "and for each bucket suggest 2–3 concrete remediation actions.")
GRIR_WC_Q = ("Estimate the working capital that would be released by clearing all GR/IR items "
             "older than 60 and 90 days, by month.")
GRIR_FOLLOWUP_Q = ("Based on GR/IR aging and outstanding balances, draft vendor-facing follow-up "
                   "templates we can use for high-priority GR/IR items, with realistic subject "
                   "lines and concise bullet points.")
EXACT_ROUTES = (
    (GRIR_HOTSPOTS_Q, "grir_hotspots"),
    (GRIR_ROOTCAUSE_Q, "grir_root_causes"),
    (GRIR_WC_Q, "grir_working_capital"),
    (GRIR_FOLLOWUP_Q, "grir_vendor_followup"),
    ("Spending Overview", "spending_overview"),
    ("Vendor Analysis", "vendor_analysis"),
    ("Payment Performance", "payment_performance"),
    ("Invoice Aging", "invoice_aging"),
)
KEYWORD_ROUTES = (
    (("forecast cash outflow", "cash flow forecast"), "cash_flow"),
    (("pay early", "capture discounts"), "early_payment"),
    (("optimal payment timing",), "payment_timing"),
    (("late payment trend",), "late_payment_trend"),
)
ROUTE_IRRELEVANT = "static"
ROUTE_DEFAULT = "custom"

# -- FIXED VALUES: chart title words (substring match on lower(question)) ---
INCREASE_WORDS = ("higher", "increase", "more", "up", "rose", "rising", "grew")
DECREASE_WORDS = ("lower", "decrease", "less", "down", "fell", "dropped", "declin")
TITLE_PREFIX = "This Month vs Previous Month — "
TITLE_INCREASED = "Where Spend Increased"
TITLE_DECREASED = "Where Spend Decreased"
TITLE_CHANGED = "Where Spend Changed"

# -- FIXED VALUES: preset inference (first rule that matches wins) ----------
PRESET_RULES = (
    (("ytd",), "YTD", 0.8),
    (("last 30", "30 days"), "Last 30 Days", 0.7),
    (("qtd", "quarter"), "QTD", 0.7),
)

# -- FIXED VALUES: narrative section markers --------------------------------
PRESCRIPTIVE_SPLIT = r"(?i)\n?\*{0,2}prescriptive\*{0,2}[:\s\-—]*"
DESCRIPTIVE_HEAD = r"(?i)^\*{0,2}descriptive\*{0,2}[:\s\-—]*"

# -- FIXED VALUES: labels and texts shown by the source system --------------
ALL_VENDORS = "All Vendors"
UNKNOWN_VENDOR = "Unknown"
DRIVER_ROW_TYPE = "VENDOR"
DEFAULT_HISTORY = (("OPEN", "Invoice opened."), ("OVERDUE", "Invoice overdue."))
ROLE_USER_LABEL = "User"
ROLE_OTHER_LABEL = "Assistant"
CONTEXT_HEADER = "Conversation history:\n\n"
# FIXED VALUES: text around the newest turns of one session.
SHORT_CONTEXT_HEADER = "Previous conversation context (use this to answer follow-up questions):\n\n"
SHORT_CONTEXT_FOOTER = "\n\n---\nNew question:\n"
CONTEXT_FOOTER = "\n\nNew question:\n"
FREQUENT_VENDOR_KEY = "frequent_vendor"
ENTITY_MEMORY_TYPE = "entity"
INFERRED_SOURCE = "inferred"
ENTITY_MIN_MENTIONS = 3
ENTITY_RECENT_QUESTIONS = 20
ENTITY_FIRST_N = 50
CONTEXT_MESSAGES = 20
CONTEXT_DAYS = 2
