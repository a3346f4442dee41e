"""Word lists, patterns and tables that results depend on."""

# --- fixed values: calendar -------------------------------------------------
MONTH_NUMBERS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9,
    "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
MONTH_TITLES = ["January", "February", "March", "April", "May", "June", "July",
                "August", "September", "October", "November", "December"]
DATE_PARSE_THRESHOLD = 0.7
TIME_FILTER_WORDS = ["month", "year", "quarter", "date"]

# --- fixed values: money ----------------------------------------------------
CURRENCY_SYMBOLS = {"$": "USD", "₹": "INR", "€": "EUR", "£": "GBP", "¥": "JPY",
                    "A$": "AUD", "C$": "CAD"}
CURRENCY_KEYWORDS = {"usd": "USD", "inr": "INR", "eur": "EUR", "gbp": "GBP", "jpy": "JPY",
                     "dollar": "USD", "rupee": "INR", "rupees": "INR", "euro": "EUR",
                     "pound": "GBP"}
UNKNOWN_CURRENCY = "UNKNOWN"
REVENUE_WORDS = ["revenue", "sales_total", "total_sales"]

# --- fixed values: units ----------------------------------------------------
UNITS = {
    "kg": "kilograms", "kilogram": "kilograms", "kilograms": "kilograms",
    "g": "grams", "gram": "grams", "grams": "grams",
    "lbs": "pounds", "pound": "pounds", "oz": "ounces",
    "liter": "litres", "liters": "litres", "litres": "litres", "l": "litres",
    "ml": "millilitres",
    "meter": "meters", "meters": "meters", "m": "meters", "km": "kilometres",
    "pcs": "pieces", "pieces": "pieces", "units": "units",
}
UNIT_DIMENSIONS = {
    "kilograms": "weight", "grams": "weight", "pounds": "weight", "ounces": "weight",
    "litres": "volume", "millilitres": "volume",
    "meters": "length", "kilometres": "length",
}

# --- fixed values: column names ---------------------------------------------
ID_WORDS_NUMERIC = ["id", "key", "code"]
ID_WORDS_TEXT = ["id", "uuid", "key", "code", "sku"]
NOT_ID_WORDS = ["price", "revenue", "amount"]

# --- fixed values: thresholds -----------------------------------------------
OVERLAP_KEEP = 0.1
OVERLAP_RECOMMEND = 0.5
CONTRADICTION_RATIO = 0.05
ABS_TOL = 1e-9
REL_TOL = 1e-6
GENESIS = "GENESIS_BLOCK_000000000000"
PREVIEW_ROWS = 25
HISTORY_ROWS = 50
DUPLICATE_SAMPLE_ROWS = 5

# --- fixed values: question text --------------------------------------------
INTENT_PATTERNS = {
    "forecast": [r"\bwill\b", r"\bforecast\b", r"\bpredict\b", r"\bnext year\b",
                 r"\bnext month\b", r"\bfuture\b", r"\bprojected\b", r"\bexpected in 202[6-9]\b"],
    "causal": [r"\bwhy did\b", r"\bwhy has\b", r"\bwhat caused\b", r"\breason for\b",
               r"\broot cause\b"],
    "opinion": [r"\bis (?:this|the) company (?:good|successful|bad)\b",
                r"\bshould (?:we|i)\b", r"\bwhat do you think\b", r"\bis it worth\b"],
}
DEFAULT_INTENT = "historical_analytics"
ABSENT_METRICS = ["churn", "nps", "satisfaction", "ebitda", "bounce rate"]
METRIC_WORDS = ["churn", "nps", "csat", "satisfaction", "ebitda", "bounce rate", "revenue",
                "sales", "quantity", "price", "profit", "units"]
METRIC_LEADS = ["average", "total", "sum of", "mean of", "max of", "min of", "mean", "max", "min"]
NOT_METRICS = ["the", "of", "all", "orders", "records", "combined", "transactions", "customer",
               "product", "monthly", "annual"]
OPERATION_WORDS = {
    "mean": ["average", "avg", "mean"],
    "max": ["highest", "max", "maximum", "most", "top"],
    "min": ["lowest", "min", "minimum", "least"],
    "count": ["how many", "count", "number of"],
}
GROUP_WORDS = {
    "category": ["category", "product category"],
    "region": ["region", "area"],
    "product_id": ["product", "item"],
    "month": ["month", "monthly"],
}

# --- fixed values: secrets --------------------------------------------------
SECRET_PATTERNS = [
    (r"sk-[a-zA-Z0-9_\-]{20,}", "[REDACTED_KEY]"),
    (r"(api[_-]?key\s*[:=]\s*['\"]?)([^'\";\s]+)", "$1[REDACTED_KEY]"),
    (r"(bearer\s+)([a-zA-Z0-9_\-\.]{10,})", "$1[REDACTED_TOKEN]"),
    (r"(password\s*[:=]\s*['\"]?)([^'\";\s]+)", "$1[REDACTED_PW]"),
]
TOKEN_PATTERN = (r"(token\s*[:=]\s*['\"]?)([^'\";\s]+)", "$1[REDACTED_TOKEN]")
