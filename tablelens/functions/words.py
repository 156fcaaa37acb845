"""Word lists and fixed texts.

FIXED VALUES: every list below must equal the analysed application's lists
word for word and in this order, or domain names, KPI types, answers and
chart formats come out differently.
"""

from __future__ import annotations

# FIXED VALUES — domain detection (D1): domain name, then its keywords, in order.
DOMAIN_KEYWORDS: list[tuple[str, list[str]]] = [
    ("Retail / E-commerce", ["product", "sku", "price", "quantity", "order", "customer",
                             "sale", "revenue", "discount", "cart", "shipping"]),
    ("Finance / Accounting", ["debit", "credit", "balance", "account", "transaction",
                              "ledger", "invoice", "tax", "profit", "loss", "asset", "liability"]),
    ("Human Resources", ["employee", "salary", "department", "hire", "position",
                         "payroll", "leave", "attendance"]),
    ("Marketing", ["campaign", "impression", "click", "conversion", "ctr",
                   "bounce", "engagement", "lead", "channel"]),
    ("Food & Beverage", ["menu", "restaurant", "food", "beverage", "recipe",
                         "ingredient", "serving", "dine", "cafe", "makanan", "minuman"]),
    ("Operations / Logistics", ["shipment", "warehouse", "inventory", "delivery", "supplier",
                                "stock", "tracking"]),
    ("Healthcare", ["patient", "diagnosis", "treatment", "prescription",
                    "hospital", "doctor", "medical"]),
    ("Education", ["student", "grade", "course", "teacher", "class",
                   "semester", "school", "university"]),
    ("Real Estate", ["property", "tenant", "rent", "building", "unit",
                     "lease", "square", "meter"]),
]
GENERAL_DOMAIN = "General Business"
MIN_DOMAIN_SCORE = 2

# FIXED VALUES — KPI money words (K1), tested on the lower-cased column name.
KPI_MONEY_WORDS = ["revenue", "sales", "total", "amount", "income", "harga", "price"]

# FIXED VALUES — currency field-name words (F3, G2), tested on the lower-cased
# name with runs of blanks turned into "_".
CURRENCY_WORDS = ["revenue", "sales", "amount", "income", "profit", "expense", "cost",
                  "price", "harga", "pendapatan", "omzet", "total", "subtotal", "gaji",
                  "salary", "budget", "payment", "cash", "id_r", "idr", "rupiah"]

# FIXED VALUES — question routing (Q1), tested in this order on the lower-cased question.
QUESTION_SUMMARY_WORDS = ["summary", "overview", "tell me", "ringkasan", "apa ini"]
QUESTION_KPI_WORDS = ["kpi", "metric", "number", "total", "value", "angka", "nilai"]
QUESTION_INSIGHT_WORDS = ["insight", "finding", "temuan", "analisa"]
QUESTION_RECOMMEND_WORDS = ["recommend", "suggest", "should", "action", "saran", "rekomendasi"]

# FIXED VALUES — answer texts (Q1).
NO_SUMMARY = "No summary available."
KPI_HEADER = "Here are the key metrics:"
NO_KPI = "No KPI data available."
INSIGHT_HEADER = "Key insights:"
NO_INSIGHT = "No insights available."
RECOMMEND_HEADER = "Recommendations:"
NO_RECOMMEND = "No recommendations available."
HELP_TAIL = "Try asking about: KPIs, insights, recommendations, or a summary."

# FIXED VALUES — dataset kind by exact lower-cased column name (M1), first match wins.
KIND_COLUMNS: list[tuple[str, list[str]]] = [
    ("sales", ["revenue", "sales", "omzet"]),
    ("inventory", ["stock", "inventory"]),
    ("finance", ["expense", "cost", "profit"]),
    ("marketing", ["click", "ctr"]),
]
UNKNOWN_KIND = "unknown"

# FIXED VALUES — metric map by contained word (M2); a later group overwrites an earlier one.
METRIC_WORDS: list[tuple[str, list[str]]] = [
    ("revenue", ["revenue", "sales", "omzet"]),
    ("cost", ["cost", "expense", "biaya"]),
    ("profit", ["profit", "laba"]),
    ("quantity", ["qty", "jumlah", "unit"]),
]

# FIXED VALUES — upload types by lower-cased file suffix (S3, F8).
FILE_TYPES: list[tuple[str, str]] = [
    (".xlsx", "excel"), (".xls", "excel"), (".csv", "csv"),
    (".pdf", "pdf"), (".docx", "docx"), (".doc", "docx"),
]
UNKNOWN_FILE_TYPE = "unknown"
# FIXED VALUES — suffixes the browser's upload widget offers (S3); the server also takes .doc.
CLIENT_SUFFIXES = [".xlsx", ".xls", ".csv", ".pdf", ".docx"]

# FIXED VALUES — defaults when flattening stored insights / recommendations.
INSIGHT_DEFAULTS = {"title": "Untitled Insight", "description": "No description available.",
                    "severity": "info", "category": "General"}
RECOMMENDATION_DEFAULTS = {"title": "Untitled Recommendation", "description": "No description available.",
                           "priority": "low", "impact": "Not specified"}

# FIXED VALUES — the text that stands in for a missing text cell (C2), and for an empty document.
EMPTY_TEXT = "(empty)"
EMPTY_DOCUMENT = "(empty document)"

# FIXED VALUES — insight rows (I1), trend text (W2), summary sentence (I2) and
# recommendations (I3); ``{…}`` marks where computed values go.
INSIGHT_OVERVIEW = ("{domain} Data Analysis",
                    "Dataset covers {rows} records with {cols} data fields. "
                    "{numeric} numeric and {text} categorical columns detected.",
                    "info", "Overview")
INSIGHT_QUALITY_ISSUE = ("Data Quality Issue",
                         "{pct}% missing values detected. This can skew analysis results and needs attention.",
                         "warning", "Data Quality")
INSIGHT_QUALITY_GOOD = ("Good Data Completeness",
                        "Only {pct}% missing values. Data quality is solid for analysis.",
                        "success", "Data Quality")
INSIGHT_DISTRIBUTION = ("{col} Distribution",
                        "Found {unique} unique values in '{col}'. Most common: '{top}'. "
                        "This distribution reveals the primary segments in your business.",
                        "info", "Segmentation")
INSIGHT_GROWTH = ("Growth in {col}", "{col} changed by {pct}% from first to second half of data.", "success", "Trend")
INSIGHT_DECLINE = ("Decline in {col}", "{col} changed by {pct}% from first to second half of data.", "warning", "Trend")
NO_TOP_VALUE = "N/A"
QUALITY_LIMIT = 10
TREND_LIMIT = 5
TREND_TEXT = "{col} {label} by {pct}% across the dataset."
TREND_LABELS = {"up": "increased", "down": "decreased", "stable": "remained stable"}
SUMMARY_FIRST = "This {domain} dataset contains {rows} records across {cols} fields."
SUMMARY_NUMERIC = "Numeric fields: {names}."
SUMMARY_TEXT = "Categorical fields: {names}."
SUMMARY_MONEY = "Key financial metric: {name} = {value}."
RECOMMENDATIONS = [
    ("Upload More Data",
     "Provide larger datasets with more historical records for deeper trend analysis and more accurate forecasting.",
     "high", "Significantly better insights quality"),
    ("Use Structured Data Files",
     "For best results, upload Excel or CSV files with clear column headers. "
     "This allows the system to calculate precise KPIs.",
     "medium", "More accurate analysis"),
    ("Regular Monitoring",
     "Upload updated {domain} data periodically to track changes and catch issues early.",
     "medium", "Proactive decision-making"),
]

# FIXED VALUES — why a question has no analysis (J2), in the order they are tested.
ERR_ANALYSIS_NOT_FOUND = "Analysis not found"
ERR_CONTEXT_REQUIRED = "Analysis context is required"
ERR_UPLOAD_NOT_FOUND = "Upload not found"
ERR_NO_ANALYSIS = "No analysis found for selected upload"
ERR_NOT_COMPLETED = "Analysis not yet completed"

# FIXED VALUES — how long a stored answer may be reused (J4), in seconds.
TTL_ANALYSIS = 24 * 3600
TTL_QUESTION = 4 * 3600
TTL_PROMPT = 12 * 3600
TTL_DASHBOARD = 5 * 60

# FIXED VALUES — chat-context section heads (Q2) and the correction line.
CONTEXT_TYPE = "Business Type: "
CONTEXT_SUMMARY = "Summary: "
CONTEXT_KPIS = "\nKPIs:"
CONTEXT_INSIGHTS = "\nInsights:"
CONTEXT_RECOMMENDATIONS = "\nRecommendations:"
CONTEXT_STATS = "\nColumn Statistics:"
CONTEXT_SAMPLE = "\nSample Data (first {n} rows):"
CORRECTION_LINE = "{column} — {action} ({rows} rows)"
