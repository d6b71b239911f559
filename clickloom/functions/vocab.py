"""Fixed vocabularies: names, labels and colours the results must carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event types.
VIEW = "view"
CART = "cart"
PURCHASE = "purchase"
EVENT_TYPES = (VIEW, CART, PURCHASE)

# Label of events without a category.
UNKNOWN_CATEGORY = "unknown"

# Display name per top-level category. Categories not listed show their own code.
CATEGORY_NAMES = {
    "electronics": "Electronics",
    "appliances": "Appliances",
    "computers": "Computers & Peripherals",
    "construction": "DIY / Home Improvement",
    "country_yard": "Garden & Dacha",
    "sport": "Sports & Outdoor",
    "auto": "Automotive",
    "furniture": "Furniture & Home",
    "kids": "Kids & Toys",
    "medicine": "Health & Medicine",
    "stationery": "Stationery & Office",
    "unknown": "Unknown / No Category",
}

# The experiment reports mark the mislabeled category with a star.
CATEGORY_NAMES_STARRED = {**CATEGORY_NAMES, "construction": "DIY / Home Improvement *"}

# The weekly two-category timeline uses these names.
CATEGORY_NAMES_WEEKLY = {
    "construction": "DIY / Home Improvement (raw: construction)",
    "electronics": "Electronics",
}

# The category dimension of the mart (code, display name, mislabeled flag).
CATEGORY_DIMENSION = [
    ("construction", "DIY / Home Improvement", "Y"),
    ("electronics", "Electronics", ""),
    ("appliances", "Appliances", ""),
    ("unknown", "Unknown / No Category", ""),
    ("apparel", "Apparel", ""),
    ("computers", "Computers & Peripherals", ""),
    ("sport", "Sports & Outdoor", ""),
    ("furniture", "Furniture & Home", ""),
    ("country_yard", "Garden & Dacha", ""),
    ("auto", "Auto", ""),
    ("kids", "Kids", ""),
    ("accessories", "Accessories", ""),
    ("stationery", "Stationery", ""),
    ("medicine", "Medicine", ""),
]

# Session depth buckets (largest event count, label); the last one is open.
DEPTH_BUCKETS = [
    (1, "01: 1 event"),
    (5, "02: 2-5 events"),
    (10, "03: 6-10 events"),
    (20, "04: 11-20 events"),
    (50, "05: 21-50 events"),
    (None, "06: 51+ events"),
]

# Customer segments in report order.
SEGMENTS = ["Champion", "Loyal", "At Risk", "Others", "Recent but Infrequent", "Lost"]

# Flags of the daily volume check (the dash is an em dash).
FLAG_NO_HISTORY = "Insufficient history"
FLAG_LOW = "LOW — potential logging gap"
FLAG_HIGH = "HIGH — unusual spike"
FLAG_NORMAL = "Normal"

# Report colours.
GREEN = "#2ECC71"
RED = "#E74C3C"
AMBER = "#E67E22"
BLUE = "#5B8DBE"
BAR_BLUE = "#385870"


def display_name(code: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """Look ``code`` up in a fixed name table; codes not listed give ``default`` (the code itself if None)."""
    pairs = iter(names.items())
    key, name = next(pairs)
    out = F.when(code == key, name)
    for key, name in pairs:
        out = out.when(code == key, name)
    return out.otherwise(code if default is None else default)
