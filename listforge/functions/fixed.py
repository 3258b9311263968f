"""Results depend on them, so they are stated plainly in one place."""

# Source column names accepted for each canonical column, first hit wins.
COLUMN_ALIASES = {
    "name": ["name", "restaurant_name", "Name", "Restaurant Name"],
    "location": ["location", "Location", "city", "City", "area", "Area"],
    "cuisines": ["cuisines", "Cuisines", "cuisine", "Cuisine"],
    "rating": ["rate", "Rate", "rating", "Rating", "aggregate_rating"],
    "cost_for_two": [
        "approx_cost(for two people)",
        "cost for two",
        "cost",
        "Cost",
        "avg_cost",
        "average_cost_for_two",
    ],
}

# Price tiers: below 500 low, up to and including 1500 medium, above high.
LOW_BELOW = 500
MEDIUM_UP_TO = 1500
TIERS = ["low", "medium", "high"]

RATING_MIN = 0.0
RATING_MAX = 5.0
DEFAULT_MIN_RATING = 0.0
UNKNOWN_NAME = "Unknown"

SHORTLIST_SIZE = 40
MAX_RECOMMENDATIONS = 5
MAX_RETRIES = 2
CARD_CUISINES = 3
PREVIEW_ROWS = 5
PREVIEW_NAME_CHARS = 40
PREVIEW_LOCATION_CHARS = 20
PREVIEW_CUISINES = 2
TOP_LOCATIONS = 10

# Quality thresholds, in percent of all rows unless the name says otherwise.
NULL_WARN_PCT = 50.0
NO_TIER_WARN_PCT = 50.0
NO_CUISINE_WARN_PCT = 30.0
LOCATION_NULL_PCT = 1.0
MIN_ROWS = 1000

# Texts of the answers given without a usable scorer response.
EMPTY_SUMMARY = ("I couldn't find any restaurants in ", " matching your criteria.")
UNAVAILABLE_SUMMARY = "LLM service is currently unavailable. Displaying raw shortlist."
FAILED_SUMMARY = (
    "We had trouble generating personalized recommendations, "
    "but here are the top matches based on highest rating."
)
ERROR_SUMMARY = "Our AI service encountered an error."
UNAVAILABLE_EXPLANATION = "No AI explanation available."
FAILED_EXPLANATION = ("Highest rated match: ", " stars.")

# Texts removed from explanations, in this order, and the final digit pattern.
EXPLANATION_REMOVALS = [".0", "AI: ", "AI:"]
TRAILING_ZERO = r"(\d+)\.0"

# Count patterns in summaries (case-insensitive, Unicode digits, "." stops at line feeds only).
PATTERN_FLAGS = "(?iUd)"
ONE_RECOMMENDATION = r"(?:top\s+)?(\d+|two|three|four|five)(\s+.*?recommendations?)"
ONE_MATCH = r"(?:top\s+)?(\d+|two|three|four|five)(\s+.*?matches?)"
MANY_RECOMMENDATIONS = r"(\d+|one|two|three|four|five)(\s+.*?recommendations?)"
MANY_MATCHES = r"(\d+|one|two|three|four|five)(\s+.*?matches?)"
TOP_COUNT = r"top\s+(\d+|one|two|three|four|five)"
COUNT_WORDS = {1: "one", 2: "two", 3: "three", 4: "four", 5: "five"}
