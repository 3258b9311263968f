"""Texts of prompts, summaries and explanations as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def preference_summary(location: Column, cuisine: Column, min_rating: Column, budget: Column) -> Column:
    quote = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    return F.concat(
        F.lit("location="), quote(location),
        F.lit("  cuisine="), quote(cuisine),
        F.lit("  min_rating="), min_rating.cast("string"),
        F.lit("  budget="), quote(budget),
    )


def clean_explanation(c: Column, strict_numbers: bool = False) -> Column:
    """Remove ``.0`` and the assistant prefix.

    By default every ``.0`` goes, so ``4.05`` becomes ``45``; ``strict_numbers`` removes
    it only where the number ends.
    """
    first, *prefixes = fixed.EXPLANATION_REMOVALS
    out = F.regexp_replace(c, r"\.0\b", "") if strict_numbers else F.replace(c, F.lit(first), F.lit(""))
    for text in prefixes:
        out = F.replace(out, F.lit(text), F.lit(""))
    if strict_numbers:
        return out
    return F.regexp_replace(out, f"(?U){fixed.TRAILING_ZERO}", "$1")


def patch_summary(summary: Column, n_items: Column, word_boundary: bool = False) -> Column:
    """Make the count named in a summary agree with the number of items; 0 items change nothing.

    ``word_boundary`` keeps words such as ``someone`` whole.
    """
    edge = r"\b" if word_boundary else ""

    def sub(c, pattern, replacement):
        return F.regexp_replace(c, F.lit(fixed.PATTERN_FLAGS + edge + pattern), replacement)

    one = sub(summary, fixed.ONE_RECOMMENDATION, F.lit("one recommendation"))
    one = sub(one, fixed.ONE_MATCH, F.lit("one match"))
    one = sub(one, fixed.TOP_COUNT, F.lit("top one"))

    word = n_items.cast("string")
    for n, text in fixed.COUNT_WORDS.items():
        word = F.when(n_items == n, text).otherwise(word)
    many = sub(summary, fixed.MANY_RECOMMENDATIONS, F.concat(word, F.lit("$2")))
    many = sub(many, fixed.MANY_MATCHES, F.concat(word, F.lit("$2")))
    many = sub(many, fixed.TOP_COUNT, F.concat(F.lit("top "), word))
    return F.when(n_items == 1, one).when(n_items > 1, many).otherwise(summary)


def empty_summary(location: Column) -> Column:
    before, after = fixed.EMPTY_SUMMARY
    return F.concat(F.lit(before), location, F.lit(after))


def rating_explanation(rating: Column) -> Column:
    before, after = fixed.FAILED_EXPLANATION
    return F.concat(F.lit(before), rating.cast("string"), F.lit(after))


#: Answer format that ends every prompt.
PROMPT_END = (
    "\n\nChoose at most five candidates, best first, and answer with one JSON object only:\n"
    '{"summary": text, "recommendations": '
    '[{"restaurant_id": whole number, "rank": whole number from 1, "explanation": text}]}\n'
)


def prompt_start(location: Column, cuisine: Column, min_rating: Column, budget: Column) -> Column:
    """A prompt up to its candidates."""
    return F.concat(
        F.lit("Request\n- place: "), location,
        F.lit("\n- cuisine: "), cuisine,
        F.lit("\n- lowest rating: "), min_rating.cast("string"),
        F.lit("\n- price tier: "), budget,
        F.lit("\n\nCandidates (JSON)\n"),
    )


def prompt(location: Column, cuisine: Column, min_rating: Column, budget: Column, shortlist_json: Column) -> Column:
    """Request, candidates and answer format for the scorer."""
    return F.concat(prompt_start(location, cuisine, min_rating, budget), shortlist_json, F.lit(PROMPT_END))
