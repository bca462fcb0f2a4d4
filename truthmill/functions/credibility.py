"""Credibility features of one document: ratios over its letter tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from truthmill.functions.arrays import keep, let
from truthmill.functions.tokens import feature_tokens
from truthmill.lexicon import Lexicon

# --- fixed values: letter-case classes and output order --------------------------
UPPER = "А-ЯA-Z"
LOWER = "а-яa-z"
FEATURES = (
    "negative_ratio",
    "has_upper_ratio",
    "all_upper_ratio",
    "first_upper_ratio",
    "all_lower_ratio",
    "first_person_ratio",
    "second_person_ratio",
    "plural_pronoun_ratio",
    "exclamation_ratio",
    "quote_ratio",
)
QUOTES = ('"', "“", "„")
# -------------------------------------------------------------------------------


def substring_count(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a string."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (gone / F.lit(float(len(needle)))).cast("long")


def _count_in(tokens: Column, words) -> Column:
    words = list(words)
    return F.size(keep(tokens, lambda t: t.isin(words))) if words else F.lit(0)


def _score_sum(tokens: Column, scores: dict[str, float]) -> Column:
    """Sum of the scores of the tokens found in a small fixed word list."""
    total = F.lit(0.0)
    by_score: dict[float, list[str]] = {}
    for word, score in scores.items():
        by_score.setdefault(score, []).append(word)
    for score, words in by_score.items():
        total = total + F.lit(float(score)) * _count_in(tokens, words)
    return total


def token_counts(text: Column, lexicon: Lexicon, upper: str = UPPER, lower: str = LOWER) -> Column:
    """Struct of every per-document counter.

    The tokens are found once. Case counters look only at tokens with a capital and
    list counters only at tokens that are in some list, so a text is walked a few
    times instead of once per feature.
    """
    lists = {
        "negative": lexicon.negative,
        "positive": lexicon.positive,
        "first_person": lexicon.first,
        "second_person": lexicon.second,
        "third_person": lexicon.third,
        "singular_pronoun": lexicon.singular,
        "plural_pronoun": lexicon.plural,
        "month": lexicon.months,
    }
    listed = sorted({w for words in lists.values() for w in words})

    def case_counts(capital: Column) -> Column:
        return F.struct(
            F.size(capital).alias("has_upper"),
            F.size(keep(capital, lambda t: t.rlike(f"^[{upper}]+$"))).alias("all_upper"),
            F.size(keep(capital, lambda t: t.rlike(f"^[{upper}]"))).alias("first_upper"),
        )

    def list_counts(known: Column) -> Column:
        return F.struct(
            *[_count_in(known, words).alias(name) for name, words in lists.items()],
            _score_sum(known, lexicon.positive).alias("positive_score"),
            _score_sum(known, lexicon.negative).alias("negative_score"),
        )

    def counts(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).alias("tokens"),
            let(keep(tokens, lambda t: t.rlike(f"[{upper}]")), case_counts).alias("case"),
            F.size(keep(tokens, lambda t: t.rlike(f"^[{lower}]+$"))).alias("all_lower"),
            F.size(keep(tokens, lambda t: t.rlike("[0-9]"))).alias("digit"),
            let(
                keep(F.transform(tokens, F.lower), lambda t: t.isin(listed)), list_counts
            ).alias("listed"),
        )

    return let(feature_tokens(F.coalesce(text, F.lit("")), lexicon), counts)


def ratios(counts: Column, text: Column) -> list[Column]:
    """The ten ratios, in their fixed order, from a ``token_counts`` struct."""
    n = F.greatest(counts["tokens"], F.lit(1)).cast("double")
    text = F.coalesce(text, F.lit(""))
    values = (
        counts["listed"]["negative"],
        counts["case"]["has_upper"],
        counts["case"]["all_upper"],
        counts["case"]["first_upper"],
        counts["all_lower"],
        counts["listed"]["first_person"],
        counts["listed"]["second_person"],
        counts["listed"]["plural_pronoun"],
        substring_count(text, "!"),
        substring_count(text, '"'),
    )
    return [(v / n).alias(name) for v, name in zip(values, FEATURES)]


def extra_ratios(counts: Column) -> list[Column]:
    """Counters that are computed beside the ten features: ratios and score sums."""
    n = F.greatest(counts["tokens"], F.lit(1)).cast("double")
    listed = counts["listed"]
    return [
        (listed["third_person"] / n).alias("third_person_ratio"),
        (listed["singular_pronoun"] / n).alias("singular_pronoun_ratio"),
        (listed["positive"] / n).alias("positive_ratio"),
        (listed["month"] / n).alias("month_ratio"),
        (counts["digit"] / n).alias("digit_ratio"),
        listed["positive_score"].alias("positive_score"),
        listed["negative_score"].alias("negative_score"),
    ]


def feature_array(text: Column, lexicon: Lexicon) -> Column:
    """``array<double>`` of the ten ratios, as one expression over the text column."""
    return let(token_counts(text, lexicon), lambda c: F.array(*ratios(c, text)))
