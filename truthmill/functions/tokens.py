"""Tokenisers, token filters, n-grams and the light stemmer, as array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from truthmill.functions.arrays import blank_out, keep, let
from truthmill.lexicon import LINE_BREAK_MARKER, Lexicon

# --- fixed values: token patterns and length limits ----------------------------
SPLIT_PATTERN = r"""[\s!,.?;'"]+"""
LETTER_RUN = r"\p{L}{1,255}"
PUNCTUATION_RUN = r"""[;.,!?\(\):'"“”–\\]+"""
FEATURE_TOKEN_LENGTH = (1, 1000)
ANALYZER_TOKEN_LENGTH = (3, 1000)
MAX_WORD_LENGTH = 255
# -------------------------------------------------------------------------------

# Word characters run together; `.` and quotes also join two letters or two digits,
# `:` joins letters, `,` and `;` join digits.
_WORD = (
    r"[\p{L}\p{M}\p{N}_]+"
    r"(?:(?:(?<=[\p{L}\p{M}])[.:'’](?=\p{L})|(?<=\p{N})[.,;'’](?=\p{N}))[\p{L}\p{M}\p{N}_]+)*"
)
_NUMBER = (
    r"^-?(?:0[xX][0-9a-fA-F]+"
    r"|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    r"|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[dDfF]"
    r"|[0-9]+[lL])$"
)


def _all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def split_tokens(text: Column) -> Column:
    """Lower-case, split on blanks and punctuation, drop empty tokens."""
    return keep(F.split(F.lower(text), SPLIT_PATTERN), lambda t: t != "")


def letter_tokens(text: Column) -> Column:
    """Maximal runs of letters, case kept, cut at 255."""
    return _all_matches(text, LETTER_RUN)


def word_tokens(text: Column) -> Column:
    """Words by Unicode word-break rules; over-long words stay as null positions."""
    return blank_out(_all_matches(text, _WORD), lambda t: F.length(t) <= MAX_WORD_LENGTH)


def not_stop(words: Sequence[str]):
    """Predicate: token, lower-cased, is not one of the words."""
    return lambda t: ~F.lower(t).isin(list(words)) if words else F.lit(True)


def drop_stop_words(tokens: Column, words: Sequence[str]) -> Column:
    return keep(tokens, not_stop(words))


def feature_tokens(text: Column, lexicon: Lexicon) -> Column:
    """Letter tokens without stop words (pronouns stay), the base of the ratios."""
    low, high = FEATURE_TOKEN_LENGTH
    no_stop = not_stop(lexicon.stop_keeping_pronouns)
    return keep(letter_tokens(text), lambda t: no_stop(t) & F.length(t).between(low, high))


def is_number(token: Column) -> Column:
    """Decimal, exponent, hexadecimal or suffixed number; ``,`` reads as ``.``."""
    return F.replace(token, F.lit(","), F.lit(".")).rlike(_NUMBER)


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Word n-grams over neighbours in the array, so they bridge removed words."""
    return F.transform(
        F.when(F.size(tokens) >= n, F.slice(tokens, F.lit(1), F.size(tokens) - (n - 1))).otherwise(
            F.array().cast("array<string>")
        ),
        lambda t, i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " "),
    )


def gap_aware_shingles(tokens: Column, max_n: int = 3) -> Column:
    """1..max_n word shingles that do not cross a null (removed) position.

    ``get`` past the end and ``concat`` with a null are both null, so one rule
    covers the end of the text and the gaps. Shingles holding ``_`` are dropped.
    """

    def at(t: Column) -> Column:
        def sized(x: Column, i: Column) -> Column:
            parts = [x] + [F.get(t, i + k) for k in range(1, max_n)]
            out = [parts[0]]
            for k in range(1, max_n):
                joined: list[Column] = []
                for p in parts[: k + 1]:
                    joined += [F.lit(" "), p]
                out.append(F.concat(*joined[1:]))
            return F.array(*out)

        return F.flatten(F.transform(t, sized))

    return keep(let(tokens, at), lambda s: s.isNotNull() & ~s.contains("_"))


def strip_line_marker(text: Column, replacement: str = "") -> Column:
    return F.replace(text, F.lit(LINE_BREAK_MARKER), F.lit(replacement))


# --- fixed values: published light-stemmer rules for Bulgarian -------------------
# (minimum word length, ending, characters cut, characters put back); ``?`` in an ending
# stands for any one letter, and in the text put back for that letter. In each group the
# first rule that fits is taken. A word a place rule fits goes through no further group.
PLACE_RULES = ((6, "ища", 3, ""),)
ARTICLE_RULES = (
    (7, "ият", 3, ""),
    (6, "ът", 2, ""), (6, "то", 2, ""), (6, "те", 2, ""), (6, "та", 2, ""), (6, "ия", 2, ""),
    (5, "ят", 2, ""),
)
PLURAL_RULES = (
    (7, "овци", 3, ""), (7, "ове", 3, ""), (7, "еве", 3, "й"),
    (6, "ища", 3, ""), (6, "та", 2, ""), (6, "ци", 2, "к"), (6, "зи", 2, "г"),
    (6, "е?и", 3, "я?"),
    (5, "си", 2, "х"), (5, "и", 1, ""),
)
# A final я goes first, then a final vowel of what is left; the length is that before either goes.
VOWEL_RULES = (
    (4, "ая", 2, ""), (4, "оя", 2, ""), (4, "ея", 2, ""), (4, "я", 1, ""),
    (4, "а", 1, ""), (4, "о", 1, ""), (4, "е", 1, ""),
)
# ен becomes н first, then a ъ before the last letter goes.
CONSONANT_RULES = ((7, "ъен", 3, "н"), (5, "ен", 2, "н"), (6, "ъ?", 2, "?"))
# -------------------------------------------------------------------------------
_FINISHED = "\u0001"


def _rule(word: Column, n: Column, rule) -> tuple[Column, Column]:
    """(condition, result) of one rule on a word of length n."""
    low, ending, cut, put = rule
    at = ending.find("?")
    if at < 0:
        fits, tail = word.endswith(ending), F.lit(put)
    else:
        back = len(ending) - at  # the wild letter, counted from the end
        wild = F.substring(word, n - (back - 1), F.lit(1))
        fits = word.endswith(ending[at + 1:])
        if at:
            fits = fits & (F.substring(word, n - (len(ending) - 1), F.lit(at)) == ending[:at])
        tail = F.concat(*[wild if p == "?" else F.lit(p) for p in put])
    return (n >= low) & fits, F.concat(F.substring(word, F.lit(1), n - cut), tail)


def _apply_rules(word: Column, rules) -> Column:
    """First rule whose ending and minimum length fit; the word itself if none does.

    Rules are tried by last letter, so a word meets only those it could end with.
    """
    n = F.length(word)
    anywhere = [r for r in rules if r[1][-1] == "?"]
    by_last: dict[str, list] = {}
    for rule in rules:
        if rule not in anywhere:
            by_last.setdefault(rule[1][-1], []).append(rule)

    def first(group, start=F):
        for rule in group:
            start = start.when(*_rule(word, n, rule))
        return start.otherwise(word) if group else word

    out = F.when(word.endswith(_FINISHED), word)
    for last, group in by_last.items():
        out = out.when(word.endswith(last), first(group + anywhere))
    return out.otherwise(first(anywhere))


def stem_tokens(tokens: Column, passes: int = 1) -> Column:
    """Bulgarian light stems of all tokens, one walk over the array per rule group."""
    (low, ending, cut, _), = PLACE_RULES

    def place_or_article(w: Column) -> Column:
        stem = F.concat(F.substring(w, F.lit(1), F.length(w) - cut), F.lit(_FINISHED))
        return F.when(w.endswith(ending) & (F.length(w) >= low), stem).otherwise(
            _apply_rules(w, ARTICLE_RULES)
        )

    def last_group(w: Column) -> Column:
        return F.when(w.endswith(_FINISHED), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(
            _apply_rules(w, CONSONANT_RULES)
        )

    for _ in range(passes):
        for group in (
            place_or_article,
            lambda w: _apply_rules(w, PLURAL_RULES),
            lambda w: _apply_rules(w, VOWEL_RULES),
            last_group,
        ):
            tokens = F.transform(tokens, group)
    return tokens


def stem(word: Column) -> Column:
    """Bulgarian light stem of one word."""
    return stem_tokens(F.array(word))[0]


def analyzer_terms(text: Column, lexicon: Lexicon, passes: int = 2) -> Column:
    """Full term chain: words, lower case, stop words, stem, numbers, length, stem, shingles."""
    low, high = ANALYZER_TOKEN_LENGTH
    stop = list(lexicon.stop)
    words = F.transform(word_tokens(strip_line_marker(text)), F.lower)
    words = blank_out(words, lambda t: ~t.isin(stop)) if stop else words
    words = stem_tokens(words)
    words = blank_out(words, lambda t: ~is_number(t) & F.length(t).between(low, high))
    words = stem_tokens(words, passes - 1)
    return F.transform(
        gap_aware_shingles(words, 3),
        lambda s: F.replace(s, F.lit(","), F.lit("(comma)")),
    )


def normalised_words(text: Column, stop: Sequence[str]) -> Column:
    """Words of the corpus count: the replacements run in this order and matter in it.

    Two numbers in a row share the blank between them, so only the first goes.
    """
    t = F.lower(text)
    t = F.regexp_replace(t, PUNCTUATION_RUN, " ")
    t = F.regexp_replace(t, r"\s+-\s+", " ")
    t = F.regexp_replace(t, r"\s+\d+\s+", " ")
    t = strip_line_marker(t, " ")
    t = F.regexp_replace(t, r"\s+", " ")
    words = F.split(t, " ")
    return keep(words, lambda w: (w != "") & ~w.isin(list(stop)))
