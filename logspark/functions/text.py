"""Tokens, keyword cleaning, message hygiene and exception text."""

from pyspark.sql import Column, functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}_]+"
# Characters a keyword must not carry into a search.
SEARCH_META = r"[+\-=&|><!(){}\[\]^\"~*?:\\/]"
# Script markup and what it becomes.
SCRIPT_RULES = (
    (r"(?i)<script", "&lt;script"),
    (r"(?i)</script>", "&lt;/script&gt;"),
    (r"(?i)javascript:", ""),
    (r"(?i)onerror\s*=", ""),
    (r"(?i)onload\s*=", ""),
)
# Words that an identifier or keyword must not contain.
BLACKLIST = (
    r"(?i)(union|select|insert|update|delete|drop|create|alter|exec|execute"
    r"|script|javascript|<script|</script>)"
)
MAX_MESSAGE = 10_000
# Fixed value: name shown when an exception carries no class.
UNKNOWN_EXCEPTION = "未知异常"


def tokens(text: Column) -> Column:
    """Lower-case words of a text; empty pieces are dropped."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def fuzziness(term: str) -> int:
    """Edit distance allowed for a search term of this length."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def swaps(term: str) -> list[str]:
    """The term with two letters that stand next to each other swapped, each place once."""
    out = {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)}
    return sorted(out - {term})


def is_near(word: Column, term: str) -> Column:
    """Does the word lie within the distance allowed for the term? A swap of two neighbours is one edit."""
    k = fuzziness(term)
    if k == 0:
        return word == term
    swapped = word.isin(*swaps(term))
    if k == 2:
        # a swap and one more edit; two swaps that do not touch are covered from either one
        for other in swaps(term):
            swapped = swapped | (F.levenshtein(word, F.lit(other), 1) >= 0) | word.isin(*swaps(other))
    # a swap is two plain edits, so one bounded comparison settles most words
    by_swaps = (F.levenshtein(word, F.lit(term), 2 * k) > k) & swapped
    close = (F.levenshtein(word, F.lit(term), k) >= 0) | by_swaps
    return F.length(word).between(len(term) - k, len(term) + k) & close


def matches_fuzzy(text: Column, terms: list[str]) -> Column:
    """True if any word of the text lies within the allowed distance of any term."""

    def near(word: Column) -> Column:
        hit = F.lit(False)
        for term in terms:
            hit = hit | is_near(word, term)
        return hit

    return F.exists(tokens(text), near)


#: Letters at the start of a word whose deletions are indexed.
PREFIX = 7


def deletions(word: str, most: int = 2) -> list[str]:
    """What is left of the start of a word after up to so many deletions; words within that distance share one."""
    found, last = {word[:PREFIX]}, {word[:PREFIX]}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found |= last
    return sorted(found)


def deletions_of(word: Column) -> Column:
    """The same for a column of words, with two deletions."""
    start = F.substring(word, 1, PREFIX)
    less = lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.length(w)), lambda i: i > 0), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(PREFIX)))
    )
    once = less(start)
    return F.array_distinct(F.concat(F.array(start), once, F.flatten(F.transform(once, less))))


def matches_any(text: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(tokens(text), F.array(*[F.lit(t) for t in terms]))


def clean_keyword(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(text, SEARCH_META, " "))
    return F.regexp_replace(spaced, r"\s+", " ")


def neutralise_scripts(text: Column) -> Column:
    for pattern, replacement in SCRIPT_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def clean_message(text: Column, limit: int = MAX_MESSAGE) -> Column:
    text = F.coalesce(text, F.lit(""))
    cut = F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("...[truncated]"))
    ).otherwise(text)
    return neutralise_scripts(cut)


def abbreviate(text: Column, limit: int = 500) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def exception_class(stack: Column) -> Column:
    """Class name: what stands before the first colon of the first line."""
    name = F.trim(F.regexp_extract(stack, r"^([^:\r\n]*)", 1))
    return F.when(name != "", name)


def cause_classes(stack: Column) -> Column:
    """Classes of the cause chain, outermost first."""
    return F.regexp_extract_all(stack, F.lit(r"Caused by: ([^:\r\n]+)"), F.lit(1))


def exception_short_name(name: Column) -> Column:
    last = F.element_at(F.split(name, r"\."), -1)
    short = F.when(
        last.endswith("Exception"), F.substring(last, F.lit(1), F.length(last) - 9)
    ).otherwise(last)
    return F.when(F.coalesce(name, F.lit("")) == "", UNKNOWN_EXCEPTION).otherwise(short)
