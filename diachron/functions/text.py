"""The tokenizer and phrase-form scalars as Column expressions; all stay inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private-use characters that stand for a protected hyphen, plus and dot.
HYPHEN, PLUS, DOT = "", "", ""


def cleaned(text: Column) -> Column:
    """Lower-cased text reduced to ``[a-z0-9-+. ]`` with the protected symbols in place.

    Every pattern starts at a literal or at the start of a run and never gives a run back, so the cost
    is linear in the text whatever it holds.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"-(?:(?<=[0-9]-)(?=[0-9a-z])|(?<=[a-z]-)(?=[0-9]))", HYPHEN)
    t = F.regexp_replace(t, r"\+(?<=[0-9]\+)(?=[0-9])", PLUS)
    t = F.regexp_replace(t, r"(?<![a-z0-9])([a-z0-9]++)\.([a-z0-9]++)", f"$1{DOT}$2")
    t = F.regexp_replace(t, rf"(?<![a-z0-9])([0-9]++){DOT}([0-9]++)(?![a-z0-9])", "$1 $2")
    t = F.translate(t, "-+./~" + HYPHEN + PLUS + DOT + "_^", "     -+.")
    return F.regexp_replace(t, r"[^a-z0-9\-+.]+", " ")


def tokenize(text: Column) -> Column:
    """Array of tokens; empty ones and all-digit ones are dropped."""
    return F.filter(F.split(cleaned(text), " +"), lambda x: x.rlike("[^0-9]"))


def seed_ok(term: Column) -> Column:
    return term.contains(" ") | ((F.length(term) > 1) & term.rlike("[a-z]"))


def phrase_variants(phrase: Column) -> Column:
    """The phrase as it is and with (s), es and (es), without repeats."""
    p = F.trim(phrase)
    return F.array_distinct(F.array(p, F.concat(p, F.lit("(s)")), F.concat(p, F.lit("es")), F.concat(p, F.lit("(es)"))))


def strip_plural(phrase: Column) -> Column:
    """Without a trailing es, else without a trailing s; null if there is neither."""
    p = F.lower(F.trim(phrase))
    n = F.length(p)
    return F.when(p.endswith("es") & (n > 3), F.left(p, n - 2)).when(p.endswith("s") & (n > 2), F.left(p, n - 1))


def loose_candidates(phrase: Column) -> Column:
    s = strip_plural(phrase)
    return F.when(s.isNull() | (s == ""), phrase_variants(phrase)).otherwise(F.array_union(phrase_variants(phrase), F.array(s)))


def clean_fts_query(phrase: Column) -> Column:
    p = F.regexp_replace(F.trim(phrase), r"\(s\)$", "")
    p = F.trim(F.regexp_replace(F.regexp_replace(p, r"[^0-9a-zA-Z \-]", " "), r"\s+", " "))
    return F.when(p == "", F.trim(phrase)).otherwise(p)


def parse_phrases(text: Column, most: int = 5) -> Column:
    parts = F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x)))
    return F.slice(F.filter(parts, lambda x: x != ""), 1, most)


def skips_expansion(text: Column, most: int = 5) -> Column:
    """Plain English phrases that need no expansion: allowed characters and one to ``most`` parts."""
    n = F.size(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""))
    return text.rlike(r"^[A-Za-z0-9\s\-,.:']+$") & n.between(1, most)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams in order; empty for shorter arrays."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def contains_stop(phrase: Column, stop: list[str], n: int) -> Column:
    if not stop:
        return F.lit(False)
    return F.arrays_overlap(ngrams(F.split(phrase, " "), n), F.array(*[F.lit(s) for s in stop]))


def shared_tokens(a: Column, b: Column) -> Column:
    """Share of common tokens in the longer phrase, 0 without common ones: variants of each other exceed 0.4."""
    x, y = F.array_distinct(F.split(F.lower(a), " ")), F.array_distinct(F.split(F.lower(b), " "))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
