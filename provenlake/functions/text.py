"""Text functions as Column expressions; nulls give nulls unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(K.TOKEN), F.lit(0))


def normalized(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def stemmed(token: Column) -> Column:
    out = None
    for ending, least, cut, put in K.STEM_RULES:
        applies = F.endswith(token, F.lit(ending)) & (F.char_length(token) >= least)
        if ending == "s":
            applies = applies & ~F.endswith(token, F.lit("ss"))
        value = F.concat(F.left(token, F.char_length(token) - cut), F.lit(put))
        out = F.when(applies, value) if out is None else out.when(applies, value)
    return out.otherwise(token)


def stem_word(word: str) -> str:
    """stemmed() of one word, for word lists that become literals."""
    for ending, least, cut, put in K.STEM_RULES:
        if word.endswith(ending) and len(word) >= least and not (ending == "s" and word.endswith("ss")):
            return word[:-cut] + put
    return word


def word_set(words: Iterable[str], stopwords: bool = False) -> Column:
    """A word list, stemmed, as an array literal; stopwords are left out unless asked for."""
    return F.array(*[F.lit(w) for w in sorted({stem_word(w) for w in words if stopwords or w not in K.STOPWORDS})])


def terms(text: Column) -> Column:
    """Stems of the tokens that are no stopwords, numbers or years; order and repeats stay."""
    stop = F.array(*[F.lit(w) for w in K.STOPWORDS])
    kept = F.filter(tokens(text), lambda t: ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$"))
    return F.transform(kept, stemmed)


def term_set(text: Column) -> Column:
    return F.array_distinct(terms(text))


def numbers(text: Column) -> Column:
    """Distinct numbers, without a per-cent sign at the end."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(?U)" + K.NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.rtrim(x, F.lit("%"))))


def dates(text: Column) -> Column:
    """Distinct YYYY-MM-DD and four-digit runs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?U)" + K.DATE), F.lit(0)))


def sorted_numbers(numbers: Column) -> Column:
    """Numbers by value, then other texts by text."""
    keyed = F.transform(numbers, lambda x: F.struct(x.try_cast("double").isNull().alias("odd"), x.try_cast("double").alias("v"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def phrases(terms: Column) -> Column:
    """Distinct runs of two and of three terms, joined by spaces."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(terms) >= n, F.sequence(F.lit(1), F.size(terms) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(terms, i, n), " "))

    return F.array_distinct(F.concat(runs(2), runs(3)))


def any_pattern(text: Column, patterns: Iterable[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def any_substring(text: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def short_id(prefix: str, *parts: Column) -> Column:
    """prefix-, then twelve hex digits of the SHA-256 of the parts joined by colons."""
    return F.concat(F.lit(prefix + "-"), F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(12)))


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def safe_name(text: Column) -> Column:
    """File name part: everything but letters, digits, dot, underscore and hyphen becomes a hyphen."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "-")


def anchor(text: Column, fallback: str) -> Column:
    """Link anchor: lower case, other runs than a-z, 0-9 and hyphen become one hyphen."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9-]+", "-"), "-+", "-")
    out = F.btrim(out, F.lit("-"))
    return F.when(out == "", F.lit(fallback)).otherwise(out)


def rounded(value: Column, digits: int = 4) -> Column:
    """Half-up rounding by floor, which other engines reproduce to the bit."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def clamped(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
