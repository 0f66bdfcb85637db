"""Text normalisation: trimming, terms, keys, search tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with diacritics and the letters they fold to in the search index.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"


def trim_white(text: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_white(text: Column) -> Column:
    return trim_white(F.regexp_replace(text, r"(?U)\s+", " "))


def non_blank(text: Column) -> Column:
    """The trimmed text, or null where nothing is left."""
    return F.nullif(trim_white(text), F.lit(""))


def first_non_blank(*texts: Column) -> Column:
    return F.coalesce(*[non_blank(t) for t in texts], F.lit(""))


def join_non_blank(separator: str, *texts: Column) -> Column:
    return F.concat_ws(separator, *[non_blank(t) for t in texts])


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def count_id(text: Column) -> Column:
    """Identifier of a count: lower case, each other character an underscore, none at the ends; blank is unknown."""
    out = F.regexp_replace(F.lower(trim_white(text)), "[^a-z0-9]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(out, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def term(text: Column) -> Column:
    """Index term: runs of other characters become one underscore; null unless 2 to 80 characters are left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.length(out).between(2, 80), out)


def terms(text: Column) -> Column:
    """Distinct terms of each word and of the whole text, words first."""
    words = F.split(collapse_white(text), " ")
    every = F.concat(F.transform(words, lambda w: term(w)), F.array(term(text)))
    return F.array_distinct(F.filter(every, lambda t: t.isNotNull()))


def cut(text: Column, most: int) -> Column:
    """White space collapsed, then at most so many bytes of UTF-8, trimmed; a character that the cut would split goes."""
    data = F.encode(collapse_white(text), "UTF-8")
    return trim_white(F.coalesce(*[F.try_validate_utf8(F.substring(data, 1, n).cast("string")) for n in range(most, most - 4, -1)]))


def key(text: Column) -> Column:
    """Letters and digits in lower case, all else one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "))


def token_set(text_key: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text_key, " ")), " ")


def search_text(text: Column) -> Column:
    """Runs of letters and digits, lower case, diacritics folded, joined by one space."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def search_tokens(text: Column) -> Column:
    """Those runs as an array."""
    return F.filter(F.split(search_text(text), " "), lambda t: t != "")


def word_count(joined: Column) -> Column:
    """Words of a text that are joined by one space."""
    return F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.translate(joined, " ", "")) + 1)


def numeric_prefix(text: Column) -> Column:
    """Leading whole number of a text, as loose casts give it; null where there is none."""
    return F.regexp_extract(F.trim(text), r"^[+-]?\d+", 0).try_cast("bigint")
