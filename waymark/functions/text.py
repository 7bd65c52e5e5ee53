"""String functions: tokens, character grams, URLs, paths and terminal codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a host name, port and path a request may name.
URL_LABEL = r"[a-z0-9](?:[-a-z0-9]*[a-z0-9])?"
URL_PATTERN = (
    r"(?i)(?U)(?<![\w@.])"
    r"((?:https?://)?(?:www\.)?" + URL_LABEL + r"(?:\." + URL_LABEL + r")*\.[a-z]{2,24}"
    r"(?::\d{2,5})?(?:/[\w\-._~:/?#\[\]@!$&'()*+,;=%]*)?)"
    r"(?![\w@])"
)
URL_TRAILING = r"""[.,!?)\]'"]+$"""
# Fixed value: terminal escape sequences.
ANSI_PATTERN = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
# Fixed value: path segments that are identifiers.
PATH_ID_PATTERN = r"/[0-9a-f-]{8,}"


def tokenize(text: Column) -> Column:
    """Lower-case alphanumeric tokens; mixed ones also give their letter and digit runs of 2+ characters."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"([a-z0-9]+)"), 1)

    def runs(word: Column) -> Column:
        parts = F.regexp_extract_all(word, F.lit(r"([a-z]+|[0-9]+)"), 1)
        mixed = word.rlike("[a-z]") & word.rlike("[0-9]")
        return F.when(mixed, F.concat(F.array(word), F.filter(parts, lambda p: F.length(p) > 1))).otherwise(F.array(word))

    # most texts hold no mixed word at all
    return F.when(low.rlike("[a-z][0-9]|[0-9][a-z]"), F.flatten(F.transform(words, runs))).otherwise(words)


def padded_alnum(text: Column) -> Column:
    """Lower-case text with everything but letters and digits blanked, one blank at both ends."""
    blanked = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " ")
    return F.concat(F.lit(" "), F.trim(blanked), F.lit(" "))


def char_grams(text: Column, n: int = 3) -> Column:
    """
    All overlapping n-grams in one linear pass: a look-ahead matches at every position.

    Java steps by UTF-16 unit, so a position inside a surrogate pair gives a gram with an
    undecodable half, which arrives as '?'. The padded text holds no '?', so those go.
    """
    grams = F.regexp_extract_all(padded_alnum(text), F.lit("(?s)(?=(" + "." * n + "))"), 1)
    return F.filter(grams, lambda g: ~g.contains("?"))


def first_url(text: Column) -> Column:
    """First URL named in the text, or null; trailing punctuation trimmed."""
    raw = F.regexp_replace(F.regexp_extract(text, URL_PATTERN, 1), URL_TRAILING, "")
    return F.when(raw != "", raw)


def normalised_url(text: Column) -> Column:
    """``first_url`` with https as the default scheme, scheme and host in lower case, path as typed."""
    raw = first_url(text)
    full = F.when(F.lower(raw).rlike("^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    head = F.regexp_extract(full, r"^([^:]*://[^/]*)", 1)
    return F.concat(F.lower(head), F.substring(full, F.length(head) + 1, F.length(full)))


def normalise_path(path: Column) -> Column:
    return F.regexp_replace(path, PATH_ID_PATTERN, "/{id}")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI_PATTERN, "")


def word_parts(name: Column) -> Column:
    """Words of a field or API name."""
    return F.filter(F.split(F.lower(name), r"(?U)[_\-\s]+"), lambda w: w != "")


def alnum_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
