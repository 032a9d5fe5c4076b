"""Text functions: Column to Column, all inside Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest value that patterns are applied to.
PATTERN_BOUND = 320


#: White space of any Unicode kind.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any Unicode kind at either end; `trim` alone takes off spaces only."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def nonblank(c: Column) -> Column:
    """The stripped value; null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def bounded(c: Column) -> Column:
    return F.substring(c, 1, PATTERN_BOUND)


#: Full case folding, by the rule of Unicode that Python's own table follows: characters that become one other, and those
#: that become several (`ß` two of `s`).
_FOLDED = [(c, f) for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and (f := c.casefold()) != c]
_ONE = tuple("".join(x) for x in zip(*(p for p in _FOLDED if len(p[1]) == 1), strict=True))
_MANY = [p for p in _FOLDED if len(p[1]) > 1]


def casefold(c: Column) -> Column:
    """Full Unicode case folding, the same for every way to write a word in capitals or small letters: all forms of sigma
    meet, and `ß` meets `ss`. Nothing depends on the language. ASCII texts are only lower-cased, and only texts with a
    character that becomes several are looked at one by one."""
    one = F.translate(c, *_ONE)
    table = F.str_to_map(F.lit(",".join(f"{a}:{b}" for a, b in _MANY)), F.lit(","), F.lit(":"))
    each = F.transform(F.regexp_extract_all(one, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(table, x), x))
    several = one.rlike("[" + "".join(a for a, _ in _MANY) + "]")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).when(several, F.array_join(each, "")).otherwise(one)


def fold(c: Column) -> Column:
    """Stripped, in lower case, runs of white space, underscores and hyphens as one space. `ß` stays as it is: values are
    compared by `fold_full`."""
    return F.regexp_replace(F.lower(strip(c)), r"(?U)[\s_\-]+", " ")


def fold_full(c: Column) -> Column:
    """As `fold`, but case-folded: what values and labels are compared by."""
    return F.regexp_replace(casefold(strip(c)), r"(?U)[\s_\-]+", " ")


def fold_case(c: Column) -> Column:
    """The stricter fold: stripped and case-folded, inner characters kept."""
    return casefold(strip(c))


def fold_name(c: Column) -> Column:
    """A person's name: stripped, case-folded, runs of white space as one space."""
    return F.regexp_replace(casefold(strip(c)), r"(?U)\s+", " ")


def compact(c: Column) -> Column:
    """Lower-case letters and digits of a header."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def header_tokens(c: Column) -> Column:
    """The sorted distinct words of a header, cut at case changes, before the last capital of an acronym and at digits."""
    found = F.regexp_extract_all(c, F.lit(r"([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def tokens_of(header: str) -> set[str]:
    """header_tokens on the driver, for the few headers of a table."""
    return {t.lower() for t in re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+", header or "")}


def mask(c: Column, bound: int = 40) -> Column:
    """Upper-case letters as A, other letters as a, digits as #; cut at `bound` with an ellipsis."""
    cut = F.substring(c, 1, bound)
    for pattern, sign in ((r"\p{Lu}", "A"), (r"[\p{L}&&[^A]]", "a"), (r"\p{Nd}", "#")):
        cut = F.regexp_replace(cut, pattern, sign)
    return F.when(F.length(c) > bound, F.concat(cut, F.lit("…"))).otherwise(cut)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def slug(c: Column, longest: int = 48) -> Column:
    """A machine key: a letter and a hyphen before a word join it, the rest is letters, digits and underscores."""
    joined = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\b([a-z])-(?=[a-z])", "$1")
    key = F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    key = F.when(key == "", "field").when(key.rlike("^[a-z]"), key).otherwise(F.concat(F.lit("f_"), key))
    return F.regexp_replace(F.substring(key, 1, longest), "_+$", "")


def context_name(sheet: Column, file_name: Column) -> Column:
    """The sheet's name; for a file its stem without leading numbering."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.coalesce(nonblank(sheet), F.regexp_replace(stem, r"^[0-9_\-\s.]+", ""))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and twelve hex digits of the SHA-1 of the parts joined by |; a null part counts as None."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha1(text), 1, 12))
