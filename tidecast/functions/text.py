"""Names: cleaning, codes and similarity, by built-in functions alone."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms and filler words that names are cleaned of.
LEGAL = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "gmbh", "ag", "sa", "nv", "bv", "pte", "sdn", "bhd",
    "kk", "gk", "plc", "spa", "lp", "llp", "srl", "oy", "ab", "as", "pty", "pvt", "the", "of", "and", "se", "kg",
)
# Words of a name that tell no company from another.
GENERIC = (
    "operations", "operation", "opns", "sales", "international", "intl", "europe", "emea", "asia", "pacific", "america", "americas", "north", "na",
    "group", "holding", "holdings", "trading", "manufacturing", "mfg", "plant", "assembly", "division", "services", "svc", "solutions", "automotive",
    "industry", "computer", "technologies", "technology", "electronics", "usa", "us", "china", "japan", "germany", "ireland",
)


def _decompositions() -> dict[str, str]:
    """Characters beyond ASCII whose compatibility decomposition (NFKD) has ASCII in it, and that ASCII."""
    marked = (chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    plain = ((c, unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) for c in marked)
    return {c: p for c, p in plain if p}


@functools.cache
def _tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters that become one each, what they become, and for each place of longer decompositions the characters that reach it and what stands there."""
    found = _decompositions()
    one = [c for c, p in found.items() if len(p) == 1]
    longer = {c: p for c, p in found.items() if len(p) > 1}
    places = []
    for i in range(max(map(len, longer.values()))):
        reach = [c for c, p in longer.items() if len(p) > i]
        places.append(("".join(reach), "".join(longer[c][i] for c in reach)))
    return "".join(one), "".join(found[c] for c in one), places


def to_ascii(text: Column) -> Column:
    """``text`` with each character decomposed for compatibility (NFKD: letters without marks, ligatures, full-width forms, numerals), what is not ASCII then dropped. Texts that are ASCII are left alone; only texts with characters of several letters are taken apart."""
    one, plain, places = _tables()
    some = places[0][0]
    spelled = lambda c: F.concat(*(F.when(F.contains(F.lit(chars), c), F.translate(c, chars, to)).otherwise(F.lit("")) for chars, to in places))
    apart = F.array_join(F.transform(F.split(text, ""), lambda c: F.when((c != "") & F.contains(F.lit(some), c), spelled(c)).otherwise(c)), "")
    whole = F.when(text.rlike(f"[{some}]"), apart).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(whole, one, plain), r"[^\x00-\x7F]", "")).otherwise(text)


def normalize_name(name: Column) -> Column:
    """Lower case without marks (by ``to_ascii``), punctuation and legal forms; words with one space between. Null gives the empty name."""
    plain = F.lower(to_ascii(F.coalesce(name, F.lit(""))))
    words = F.split(F.trim(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*LEGAL) & (w != "")), " ")


def code(value: Column, length: int) -> Column:
    """An upper-case code of a name; the word of the hierarchy's total is set apart."""
    out = F.regexp_replace(F.upper(F.trim(value)), r"[^A-Z0-9_\-]+", "_")
    out = F.substring(F.regexp_replace(out, "^_+|_+$", ""), 1, length)
    return F.when(out == "", "X").when(out == "ALL", "ALL_").otherwise(out)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def name_similarity(name: Column, alias: Column, generic: tuple[str, ...] = GENERIC, least: float = 0.6) -> Column:
    """How well the words of ``alias`` are covered by those of ``name``, less 0.12 for each further telling word (0.36 at most); at least the whole texts' similarity."""
    words, own = (F.filter(F.split(x, " "), lambda w: w != "") for x in (name, alias))
    best = F.transform(own, lambda a: F.array_max(F.transform(words, lambda t: similarity(a, t))))
    total = F.aggregate(F.transform(best, lambda b: F.when(b >= least, b).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)
    more = F.size(F.filter(words, lambda t: ~F.exists(own, lambda a: similarity(a, t) >= least) & ~t.isin(*generic)))
    covered = total / F.size(own) * (1 - F.least(F.lit(0.36), 0.12 * more))
    return F.when((F.size(words) == 0) | (F.size(own) == 0), 0.0).otherwise(F.greatest(covered, similarity(name, alias)))
