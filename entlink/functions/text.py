"""Name and address functions as column expressions; texts beyond plain letters are folded by an Arrow function."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
# Legal suffixes of company names, and address words with their short forms.
LEGAL = ("inc", "incorporated", "llc", "llp", "ltd", "limited", "pvt", "private", "corp", "corporation", "company", "co", "plc", "sarl", "sas", "eurl")
ADDRESS_ALIAS = {"road": "rd", "street": "st", "avenue": "ave", "drive": "dr", "lane": "ln", "boulevard": "blvd", "apartment": "apt", "suite": "ste"}
# The pattern of units.
# A unit's word, an optional "no" and sign, then the unit itself; no letter, digit or underscore may come before.
UNIT = r"(?<![\p{L}\p{N}_])(?:unit|suite|ste|apt|apartment|flat)(?U:\s)*(?:no\.?(?U:\s)*)?[:#-]?(?U:\s)*([\p{L}\p{N}_]+)"


# Characters that NFKC leaves alone, in any order, and whose case folding is their small letter (or "ss"):
# ASCII, and the letters from U+00C0 to U+017E but those with a compatibility form or a dot of their own.
PLAIN = "^[\\x00-\\x7F\\u00C0-\\u012F\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E]*$"


def _where_needed(text: Column, change: Callable[[str], str], plain: Column) -> Column:
    """``plain`` where a text has plain characters only; else ``change`` by an Arrow function, which gets only those texts."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(change, na_action="ignore")

    simple = text.rlike(PLAIN)
    return F.when(simple, plain).otherwise(F.pandas_udf(run, "string")(F.when(~simple, text)))


def fold(text: Column) -> Column:
    """Text in its compatibility form (NFKC), case-folded; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    return _where_needed(text, lambda x: unicodedata.normalize("NFKC", x).casefold(), F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def words(folded: Column) -> Column:
    """Runs of letters and digits; combining marks and underscores separate."""
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def norm(text: Column) -> Column:
    return F.array_join(words(fold(text)), " ")


def address_words(folded: Column) -> Column:
    """Words of an address without "null" and "none", long forms replaced by short ones."""
    alias = F.create_map(*[F.lit(x) for pair in ADDRESS_ALIAS.items() for x in pair])
    kept = F.filter(words(folded), lambda t: ~t.isin("null", "none"))
    return F.transform(kept, lambda t: F.coalesce(F.try_element_at(alias, t), t))


def core_words(tokens: Column) -> Column:
    """Sorted distinct words that are no legal suffix."""
    return F.array_sort(F.array_except(tokens, F.array(*[F.lit(x) for x in LEGAL])))


def grams(text: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` characters, spaces included; none if the text is shorter. Linear in the text."""

    def runs(c: Column) -> Column:
        return F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(0))), lambda x, i: F.concat(x, *[F.get(c, i + k) for k in range(1, n)]))

    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.array_distinct(F.get(F.transform(F.array(chars), runs), F.lit(0)))


def gram_codes(grams: Column) -> Column:
    """Runs of three characters as numbers, 21 bits a character: equal if and only if the texts are, and a third of their size."""
    return F.transform(grams, lambda x: F.shiftleft(F.ascii(x).cast("bigint"), 42) + F.shiftleft(F.ascii(F.substring(x, 2, 1)).cast("bigint"), 21) + F.ascii(F.substring(x, 3, 1)))


def number_words(address: Column) -> Column:
    """Distinct runs of digits with the small letters that follow them."""
    return F.array_distinct(F.regexp_extract_all(address, F.lit(r"\p{Nd}+[a-z]*"), F.lit(0)))


def unit_id(folded: Column) -> Column:
    return F.regexp_extract(folded, UNIT, 1)


def clean_text(text: Column) -> Column:
    """NFKC and single spaces, case and accents kept: what an encoder reads."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(_where_needed(text, lambda x: unicodedata.normalize("NFKC", x), text), r"(?U:\s)+", " "))


def encoder_view(name: Column, address: Column, view: str = "combined") -> Column:
    if view == "name":
        return F.concat(F.lit("query: "), clean_text(name))
    if view == "combined":
        return F.concat(F.lit("query: business name: "), clean_text(name), F.lit("; address: "), clean_text(address))
    raise ValueError(view)


def is_blank(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U:\s)+", "") == ""


def jaccard(a: Column, b: Column) -> Column:
    """0 if both are empty; null arrays count as empty sets nowhere: pass arrays. Both hold distinct elements."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Common elements by the smaller set's size; 0 if either is empty. Both arrays hold distinct elements."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def parse_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def format_list(items: Column) -> Column:
    return F.coalesce(F.array_join(items, ","), F.lit(""))
