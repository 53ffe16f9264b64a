"""Search text: compatibility forms, accents and case folded; terms and identifiers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ACCENTS = re.compile("[̀-ͯ]")
_HEX = re.compile("[0-9a-f]+")


def fold(text: str) -> str:
    return _ACCENTS.sub("", unicodedata.normalize("NFKD", text)).lower()


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(fold, na_action="ignore")


def folded(text: Column) -> Column:
    """``fold`` of a column. Texts of plain ASCII stay in the JVM's lower case."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(_folded(text))


def terms(query: str) -> list[str]:
    """Terms of a query: cut at white space and punctuation, without an 0x in front of hexadecimal digits."""
    out, word = [], ""
    for c in fold(query) + " ":
        if c.isspace() or unicodedata.category(c).startswith("P"):
            out.append(word)
            word = ""
        else:
            word += c
    return [t for t in (re.sub("^0x(?=[0-9a-f]+$)", "", w) for w in out) if t]


def matches_term(haystack: Column, identifier: Column, term: str) -> Column:
    """The term is in the text, or names the identifier (lower-case hex without leading zeros): up to two digits in full."""
    hit = F.contains(haystack, F.lit(term))
    if _HEX.fullmatch(term):
        digits = term.lstrip("0") or "0"
        named = identifier == digits if len(digits) < 3 else F.contains(identifier, F.lit(digits))
        hit = hit | F.coalesce(named, F.lit(False))
    return hit
