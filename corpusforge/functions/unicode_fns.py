"""Unicode normal forms as Arrow functions: Spark has no built-in for them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

_LINE_BLANKS = re.compile(r"[^\S\n]+")


def _map(form: str, squeeze: bool = False):
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            x = x if unicodedata.is_normalized(form, x) else unicodedata.normalize(form, x)
            return _LINE_BLANKS.sub(" ", x).strip() if squeeze else x

        return s.map(one, na_action="ignore")

    return f


def nfc(c: Column) -> Column:
    return _map("NFC")(c)


def nfkc_key(c: Column) -> Column:
    """NFKC with blanks squeezed, line breaks kept: a key for comparisons."""
    return _map("NFKC", True)(c)


def remove_dot_below_composed(c: Column) -> Column:
    """Without the dot below on letters, composed letters too (ạ -> a)."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", unicodedata.normalize("NFD", x).replace("̣", "")), na_action="ignore")

    return f(c)
