"""Arabic text, phone and currency functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Arabic and Persian digits, marks, and letters that are folded.
ARABIC_DIGITS, PERSIAN_DIGITS, LATIN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
MARKS = "".join(chr(k) for a, b in ((0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6ED), (0x640, 0x640)) for k in range(a, b + 1))
FOLDED, INTO = "آأإٱىةؤئ", "ااااي" "هوي"
WIDE = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Runs of white space other than a single blank.
WIDE_SPACES = f"[{WIDE}&&[^ ]][{WIDE}]*+| [{WIDE}]++"


#: Signs that compatibility composition leaves alone, alone and beside each other.
COMPOSED = "\\x00-\\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0621-\u063A\u0641-\u064A\u0660-\u0669\u06F0-\u06F9\u2013\u2014\u2018-\u201D"


@pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark has no function for. Only texts with a sign that it may change go through Arrow."""
    return F.coalesce(_nfkc(F.when(text.rlike(f"[^\\x00-\\x7F](?<![{COMPOSED}])"), text)), text)


def latin_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS + PERSIAN_DIGITS, LATIN_DIGITS * 2)


def normalize_arabic(text: Column, compatibility: bool = True) -> Column:
    """Folded text for search; null counts as empty. ``compatibility`` off leaves out NFKC for texts known to be composed."""
    s = nfkc(text) if compatibility else text
    s = F.coalesce(s, F.lit(""))
    folded = F.translate(s, FOLDED + ARABIC_DIGITS + PERSIAN_DIGITS + MARKS, INTO + LATIN_DIGITS * 2)
    s = F.when(s.rlike("[\u0610-\u06FF]"), folded).otherwise(s)  # other texts have nothing to fold
    return F.lower(F.trim(F.regexp_replace(s, WIDE_SPACES, " ")))


def slugify(text: Column, compatibility: bool = True) -> Column:
    dashed = F.regexp_replace(normalize_arabic(text, compatibility), r"[^\p{L}\p{N}]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 80)


def tokenize(text: Column, compatibility: bool = True) -> Column:
    return F.filter(F.split(normalize_arabic(text, compatibility), " "), lambda t: t != "")


def normalize_phone(text: Column) -> Column:
    """+9647 and nine digits, or null."""
    s = F.regexp_replace(F.translate(text, ARABIC_DIGITS, LATIN_DIGITS), "[^0-9+]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^\+", ""), "^00", "")
    s = F.when(s.startswith("964"), F.substring(s, 4, 1000)).when(s.startswith("0"), F.substring(s, 2, 1000)).otherwise(s)
    return F.when(s.rlike("^7[0-9]{9}$"), F.concat(F.lit("+964"), s))


def local_phone(text: Column) -> Column:
    """0770 123 4567, or the input if it is no phone number."""
    local = F.concat(F.lit("0"), F.substring(normalize_phone(text), 5, 10))
    return F.when(local.isNotNull(), F.concat(F.substring(local, 1, 4), F.lit(" "), F.substring(local, 5, 3), F.lit(" "), F.substring(local, 8, 4))).otherwise(text)


def format_iqd(amount: Column, symbol: bool = True, latin: bool = True) -> Column:
    """Half up to whole dinars with thousands marks; null gives a zero."""
    whole = F.format_number(F.floor(amount + F.lit("0.5").cast("decimal(2,1)")), 0)
    shown = whole if latin else F.translate(whole, LATIN_DIGITS + ",", ARABIC_DIGITS + "٬")
    out = F.coalesce(shown, F.lit("٠"))
    return F.concat(out, F.lit(" د.ع")) if symbol else out


def parse_iqd(text: Column) -> Column:
    """Whole dinars from typed text, half up; 0 if it is no number."""
    cleaned = F.regexp_replace(F.translate(text, ARABIC_DIGITS, LATIN_DIGITS), "[^0-9.-]", "")
    number = F.regexp_replace(cleaned, r"\.$", "").try_cast("decimal(30,6)")
    return F.coalesce(F.floor(number + F.lit("0.5").cast("decimal(2,1)")), F.lit(0)).cast("long")
