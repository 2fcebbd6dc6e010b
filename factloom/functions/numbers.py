"""Number grammar as column expressions: strict and lenient readers, locale, scale and tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that declare a cell empty (compared in lower case) and signs.
NIL_TOKENS = ("", "-", "–", "—", "−", "―", "n/a", "na", "n.a.", "n.a", "null", "nm", "n.m.", "n.m")
MINUS = "-–−"
MONEY = "decimal(38,6)"
# Fixed patterns: a number token in running text, and tokens with one reading only.
TOKEN = r"\(?[-–−+]?[$€£]?\d[\d.,]*\d%?\)?|\(?[-–−+]?\d%?\)?"
EU_ONLY = r"\d{1,3}(?:\.\d{3})+,\d+|\d{1,3}(?:\.\d{3}){2,}"
EN_ONLY = r"\d{1,3}(?:,\d{3})+\.\d+|\d{1,3}(?:,\d{3}){2,}"


def stripped(token: Column) -> Column:
    """Without white space at the ends, no-break spaces included; null reads as empty."""
    return F.regexp_replace(F.coalesce(token, F.lit("")), r"^[\s  ]+|[\s  ]+$", "")


def body_pattern(sep: str) -> str:
    dec, grp = ("\\.", ",") if sep == "." else (",", "\\.")
    return rf"\d{{1,3}}(?:{grp}\d{{3}})+(?:{dec}\d+)?|\d+(?:{dec}\d+)?|{dec}\d+"


def strict_pattern(sep: str) -> str:
    """Fixed pattern: balanced parentheses around an unsigned body, or one sign and a body; one percent sign."""
    body = body_pattern(sep)
    return rf"^(?:\(\s*(?:{body})\s*\)|[{MINUS}+]?\s*(?:{body}))\s*%?$"


def parse_strict(token: Column, sep: str = ".") -> Column:
    """struct(value, is_nil). A null value that is not nil is a reject, never a zero. One pattern decides; what it accepts
    is a number once marks and blanks are taken out, so no further pattern runs."""
    t = stripped(token)
    group = "," if sep == "." else "."
    digits = F.translate(t, f"{sep}{group}()%+{MINUS} \t\n\x0b\f\r", ".")
    size = F.concat(F.lit("0"), digits).try_cast(MONEY)
    negative = F.substring(t, 1, 1).isin("(", *MINUS)
    nil = F.lower(t).isin(*NIL_TOKENS)
    value = F.when(~nil & t.rlike(strict_pattern(sep)), F.when(negative, -size).otherwise(size))
    return F.struct(value.cast(MONEY).alias("value"), nil.alias("is_nil"))


def is_number_token(token: Column, sep: str = ".") -> Column:
    parsed = parse_strict(token, sep)
    return parsed["value"].isNotNull() | parsed["is_nil"]


def detect_separator(text: Column) -> Column:
    """',' where more tokens can only be read with a decimal comma than with a point."""
    count = lambda p: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p))
    return F.when(count(EU_ONLY) > count(EN_ONLY), ",").otherwise(".")


def parse_lenient(token: Column, sep: Column) -> Column:
    """A double; an ambiguous single group of three digits follows the document's separator."""
    t = stripped(token)
    bare = F.regexp_replace(t, r"^[()]+|[()]+$", "")
    negative = (t.startswith("(") & t.endswith(")")) | bare.rlike(rf"^\s*[{MINUS}]")
    bare = F.regexp_replace(F.regexp_replace(bare, rf"^\s*[{MINUS}+]", ""), r"[$€£%\s]", "")
    tail = F.regexp_extract(bare, r"[.,](\d+)$", 1)
    last_comma = F.length(F.substring_index(bare, ",", -1)) < F.length(F.substring_index(bare, ".", -1))
    chosen = (
        F.when(bare.contains(".") & bare.contains(","), F.when(last_comma, ",").otherwise("."))
        .when(bare.rlike(r"^\d{1,3}(?:\.\d{3}){2,}$"), ",")
        .when(bare.rlike(r"^\d{1,3}(?:,\d{3}){2,}$"), ".")
        .when((tail != "") & (F.length(tail) != 3), F.when(last_comma & bare.contains(","), ",").otherwise("."))
        .otherwise(sep)
    )
    clean = F.when(chosen == ",", F.translate(F.translate(bare, ".", ""), ",", ".")).otherwise(F.translate(bare, ",", ""))
    value = F.when(bare.rlike(r"^[\d.,]+$") & clean.rlike(r"^\d+(?:\.\d+)?$"), clean.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def input_numbers(text: Column, sep: Column | None = None) -> Column:
    """Distinct numbers of a text under one reading."""
    sep = detect_separator(text) if sep is None else sep
    return F.array_distinct(F.filter(F.transform(tokens_of(text), lambda t: parse_lenient(t, sep)), lambda v: v.isNotNull()))


def numbers_of(text: Column) -> Column:
    """Distinct absolute values under both readings."""
    reading = lambda sep: F.transform(tokens_of(text), lambda t: F.abs(parse_lenient(t, F.lit(sep))))
    both = F.concat(reading("."), reading(","))
    return F.array_distinct(F.filter(both, lambda v: v.isNotNull()))


def tolerance(value: Column, rel: float = 0.005) -> Column:
    return F.greatest(F.lit(0.5), F.abs(value) * rel)


def covered(value: Column, numbers: Column) -> Column:
    return F.exists(numbers, lambda n: F.abs(n - value) <= tolerance(value))


def sign_flipped(value: Column, numbers: Column) -> Column:
    return ~covered(value, numbers) & covered(-value, numbers) & (value != 0)


def scale_exponent(d: Column, g: Column, rel: float = 0.005) -> Column:
    """k in -9..9, not 0, with |d| = |g| * 10^k within rel; null otherwise."""
    ratio = F.abs(d.cast("double")) / F.nullif(F.abs(g.cast("double")), F.lit(0.0))
    k = F.round(F.log10(F.nullif(ratio, F.lit(0.0)))).cast("int")
    fits = F.abs(ratio / F.pow(F.lit(10.0), k) - 1) <= rel
    return F.when(fits & (k != 0) & k.between(-9, 9), k)


def decimals_tolerance(decimals: Column) -> Column:
    """Half a unit of the declared precision; 0 where it is exact or unknown."""
    return F.coalesce(F.pow(F.lit(10.0), -decimals) / 2, F.lit(0.0))


def trailing_zeros(value: Column, cap: int = 9) -> Column:
    digits = F.abs(value.cast("decimal(38,0)")).cast("string")
    return F.least(F.length(digits) - F.length(F.rtrim(digits, F.lit("0"))), F.lit(cap))
