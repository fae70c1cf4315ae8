"""Scalar functions over alarm fields and C text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The range of each integer type.
INTEGER_TYPES = (("uint8", 0, 255), ("uint16", 0, 65535), ("uint32", 0, 4294967295), ("int8", -128, 127), ("int16", -32768, 32767), ("int32", -2147483648, 2147483647))


def order_id(text: Column) -> Column:
    """`1,112` as 1112; null if it is no integer."""
    return F.regexp_replace(F.trim(text), "[ ,]", "").try_cast("bigint")


def after(text: Column, sign: str) -> Column:
    """What follows the first sign of a text; empty if it has none."""
    at = F.instr(text, sign)
    return F.when(at > 0, text.substr(at + 1, F.length(text))).otherwise("")


def digits(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def location(text: Column) -> dict[str, Column]:
    """file, line, col_start, col_end, end_line of `file:line.col`, `file:line.col-col` or `file:line.col-line.col`.

    The last colon ends the file. Nulls if the start is no `line.col`; an end, or a part of it, that is no number counts as the start's.
    """
    text = F.trim(text)
    part = lambda i: F.regexp_extract(text, r"(?s)^(.*):([0-9]+)\.([0-9]+)(?:-([^:]*))?$", i)
    line, column, end = part(2).try_cast("bigint"), part(3).try_cast("bigint"), part(4)
    two = F.contains(end, F.lit("."))
    if_told = lambda x: F.when(line.isNotNull() & column.isNotNull(), x)
    return {
        "file": if_told(part(1)),
        "line": F.when(column.isNotNull(), line),
        "col_start": F.when(line.isNotNull(), column),
        "end_line": if_told(F.coalesce(F.when(two, digits(F.substring_index(end, ".", 1))), line)),
        "col_end": if_told(F.coalesce(F.when(two, digits(after(end, "."))).otherwise(digits(end)), column)),
    }


def bare_name(variable: Column) -> Column:
    """A variable without its scope and quotes."""
    return F.regexp_replace(F.substring_index(variable, "@", 1), '"', "")


def root_name(variable: Column) -> Column:
    return F.substring_index(bare_name(variable), ".", 1)


def has_token(text: Column, token: str) -> Column:
    """Whether the token stands in the text as it is, not as a part of a longer identifier."""
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{token}\E(?![\p{{L}}\p{{N}}_])")


def int_literal(text: Column) -> Column:
    """The value of a hexadecimal or decimal C literal with a suffix, in any number of parentheses, blanks left out; null for anything else."""
    bare = F.regexp_replace(text, r"\s", "")
    # Pairs of parentheses around the whole: as many as it opens with, if it ends with as many.
    inside = F.regexp_extract(bare, r"^\(*(.*?)\)*$", 1)
    opened, closed = F.length(F.regexp_extract(bare, r"^\(*", 0)), F.length(F.regexp_extract(bare, r"\)*$", 0))
    bare = F.when(opened == closed, inside).otherwise("")
    bare = F.regexp_extract(bare, "^(0[xX][0-9a-fA-F]+|[0-9]+)(?:[uU]?[lL]{0,2}|[lL]{1,2}[uU])$", 1)
    hexadecimal = F.conv(F.substring(bare, 3, 32), 16, 10).try_cast("bigint")
    return F.when(F.lower(bare).startswith("0x"), hexadecimal).otherwise(bare.try_cast("bigint"))


def mask(text: Column) -> Column:
    """The first mask literal of a text: hexadecimal before decimal."""
    hexadecimal = F.conv(F.regexp_extract(text, r"&\s*0[xX]([0-9a-fA-F]+)", 1), 16, 10).try_cast("bigint")
    decimal = F.regexp_extract(text, r"&\s*([0-9]+)", 1).try_cast("bigint")
    return F.coalesce(F.when(F.regexp_extract(text, r"&\s*0[xX]([0-9a-fA-F]+)", 1) != "", hexadecimal), decimal)


def type_range(text: Column) -> tuple[Column, Column]:
    """The least and greatest value of the integer type that a text names, the unsigned ones first."""
    low, high = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for name, least, most in reversed(INTEGER_TYPES):
        named = F.contains(F.lower(text), F.lit(name))
        low, high = F.when(named, F.lit(least).cast("bigint")).otherwise(low), F.when(named, F.lit(most).cast("bigint")).otherwise(high)
    return low, high


def estimated_tokens(text: Column) -> Column:
    """Characters over four, at least one; none for an empty text."""
    size = F.length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / 4))).cast("bigint")


def fingerprint(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by bars; a null reads None."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256), 1, 16)


def normal_class(text: Column) -> Column:
    """A verdict's class by its aliases; null if unknown."""
    # The aliases of each class.
    names = {"false": ("false", "f", "fp", "false_positive"), "true (low)": ("true (low)", "true_low", "low", "potential"), "true": ("true", "t", "bug", "true_positive"), "undecided": ("undecided", "u", "inter_procedural"), "review": ("review", "uncertain", "unknown")}
    out = F.lit(None).cast("string")
    for name, aliases in names.items():
        out = F.when(F.lower(F.trim(text)).isin(*aliases), name).otherwise(out)
    return out
