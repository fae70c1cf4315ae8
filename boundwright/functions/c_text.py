"""Scalar functions over C expressions and messages, as Column expressions. Identifiers are ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that may lead an expression.
LEADING = ("return", "if", "else", "while", "for", "switch", "case", "sizeof", "void")
#: Identifiers that are no symbols.
NO_SYMBOLS = (
    "if", "for", "while", "return", "sizeof", "void", "uint8", "uint16", "uint32", "uint8_t", "uint16_t", "uint32_t", "int", "const", "static", "null", "true",
    "false", "else", "switch", "case", "break", "continue", "unsigned", "signed", "struct", "enum", "typedef", "volatile", "NULL", "TRUE", "FALSE",
)
#: Letters outside brackets, strings and characters, with and without commas; a string or character.
ANY, NO_COMMA = r"[^()\[\]{}\"']", r"[^(),\[\]{}\"']"
QUOTED = r"""\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'"""
#: What an error of each kind says, lower-cased.
ERRORS = {
    "timeout": ("timed out", "timeout"),
    "rate_limit": ("429", "too many requests"),
    "network": ("connection aborted", "connection reset", "connectionreseterror", "nameresolutionerror", "getaddrinfo failed", "failed to resolve", "max retries exceeded", "temporarily unavailable"),
}


def collapsed(text: Column) -> Column:
    """Words joined by single blanks."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def is_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def member_access(text: Column) -> Column:
    """`->` as a dot, without blanks after dots."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("->"), F.lit(".")), r"\.\s+", "."))


def without_keyword(text: Column) -> Column:
    """An expression without one leading keyword."""
    return F.trim(F.regexp_replace(F.trim(text), rf"(?i)^({'|'.join(LEADING)})(?![A-Za-z0-9_])", ""))


def rightmost_path(text: Column) -> Column:
    """The dotted path that ends a text."""
    return F.trim(F.regexp_extract(F.trim(text), r"[A-Za-z0-9_.]*$", 0), F.lit(" ."))


def identifiers(text: Column) -> Column:
    """The distinct identifiers of a text in their order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))


def callees(text: Column) -> Column:
    """The distinct names that a text calls in their order."""
    called = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    return F.array_distinct(F.filter(called, lambda x: ~x.isin(*NO_SYMBOLS)))


def symbols(names: Column, called: Column) -> Column:
    """Identifiers without callees, keywords, type names and placeholders such as CName."""
    placeholder = lambda x: x.rlike("^C[A-Z][a-z]+$") & ~F.contains(x, F.lit("Idx"))
    return F.filter(names, lambda x: ~x.isin(*NO_SYMBOLS) & ~F.array_contains(called, x) & ~x.endswith("Type") & ~placeholder(x))


def balanced(unit: str) -> str:
    """A pattern of units, strings, characters and brackets around them, to four levels; possessive, so it takes linear time and no stack."""
    inner = ""
    for _ in range(4):
        inner = rf"|[(\[{{](?:[^()\[\]{{}}\"']++|{QUOTED}{inner})*+[)\]}}]"
    return f"(?:{unit}++|{QUOTED}{inner})*+"


def arguments(text: Column, opened: Column) -> Column:
    """The arguments of the call whose parenthesis opens at a position (from 1): cut at commas in no inner bracket, string or character.

    They end with the call, or with the text where it doesn't end there. Two patterns cut calls that end and are at most five brackets deep; a fold over the letters cuts all others.
    """
    rest = F.substring(text, opened, F.length(text))
    call = F.regexp_extract(rest, rf"(?s)^[(\[{{]{balanced(ANY)}[)\]}}]", 0)
    inside = F.substring(call, F.lit(2), F.length(call) - 2)
    cut = F.regexp_extract_all(F.concat(F.lit(","), inside), F.lit(f"(?s),({balanced(NO_COMMA)})"), F.lit(1))
    none = F.array().cast("array<string>")
    rarer = F.get(F.transform(F.array(folded_arguments(rest)), lambda parts: F.when(parts == F.array(F.lit("")), none).otherwise(parts)), 0)
    return F.when(call == "", rarer).when(F.trim(inside) == "", none).otherwise(F.transform(cut, lambda x: F.trim(x)))


def folded_arguments(rest: Column) -> Column:
    """The arguments of a text that starts with a call's parenthesis; an empty one where there is none. One pass over the letters keeps the depth and the cuts only."""
    letters = F.transform(F.split(rest, ""), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("escaped"), F.lit(False).alias("ended"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, letter: Column) -> Column:
        x, plain = letter["x"], (s["quote"] == "") & ~s["ended"]
        depth = s["depth"] + F.when(plain & x.isin("(", "[", "{"), 1).when(plain & x.isin(")", "]", "}"), -1).otherwise(0)
        ended = s["ended"] | (depth == 0)
        cut = plain & ((letter["i"] == 1) | ended | ((x == ",") & (s["depth"] == 1)))
        quote = F.when(s["escaped"], s["quote"]).when((s["quote"] == "") & x.isin('"', "'"), x).when(x == s["quote"], "").otherwise(s["quote"])
        cuts = F.when(cut, F.array_append(s["cuts"], letter["i"])).otherwise(s["cuts"])
        return F.struct(depth.alias("depth"), quote.alias("quote"), ((s["quote"] != "") & ~s["escaped"] & (x == "\\")).alias("escaped"), ended.alias("ended"), cuts.alias("cuts"))

    def cut(s: Column) -> Column:
        cuts = F.when(s["ended"], s["cuts"]).otherwise(F.array_append(s["cuts"], F.length(rest) + 1))
        pairs = F.slice(F.arrays_zip(cuts.alias("a"), F.slice(cuts, 2, F.size(cuts)).alias("b")), 1, F.greatest(F.size(cuts) - 1, F.lit(0)))
        return F.transform(pairs, lambda c: F.trim(F.substring(rest, c["a"] + 1, c["b"] - c["a"] - 1)))

    return F.aggregate(letters, start, step, cut)


def last_member(text: Column) -> Column:
    """The last name of a member access, blanks left out: `f` of `a -> b . f`."""
    return F.substring_index(F.replace(F.regexp_replace(text, r"\s", ""), F.lit("->"), F.lit(".")), ".", -1)


def made_location(tag: Column, line: Column, column: Column) -> Column:
    """`tag:line.1-column`, the column at least 1; empty without a line."""
    return F.when(line.isNull(), "").otherwise(F.concat(tag, F.lit(":"), line.cast("string"), F.lit(".1-"), F.greatest(F.lit(1), F.coalesce(column, F.lit(1))).cast("string")))


def error_kind(text: Column) -> Column:
    """timeout, rate_limit or network, for errors that are worth a retry; else null."""
    out = F.lit(None).cast("string")
    for kind, signs in reversed(list(ERRORS.items())):
        said = F.contains(F.lower(text), F.lit(signs[0]))
        for sign in signs[1:]:
            said = said | F.contains(F.lower(text), F.lit(sign))
        out = F.when(said, kind).otherwise(out)
    return out


def report_class(text: Column) -> Column:
    """A report's class by its aliases; review for anything else."""
    # The aliases of each class.
    names = {"false": ("false", "f", "fp", "false_positive"), "true (low)": ("true (low)", "true_low", "low", "potential"), "true": ("true", "t", "bug", "tp", "true_positive"), "undecided": ("undecided", "u", "inter_procedural")}
    raw, out = F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("review")
    for name, aliases in names.items():
        out = F.when(raw.isin(*aliases), name).otherwise(out)
    return out


def message_tokens(text: Column, total: Column, given: Column, made: Column) -> Column:
    """A provider's total if positive, else tokens given and made if positive, else characters over four."""
    size = F.length(F.coalesce(text, F.lit("")))
    estimate = F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / 4)))
    both = F.coalesce(given, F.lit(0)) + F.coalesce(made, F.lit(0))
    return F.when(total > 0, total).when(both > 0, both).otherwise(estimate).cast("bigint")
