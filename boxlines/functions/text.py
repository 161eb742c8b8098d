"""Column functions on recognised text and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a reader takes for a pair of parentheses, in the order in which they are tried
ROUND = ("O", "0", "Q", "®")


def fix_parentheses(text: Column) -> Column:
    """Repairs `()` read as a round letter. The first of ROUND that fits decides: one that stands first at
    the very end after a letter becomes `()`; else all before a colon do."""
    out = text
    for char in reversed(ROUND):
        first = F.instr(text, char)
        at_end = (first > 0) & (first == F.length(text))
        before = F.when(F.length(text) == 1, text).otherwise(F.substring(text, F.length(text) - 1, F.lit(1)))
        out = (
            F.when(at_end & before.rlike(r"^\p{L}$"), F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit("()")))
            .when(F.contains(text, F.lit(f"{char}:")), F.replace(text, F.lit(f"{char}:"), F.lit("():")))
            .otherwise(out)
        )
    return out


def is_method(text: Column) -> Column:
    """Whether the first `(` stands before the first `)`."""
    opened, closed = F.instr(text, "("), F.instr(text, ")")
    return (opened > 0) & (closed > opened)


def sanitize_name(name: Column) -> Column:
    """Letters, digits, `_`, `<`, `>` and spaces stay, the rest become `_`; a leading digit gets one before it."""
    clean = F.regexp_replace(name, r"(?U)[^\w<> ]", "_")
    return F.when(clean.rlike(r"^\p{Nd}"), F.concat(F.lit("_"), clean)).otherwise(clean)


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('""'))


def safe_file_name(text: Column) -> Column:
    """Characters that file systems refuse become `_`; spaces and dots at the end go; nothing: `untitled`."""
    clean = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"[ .]+$", "")
    return F.when(clean == "", F.lit("untitled")).otherwise(clean)


def natural_key(name: Column) -> Column:
    """Sorts names as file managers do: case aside, runs of digits by number, then by the name itself."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def weighed(run: Column) -> Column:
        number = F.regexp_replace(run, "^0+(?=.)", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(number).cast("string"), 4, "0"), number)).otherwise(F.concat(F.lit("1"), run))

    return F.array_join(F.transform(runs, weighed), "\x01")
