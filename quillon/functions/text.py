"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters escaped for LaTeX, in the order of their replacement.
LATEX_ESCAPES = (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White-space runs as one space, ends stripped."""
    return F.regexp_replace(strip(c), r"\s+", " ")


def to_latex(c: Column) -> Column:
    """LaTeX escapes, one after the other: the braces that the backslash's name brings are escaped too."""
    for plain, escaped in LATEX_ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def match_normalise(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def truncate_display(c: Column, width: int) -> Column:
    """At most `width` characters, the last three of a cut text being dots."""
    return F.when(F.char_length(c) > width, F.concat(F.left(c, F.lit(width - 3)), F.lit("..."))).otherwise(c)


def limit_blank_lines(c: Column, most: int = 1) -> Column:
    """At most `most` blank lines in a row."""
    return F.regexp_replace(c, r"\n(?:[ \t]*\n){%d,}" % (most + 1), "\n" * (most + 1))


def occurrences(c: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a lower-case word, any case in the text; 0 for an empty word."""
    low = F.lower(c)
    gone = F.char_length(low) - F.char_length(F.replace(low, word, F.lit("")))
    return F.when(F.char_length(word) > 0, (gone / F.char_length(word)).cast("long")).otherwise(F.lit(0).cast("long"))


def glob_to_regex(pattern: str) -> str:
    """Anchored Java pattern of a shell glob with * ? and [set]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", "\\^", 1) if body[0] == "^" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return "^" + out + "$"


def without_overlap(prefix: Column, text: Column) -> Column:
    """prefix + text, a longest end of the prefix that begins the text written once."""
    longest = F.least(F.char_length(prefix), F.char_length(text))
    sizes = F.filter(F.sequence(F.lit(0), longest), lambda n: F.right(prefix, n) == F.left(text, n))
    return F.concat(prefix, F.substring(text, F.array_max(sizes) + 1, F.char_length(text)))


def relative_time(ts: Column, now: Column) -> Column:
    """Age in the largest of s, m, h, d that is not 0; what lies ahead is 'from now'."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(ts)
    size = F.abs(seconds)
    text = F.when(size < 60, F.concat(size, F.lit("s"))).when(size < 3600, F.concat(F.floor(size / 60), F.lit("m"))).when(size < 86400, F.concat(F.floor(size / 3600), F.lit("h"))).otherwise(F.concat(F.floor(size / 86400), F.lit("d")))
    return F.concat(text, F.when(seconds < 0, F.lit(" from now")).otherwise(F.lit(" ago")))


def leading_number(c: Column) -> Column:
    """The number a text begins with, else null."""
    return F.nullif(F.regexp_extract(c, r"^([0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double")
