"""Text as Column expressions: escapes, quoting, references, titles, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKSLASH = "\\"


def escape_controls(c: Column, backslash: bool = False) -> Column:
    """Newline, return and tab as two characters. By default a backslash stays single, as the
    format's own writer leaves it, so the way back can differ; with `backslash` it is doubled."""
    if backslash:
        c = F.replace(c, F.lit(BACKSLASH), F.lit(BACKSLASH * 2))
    for plain, mark in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        c = F.replace(c, F.lit(plain), F.lit(BACKSLASH + mark))
    return c


def unescape_controls(c: Column) -> Column:
    """The reverse of the doubled form; any other escaped character stands for itself. What lies
    between double backslashes holds only single ones, so no placeholder is needed."""

    def part(p: Column) -> Column:
        for plain, mark in (("\n", "n"), ("\r", "r"), ("\t", "t")):
            p = F.replace(p, F.lit(BACKSLASH + mark), F.lit(plain))
        return F.regexp_replace(p, r"\\(.)", "$1")

    return F.array_join(F.transform(F.split(c, r"\\\\"), part), BACKSLASH)


def ends_in_backslash(c: Column) -> Column:
    """Whether an escape lacks its character (an odd number of backslashes at the end)."""
    return F.length(F.regexp_extract(c, r"(\\*)$", 1)) % 2 == 1


def quote(c: Column) -> Column:
    """A catalog string: quoted and escaped."""
    return F.concat(F.lit('"'), F.replace(escape_controls(c, True), F.lit('"'), F.lit(BACKSLASH + '"')), F.lit('"'))


def unquote(c: Column) -> Column:
    """A quoted catalog string's text. A backslash that escapes nothing is an error."""
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    checked = F.when(ends_in_backslash(inner), F.raise_error(F.concat(F.lit("an escape without its character: "), c)).cast("string")).otherwise(inner)
    return unescape_controls(checked)


def slice_text(c: Column, start: int, length: int | None = None) -> Column:
    """Characters from `start`; a negative start counts from the end, clamped to the text."""
    n = F.length(c)
    at = F.least(F.lit(start), n) if start >= 0 else F.when(n > 0, F.pmod(F.lit(start), n)).otherwise(0)
    return F.substring(c, at + 1, n if length is None else F.greatest(F.lit(length), F.lit(0)))


def split_limited(c: Column, delimiter: str, limit: int, fill: bool = False) -> Column:
    """At most `limit` parts by a one-character delimiter; with fill, padded with empty parts."""
    parts = F.split(c, "\\Q" + delimiter + "\\E", limit)
    return F.concat(parts, F.array_repeat(F.lit(""), F.greatest(F.lit(0), limit - F.size(parts)))) if fill else parts


def references(comments: Column) -> Column:
    """Reference marks of an entry: comments that start with a colon, split at white space."""
    marks = F.filter(comments, lambda x: F.trim(x).startswith(":"))
    words = F.flatten(F.transform(marks, lambda x: F.split(F.trim(F.substring(F.trim(x), F.lit(2), F.length(x))), r"\s+")))
    return F.filter(words, lambda w: w != "")


def reference_id(reference: Column) -> Column:
    """The number behind a reference's last colon; null if it is none."""
    return F.element_at(F.split(reference, ":"), -1).try_cast("int")


def fold_lines(c: Column) -> Column:
    """One line: returns go, and a line break with at most one space beside it is one space."""
    c = F.replace(c, F.lit("\r"), F.lit(""))
    for broken in ("\n ", " \n", "\n"):
        c = F.replace(c, F.lit(broken), F.lit(" "))
    return c


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "“”", '""')


def message(title: Column, body: Column) -> Column:
    """{title}, a line break and the body; only the body without a title."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("{"), title, F.lit("}\n"), body)).otherwise(body)


def message_title(full: Column) -> Column:
    return F.translate(F.element_at(F.split(full, "\n", 2), 1), "{}", "")


def message_body(full: Column) -> Column:
    return F.try_element_at(F.split(full, "\n", 2), F.lit(2))


def reshape(original: Column, target: Column) -> Column:
    """The target between the original's leading and trailing white space."""
    return F.concat(F.regexp_extract(original, r"^\s*", 0), target, F.regexp_extract(original, r"\s*$", 0))


def tokens(c: Column) -> Column:
    """Words and runs of punctuation: the parts between word boundaries that are not blank."""
    return F.filter(F.split(c, r"(?U)\b+"), lambda x: x.rlike(r"\S"))


def header_id(c: Column) -> Column:
    """The number a section's header starts with."""
    return F.regexp_extract(c, r"^(\d+)", 1).try_cast("int")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def encodable(c: Column) -> Column:
    """Whether LATIN1 holds the text, for a check before writing scripts."""
    return ~c.rlike(r"[^\x00-\xFF]")
