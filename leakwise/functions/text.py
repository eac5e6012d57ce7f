"""Functions of values, positions and cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "-"
TRIM = " \t\n\x0b\x0c\r\x85\xa0"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out, and written into the plan, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _inside(mark: str) -> Callable[[Column], Column]:
    def inside(text: Column) -> Column:
        held = (F.length(text) > 2 * len(mark) - 1) & text.startswith(mark) & text.endswith(mark)
        return F.when(held, F.substring(text, F.lit(len(mark) + 1), F.length(text) - 2 * len(mark))).otherwise(text)

    return inside


def trim_quotes(text: Column) -> Column:
    """Without outer white space and one balanced pair each of backtick, single and double quotes, in that order; a
    second and third pair of double quotes go together."""
    out = F.btrim(text, F.lit(TRIM))
    for mark in ("`", "'", '"', '""'):
        out = let(out, _inside(mark))
    return out


def value_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def line_of(text: Column, offset: Column) -> Column:
    """Line breaks before a UTF-8 byte offset (lines count from 0)."""
    before = F.decode(F.substring(F.encode(text, "utf-8"), F.lit(1), offset.cast("int")), "iso-8859-1")
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("long")


def character_of(text: Column, offset: Column) -> Column:
    """Bytes since the last line break before the offset."""
    before = F.decode(F.substring(F.encode(text, "utf-8"), F.lit(1), offset.cast("int")), "iso-8859-1")
    return F.length(F.substring_index(before, "\n", -1)).cast("long")


#: What stands for values under eight characters (a fixed value).
REDACTED = "***REDACTED***"


def redacted(value: Column) -> Column:
    """Trimmed; short values as a fixed text, else 60 % of the characters (four at least) in the middle are starred."""
    value = F.btrim(value, F.lit(TRIM))
    n = F.length(value)
    hidden = F.greatest(F.lit(4), F.floor(n * 0.6)).cast("int")
    head = F.floor((n - hidden) / 2).cast("int")
    masked = F.concat(F.substring(value, F.lit(1), head), F.repeat(F.lit("*"), hidden), F.substring(value, head + hidden + 1, n))
    return F.when(n < 8, F.lit(REDACTED)).otherwise(masked)


def dash_if_blank(text: Column) -> Column:
    return F.when(text.isNull() | (F.btrim(text, F.lit(TRIM)) == ""), F.lit(DASH)).otherwise(text)


def finding_id(rule: Column, path: Column, line: Column, character: Column, checksum: Column, repository: Column | None = None) -> Column:
    """Stable identity of a finding; line and character count from 0 and are hashed from 1 on."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [text(rule), F.lit("") if repository is None else text(repository), text(path), text(line + 1), text(character + 1), text(checksum)]
    return F.sha2(F.concat_ws(":", *parts), 256)


#: Part of the upper-cased rule name -> secret type, in order; and what is left.
SECRET_TYPES = (
    ("AWS_ACCESS", "aws.access_key"),
    ("AWS_SECRET", "aws.secret_key"),
    ("GITHUB", "github.personal_access_token"),
    ("RSA", "crypto.rsa_private_key"),
    ("PASSWORD", "generic.password"),
    ("JWT", "generic.jwt"),
)
OTHER_SECRET = "generic.high_entropy"


def secret_type(rule: Column) -> Column:
    out = F.lit(OTHER_SECRET)
    for part, name in reversed(SECRET_TYPES):
        out = F.when(F.upper(rule).contains(part), name).otherwise(out)
    return out


def decoded(source: Column, is_base64: Column) -> Column:
    """The text of a string request, decoded if it is marked as base64 (undecodable input gives null)."""
    return F.when(F.coalesce(is_base64, F.lit(False)), F.make_valid_utf8(F.try_to_binary(source, F.lit("base64")).cast("string"))).otherwise(source)


def has_tag(tags: Column, tag: str) -> Column:
    """``prod`` is virtual: it holds wherever ``test`` does not."""
    own = F.coalesce(F.array_contains(tags, tag), F.lit(False))
    return own | ~F.coalesce(F.array_contains(tags, "test"), F.lit(False)) if tag == "prod" else own


def contains_range(outer_start: Column, outer_end: Column, inner_start: Column, inner_end: Column) -> Column:
    """Inclusive containment of character ranges."""
    return (outer_start <= inner_start) & (inner_end <= outer_end)


def position_le(line: Column, character: Column, other_line: Column, other_character: Column) -> Column:
    """Both the line and the character are at most the other's."""
    return (line <= other_line) & (character <= other_character)
