"""Tech lists as they stand in files: JSON text, or the text of a Python list."""

from pyspark.sql import Column, functions as F

from .text import col, strip

LIST = "array<string>"


def encode_json(c) -> Column:
    return F.coalesce(F.to_json(col(c)), F.lit("[]"))


def decode_json(c) -> Column:
    """Bad or blank text gives an empty list."""
    return F.coalesce(F.from_json(col(c), LIST), F.array().cast(LIST))


def decode_literal(c) -> Column:
    """['a', "b"] as text; anything that is not such a list gives an empty one."""
    t = strip(F.coalesce(col(c), F.lit("")))
    item = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
    whole = rf"^\[\s*(?:(?:{item})\s*(?:,\s*(?:{item})\s*)*,?)?\s*\]$"
    quoted = F.regexp_extract_all(t, F.lit(f"({item})"), F.lit(1))
    bare = F.transform(
        quoted, lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1")
    )
    return F.when(t.rlike(whole), bare).otherwise(F.array().cast(LIST))


def encode_literal(c) -> Column:
    """The text a Python list of plain strings prints as."""
    def quoted(s):
        safe = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        return F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'"))

    return F.concat(F.lit("["), F.array_join(F.transform(col(c), quoted), ", "), F.lit("]"))
