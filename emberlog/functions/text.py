"""Text rewriting as native column expressions.

Java patterns carry ``(?U)`` where the contract is Unicode-aware, so ``\\s``, ``\\d``, ``\\b``
and ``\\w`` cover non-ASCII text; ``(?d)`` makes ``.`` and ``$`` stop at ``\\n`` only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog import fixed_values as V

UNI = "(?U)"
UNI_I = "(?iU)"
SPACES = r"[\s\x1c-\x1f]+"
SPACE_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def cut(col: Column, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(col, 1, n)


def cut_bytes(col: Column, n: int) -> Column:
    """First ``n`` UTF-8 bytes as text; a split character becomes the replacement mark."""
    return F.when(F.octet_length(col) <= n, col).otherwise(
        F.make_valid_utf8(F.substring(F.encode(col, "UTF-8"), 1, n).cast("string"))
    )


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends, the characters of ``SPACES`` (Spark's trim takes spaces only).

    Bytes that are no UTF-8 become replacement marks, as in the patterns' results."""
    return F.btrim(F.make_valid_utf8(col), F.lit(SPACE_CHARACTERS))


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, UNI + SPACES, " "))


def rewrite(col: Column, steps: list[tuple[str, str]]) -> Column:
    """Apply pattern replacements in order."""
    for pattern, replacement in steps:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def first_match(col: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null where there is none."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def lookup(col: Column, table: dict) -> Column:
    """Value of a small fixed table, null where the key is missing."""
    pairs = ", ".join(f"'{k}', {v!r}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), col)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def template_key(message: Column) -> Column:
    """Digest template: any digit run is a placeholder."""
    return collapse_spaces(
        rewrite(
            F.lower(cut(message, V.MAX_KEY_MESSAGE)),
            [(UNI + V.UUID, "<uuid>"), (UNI + V.HEX, "<hex>"), (UNI + V.ANY_DIGITS, "<n>")],
        )
    )


def redact(col: Column) -> Column:
    """Mask secrets: fields, bearer tokens, URL passwords, long tokens, in that order."""
    return rewrite(
        col,
        [
            (UNI_I + V.SECRET_FIELD, "$1=<redacted>"),
            (UNI_I + V.BEARER, "Bearer <redacted>"),
            (UNI_I + V.URL_PASSWORD, "$1<redacted>$2"),
            (UNI + V.LONG_TOKEN, "<redacted-long>"),
        ],
    )


def sample_text(message: Column) -> Column:
    """One printable line of at most 180 characters, with secrets masked."""
    return cut(redact(F.replace(strip(message), F.lit("\n"), F.lit(" "))), V.MAX_SAMPLE)


def is_json_object(body: Column) -> Column:
    """The text is one JSON object, in which a name may occur twice.

    Spark's parsers ignore what follows a value, so the text is read twice: as the only field of an object and as the only
    element of a list around it.  What trails the object can close one of the two, not both.
    """
    strict = {"allowSingleQuotes": "false"}
    field = F.from_json(F.concat(F.lit('{"x":'), body, F.lit("}")), "map<string, string>", strict)
    element = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<map<string, string>>", strict)
    whole = (F.size(field) == 1) & F.ltrim(F.get(F.map_values(field), F.lit(0))).startswith("{")
    alone = (F.size(element) == 1) & F.get(element, F.lit(0)).isNotNull()
    return F.coalesce(whole & alone & body.rlike(r"\}\s*\z"), F.lit(False))
