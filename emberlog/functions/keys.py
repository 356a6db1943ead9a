"""Grouping keys: hashes of the parts that identify a fault.

The text is lower-cased before the patterns run, so they need not ignore case; only the time
pattern has capitals of its own.
"""

from __future__ import annotations

from string import ascii_lowercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.source import class_component
from emberlog.functions.text import UNI, UNI_I, collapse_spaces, cut, rewrite

# The same characters, listed one by one: Java keeps listed ones in one bit set, but asks range after range.
_SKELETON_OTHER = V.SKELETON_OTHER.replace("a-z", ascii_lowercase).replace("0-9", digits)


def _timestamp(collapse_iso_t: bool) -> str:
    """'T' and 'Z' match lower-cased text only where case is ignored."""
    return (UNI_I if collapse_iso_t else UNI) + V.TIMESTAMP


def gate_message(message: Column, collapse_iso_t: bool = False) -> Column:
    """Lower-case message with ids, times and numbers replaced by placeholders."""
    return collapse_spaces(
        rewrite(
            F.lower(cut(message, V.MAX_KEY_MESSAGE)),
            [
                (UNI + V.UUID, "<uuid>"),
                (UNI + V.HEX, "<hex>"),
                (_timestamp(collapse_iso_t), "<ts>"),
                (UNI + V.CLOCK, "<clock>"),
                (UNI + V.LONG_DIGITS, "<n>"),
            ],
        )
    )


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def gate_fingerprint(
    host: Column, stable: Column, severity: Column, message: Column, collapse_iso_t: bool = False
) -> Column:
    """``stable`` is ``stable_source(source)``, passed in so that it is computed once."""
    return _digest(
        cut(host, V.MAX_HOST),
        stable,
        F.lower(cut(severity, V.MAX_SEVERITY)),
        gate_message(message, collapse_iso_t),
    )


def class_head(message: Column, collapse_iso_t: bool = False) -> Column:
    """First four words of the message with brackets, values and symbols taken out."""
    words = collapse_spaces(
        rewrite(
            F.lower(cut(message, V.MAX_KEY_MESSAGE)),
            [
                (V.BRACKETED, " "),
                (_timestamp(collapse_iso_t), "<ts>"),
                (UNI + V.CLOCK, "<clock>"),
                (UNI + V.UUID, "<uuid>"),
                (UNI + V.HEX, "<hex>"),
                (UNI + V.URL, "<url>"),
                (UNI + V.LONG_DIGITS, "<n>"),
                (_SKELETON_OTHER, " "),
            ],
        )
    )
    return F.array_join(F.slice(F.split(words, " "), 1, V.CLASS_HEAD_WORDS), " ")


def class_key(host: Column, stable: Column, effective: Column, message: Column, head: Column) -> Column:
    """``stable`` is ``stable_source(source)`` and ``head`` is ``class_head(message)``."""
    return _digest(
        cut(host, V.MAX_HOST),
        stable,
        cut(effective, V.MAX_SEVERITY),
        class_component(message, head),
        cut(head, V.CLASS_HEAD),
    )


def gateway_message(message: Column) -> Column:
    return rewrite(
        F.lower(message),
        [
            ("(?i)" + V.GATEWAY_UUID, "<uuid>"),
            (V.GATEWAY_TIMESTAMP, "<timestamp>"),
            ("(?i)" + V.GATEWAY_VOLATILE, "$1<value>"),
            (V.GATEWAY_DIGITS, "<n>"),
        ],
    )


def gateway_fingerprint(source: Column, severity: Column, message: Column) -> Column:
    """The raw source takes part, so a date-stamped file name starts a new key at midnight."""
    return F.sha2(F.concat_ws("\x00", source, severity, gateway_message(message)), 256)


def short_key(key: Column) -> Column:
    return F.substring(key, 1, 12)
