"""The structured source string, file paths and components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.text import UNI, UNI_I, cut, first_match, rewrite, strip

# A match counts only inside a log_file segment.  The look-ahead keeps the look-behind off
# every position that does not start with four digits; a source holds at most 500 characters.
_IN_LOG_FILE = r"(?=\d{4})(?<=log_file=[^;]{0,500})"


def stable_source(source: Column) -> Column:
    """The source with dates and long numbers of its log file collapsed."""
    return rewrite(
        cut(F.coalesce(source, F.lit("")), V.MAX_SOURCE),
        [
            (UNI + _IN_LOG_FILE + V.FILE_DATE, "<date>"),
            (UNI + _IN_LOG_FILE + V.FILE_NUMBER, "<n>"),
        ],
    )


def stable_file(path: Column) -> Column:
    return rewrite(
        F.coalesce(path, F.lit("")), [(UNI + V.FILE_DATE, "<date>"), (UNI + V.FILE_NUMBER, "<n>")]
    )


def source_field(source: Column, name: str) -> Column:
    """project, program or log_file of a structured source; '' if absent or unknown."""
    group = {"project": 1, "program": 2, "log_file": 3}[name]
    value = strip(
        F.regexp_extract(F.coalesce(source, F.lit("")), "(?dU)" + V.SOURCE_FIELDS, group)
    )
    return F.when(value == "unknown", "").otherwise(value)


def format_source(project: Column, program: Column, log_file: Column, dll: Column) -> Column:
    return F.concat(
        F.lit("project="), F.coalesce(project, F.lit("")),
        F.lit("; program="), F.coalesce(program, F.lit("")),
        F.lit("; log_file="), F.coalesce(log_file, F.lit("")),
        F.lit("; dll="), F.coalesce(F.nullif(dll, F.lit("")), F.lit("unknown")),
    )


def clean_path(path: Column) -> Column:
    """Resolve '.', '..' and repeated slashes of an absolute path."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    resolved = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda done, p: F.when(
            p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        ).otherwise(F.concat(done, F.array(p))),
    )
    untidy = F.lit(False)
    for part in ("//", "/./", "/../"):
        untidy = untidy | path.contains(part)
    for end in ("/", "/.", "/.."):
        untidy = untidy | path.endswith(end)
    return F.when(untidy, F.concat(F.lit("/"), F.array_join(resolved, "/"))).otherwise(path)


def program_from_source(path: Column) -> Column:
    """First directory under /logs; 'unknown' for anything else.

    The name is asked for once: in a condition and again as its result, the path would be resolved twice.
    """
    names = F.regexp_extract_all(clean_path(path), F.lit(r"(?s)\A/logs/([^/]+)/"), F.lit(1))
    return F.coalesce(F.when(path.startswith("/"), F.get(names, F.lit(0))), F.lit("unknown"))


def detect_dll(message: Column) -> Column:
    """First name ending in .dll, '' if there is none; only a message with such an end is searched for whole names."""
    return F.when(~message.rlike(r"(?i)\.dll\b"), "").otherwise(F.regexp_extract(message, "(?i)" + V.DLL_NAME, 0))


def component_of(message: Column) -> Column:
    """Component named in the line: a bracket with a dot or an inner capital; '' if none."""
    texts = F.transform(
        F.regexp_extract_all(message, F.lit(UNI + V.BRACKET_TEXT), F.lit(1)), strip
    )
    # an inner capital is any upper-case letter after the first character, ASCII or not
    named = F.filter(
        texts,
        lambda t: (t != "")
        & ~t.rlike("(?dU)" + V.BRACKET_TIMESTAMP)
        & ~F.lower(t).isin(V.COMPONENT_SKIP)
        & t.rlike("[A-Za-z]")
        & (t.contains(".") | t.rlike(r"(?s)\A.[\s\S]*\p{Lu}")),
    )
    return F.coalesce(cut(F.try_element_at(named, F.lit(1)), 80), F.lit(""))


def log_file_of(message: Column) -> Column:
    """A log-like path or file name mentioned in the line; '' if none."""
    return cut(
        F.coalesce(
            first_match(message, UNI_I + V.LOG_PATH), first_match(message, UNI_I + V.LOG_NAME), F.lit("")
        ),
        120,
    )


# A logger tag that names a component: a dot in it, or at least twelve characters.  Every bare
# level word is shorter and has no dot, so none of them can match.
_COMPONENT_TAG = (
    r"\[(?=[A-Za-z0-9_.]{4,}\])([A-Za-z](?:[A-Za-z0-9_]*\.[A-Za-z0-9_.]*|[A-Za-z0-9_.]{11,}))\]"
)


def class_component(message: Column, head: Column) -> Column:
    """Logger named in the first 400 characters, else the head of the skeleton."""
    logger = first_match(cut(message, V.LOGGER_HEAD), _COMPONENT_TAG, 1)
    return F.coalesce(F.lower(logger), cut(head, V.CLASS_COMPONENT))
