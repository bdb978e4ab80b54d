"""Column expressions used by the audit exports.

All are built from JVM-side Spark functions, so they stay inside whole-stage
codegen; none needs a Python UDF.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp text of ``ts::varchar(23)``: millisecond precision, always three
# fraction digits.
TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
# Report-name stamp: month-day-year, 12-hour clock, AM/PM.
REPORT_STAMP_FORMAT = "_MM-dd-yyyy_hh_mm_a"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def resolve_value(option_label: Column | str, raw: Column | str) -> Column:
    """Displayed answer: the option label, else the ``value`` key of a JSON
    object held in the raw text, else the raw text itself.

    Bad JSON, a missing key (case-sensitive) and a JSON ``null`` all fall back
    to the raw text; nested objects / numbers come back as their JSON text.
    """
    raw = _c(raw)
    return F.coalesce(_c(option_label), F.get_json_object(raw, "$.value"), raw)


def ts_text(ts: Column | str) -> Column:
    return F.date_format(_c(ts), TS_TEXT_FORMAT)


def path_ts(ts: Column | str) -> Column:
    """Timestamp text made path-safe: blanks and colons become underscores."""
    return F.replace(F.replace(ts_text(ts), F.lit(" "), F.lit("_")), F.lit(":"), F.lit("_"))


def not_equal_keep_null(c: Column | str, value) -> Column:
    """``c != value`` that keeps rows where ``c`` is null (pandas semantics)."""
    return ~_c(c).eqNullSafe(F.lit(value))


def submission_id_from_path(path: Column | str) -> Column:
    """First ``Audit_<digits>/`` in the path as a bigint; null when absent."""
    return F.nullif(F.regexp_extract(_c(path), r"Audit_(\d+)/", 1), F.lit("")).try_cast("bigint")


# Extension swap equal to ``os.path.splitext(p)[0] + '.csv'``: the extension is
# the last dot-suffix of the final path component, provided that component has
# a non-dot character before the dot (leading dots do not start an extension).
_SPLITEXT_PATTERN = r"([^/.]\.*)\.[^./]*$"


def csv_path(path: Column | str) -> Column:
    return F.concat(F.regexp_replace(_c(path), _SPLITEXT_PATTERN, "$1"), F.lit(".csv"))


def regex_literal(text: str) -> str:
    """Quote ``text`` for a Java (and RE2) regular expression."""
    out = []
    for ch in text:
        if ch == "\n":
            out.append(r"\n")
        elif ch == "\t":
            out.append(r"\t")
        elif ch == "\r":
            out.append(r"\r")
        elif ch in string.punctuation:
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def multi_replace(text: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Replace several literals in one left-to-right pass.

    At each position the first listed key that matches wins and the output is
    never rescanned (nested ``replace`` calls would rescan).  The text is split
    on one alternation pattern, the matches are looked up in a map and the
    pieces re-joined; ``array_join`` keeps the whole thing linear in the text
    length.  A null text stays null.
    """
    if not pairs:
        return _c(text)
    keys = [k for k, _ in pairs]
    if any(k == "" for k in keys):
        raise ValueError("empty key")
    pattern = "(?:" + "|".join(regex_literal(k) for k in keys) + ")"
    first: dict[str, str] = {}
    for k, v in pairs:
        first.setdefault(k, v)
    lookup = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    t = _c(text)
    pieces = F.split(t, pattern, -1)
    hits = F.regexp_extract_all(t, F.lit(pattern), 0)
    joined = F.zip_with(pieces, hits, lambda x, y: F.concat(F.coalesce(x, F.lit("")),
                                                              F.coalesce(F.try_element_at(lookup, y),
                                                                         F.lit(""))))
    return F.array_join(joined, "")
