"""Pieces of SQL for the checks."""

from __future__ import annotations

from tablewright.functions.parse import MISSING_TOKENS

INTS = ["PAT_ID", "Y5", "T", *(f"X{i}" for i in range(1, 13))]
DOUBLES = "Y1 Y2 Y3 Y4 X_signal X20_heart_rate X21_systolic X22_diastolic X25_weight_lb X26_bmi X27_cost X30 X31 X40_skewed chk_hour x13 X60_sparse".split()
NUMBER_TEXTS = ["X23_temperature", "X24_oxygen_sat"]
LABELS = "X50_department X51_visit_type X52_referral X53_weekday X54_season X55_weather X56_reminder X57_payment X58_language".split()
#: The order of the table.
FIELDS = (
    "PAT_ID Y1 Y2 Y3 Y4 Y5 T X_signal X1 X2 X3 X4 X5 X6 X7 X8 X9 X10 X11 X12 X20_heart_rate X21_systolic X22_diastolic "
    "X23_temperature X24_oxygen_sat X25_weight_lb X26_bmi X27_cost X30 X31 X40_skewed X50_department X51_visit_type X52_referral "
    "X53_weekday X54_season X55_weather X56_reminder X57_payment X58_language chk_hour x13 X60_sparse"
).split()
TOKENS = "(" + ", ".join(f"'{t}'" for t in MISSING_TOKENS) + ")"
NUMBER_RE = r"[ \t\n\x0b\f\r]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity))[ \t\n\x0b\f\r]*"


def present(c: str) -> str:
    """Null where missing, the column's own type."""
    if c in DOUBLES:
        return f"case when not isnan({c}) then {c} end"
    if c in INTS:
        return c
    return f"case when {c} not in {TOKENS} then {c} end"


def number(c: str) -> str:
    """As a double, null where missing or not a number."""
    if c in DOUBLES:
        return present(c)
    if c in INTS:
        return f"{c}::double"
    return f"case when {c} not in {TOKENS} and regexp_full_match({c}, '{NUMBER_RE}') then try_cast(trim({c}, ' ' || chr(9) || chr(10) || chr(13)) as double) end"


def clean(c: str) -> str:
    """What coerce makes of it."""
    return number(c) if c in (*DOUBLES, *NUMBER_TEXTS) else present(c)


NUMERIC = [c for c in FIELDS if c not in LABELS]
NUMERIC_FEATURES = [c for c in NUMERIC if c not in ("PAT_ID", "Y1", "Y2", "Y3", "Y4", "Y5")]
CLEAN = "clean as (select row_id, " + ", ".join(f"{clean(c)} as {c}" for c in FIELDS) + " from encounters)"


def blank(c: str) -> str:
    return f"regexp_full_match({c}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]*')"


def union(parts: list[str]) -> str:
    return "\nunion all ".join(parts)
