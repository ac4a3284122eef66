"""A made-up sample with the columns of the encounter table. Every value is a function of row number, column and seed, so that
any partitioning gives the same table.

What the sample is for decides its values:

* importance: a hidden severity drives the outcomes Y1-Y4, the treatment T and, as X_signal, can be seen; flags and most other
  columns have nothing to do with it. Y5 is drawn for itself.
* scales: a vital lies around the middle of the range that is usual for adults, which spans four deviations. The ranges have
  very different sizes, so that distances need scaling.
* correlation: X31 repeats X30 with a twentieth of its variance added. X40_skewed is the cube of an exponential.
* labels: shares fall with the place of a label, as one over the place; X56_reminder is dominated by its first.
* types: a share of two numeric columns holds text.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The shares of gaps, of gaps in X60_sparse, of text in number columns, and of the dominant reminder.
GAP, SPARSE_GAP, TEXT, DOMINANT = 0.03, 0.73, 0.01, 0.94
#: Columns without gaps.
COMPLETE = ("PAT_ID", "Y1", "Y2", "Y3", "Y4", "Y5", "T", "X_signal")
#: Usual range of adults, and decimals.
USUAL = {
    "X20_heart_rate": (60, 100, 0), "X21_systolic": (90, 140, 0), "X22_diastolic": (60, 90, 0), "X23_temperature": (36.1, 37.5, 2), "X24_oxygen_sat": (94, 100, 0),
    "X25_weight_lb": (110, 250, 1), "X26_bmi": (18, 36, 1), "X27_cost": (5_000, 45_000, 0),
}
LABELS = {
    "X50_department": ("GEN", "SURG", "PSY", "OBGYN"), "X51_visit_type": ("follow-up", "new_patient", "urgent_care"), "X52_referral": ("PCP", "self", "specialist", "employer"),
    "X53_weekday": ("Mon", "Tue", "Wed", "Thu", "Fri"), "X54_season": ("Spring", "Summer", "Autumn", "Winter"), "X55_weather": ("sunny", "rain", "cloudy"),
    "X56_reminder": ("email", "text", "phone"), "X57_payment": ("insurance", "card", "cash"), "X58_language": ("EN", "ES"),
}
WORDS = {"X23_temperature": "not taken", "X24_oxygen_sat": "see note"}


class _Draws:
    def __init__(self, seed: int):
        self.seed = seed

    def uniform(self, tag: str) -> Column:
        """In (0, 1), from a hash."""
        h = F.pmod(F.xxhash64(F.col("id"), F.lit(tag), F.lit(self.seed)), F.lit(1 << 40))
        return (h.cast("double") + 0.5) / float(1 << 40)

    def normal(self, tag: str) -> Column:
        return F.sqrt(-2 * F.ln(self.uniform(tag + "/a"))) * F.cos(2 * pi * self.uniform(tag + "/b"))

    def ranged(self, tag: str, low: float, high: float) -> Column:
        return (low + high) / 2 + self.normal(tag) * ((high - low) / 4)

    def label(self, tag: str, values: tuple[str, ...], first: float | None = None) -> Column:
        """Shares fall as one over the place; first: the share of the first label, the others divide the rest."""
        weights = [1 / k for k in range(1, len(values) + 1)]
        if first is not None:
            weights[0] = first / (1 - first) * sum(weights[1:])
        upto = [sum(weights[: k + 1]) / sum(weights) for k in range(len(weights))]
        return F.element_at(F.array(*map(F.lit, values)), 1 + sum(((self.uniform(tag) >= share).cast("int") for share in upto[:-1]), F.lit(0)))


def generate(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """`rows` rows of the 43 columns."""
    d = _Draws(seed)
    severity = d.normal("severity")

    def driven(tag: str, weight: float) -> Column:
        """Unit variance, of which the severity makes up the square of the weight."""
        return severity * weight + d.normal(tag) * (1 - weight**2) ** 0.5

    x30 = d.ranged("X30", 50, 150)
    made: dict[str, Column] = {
        "PAT_ID": F.col("id") + 1,
        "Y1": F.round(1 / (1 + F.exp(-driven("Y1", 0.95))), 4), "Y2": F.round(0.5 + driven("Y2", -0.95) / 4, 4), "Y3": F.round(0.5 + driven("Y3", 0.9) / 4, 4), "Y4": F.round(F.greatest(6 + 3 * driven("Y4", 0.95), F.lit(0.0)), 3),
        "Y5": F.floor(3 * d.uniform("Y5")).cast("int"), "T": (driven("T", 0.9) > 0).cast("int"), "X_signal": F.round(severity, 5),
        **{f"X{i}": (d.uniform(f"X{i}") < i / 13).cast("int") for i in range(1, 13)},
        **{c: F.round(d.ranged(c, low, high), digits) for c, (low, high, digits) in USUAL.items()},
        "X30": F.round(x30, 1), "X31": F.round(x30 + d.normal("X31") * 25 * 0.05**0.5, 1), "X40_skewed": F.round(F.pow(-F.ln(d.uniform("X40_skewed")), 3), 2),
        **{c: d.label(c, values, DOMINANT if c == "X56_reminder" else None) for c, values in LABELS.items()},
        # an hour of the day, a number that hardly varies for its size, and one that is seldom there
        "chk_hour": F.round(8 + 9 * d.uniform("chk_hour"), 2), "x13": F.round(10_000 + d.normal("x13"), 2), "X60_sparse": F.round(100 * d.uniform("X60_sparse"), 1),
    }
    out = []
    for c, value in made.items():
        if c in WORDS:
            value = F.when(d.uniform(c + "/word") < TEXT, WORDS[c]).otherwise(value.cast("string"))
        if c not in COMPLETE:
            value = F.when(d.uniform(c + "/gap") >= (SPARSE_GAP if c == "X60_sparse" else GAP), value)
        out.append(value.alias(c))
    return spark.range(rows).select(*out)
