"""Loading delimited text lines: typed records on one side, rejected lines with reasons on the other.

Structure (quoting, number of fields) is decided per line by array expressions. Values are decided per distinct value:
the distinct texts of each checked column are written, and every one of them is cast once. Those that can't stand form a
dictionary (column, text, reason) that is joined back to the lines; records take the cast values of the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parse import FINITE_NUMBER, MISSING_TOKENS, name
from tablewright.plans.shared import fits_broadcast, sized_join, written

FIELD = r',("[^"]*+(?:""[^"]*+)*+"|[^",]*)'


@dataclass(frozen=True)
class Field:
    """One column of the lines. A field with bounds is checked: its text must be missing or a number within them."""

    name: str
    kind: str = "string"
    low: float | None = None
    high: float | None = None

    @property
    def checked(self) -> bool:
        return self.low is not None or self.high is not None


@dataclass(frozen=True)
class LoadedLines:
    """records: the input's other columns, one typed column per field, and `unparsed`, a map of texts no field type could
    hold. rejects: the input's columns, `reason` (quoting, column_count, value) and `detail`. dictionary: column_name,
    text and reason of the invalid values."""

    rejects: DataFrame
    dictionary: DataFrame
    _records: Callable[[], DataFrame]

    @property
    def records(self) -> DataFrame:
        return self._records()


def bad_quoting(line: Column) -> Column:
    """Cut at the double quotes, the pieces lie outside and inside quotes in turn; every outer piece must be a doubled
    quote (empty) or begin and end where fields do."""
    parts = F.split(line, '"', -1)
    last = F.size(parts) - 1

    def misplaced(x: Column, i: Column) -> Column:
        opens = (i == 0) | F.startswith(x, F.lit(","))
        closes = (i == last) | F.endswith(x, F.lit(","))
        return (i % 2 == 0) & (x != "") & ~(opens & closes)

    return F.contains(line, F.lit('"')) & ((last % 2 == 1) | (F.size(F.filter(parts, misplaced)) > 0))


def field_count(line: Column) -> Column:
    """Fields of a line whose quoting is sound: commas outside quotes, and one."""
    outer = F.concat_ws("", F.filter(F.split(line, '"', -1), lambda x, i: i % 2 == 0))
    text = F.when(F.contains(line, F.lit('"')), outer).otherwise(line)
    return F.length(text) - F.length(F.replace(text, F.lit(","))) + 1


def fields_of(line: Column) -> Column:
    """The fields of a sound line as an array of text, quotes undone."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), 1)
    undone = F.transform(quoted, lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(F.contains(line, F.lit('"')), undone).otherwise(F.split(line, ",", -1))


def _bare(c: Column) -> Column:
    return F.trim(c, F.lit(" \t"))


def _loose(c: Column) -> Column:
    """Without white space that lines carry at their ends as well."""
    return F.trim(c, F.lit(" \t\r\n"))


def judged(values: DataFrame, checked: list[Field]) -> DataFrame:
    """(column_name, text, number, reason) of (column_name, text): each bare text of a checked field as a number, and why it
    can't stand; no reason if it can, missing tokens included."""
    text = F.col("text")
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for f in checked:
        here = F.col("column_name") == f.name
        low = F.when(here, F.lit(float("-inf") if f.low is None else float(f.low))).otherwise(low)
        high = F.when(here, F.lit(float("inf") if f.high is None else float(f.high))).otherwise(high)
    cast = values.withColumn("number", F.when(text.rlike(FINITE_NUMBER) & ~text.rlike(r"[\r\n]"), text.try_cast("double")))
    number = F.col("number")
    reason = F.when(number.isNull(), "not_a_number").when((number < low) | (number > high), "out_of_range")
    return cast.select("column_name", "text", "number", F.when(~text.isin(*MISSING_TOKENS), reason).alias("reason"))


def _typed(text: Column, kind: str, number: Column | None = None) -> Column:
    """A present text in its field's type; number: its value where that is known."""
    if kind == "string":
        return text
    bare = _loose(text)
    number = F.when(bare.rlike(FINITE_NUMBER), bare.try_cast("double")) if number is None else number
    if kind == "double":
        return number
    return F.when(number == F.floor(number), F.coalesce(bare.try_cast(kind), number.try_cast(kind)))


def _typing(kind: str) -> Callable[[Column], Column]:
    return lambda x: _typed(x, kind)


def load_lines(lines: DataFrame, line: str, fields: list[Field]) -> LoadedLines:
    """Divide the lines into typed records and rejects. Every input row appears on exactly one side, repeated rows too.

    A null line is a reject for its column count, as is an empty one where more than one field is expected. Missing
    tokens become null in records, and a number may have a line end behind it. Texts that a field without bounds can't hold don't reject the line: the value is
    null and the text is kept in `unparsed`. Extra input columns are kept; one that has the name of a field, or of
    `reason`, `detail` or `unparsed`, is replaced by ours. Empty input gives empty results.
    """
    checked = [f for f in fields if f.checked]
    order = {f.name: i for i, f in enumerate(fields)}
    text = name(line)
    structure = (
        F.when(text.isNull(), "column_count").when(bad_quoting(text), "quoting").when(field_count(text) != len(fields), "column_count")
    )
    ours = {"reason", "detail", "unparsed", "_reason", "_fields", "_salt", "_present", "_double", "_int", "_long"} | {f"_{x}{i}" for i in range(len(fields)) for x in "vrgt"}
    kept = [c for c in lines.columns if c not in ours]
    parsed = lines.select(*map(name, kept)).withColumn("_reason", structure)
    parsed = parsed.withColumn("_fields", F.when(F.col("_reason").isNull(), fields_of(text)))
    for i, f in enumerate(checked):
        parsed = parsed.withColumn(f"_v{i}", _bare(F.get("_fields", F.lit(order[f.name]))))

    values = written(judged(_distinct_texts(parsed, checked), checked), "values")
    invalid = written(values.where("reason IS NOT NULL").select("column_name", "text", "reason"), "invalid_values")

    def joined(table: DataFrame, what: str, to: str) -> DataFrame:
        """The lines with what the table has for the text of each checked field."""
        out, fits = parsed, fits_broadcast(table)
        for i, f in enumerate(checked):
            part = table.where(F.col("column_name") == f.name).select(F.col("text").alias(f"_v{i}"), F.col(what).alias(f"{to}{i}"))
            out = sized_join(out, part, [f"_v{i}"], "left", [line], fits)
        return out

    any_fault = F.lit(False)
    for i in range(len(checked)):
        any_fault = any_fault | F.col(f"_r{i}").isNotNull()
    reason = F.coalesce("_reason", F.when(any_fault, "value"))
    faults = F.concat_ws("; ", *(F.concat(F.lit(f.name + ": "), F.col(f"_r{i}")) for i, f in enumerate(checked)))
    rejects = joined(invalid, "reason", "_r").where(reason.isNotNull()).select(*map(name, kept), reason.alias("reason"), F.when(F.col("_reason").isNull(), faults).alias("detail"))

    return LoadedLines(rejects, invalid, lambda: _records(joined, values, fields, [c for c in kept if c not in order and c != line]))


def _records(joined: Callable[[DataFrame, str, str], DataFrame], values: DataFrame, fields: list[Field], kept: list[str]) -> DataFrame:
    checked = [f for f in fields if f.checked]
    # a text that can't stand has no row among the good values, and a line with one is no record
    good = values.where("reason IS NULL").select("column_name", "text", F.struct("number").alias("is"))
    sound = joined(good, "is", "_g").where(F.col("_reason").isNull())
    for i in range(len(checked)):
        sound = sound.where(F.col(f"_g{i}").isNotNull())
    # arrays keep the generated code small: one expression for all fields of a kind
    of = {k: [i for i, f in enumerate(fields) if f.kind == k and not f.checked] for k in {f.kind for f in fields} - {"string"}}
    known = {f.name: F.col(f"_g{i}.number") for i, f in enumerate(checked)}
    present = sound.withColumn("_present", F.transform("_fields", lambda x: F.when(~_loose(x).isin(*MISSING_TOKENS), x)))
    typed = present.withColumns({f"_{k}": F.transform(F.array(*(F.get("_present", F.lit(i)) for i in at)), _typing(k)) for k, at in of.items() if at})
    value = {i: F.get("_present", F.lit(i)) if f.kind == "string" else _typed(F.get("_present", F.lit(i)), f.kind, known[f.name]) if f.checked else F.get(f"_{f.kind}", F.lit(of[f.kind].index(i))) for i, f in enumerate(fields)}
    typed = typed.select("*", *(v.alias(f"_t{i}") for i, v in value.items()))
    known_null = F.array(*(F.lit(True) if f.kind == "string" else F.col(f"_t{i}").isNotNull() for i, f in enumerate(fields)))
    names = F.array(*(F.lit(f.name) for f in fields))
    lost = F.filter(F.arrays_zip(names.alias("key"), F.col("_present").alias("value"), known_null.alias("held")), lambda x: x["value"].isNotNull() & ~x["held"])
    unparsed = F.map_from_entries(F.transform(lost, lambda x: F.struct(x["key"], x["value"])))
    return typed.select(*map(name, kept), *(F.col(f"_t{i}").alias(f.name) for i, f in enumerate(fields)), unparsed.alias("unparsed"))


def _distinct_texts(parsed: DataFrame, checked: list[Field]) -> DataFrame:
    """(column_name, text) of the sound lines, each once, as a written table: what is decided about them can't move below the
    grouping. Texts are combined before the shuffle, so one in a third of all lines is one row per task there."""
    if not checked:
        return parsed.sparkSession.createDataFrame([], "column_name string, text string")
    pairs = F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.col(f"_v{i}").alias("text")) for i, f in enumerate(checked)))
    return written(parsed.where("_reason IS NULL").select(F.explode(pairs).alias("p")).select("p.column_name", "p.text").distinct(), "distinct_texts")
