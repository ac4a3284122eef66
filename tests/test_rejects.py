import csv
import io
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablewright.operators.rejects import Field, load_lines

FIELDS = [Field("a", "long"), Field("hr", "double", 20, 300), Field("note")]
NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
MISSING = ("", "nan", "NaN", "NA", "N/A", "null", "NULL", "None", "-", "--")


def brute(line):
    """A character-wise reading of the same rules."""
    if line is None:
        return "column_count"
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            value, i, closed = "", i + 1, False
            while i < n:
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        value, i = value + '"', i + 2
                        continue
                    closed, i = True, i + 1
                    break
                value, i = value + line[i], i + 1
            if not closed or (i < n and line[i] != ","):
                return "quoting"
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            value, i = line[i:j], j
            if '"' in value:
                return "quoting"
        fields.append(value)
        if i >= n:
            break
        i += 1
    if len(fields) != 3:
        return "column_count"
    v = fields[1].strip(" \t")
    if v in MISSING:
        return None
    return None if NUMBER.fullmatch(v) and 20 <= float(v) <= 300 else "value"


LINES = [
    "1,70,x", '1,"70",x', "1,70", "1,70,x,y", '1,70,"a,b"', '1,70,"a""b"', '1,70,"a', '1,70,a"b', '1,70,"a"b', "1,  70\t,x", "1,NA,x", "1,,x", "1,n/a,x", "1,19.999,x", "1,20,x", "1,300,x",
    "1,300.1,x", "1,+7e1,x", "1,7_0,x", "1,70d,x", "1,0x46,x", "1,inf,x", "1,٧٠,x", "1,70\n,x", '1,70,"line\nbreak"', '"",70,""', '1,"",x', "", ",", ",,", '"""",70,x', '1,70,""""', '1,70,"', None,
    "1,1e400,x", "1,--,x", "1, -- ,x", '1," 70 ",x', '1,70," x"', '1,70, "x"', "1,.5e2,x", "1,5.e1,x", "1,.,x", "1,e5,x", "1,70,x\r", 'x"",70,y', '"a","b","c"', "1,NaN,x", "1,None,x", "1,none,x",
]


def found(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    out = load_lines(df, "line", FIELDS)
    return {r.line_id: r.reason for r in out.rejects.collect()}, out


def test_reasons_match_a_reader_of_characters(spark):
    got, out = found(spark, LINES)
    assert got == {i: r for i, line in enumerate(LINES) if (r := brute(line))}
    assert sorted(r.line_id for r in out.records.collect()) == [i for i, line in enumerate(LINES) if not brute(line)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='",1a \n7', max_size=14), min_size=30, max_size=60))
def test_any_text(spark, lines):
    got, _ = found(spark, lines)
    assert got == {i: r for i, line in enumerate(lines) if (r := brute(line))}


def test_records_are_typed_and_unquoted(spark):
    _, out = found(spark, ['1,"70","say ""hi"", ok"', "x,80,plain", "2,NA,-"])
    rows = {r.line_id: r for r in out.records.collect()}
    assert (rows[0].a, rows[0].hr, rows[0].note) == (1, 70.0, 'say "hi", ok')
    assert rows[1].a is None and rows[1].unparsed == {"a": "x"}
    assert rows[2].hr is None and rows[2].note is None and rows[2].unparsed == {}


def test_quotes_as_the_csv_module_reads_them(spark):
    lines = ['1,70,"a,b"', '1,70,"x""y"', '"1","70","z"', '1,70,"two\nlines"']
    _, out = found(spark, lines)
    for r in out.records.collect():
        assert r.note == next(csv.reader(io.StringIO(lines[r.line_id])))[2]


def test_long_lines_repeated_rows_and_clashing_columns(spark):
    long = '1,70,"' + '""' * 60_000 + '"'
    df = spark.createDataFrame([(1, long, "kept", "mine"), (1, long, "kept", "mine"), (2, "bad", "kept", "mine"), (2, "bad", "kept", "mine")], "line_id long, line string, hr string, reason string")
    out = load_lines(df, "line", FIELDS)
    assert [len(r.note) for r in out.records.collect()] == [60_000, 60_000]
    assert out.records.columns == ["line_id", "a", "hr", "note", "unparsed"]
    assert [(r.line_id, r.reason) for r in out.rejects.collect()] == [(2, "column_count")] * 2


def test_empty_table(spark):
    got, out = found(spark, [])
    assert got == {} and out.records.count() == 0 and out.dictionary.count() == 0


def test_dictionary_has_each_text_once(spark):
    _, out = found(spark, ["1,999,x"] * 50 + ["1,oops,x"] * 50 + ["1,70,x"] * 50)
    assert sorted((r.column_name, r.text, r.reason) for r in out.dictionary.collect()) == [("hr", "999", "out_of_range"), ("hr", "oops", "not_a_number")]


def test_each_distinct_text_is_cast_once(spark, monkeypatch):
    """The cast reads a table that has each text of a column once, and stands above nothing but its scan."""
    import tablewright.operators.rejects as R

    seen, plain = [], R.judged
    monkeypatch.setattr(R, "judged", lambda values, checked: seen.append((values, plain(values, checked))) or seen[-1][1])
    _, out = found(spark, [f"1,{60 + i % 7},x" for i in range(500)] + ["1,oops,x"] * 90 + ["1,,x"])
    values, made = seen[0]
    assert values.count() == made.count() == 9 and out.records.count() == 501
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "distinct_texts" in str(values.inputFiles())


def test_large_dictionary_is_joined_by_salted_shuffle(spark, monkeypatch):
    import tablewright.plans.shared as shared

    monkeypatch.setattr(shared, "MAX_BROADCAST_ROWS", 0)
    got, out = found(spark, LINES)
    assert got == {i: r for i, line in enumerate(LINES) if (r := brute(line))}
    assert sorted(r.line_id for r in out.records.collect()) == [i for i, line in enumerate(LINES) if not brute(line)]


@pytest.mark.parametrize("name", ["p1_found", "p1_records"])
def test_whole_table_is_divided(spark, sf, name):
    from tablewright.plans import data_queries as Q

    total = spark.read.parquet(f"{sf}/raw_lines.parquet").count()
    assert Q.p1_found(spark, sf).count() + Q.p1_records(spark, sf).count() == total
