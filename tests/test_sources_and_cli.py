import pytest
from pyspark.sql import functions as F

from tablewright import cli
from tablewright import figures as G
from tablewright.operators import columns as C
from tablewright.operators.roles import classify
from tablewright.sources.generator import generate
from tablewright.sources.io import CsvSource, SourceError, load, source_for, with_row_key, write_frame
from tablewright.streaming.quality import follow_counts, windowed_gaps

TEXT = 'k,name,note\n1,"a ""quoted"" one","two\nlines"\n2,n/a,-\n3,,"x,y"\n'


def test_csv_with_quotes_breaks_and_missing_spellings(spark, tmp_path):
    (tmp_path / "t.CSV").write_text(TEXT)
    rows = [r[:] for r in source_for(str(tmp_path / "t.CSV")).read(spark, as_text=True).collect()]
    assert rows == [("1", 'a "quoted" one', "two\nlines"), ("2", None, None), ("3", None, "x,y")]
    assert dict(source_for(str(tmp_path / "t.CSV")).read(spark).dtypes)["k"] == "int"


def test_separators_encodings_and_endings(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx,y\n")
    assert source_for(str(tmp_path / "t.tsv")).read(spark).first()[:] == (1, "x,y")
    (tmp_path / "l.csv").write_bytes("a;b\né;1\n".encode("latin-1"))
    assert CsvSource(str(tmp_path / "l.csv"), ";", "ISO-8859-1").read(spark).first()[:] == ("é", 1)
    for bad in ("t.doc", "t", "t.xlsb"):
        with pytest.raises(SourceError):
            source_for(bad)
    with pytest.raises(SourceError, match="no such file"):
        source_for(str(tmp_path / "none.csv")).read(spark)
    (tmp_path / "book.xlsx").write_bytes(b"PK")
    with pytest.raises(SourceError):
        source_for(str(tmp_path / "book.xlsx")).read(spark)


@pytest.mark.parametrize("ending", ["csv", "txt", "parquet", "orc", "json"])
def test_round_trips(spark, tmp_path, ending):
    df = spark.createDataFrame([(1, 'a,"b"', 1.5), (2, "c", None)], "k int, l string, v double")
    path = write_frame(df, str(tmp_path / "deep" / f"t.{ending}"), single_file=True)
    back = source_for(path).read(spark).select("k", "l", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(SourceError):
        write_frame(df, str(tmp_path / "t.tsv"))


def test_row_keys_follow_the_files(spark, tmp_path):
    write_frame(spark.range(100).repartition(4), str(tmp_path / "t.parquet"))
    df, roles = load(spark, str(tmp_path / "t.parquet"))
    keyed = with_row_key(df)
    assert sorted(r._row_id for r in keyed.collect()) == list(range(100)) and roles.numeric == ("id",)
    assert sorted(map(tuple, keyed.collect())) == sorted(map(tuple, with_row_key(df).collect()))
    with pytest.raises(SourceError):
        with_row_key(keyed)


def test_generator_is_the_same_for_any_partitioning(spark):
    a = generate(spark, 2000)
    b = generate(spark, 2000).repartition(7)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and len(a.columns) == 43
    assert len(classify(a).numeric) == 34
    row = a.agg(F.avg(F.col("X60_sparse").isNull().cast("int")).alias("s"), F.avg(F.col("X26_bmi").isNull().cast("int")).alias("g"), F.corr("X30", "X31").alias("r"), F.avg((F.col("X56_reminder") == "email").cast("int")).alias("d"), F.skewness("X40_skewed").alias("k"), F.corr("Y4", "X_signal").alias("p")).first()
    assert abs(row.s - 0.73) < 0.05 and abs(row.g - 0.03) < 0.02 and row.r > 0.95 and row.d > 0.9 and row.k > 2 and row.p > 0.8
    assert sorted(map(repr, generate(spark, 50, 1).collect())) != sorted(map(repr, generate(spark, 50, 2).collect()))


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    columns = ["PAT_ID", "Y4", "T", "X_signal", "X21_systolic", "X23_temperature", "X30", "X31", "X50_department", "X56_reminder"]
    generate(spark, 150).select(*columns).coalesce(1).write.csv(str(root / "in.csv"), header=True)
    return root


def test_profile_and_correlate(spark, sample, capsys):
    assert cli.main(["profile", "--input", f"{sample}/in.csv", "--output-dir", f"{sample}/out", "--save"], spark) == 0
    assert "Dominant values" in capsys.readouterr().out and (sample / "out" / "profile.csv").exists()
    assert cli.main(["correlate", "--input", f"{sample}/in.csv", "--output-dir", f"{sample}/out", "--method", "spearman", "--threshold", "0.9"], spark) == 0
    out = capsys.readouterr().out
    assert "X30 ~ X31" in out and "pairs at 0.9 or above" in out
    assert (sample / "out" / "correlation_spearman.svg").read_text().startswith("<svg") and (sample / "out" / "correlation_ranked_spearman.csv").exists()


def test_impute_and_validate(spark, sample, capsys):
    assert cli.main(["impute", "--input", f"{sample}/in.csv", "--output", f"{sample}/done.parquet", "--neighbors", "3", "--skip", "PAT_ID"], spark) == 0
    assert "values filled" in capsys.readouterr().out
    assert cli.main(["validate", "--input", f"{sample}/done.parquet", "--original", f"{sample}/in.csv", "--expect-skipped", "PAT_ID"], spark) == 0
    assert cli.main(["validate", "--input", f"{sample}/in.csv"], spark) == 1
    assert "FAILED" in capsys.readouterr().out


def test_importance_eda_and_bad_input(spark, sample, capsys):
    assert cli.main(["importance", "--input", f"{sample}/in.csv", "--output-dir", f"{sample}/out", "--target", "T", "--permutation-repeats", "1"], spark) == 0
    assert "accuracy" in capsys.readouterr().out and (sample / "out" / "importance_gain.svg").exists()
    assert cli.main(["eda", "--input", f"{sample}/in.csv", "--output-dir", f"{sample}/out", "--skip-tsne"], spark) == 0
    assert (sample / "out" / "pca_projection.parquet").exists() and "pairplot_top_features" in capsys.readouterr().out
    assert cli.main(["importance", "--input", f"{sample}/in.csv", "--target", "none"], spark) == 2
    assert cli.main(["profile", "--input", f"{sample}/nothing.csv"], spark) == 2


def test_drawings():
    style = G.apply_style()
    assert G.colour(0, "viridis") == "#440154" and G.colour(9, "coolwarm") == "#b40426"
    rows = [{"x": 1.0, "y": 2.0, "n": "a<b", "v": 0.5}, {"x": 2.0, "y": 2.0, "n": "c", "v": None}]
    assert G.scatter_svg(rows, "x", "y", style, "t").count("<circle") == 2 and "a&lt;b" in G.bars_svg(rows, "n", "v", style, "t")
    assert G.heat_svg(rows, "x", "n", "v", style, "t", (-1, 1), "coolwarm").count("<rect") == 2 and "circle" not in G.scatter_svg([], "x", "y", style, "t")


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    rows = [(i % 3, float(i % 11) if i % 4 else None, "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "load_id long, x double, y string")
    store = C.CountStore(spark, str(tmp_path / "counts"), ["x", "y"])
    seen = []
    for part in range(2):
        df.where(F.col("load_id") == part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        follow_counts(stream, "load_id", store, str(tmp_path / "checkpoint"), lambda c, n: seen.append(n)).awaitTermination()
    want = C.delta(df.where("load_id < 2"), "load_id", ["x", "y"])
    assert seen == [0, 1] and sorted(map(repr, C.merged(store.counts()).collect())) == sorted(map(repr, C.merged(want).collect()))


def test_windowed_gaps(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 05:00:00' + make_interval(0, 0, 0, id div 10) AS at, IF(id % 3 = 0, NULL, id * 1.0D) AS x FROM range(30)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, x double").parquet(str(tmp_path / "in"))
    windowed_gaps(stream, "at", ["x"]).writeStream.outputMode("complete").format("memory").queryName("gaps_test").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.rows, r.missing) for r in spark.table("gaps_test").collect()) == [(10, 3), (10, 3), (10, 4)]


def test_csv_without_line_breaks_in_values_is_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f'{i},"x, {i}"\n' for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = CsvSource(str(tmp_path / "a.csv")).read(spark)
        assert df.rdd.getNumPartitions() > 2 and df.count() == 20_000 and df.agg(F.sum("k")).first()[0] == 19_999 * 10_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "b.csv").write_text(TEXT)
    assert CsvSource(str(tmp_path / "b.csv"))._breaks(spark) and not CsvSource(str(tmp_path / "b.csv"), multi_line=False)._breaks(spark)


def test_treatment_and_outcomes_follow_the_signal(spark):
    r = generate(spark, 2000).agg(*(F.corr(c, "X_signal").alias(c) for c in ("Y1", "Y2", "Y3", "T", "X5", "Y5"))).first()
    assert r.Y1 > 0.8 and r.Y2 < -0.8 and r.Y3 > 0.8 and r["T"] > 0.6 and abs(r.X5) < 0.1 and abs(r.Y5) < 0.1
