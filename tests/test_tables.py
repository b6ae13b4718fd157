"""Perturbation, reporting periods, scans and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import periods, perturb
from tallyscope.sources import files, sinks, tables

TEXTS = ["12", " 12 ", "0012", "+7", "-4", "10", "11", "12.0", "1e3", "inf", ".5", "abc", "True", "1,000", "", "12d", "9" * 30, None]


def test_cells_are_typed_by_their_text(spark):
    df = spark.createDataFrame([(str(i), "a", "b", t) for i, t in enumerate(TEXTS)], "kc63_output_by_run_id string, col_b string, col_c string, v string")
    got = {TEXTS[int(r[0])]: r["v"] for r in perturb.perturb(df, seed=1).collect()}
    for text in ("12", " 12 ", "0012"):
        assert 6 <= int(got[text]) <= 18
    for text in ("+7", "-4", "10"):
        assert 0 <= int(got[text]) <= 10
    assert 5 <= int(got["11"]) <= 16
    for text in ("12.0", "1e3", "inf", ".5"):
        assert 0 <= float(got[text]) <= 100 and "." in got[text]
    for text in ("abc", "True", "1,000", "", "12d", "9" * 30, None):
        assert got[text] == text


def test_noise_does_not_depend_on_partitions_and_reaches_both_ends(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), F.lit(20).alias("v"), F.lit(3).alias("w"), F.lit(1.5).alias("x"))
    one = perturb.perturb(df.repartition(1), ["k"], seed=9)
    many = perturb.perturb(df.repartition(13), ["k"], seed=9)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    row = one.agg(F.min("v"), F.max("v"), F.min("w"), F.max("w"), F.countDistinct("v")).first()
    assert tuple(row) == (10, 30, 0, 10, 21)
    assert perturb.perturb(df, ["k"], seed=10).exceptAll(one).count() > 3000


def test_very_large_integers_stay_in_range(spark):
    df = spark.createDataFrame([("1", str(2**63 - 1))], "k string, v string")
    assert 0 < int(perturb.perturb(df, ["k"], seed=1).first()["v"]) <= 2**63 - 1


def test_report_equals_linear_quartiles(spark):
    rng = np.random.default_rng(0)
    old = rng.uniform(0, 1000, 101)
    new = old + rng.normal(0, 300, 101)
    before = spark.createDataFrame([(i, float(v)) for i, v in enumerate(old)], "k int, v double")
    after = spark.createDataFrame([(i, float(v)) for i, v in enumerate(new)], "k int, v double")
    row = perturb.perturbation_report(after, before, ["k"]).first().asDict()
    diff = np.abs(new - old)
    assert row["count"] == 101
    for name, value in {
        "mean": diff.mean(), "std": diff.std(ddof=1), "min": diff.min(), "max": diff.max(),
        "p25": np.quantile(diff, 0.25), "p50": np.quantile(diff, 0.5), "p75": np.quantile(diff, 0.75),
    }.items():
        assert row[name] == np.round(value), name


def test_ranked_values_of_every_size(spark):
    """Ranks among ties, tiny and huge numbers, zeros, infinity and NaN."""
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.uniform(0, 1, 300), rng.integers(0, 4, 500), 2.0 ** rng.integers(-1074, 1023, 200), np.nextafter(2.0 ** rng.integers(-60, 60, 100), 0), [0.0, 5e-324, 1.7976931348623157e308, np.inf, 2.0**-1022]])
    b = np.where(np.arange(len(a)) % 3 == 0, np.nan, 7.25)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(6)
    ranks = list(range(0, len(a), 37)) + [len(a) - 1]
    got = perturb.ranked_values(df, {"a": ranks, "b": ranks})
    for name, values in (("a", np.sort(a)), ("b", np.sort(b))):  # NaN sorts last in both
        for rank in ranks:
            assert got[name][rank] == values[rank] or np.isnan(values[rank]) and np.isnan(got[name][rank]), (name, rank)
    with_nulls = df.select(perturb.F.when(df["a"] >= 1, df["a"]).alias("a"))
    assert perturb.ranked_values(with_nulls, {"a": [0]}) == {"a": {0: 1.0}}


def test_report_of_few_rows(spark):
    one = spark.createDataFrame([("1", "4", None, "1")], "k string, v string, w string, x string")
    two = spark.createDataFrame([("1", "9", "1", "1")], "k string, v string, w string, x string")
    rows = {r["column"]: r for r in perturb.perturbation_report(one, two, ["k"]).collect()}
    assert set(rows) == {"v", "x"} and (rows["v"]["p25"], rows["v"]["max"], rows["v"]["std"], rows["x"]["p50"]) == (5.0, 5.0, None, 0.0)
    assert perturb.perturbation_report(one.limit(0), two, ["k"]).count() == 0


def test_report_refuses_words(spark):
    df = spark.createDataFrame([("1", "word")], "k string, v string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        perturb.perturbation_report(df, df, ["k"])


def test_copies_per_date_differ(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.lit(500).alias("v"))
    copies = perturb.replicate_for_dates(df, ["2020-11-23", "2021-11-23"], ["k"], seed=1)
    assert copies.count() == 100 and copies.groupBy("k").agg(F.countDistinct("v").alias("n")).filter("n = 2").count() > 40


@pytest.mark.parametrize(
    "path, year", [("x12023.csv", 2023), ("/a/b_2001.csv", 2001), ("y_2024.tar.csv", None), ("abc.csv", None), ("2020x.csv", None), ("q2019", 2019)]
)
def test_year_is_the_end_of_the_stem(spark, path, year):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(periods.year_or_null(df["path"])).first()[0] == year


def test_file_without_a_year_is_an_error(spark):
    df = spark.createDataFrame([("abc.csv",)], "path string")
    with pytest.raises(Exception, match="does not end with a 4-digit year"):
        periods.with_reporting_period(df, "path").collect()


def test_tagging_a_folder(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "kc_2023.csv").write_text('a,b\n1,"x,""y"\n007,\n')
    (source / "kc_2024.csv").write_text("a,b\n2,z\n")
    (source / "other_2022.csv").write_text("b,c\nq,r\n")
    (source / "notes.txt").write_text("not read")
    (source / "my file%20 2021.csv").write_text("b,a\n3,4\n")
    for _ in range(2):  # a rerun replaces its outputs
        tagged = periods.tag_reporting_period(spark, str(source), str(target))
    rows = {(r["output"], r["a"], r["b"], r["c"], r["reporting_period"]) for r in tagged.collect()}
    assert rows == {
        ("kc_2023_preprocessed", "1", 'x,"y', None, "2022-2023"),
        ("kc_2023_preprocessed", "007", None, None, "2022-2023"),
        ("kc_2024_preprocessed", "2", "z", None, "2023-2024"),
        ("other_2022_preprocessed", None, "q", "r", "2021-2022"),
        ("my file%20 2021_preprocessed", "4", "3", None, "2020-2021"),
    }
    one = spark.read.option("header", True).csv(str(target / "output=kc_2023_preprocessed"))
    assert one.columns == ["a", "b", "reporting_period"] and one.count() == 2


def test_named_output_files(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    lines = "".join(f"{i},row {i}\n" for i in range(5000))
    (source / "kc 2023.csv").write_text("a,b\n" + lines)
    (source / "other%20_2022.csv").write_text('c,"d\n,e"\n')
    (source / "third_2021.csv").write_text("b,c\nq,\n")
    for _ in range(2):  # a rerun replaces its outputs
        tagged = periods.tag_reporting_period(spark, str(source), str(target), multi_line=True, single_files=True)
    visible = sorted(p.name for p in target.iterdir() if not p.name.startswith("."))
    assert visible == ["kc 2023_preprocessed.csv", "other%20_2022_preprocessed.csv", "third_2021_preprocessed.csv"]
    whole = "a,b,reporting_period\n" + "".join(f"{i},row {i},2022-2023\n" for i in range(5000))
    assert (target / visible[0]).read_text() == whole
    assert (target / visible[1]).read_text() == 'c,"d\n,e",reporting_period\n'
    assert tagged.count() == 5001 and set(tagged.columns) == {"a", "b", "c", "d\n,e", "reporting_period", "output"}


def test_headers_are_read_by_tasks(spark, tmp_path, monkeypatch):
    import gzip

    texts = {
        "a.csv": "x,y\n1,2\n", "b.csv": "\ufeffx,y\r\n1,2\r\n", "c.csv": '"x\n1",y\n1,2\n', "d.csv": "", "e.csv": "y,x", "f.csv": '"x\r\n1",y\r\n3,4',
        "long.csv": ",".join(f"column {i}" for i in range(20_000)) + "\n1\n", "z y%20.csv": "x,y\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "g.csv.gz").write_bytes(gzip.compress(b"x,y\n5,6\n"))
    names = tables.csv_parts(spark, str(tmp_path))
    found = {header: [f.rsplit("/", 1)[1] for f in names] for header, names in files.by_header(spark, names).items()}
    assert found.pop(tuple(f"column {i}" for i in range(20_000))) == ["long.csv"]
    same = {("x", "y"): ["a.csv", "b.csv", "g.csv.gz", "z y%20.csv"], ("x\n1", "y"): ["c.csv"], ("x\r\n1", "y"): ["f.csv"], ("y", "x"): ["e.csv"]}
    assert found == same
    # where tasks cannot open the files, Spark's own reader finds the same headers
    scanned = {r.file.rsplit("/", 1)[1]: r.record for r in files.scanned_records(spark, names).collect()}
    direct = {r.file.rsplit("/", 1)[1]: r.record for r in files.first_records(spark, names).collect()}
    assert {k: v.replace("\r\n", "\n").removeprefix("\ufeff") for k, v in direct.items() if v} == {k: v.removeprefix("\ufeff") for k, v in scanned.items()}
    monkeypatch.setattr(files, "first_records", lambda spark, names: spark.createDataFrame([(n, None) for n in names], "file string, record string"))
    assert ("x", "y") in files.by_header(spark, names) and files.by_header(spark, []) == {}


def test_broken_documents_are_kept(spark):
    schema = "a int, b array<string>"
    texts = ['{"a": 1, "b": ["x"]}', "{}", '{"a": 1, "b"', "[1]", "", "  ", "null", None, '{"a": "x"}', '{"a": 1} trailing']
    rows = tables.checked_documents(spark.createDataFrame([(t,) for t in texts], "json string"), schema).collect()
    assert rows[0].parsed == (1, ["x"]) and rows[1].parsed == (None, None) and rows[0].corrupt is None and rows[1].corrupt is None
    broken = {r.json for r in rows if r.corrupt is not None}
    assert broken == {'{"a": 1, "b"', "[1]", "", "  ", "null", '{"a": "x"}'}  # the reader stops behind an object
    assert all(r.parsed is None and r.corrupt == r.json for r in rows if r.json in broken)
    assert rows[7].parsed is None and rows[7].corrupt is None


def test_csv_columns_by_name_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x\ny",2\n')
    (tmp_path / "b.csv").write_text("b,a\n3,z\n")
    (tmp_path / "c.csv").write_text("")
    rows = {(r["a"], r["b"]) for r in tables.text_csv(spark, str(tmp_path), multi_line=True).collect()}
    assert rows == {("x\ny", "2"), ("z", "3")}
    schema = tables.T.StructType([tables.T.StructField("b", tables.T.IntegerType()), tables.T.StructField("a", tables.T.StringType())])
    assert {tuple(r) for r in tables.csv_table(spark, str(tmp_path), schema, multi_line=True).collect()} == {(2, "x\ny"), (3, "z")}


def test_quoted_export(spark, tmp_path):
    df = spark.createDataFrame([("7", 'say "hi"', None, 1.5), ("8", "a,b", "c", 2.0)], "id string, t string, n string, x double")
    path = str(tmp_path / "out")
    sinks.export_quoted(df.coalesce(1), path)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert lines == ['"id","t","n","x"', '7,"say ""hi""","","1.5"', '8,"a,b","c","2.0"']


def test_csv_by_declared_schema(spark, tmp_path):
    (tmp_path / "Reader.csv").write_text("bso_code,reader_id,extra\n01,R1,x\nNA,R2,y\n")
    df = tables.csv_table(spark, str(tmp_path / "Reader.csv"), tables.READING_SCHEMAS["Reader"])
    assert [tuple(r) for r in df.collect()] == [("R1", "01"), ("R2", "NA")]
    df = tables.csv_table(spark, str(tmp_path / "Reader.csv"), tables.READING_SCHEMAS["Reader"], null_value="NA")
    assert [tuple(r) for r in df.collect()] == [("R1", "01"), ("R2", None)]
    with pytest.raises(ValueError, match="missing columns"):
        tables.csv_table(spark, str(tmp_path / "Reader.csv"), tables.READING_SCHEMAS["Biopsies"])


def test_json_documents_skip_empty_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"observations":\n [1]}')
    (tmp_path / "b.json").write_text("")
    rows = tables.json_documents(spark, str(tmp_path)).collect()
    assert [(r["file_name"], r["json"]) for r in rows] == [("a.json", '{"observations":\n [1]}')]


def test_header_check_names_the_difference(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tables.check_header(df, ["b", "a"]) is df
    with pytest.raises(ValueError, match=r"missing \['c'\], extra \['b'\]"):
        tables.check_header(df, ["a", "c"])


def test_default_output_name(spark):
    df = spark.createDataFrame([("data/x.csv",), ("data.d/x",)], "p string")
    assert [r[0] for r in df.select(tables.flat_file_name(df["p"])).collect()] == ["data/x_flat.csv", "data.d/x_flat"]


def test_cells_that_only_look_like_numbers_stay(spark):
    texts = ["nan", "NaN", "1e400", "-inf", "12", "1.5", "9223372036854775807"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "k string, v string")
    rows = [r["v"] for r in perturb.perturb(df, ["k"], seed=1, smear=1.5).orderBy("k").collect()]
    assert rows[:3] == texts[:3] and 0 <= float(rows[3]) <= 100 and 0 <= int(rows[4]) <= 30 and rows[5] != "1.5"
    assert 0 <= int(rows[6]) <= 9223372036854775807
