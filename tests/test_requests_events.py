import json

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import catalog, events, requests as req
from tallyscope.sources.sinks import jsonl_name, size_in_mb, write_jsonl
from tallyscope.plans import event_queries
from tallyscope.plans.event_queries import land_restarted
from tallyscope.streaming.landing import committed, compact, in_datasets, land_events, read_landed

def make_events(spark, n_events, n_pairs):
    """Events 0 to n_events - 1 with n_pairs one-key maps each."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n_pairs - 1)), lambda j: F.create_map(F.concat(F.lit("key_"), j), F.concat(F.lit("value_"), j)))
    payload = pairs if n_pairs else F.array().cast("array<map<string,string>>")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return spark.range(n_events).select("id", F.lit("foo").alias("name"), stamp.alias("timestamp"), payload.alias("payload"))



@pytest.mark.parametrize(
    "dataset, level, reason",
    [
        ("TS030", "ctry", None), ("rm097", None, None), (None, "ctry", "Dataset ID is required"), ("", None, "Dataset ID is required"),
        ("TS", "ctry", "Invalid dataset ID format: TS"), ("XX123", "ctry", "Unsupported dataset type: XX"),
        ("TS030", "invalid", "Invalid geographic level: invalid"),
    ],
)
def test_validation(spark, dataset, level, reason):
    df = spark.createDataFrame([(dataset, level)], "dataset_id string, geo_level string")
    assert req.validate_requests(df).first()["reason"] == reason


def test_expansion_defaults(spark):
    df = spark.createDataFrame([("TS030", None, None, None), ("RM1", "la", "out", 25)], "dataset_id string, geo_level string, output_dir string, batch_size bigint")
    rows = [tuple(r) for r in req.expand_requests(df).collect()]
    assert rows[:6] == [("TS030", level, "data/TS030", 200) for level in req.LEVELS]
    assert rows[6] == ("RM1", "la", "out", 25)


def test_batches_of_two_give_two_parameters(spark):
    codes = ["E92000001", "W92000004", "S92000003", "N92000002"]
    areas = spark.createDataFrame([("ctry", i, c) for i, c in enumerate(codes)], "geo_level string, area_no bigint, area_code string")
    batches = req.area_batches(areas, 2).orderBy("batch_no")
    params = [r[0] for r in batches.select(req.area_param(F.col("geo_level"), F.col("area_codes"))).collect()]
    assert params == ["ctry,E92000001,W92000004", "ctry,S92000003,N92000002"]


def test_payload_is_json(spark):
    df = spark.createDataFrame([("TS030", "la", ["a", 'b"']), ("TS030", None, ["a"]), ("TS030", "la", None)], "d string, l string, c array<string>")
    texts = df.select(req.filter_payload(F.col("d"), F.col("l"), F.col("c"), F.array(F.lit("sex")))).collect()
    full, no_level, no_codes = (json.loads(t[0]) for t in texts)
    assert full == {
        "dataset": {"id": "TS030", "edition": "2021", "version": 1}, "population_type": "UR",
        "dimensions": [{"name": "la", "is_area_type": True, "options": ["a", 'b"']}, {"name": "sex"}],
    }
    assert no_level["dimensions"] == no_codes["dimensions"] == [{"name": "sex"}]
    whole = F.array(F.lit('{"name":"age","options":["1"]}'))
    odd = req.filter_payload(F.col("d"), F.col("l"), F.col("c"), whole, F.lit('x"y'), edition="2011", version=2)
    first = json.loads(df.select(odd).first()[0])
    assert first["population_type"] == 'x"y' and first["dimensions"][1] == {"name": "age", "options": ["1"]}
    assert first["dataset"] == {"id": "TS030", "edition": "2011", "version": 2}


def test_a_request_that_failed_without_a_status(spark):
    rows = [("TS1", "la", 5, None, None, "timed out"), ("TS2", "la", 5, 200, 3, None), ("TS3", "la", 5, None, 0, None)]
    df = spark.createDataFrame(rows, "dataset_id string, geo_level string, n_areas bigint, status int, n_observations bigint, failure string")
    got = {r["dataset_id"]: r["error_message"] for r in req.availability(df).collect()}
    assert got["TS1"] == "Error requesting dataset: timed out" and got["TS2"] is None and "observations" in got["TS3"]


@pytest.mark.parametrize("level, use, route", [("lsoa", False, "filter"), ("ctry", True, "filter"), ("la", None, "batch")])
def test_routes(spark, level, use, route):
    df = spark.createDataFrame([(level, use)], "l string, u boolean")
    assert df.select(req.route(df["l"], df["u"])).first()[0] == route


def test_run_summary_hints(spark):
    log = spark.createDataFrame(
        [
            ("A", "la", "f.csv", True, None), ("A", "oa", None, True, None), ("B", "la", None, False, ""),
            ("C", "oa", None, False, "gone"), ("D", "la", None, True, None),
        ],
        "dataset_id string, geo_level string, output_file string, is_available boolean, error_message string",
    )
    status = {(r[0], r[1]): (r["status"], r["reason"]) for r in req.level_status(log).collect()}
    assert status[("A", "oa")] == ("failed", None)
    assert status[("B", "la")] == ("skipped", "Dataset not available at this level")
    summary = {r["dataset_id"]: r for r in req.run_summary(log).collect()}
    assert summary["A"]["succeeded"] and summary["A"]["hint"] is None
    assert summary["B"]["hint"].startswith("This dataset may not") and summary["D"]["hint"] is None


def test_sampled_dimensions_win(spark):
    rows = [(1, {"dimensions": []}), (2, {"dimensions": ["a"]}), (4, {"dimensions": ["b"], "sample_response": True}), (3, {"dimensions": ["c"]})]
    df = spark.createDataFrame([("TS1", "oa", n, json.dumps(d)) for n, d in rows], "dataset_id string, geo_level string, file_no int, json string")
    assert req.pick_dimensions(df).first()["dimensions"] == ["b"]
    assert req.pick_dimensions(df.filter("file_no < 4")).first()["dimensions"] == ["a"]


@pytest.mark.parametrize(
    "href, dataset",
    [
        ("https://x/datasets/TS008/editions/2021", "TS008"), ("/datasets/RM1", "RM1"), ("datasets/TS1/datasets/TS2", "TS1"),
        ("/datasets/", ""), ("https://x/code-lists/TS1", ""), ("x/datasets/cpih/datasets/TS9", "cpih"),
    ],
)
def test_linked_datasets(spark, href, dataset):
    df = spark.createDataFrame([(href,)], "href string")
    assert df.select(catalog.linked_dataset(df["href"])).first()[0] == dataset


def test_truncation_keeps_two_hundred(spark):
    df = spark.createDataFrame([("x" * 200,), ("x" * 201,)], "t string")
    got = [r[0] for r in df.select(catalog.truncate_text(df["t"])).collect()]
    assert got == ["x" * 200, "x" * 197 + "..."]


def test_events_and_their_json_lines(spark, tmp_path):
    path = str(tmp_path / jsonl_name("dummy", 20, 3))
    assert path.endswith("dummy--20-events-by-3-kv-pairs.jsonl")
    write_jsonl(make_events(spark, 20, 3), path)
    assert size_in_mb(path, spark) > 0
    rows = events.unnest_payload(events.read_events(spark, path)).collect()
    assert {(r["id"], r["key"], r["value"]) for r in rows} == {(i, f"key_{j}", f"value_{j}") for i in range(20) for j in range(3)}
    assert make_events(spark, 2, 0).selectExpr("max(size(payload))").first()[0] == 0


def test_landing_is_idempotent_and_drains(spark, tmp_path):
    source, out, offsets = (str(tmp_path / name) for name in ("source", "out", "offsets"))
    write_jsonl(make_events(spark, 2500, 1).repartition(3), source)

    def land():
        stream = spark.readStream.schema(events.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(source)
        land_events(stream, out, offsets, 400).awaitTermination()

    def names():
        return {r["dataset"] for r in read_landed(spark, out, events.EVENT_SCHEMA).select("dataset").distinct().collect()}

    assert read_landed(spark, out, events.EVENT_SCHEMA).count() == 0  # nothing there yet
    land()
    first, landed = names(), read_landed(spark, out, events.EVENT_SCHEMA)
    assert (landed.count(), landed.select("id").distinct().count()) == (2500, 2500)
    assert all(name.startswith("raw-nsp-events--20") for name in first)
    land()  # nothing new
    assert names() == first
    make_events(spark, 2600, 1).filter("id >= 2500").write.mode("append").json(source)
    land()
    landed = read_landed(spark, out, events.EVENT_SCHEMA)
    assert landed.select("id").distinct().count() == landed.count() == 2600
    assert landed.groupBy("dataset").count().agg(F.max("count")).first()[0] <= 400


@pytest.mark.parametrize("stops", [[("written", 0)], [("named", 1)], [("written", 1), ("named", 1), ("named", 2)], [("written", b) for b in range(4)]])
def test_stopped_landings_are_replayed_once(spark, tmp_path, stops):
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    make_events(spark, 900, 1).repartition(4).write.json(source)
    stream = spark.readStream.schema(events.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    land_restarted(spark, stream, out, stops)
    # every stopped attempt left a folder, and none of them counts twice
    assert len(list((tmp_path / "out" / "data").iterdir())) == 4 + len(stops) and len(committed(spark, out)) == 4
    landed = read_landed(spark, out, events.EVENT_SCHEMA)
    assert sorted(r["id"] for r in landed.select("id").collect()) == list(range(900))


def test_a_replayed_batch_gets_the_same_names(spark):
    batch = make_events(spark, 30, 1).withColumn("timestamp", F.lit("2024-05-06T07:08:09.1"))
    names = [sorted(r[0] for r in in_datasets(batch.repartition(n), 4, 10).select("dataset").distinct().collect()) for n in (1, 5)]
    assert names[0] == names[1] and len(names[0]) == 3
    assert names[0][0].startswith("raw-nsp-events--2024-05-06--07-08-09--")


def test_a_batch_moves_to_its_data_sets_once(spark, tmp_path):
    batch = make_events(spark, 900, 1).repartition(4)
    plan = in_datasets(batch, 0, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the row numbers' few heads, sent to the rows
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    batch.write.json(source)
    land_events(spark.readStream.schema(events.EVENT_SCHEMA).json(source), out, str(tmp_path / "offsets"), 50).awaitTermination()
    files = read_landed(spark, out, events.EVENT_SCHEMA).groupBy("dataset", "_metadata.file_path").count().collect()
    assert len(files) == len({r["dataset"] for r in files}) == 18 and {r["count"] for r in files} == {50}


@pytest.mark.parametrize("batches", [1, 8])
def test_batches_of_the_supplied_events_have_several_files(spark, tmp_path, monkeypatch, batches):
    monkeypatch.setattr(event_queries, "fresh_path", lambda _, name: str(tmp_path / name))
    rows = spark.range(4000).selectExpr("id AS event_id", "timestamp_ntz'2024-05-06 07:08:09' AS ts", "'click' AS event_type", """'{"k":"v"}' AS props""")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream, out = event_queries._stream(spark, str(tmp_path), batches), str(tmp_path / "out")
    land_events(stream, out, str(tmp_path / "offsets")).awaitTermination()
    assert len(committed(spark, out)) == batches
    assert len(list((tmp_path / "arriving").glob("*.parquet"))) == batches * spark.sparkContext.defaultParallelism > batches
    assert read_landed(spark, out, events.EVENT_SCHEMA).agg(F.count_distinct("id"), F.count("id")).first()[:] == (4000, 4000)


@pytest.mark.parametrize("parts,share", [(25, 3.5), (25, 1), (2, 9)])
def test_compaction_keeps_every_line(spark, tmp_path, parts, share):
    small, large = str(tmp_path / "small"), str(tmp_path / "large")
    write_jsonl(make_events(spark, 2000, 4).repartition(parts), small)
    target = size_in_mb(small, spark) / share
    files = compact(spark, small, large, target_mb=target)
    sizes = [p.stat().st_size for p in (tmp_path / "large").glob("part-*")]
    assert share <= files == len(sizes) <= 2 * share + 1 and max(sizes) <= target * 1024 * 1024 * 1.05
    before, after = spark.read.text(small), spark.read.text(large)
    assert before.exceptAll(after).count() == 0 and after.exceptAll(before).count() == 0
    assert spark.conf.get("spark.sql.files.openCostInBytes") != "0"
