"""Reader KPIs against a plain-Python restatement of their rules, with skew and odd rows."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyscope.functions.rules import RECALL, micros_between, ratio
from tallyscope.operators import charts, reading
from tallyscope.sources.sinks import write_bucketed
from tallyscope.sources.tables import READING_SCHEMAS, reading_tables


def random_tables(seed, hot):
    rng = random.Random(seed)
    readers = [(f"R{i}", rng.choice(["A", "B", None])) for i in range(8)]
    episodes = [f"E{i}" for i in range(40)]
    decisions = []
    for i in range(400):
        reader = "R0" if hot and rng.random() < 0.4 else rng.choice([r for r, _ in readers] + [None, "R9"])
        episode = "E0" if hot and rng.random() < 0.4 else rng.choice(episodes + ["E99", None])
        decisions.append((f"D{i % 370}", episode, reader, rng.choice([RECALL, RECALL, "Normal", None])))
    return {
        "Reader": readers,
        "ReadDecision": decisions,
        "ReadEpisode": [(e,) for e in episodes],
        "CancerPresence": [(e, rng.choice(["TRUE", "true", "t", "False", None])) for e in episodes + ["E99"]],
        "Biopsies": [(e, rng.choice(["Benign", "BENIGN", "malignant", None])) for e in episodes if rng.random() < 0.6],
        "ArbitrationDecision": [(f"D{i}", rng.choice([RECALL, "Normal", None])) for i in range(0, 370, 7)],
        "Image": [(e, f"A{e}" if rng.random() < 0.8 else None, "P0") for e in episodes for _ in range(2)],
        "Appointment": [(f"A{e}", f"S{e}" if rng.random() < 0.8 else None) for e in episodes],
        "ScreeningEpisode": [(f"S{e}", f"P{i % 9}") for i, e in enumerate(episodes)],
        "Participant": [(f"P{i}",) for i in range(7)],
        "IntervalCancers": [(f"P{i}", rng.choice(["True", "FALSE", "yes"])) for i in range(9)],
    }


COLUMNS = {
    "Reader": "reader_id string, bso_code string",
    "ReadDecision": "read_decision_id string, read_episode_id string, reader_id string, reader_decision string",
    "ReadEpisode": "read_episode_id string",
    "CancerPresence": "read_episode_id string, cancer_present string",
    "Biopsies": "read_episode_id string, biopsy_result string",
    "ArbitrationDecision": "read_decision_id string, arbitration_decision string",
    "Image": "read_episode_id string, appointment_id string, participant_id string",
    "Appointment": "appointment_id string, screening_episode_id string",
    "ScreeningEpisode": "screening_episode_id string, participant_id string",
    "Participant": "participant_id string",
    "IntervalCancers": "participant_id string, interval_cancer_found string",
}


def to_spark(spark, rows):
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in COLUMNS.items()}


def restated(rows):
    """Counts per reader, straight from the rules."""
    known = {e for (e,) in rows["ReadEpisode"]}
    cancer = {e for e, text in rows["CancerPresence"] if str(text).lower() == "true"}
    inside = [d for d in rows["ReadDecision"] if d[1] in known]
    out = defaultdict(lambda: defaultdict(set))
    for decision, episode, reader, text in inside:
        out["reads"][reader].add(decision)
        if text == RECALL:
            out["recalls"][reader].add(decision)
            if episode in cancer:
                out["detected"][reader].add(episode)
            for e, result in rows["Biopsies"]:
                if e == episode:
                    out["biopsies"][reader].add(e)
                    if str(result).lower() == "benign":
                        out["benign"][reader].add(e)
    triples = {(e, r, t) for _, e, r, t in rows["ReadDecision"] if e in cancer}
    recalls = defaultdict(int)
    for episode, _, text in triples:
        recalls[episode] += text == RECALL
    arbitrated = set()
    for decision, text in rows["ArbitrationDecision"]:
        if text == RECALL:
            arbitrated |= {e for d, e, _, _ in rows["ReadDecision"] if d == decision}
    for episode, reader, text in triples:
        if text != RECALL and (recalls[episode] > 0 or episode in arbitrated):
            out["discrepant"][reader].add(episode)
    appointment, screening = dict(rows["Appointment"]), dict(rows["ScreeningEpisode"])
    positive = {p for p, text in rows["IntervalCancers"] if text.upper() == "TRUE"}
    for _, episode, reader, _ in inside:
        for e, a, _ in rows["Image"]:
            person = screening.get(appointment.get(a)) if e == episode and a else None
            if person in positive:
                out["interval"][reader].add(person)
    return lambda measure, reader: len(out[measure][reader])


@pytest.mark.parametrize("hot", [False, True])
def test_counts_match_the_rules(spark, hot):
    rows = random_tables(3, hot)
    tables, count = to_spark(spark, rows), restated(rows)
    checks = {
        reading.kpi_images_read: ("read_decision_count", "reads"),
        reading.kpi_recalled: ("recalled_for_assessment_count", "recalls"),
        reading.kpi_cancers_detected: ("cancers_detected_count", "detected"),
        reading.kpi_discrepant: ("discrepant_cancers_count", "discrepant"),
        reading.kpi_biopsies: ("biopsies_count", "biopsies"),
        reading.kpi_benign_biopsy_rate: ("benign_biopsies_count", "benign"),
        reading.kpi_interval_cancers: ("interval_cancers_count", "interval"),
    }
    for kpi, (column, measure) in checks.items():
        got = {row["reader_id"]: row[column] for row in kpi(tables).collect()}
        assert got == {reader: count(measure, reader) for reader, _ in rows["Reader"]}, column
    for row in reading.summary_table(tables).collect():
        reader = row["Unique Code"]
        detected, discrepant = count("detected", reader), count("discrepant", reader)
        assert row["Total Cancers Detected"] == detected
        assert row["Total Discrepant Cancers"] == discrepant
        total = detected + discrepant
        assert row["Discrepant Cancer Rate"] == (round(discrepant / total * 100, 2) if total else 0.0)
        assert row["BSO Code"] == (dict(rows["Reader"])[reader] or "0")


def test_every_join_is_right_without_broadcasts(spark):
    rows = random_tables(5, True)
    tables, count = to_spark(spark, rows), restated(rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["Unique Code"]: r["Total Discrepant Cancers"] for r in reading.summary_table(tables).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {reader: count("discrepant", reader) for reader, _ in rows["Reader"]}


def test_reader_with_recall_and_pass_is_discrepant_against_itself(spark):
    rows = {name: [] for name in COLUMNS}
    rows.update(
        Reader=[("R1", "A")],
        ReadDecision=[("D1", "E1", "R1", RECALL), ("D2", "E1", "R1", "Normal")],
        ReadEpisode=[("E1",)],
        CancerPresence=[("E1", "TRUE")],
    )
    tables = to_spark(spark, rows)
    assert reading.kpi_discrepant(tables).first()["discrepant_cancers_count"] == 1


def test_ppv_counts_episodes_over_decisions(spark):
    rows = {name: [] for name in COLUMNS}
    rows.update(
        Reader=[("R1", "A")],
        ReadDecision=[("D1", "E1", "R1", RECALL), ("D2", "E1", "R1", RECALL)],
        ReadEpisode=[("E1",)],
        CancerPresence=[("E1", "true")],
    )
    row = reading.kpi_ppv(to_spark(spark, rows)).first()
    assert (row["recalled_for_assessment_count"], row["ppv_recall_for_assessment_pct"]) == (2, 50.0)


def test_ratio_rounds_half_to_even_and_survives_zero(spark):
    row = spark.range(1).select(
        ratio(F.lit(1), F.lit(32), 100).alias("half"), ratio(F.lit(1), F.lit(0), 100).alias("none")
    ).first()
    assert tuple(row) == (3.12, 0.0)


def test_read_time_takes_both_readers_and_keeps_fractions(spark):
    at = dt.datetime(2024, 1, 1, 9)
    span = lambda s: at + dt.timedelta(seconds=s)
    episodes = spark.createDataFrame(
        [("E1", "R1", at, span(90.5), "R2", at, span(-30)), ("E2", "R1", at, None, None, at, span(60))],
        "read_episode_id string, first_reader_id string, first_reader_started_at timestamp_ntz, first_reader_ended_at "
        "timestamp_ntz, second_reader_id string, second_reader_started_at timestamp_ntz, second_reader_ended_at timestamp_ntz",
    )
    readers = spark.createDataFrame([("R1", "A"), ("R2", "A"), ("R3", "A")], COLUMNS["Reader"])
    got = {r[0]: tuple(r)[1:] for r in reading.kpi_read_time({"ReadEpisode": episodes, "Reader": readers}).collect()}
    assert got == {"R1": (1.51, 1), "R2": (-0.5, 1), "R3": (0.0, 0)}


def test_durations_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        row = spark.sql("SELECT timestamp_ntz'2024-03-31 00:30:00' a, timestamp_ntz'2024-03-31 03:30:00.25' b").select(
            micros_between(F.col("a"), F.col("b"))
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row[0] == 10_800_250_000


def test_null_safe_enrichment_matches_null_appointments(spark):
    rows = {name: [] for name in COLUMNS}
    rows.update(
        Reader=[("R1", "A")], ReadDecision=[("D1", "E1", "R1", RECALL)], ReadEpisode=[("E1",)],
        Image=[("E1", None, "P1")], Appointment=[(None, "S1")], ScreeningEpisode=[("S1", "P2")], Participant=[("P2",)],
    )
    tables = to_spark(spark, rows)
    assert reading.enrich_decisions(tables).first()["screening_participant_id"] is None
    matched = reading.enrich_decisions(tables, null_safe=True).first()
    assert (matched["screening_participant_id"], matched["participant_id_participant"]) == ("P2", "P2")


def test_null_safe_enrichment_of_an_episode_without_image(spark):
    rows = {name: [] for name in COLUMNS}
    rows.update(
        ReadDecision=[("D1", "E1", "R1", RECALL), ("D2", "E1", "R2", None), ("D3", "E2", "R1", None), ("D4", "E3", "R1", None)],
        ReadEpisode=[("E1",), ("E2",)], Image=[("E2", "A2", "P1"), ("E2", "A9", "P1")],
        Appointment=[(None, "S1"), ("A2", None)], ScreeningEpisode=[("S1", "P2"), (None, "P3")], Participant=[("P2",), ("P3",), ("P3",)],
    )
    tables = to_spark(spark, rows)

    def got(**how):
        picked = reading.enrich_decisions(tables, **how).select("read_decision_id", "appointment_id", "participant_id_participant")
        return sorted(map(tuple, picked.collect()), key=str)

    assert got() == sorted([("D1", None, None), ("D2", None, None), ("D3", "A2", None), ("D3", "A9", None)], key=str)
    assert got(null_safe=True) == sorted([("D1", None, "P2"), ("D2", None, "P2"), *[("D3", a, "P3") for a in ("A2", "A9") for _ in range(2)]], key=str)


def test_decisions_move_once_to_be_enriched(spark):
    tables = to_spark(spark, random_tables(3, False))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names:
            spark.conf.set(name, "-1")
        plan = reading.enrich_decisions(tables)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    moved = [part for part in plan.split("\n\n") if "Exchange" in part.split("\n")[0] and "read_decision_id" in part]
    assert len(moved) == 1


def test_empty_input_gives_empty_charts(spark):
    rows = {name: [] for name in COLUMNS}
    tables = to_spark(spark, rows)
    tables["ReadEpisode"] = spark.createDataFrame([], "read_episode_id string, first_reader_id string")
    summary = reading.summary_table(tables)
    points = charts.funnel_points(tables, summary)
    for df in (summary, charts.ellipse_params(summary), charts.quadrants(summary), points, charts.funnel_limits(tables, points)):
        assert df.count() == 0


def test_bso_filter_compares_as_text(spark):
    summary = spark.createDataFrame([("R1", 7), ("R2", 8)], "`Unique Code` string, `BSO Code` int")
    assert [r[0] for r in reading.filter_by_bso(summary, ["7"]).collect()] == ["R1"]
    assert reading.filter_by_bso(summary, None).count() == 2
    assert [r[0] for r in reading.bso_codes(summary).collect()] == ["7", "8"]


def test_tables_from_csv_files(spark, tmp_path):
    rows = random_tables(7, False)
    for name, schema in COLUMNS.items():
        if name == "ReadEpisode":
            continue
        columns = [c.split()[0] for c in schema.split(", ")]
        own = [c.name for c in READING_SCHEMAS[name]]
        lines = [",".join(str(dict(zip(columns, r)).get(c) or "") for c in own) for r in rows[name]]
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(own), *lines]))
    header = ",".join(c.name for c in READING_SCHEMAS["ReadEpisode"])
    episodes = [f"{e},R1,2024-01-01 09:00:00,2024-01-01 09:01:30,,,," for (e,) in rows["ReadEpisode"]]
    (tmp_path / "ReadEpisode.csv").write_text("\n".join([header, *episodes]))
    (tmp_path / "Other.csv").write_text("a,b\n007,x")
    tables = reading_tables(spark, str(tmp_path))
    assert set(tables) == {*COLUMNS, "Other"} and tables["Other"].first()["a"] == "007"
    count = restated(rows)
    for row in reading.summary_table(tables).collect():
        assert row["Total Cancers Detected"] == count("detected", row["Unique Code"])
        assert row["Total Discrepant Cancers"] == count("discrepant", row["Unique Code"])
    timed = {r["reader_id"]: (r[1], r[2]) for r in reading.kpi_read_time(tables).collect()}
    assert timed["R1"] == (1.5, 40) and timed["R2"] == (0.0, 0)


def test_bucketed_tables_need_no_shuffle_by_episode(spark, tmp_path):
    rows = random_tables(11, True)
    tables, count = to_spark(spark, rows), restated(rows)
    for name in ("ReadDecision", "ReadEpisode", "CancerPresence"):
        write_bucketed(tables[name], f"b_{name}", "read_episode_id", 4, str(tmp_path / name))
        tables[name] = spark.table(f"b_{name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = reading._recalled_pairs(tables).join(reading._cancer_episodes(tables), "read_episode_id", "left_semi")
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        got = {r["Unique Code"]: r["Total Cancers Detected"] for r in reading.summary_table(tables).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("ReadDecision", "ReadEpisode", "CancerPresence"):
            spark.sql(f"DROP TABLE b_{name}")
    assert "Exchange" not in plan
    assert got == {reader: count("detected", reader) for reader, _ in rows["Reader"]}
