import pytest
from pyspark.sql import functions as F

from tallyscope.functions.draws import bernoulli, choose, uniform_date, uniform_int, unit
from tallyscope.operators import synthetic as syn


@pytest.mark.parametrize("fast", [False, True])
def test_draws_follow_their_distributions(spark, fast):
    key = F.col("id")
    row = spark.range(40000).agg(
        F.avg(unit(key, "u", 1, fast)), F.min(unit(key, "u", 1, fast)), F.max(unit(key, "u", 1, fast)),
        F.avg(bernoulli(key, "b", 0.2, 1, fast).cast("int")),
        F.min(uniform_int(key, "i", -2, 4, 1, fast)), F.max(uniform_int(key, "i", -2, 4, 1, fast)),
        F.avg((choose(key, "c", ["x", "y", "z"], 1, [0.1, 0.2, 0.7], fast) == "y").cast("int")),
        F.avg((choose(key, "e", ["x", "y", "z", "w"], 1, fast=fast) == "w").cast("int")),
        F.countDistinct(uniform_date(key, "d", "2024-04-01", "2025-03-31", 1, fast)),
    ).first()
    assert abs(row[0] - 0.5) < 0.01 and 0 <= row[1] < 0.001 and 0.999 < row[2] < 1
    assert abs(row[3] - 0.2) < 0.01 and (row[4], row[5]) == (-2, 4)
    assert abs(row[6] - 0.2) < 0.01 and abs(row[7] - 0.25) < 0.01 and row[8] == 365


def test_assignment_within_groups_is_even_and_null_without_a_group(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("none").alias("g"))
    dim = spark.createDataFrame([("a", "a1"), ("a", "a2"), ("b", "b1")], "g string, code string")
    counts = {(r["g"], r["code"]): r["n"] for r in syn.assign_from(df, dim, F.col("id"), "x", 1, "g").groupBy("g", "code").agg(F.count("*").alias("n")).collect()}
    assert counts[("b", "b1")] == 2000 and counts[("none", None)] == 2000
    assert abs(counts[("a", "a1")] - 1000) < 120 and counts[("a", "a1")] + counts[("a", "a2")] == 2000


def test_codes_are_drawn_evenly_without_a_join(spark, monkeypatch):
    codes = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "code string")
    df = spark.range(4000).withColumn("x", syn.drawn_code(codes, F.col("id"), "x", 1))
    counts = {r["x"]: r["count"] for r in df.groupBy("x").count().collect()}
    assert set(counts) == {"a", "b"} and abs(counts["a"] - 2667) < 150
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    none = spark.range(3).withColumn("x", syn.drawn_code(codes.limit(0), F.col("id"), "x", 1))
    assert {r["x"] for r in none.collect()} == {None}
    monkeypatch.setattr(syn, "MOST_CODES", 1)
    with pytest.raises(Exception, match="more than 1 codes"):
        spark.range(3).withColumn("x", syn.drawn_code(codes, F.col("id"), "x", 1)).collect()


@pytest.mark.parametrize("size", [1, 2, 255, 256, 257, 1000, 5000])
def test_slots_give_every_row_its_number(spark, size):
    """The two steps draw the same rows as one product with the size of the list."""
    dim = spark.range(size).select(F.format_string("c%06d", "id").alias("code"), F.col("id").alias("no"))
    df = spark.range(3000).select("id", unit(F.col("id"), "x", 1).alias("u"))
    rows = syn.assign_from(df, dim, F.col("id"), "x", 1).collect()
    assert len(rows) == 3000 and all(r["no"] == int(r["u"] * size) for r in rows)


def test_slots_at_their_edges(spark, monkeypatch):
    """Draws on and just below every border between rows and slots."""
    borders = [k / 256 for k in range(256)] + [k / 7 for k in range(7)] + [0.1, 1 / 3]
    draws = sorted({max(0.0, x + e) for x in borders for e in (0.0, -1e-16, 1e-16, -2**-32, -2**-52)})
    monkeypatch.setattr(syn, "unit", lambda key, name, seed: key)
    for size in (7, 300):
        dim = spark.range(size).select(F.col("id").alias("no"))
        rows = syn.assign_from(spark.createDataFrame([(x,) for x in draws], "u double"), dim, F.col("u"), "x", 1).collect()
        assert [(r["u"], r["no"]) for r in rows if r["no"] != int(r["u"] * size)] == []


def test_long_code_lists(spark):
    codes = spark.range(200_000).select(F.format_string("c%07d", "id").alias("code"))
    df = spark.range(5000).select(F.col("id").alias("episode_id"))
    got = syn.with_code(df, codes, F.col("episode_id"), "x", 1, "code").withColumn("u", unit(F.col("episode_id"), "x", 1))
    assert all(int(r["code"][1:]) == int(r["u"] * 200_000) for r in got.collect())
    mapped = syn.episode_type(df, codes.union(codes.limit(0)), 1).groupBy((F.col("episode_type") == "R").alias("routine")).count()
    assert {r["routine"]: r["count"] for r in mapped.collect()}[False] > 800


def test_offers_go_back_three_times_only(spark):
    made = spark.range(500).select((F.col("id") / 5).cast("bigint").alias("nhs_number"), F.col("id").alias("episode_id"), F.lit(True).alias("appointment_made"))
    rows = syn.date_of_foa(made, 1).withColumn("turn", F.col("episode_id") % 5)
    assert rows.filter("turn >= 3 AND date_of_foa IS NOT NULL").count() == 0
    first = rows.filter("turn = 0").select("nhs_number", F.col("date_of_foa").alias("a"))
    second = rows.filter("turn = 1").select("nhs_number", F.col("date_of_foa").alias("b"))
    gaps = first.join(second, "nhs_number").filter("b NOT IN (add_months(a, -35), add_months(a, -37))")
    assert gaps.count() == 0


@pytest.mark.parametrize("fast", [False, True])
def test_wide_ranges_are_reached_throughout(spark, fast):
    """A range of 2^40 values: odd and even ones, both halves, and no two draws alike."""
    drawn = [r[0] for r in spark.range(4000).select(uniform_int(F.col("id"), "x", 1, 2**40, 1, fast)).collect()]
    assert 1 <= min(drawn) and max(drawn) <= 2**40 and len(set(drawn)) > 3990
    assert 0.45 < sum(x % 2 for x in drawn) / 4000 < 0.55 and 0.45 < sum(x > 2**39 for x in drawn) / 4000 < 0.55


def test_latest_episode_takes_the_first_on_a_tie(spark):
    rows = [(1, 1, "2024-01-01"), (1, 2, "2024-02-01"), (1, 3, "2024-02-01"), (2, 4, "2020-01-01"), (None, 5, "2030-01-01")]
    df = spark.createDataFrame(rows, "nhs_number bigint, episode_id bigint, change_db_date_time string")
    assert sorted(r[0] for r in syn.latest_episodes(df).collect()) == [2, 4]


def test_month_shifts_clamp_to_the_month_end(spark):
    df = spark.sql("SELECT date'2024-02-29' AS date_of_as, date'2024-01-01' AS episode_date, 'RADIOTHERAPY_LOWER' AS higher_risk_referral_reason_code")
    row = syn.date_irradiated(syn.next_test_due_date(df)).first()
    assert (str(row["next_test_due_date"]), str(row["date_irradiated"])) == ("2027-02-28", "2024-03-29")
    change = spark.sql("SELECT timestamp_ntz'2024-06-30 13:14:15' AS change_db_date_time")
    assert str(syn.end_code_last_updated(change).first()["end_code_last_updated"]) == "2025-02-28 13:14:15"
