"""Uptake and round length, with ties, nulls and people with very many rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import screening

SCHEMA = "nhs_number bigint, episode_id bigint, date_of_foa string, date_of_as string, bso_organisation_code string"


def test_uptake_is_tri_state(spark):
    rows = [
        (1, 1, "2024-01-01", "2024-07-02", "A"),  # 183 days
        (1, 2, "2024-01-01", "2024-07-03", "A"),  # 184 days
        (1, 3, "2024-01-01", None, "A"),
        (1, 4, "not a date", "2024-01-01", "A"),
        (1, 5, "2024-01-01", "2023-12-01", "A"),  # attended before the offer
    ]
    flagged = screening.add_uptake_columns(spark.createDataFrame(rows, SCHEMA))
    got = {r["episode_id"]: r["uptake_six_mth_threshold"] for r in flagged.collect()}
    assert got == {1: True, 2: False, 3: False, 4: None, 5: True}


def restated(rows):
    """Prior dates per episode id."""
    out = {}
    parse = lambda t: dt.datetime.fromisoformat(t) if t else None
    for person in {r[0] for r in rows}:
        mine = sorted(
            (r for r in rows if r[0] == person),
            key=lambda r: (r[2] is not None, r[2] or "", r[1]),
            reverse=True,
        )
        for row, older in zip(mine, [*mine[1:], None]):
            if person is None or older is None:
                out[row[1]] = (None, None, None)
                continue
            prior = parse(older[3]) or parse(older[2])
            offer = parse(row[2])
            flag = offer - prior <= dt.timedelta(days=1095) if offer and prior else None
            out[row[1]] = (parse(older[3]), parse(older[2]), flag)
    return out


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_round_length_for_ordinary_and_busy_people(spark, partitions):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        person = rng.choice([1, 1, 1, 2, 3, 4, None])
        offer = rng.choice([None, f"20{rng.randint(10, 24)}-0{rng.randint(1, 9)}-15", "2020-05-05"])
        attended = rng.choice([None, f"20{rng.randint(10, 24)}-0{rng.randint(1, 9)}-20"])
        rows.append((person, i, offer, attended, "A"))
    parsed = screening.add_uptake_columns(spark.createDataFrame(rows, SCHEMA))
    with_partitions(spark, partitions)
    out = screening.add_round_length_columns(parsed)
    with_partitions(spark, 4)
    got = {
        r["episode_id"]: (r["prior_date_of_as"], r["prior_date_of_foa"], r["round_length_three_yr_threshold"])
        for r in out.collect()
    }
    assert got == restated(rows)


def with_partitions(spark, n):
    spark.conf.set("spark.sql.shuffle.partitions", n)


def test_dates_in_other_formats(spark):
    rows = [(1, 1, "31/03/2024", "2024-04-01", "A"), (2, 2, "2024-03-30", "02/04/2025", "A"), (3, 3, "no date", None, "A"), (4, 4, "03-May-2024", "31/02/2024", "A")]
    df = spark.createDataFrame(rows, SCHEMA)
    formats = ["dd/MM/yyyy", "dd-MMM-yyyy"]
    flagged = {r["episode_id"]: (str(r["date_of_foa"])[:10], r["uptake_six_mth_threshold"]) for r in screening.add_uptake_columns(df, formats).collect()}
    assert flagged == {1: ("2024-03-31", True), 2: ("2024-03-30", False), 3: ("None", None), 4: ("2024-05-03", False)}
    assert screening.unparsed_dates(df, formats).first().asDict() == {"date_of_as_unparsed": 1, "date_of_foa_unparsed": 1}
    assert screening.unparsed_dates(df).first().asDict() == {"date_of_as_unparsed": 2, "date_of_foa_unparsed": 3}


def test_window_is_inclusive_and_defaults_to_a_year(spark):
    rows = [
        (1, 1, "2024-03-31", "2024-04-01", "A"),
        (2, 2, "2025-03-31", None, "A"),
        (3, 3, "2024-03-30", "2024-04-01", "A"),
        (4, 4, "2025-01-01", "2025-01-02", None),
        (5, 5, "2025-04-01", "2025-04-02", "B"),
    ]
    flagged = screening.add_uptake_columns(spark.createDataFrame(rows, SCHEMA))
    got = screening.calculate_uptake(flagged, "bso_organisation_code", "2025-03-31").collect()
    assert [tuple(r) for r in got] == [("A", 50.0)]
    with pytest.raises(ValueError):
        screening.calculate_uptake(flagged, "bso_organisation_code", "1990-03-31", strict=True)
