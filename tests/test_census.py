"""Golden cubes and every way of reading more observations than named cells."""

import json

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import census
from tallyscope.plans import census_queries

SCHEMA = "dataset_id string, geo_level string, batch_no bigint, json string"


def responses(spark, *rows):
    return spark.createDataFrame([(d, g, b, j if j is None else json.dumps(j)) for d, g, b, j in rows], SCHEMA)


def level(spark, *codes, geo="la"):
    return spark.createDataFrame(
        [(geo, i, code) for i, code in enumerate(codes)], "geo_level string, area_no bigint, area_code string"
    )


def tidy(df, dims):
    rows = census.wide(df, dims).orderBy("pos").collect()
    return [tuple(r)[3:] for r in rows]


def test_topic_cube(spark):
    df = responses(
        spark,
        ("TS030", "ctry", 1, {
            "dimensions": [
                {"name": "place", "options": [{"id": "P7", "name": "Northshire"}]},
                {"name": "heating", "options": [{"id": "g", "name": "Gas"}, {"id": "w", "name": "Wood"}]},
            ],
            "observations": ["31", "8"],
        }),
    )
    flat = census.flatten(df)
    assert census.cell_names(df) == ["heating", "place"]
    assert census.wide(flat, ["place", "heating"]).columns[3:] == ["place", "place_code", "heating", "heating_code", "observation"]
    assert tidy(flat, ["place", "heating"]) == [("Northshire", "P7", "Gas", "g", "31"), ("Northshire", "P7", "Wood", "w", "8")]


@pytest.mark.parametrize("make", [
    lambda s, d: census_queries.topic_responses(s, d, True), lambda s, d: census_queries.matrix_responses(s, d, False),
    census_queries.scattered_responses, census_queries.single_dimension_responses, census_queries.cut_responses,
])
@pytest.mark.parametrize("with_areas", [False, True])
def test_cell_names_are_those_of_the_rows(spark, folder, make, with_areas):
    df, areas = make(spark, folder), census_queries.areas(spark, folder) if with_areas else None
    met = census.flatten(df, areas).select(F.explode("cells.dim").alias("dim")).distinct().orderBy("dim")
    assert census.cell_names(df, areas) == [r["dim"] for r in met.collect()]


def test_matrix_cube_runs_the_last_dimension_fastest(spark):
    def dim(name, *options):
        return {"dimension_name": name, "options": [{"id": i, "label": label} for i, label in options]}

    dims = [dim("place", ("P7", "Northshire")), dim("rooms", ("1", "one"), ("2", "two or more")), dim("let", ("y", "yes"), ("n", "no"), ("u", "unknown"))]
    df = responses(spark, ("RM001", "ctry", 1, {"dimensions": dims, "observations": [10, 11, 12, 20, 21, 22]}))
    rows = tidy(census.flatten(df), ["place", "rooms", "let"])
    assert [(r[2], r[4], r[6]) for r in rows] == [
        ("one", "yes", "10"), ("one", "no", "11"), ("one", "unknown", "12"),
        ("two or more", "yes", "20"), ("two or more", "no", "21"), ("two or more", "unknown", "22"),
    ]


def test_null_levels_and_batches_are_kept(spark):
    dims = [{"name": "g", "options": ["x"]}, {"name": "c", "options": ["p", "q", "r"]}]
    df = responses(
        spark,
        ("TS1", None, None, {"dimensions": dims, "observations": [0]}),
        ("TS1", None, 1, {"observations": [1, 2]}),
        ("TS2", "la", None, {"dimensions": dims, "observations": [5]}),
    )
    assert sorted((r["dataset_id"], r["pos"], r["observation"]) for r in census.combine_batches(df).collect()) == [
        ("TS1", 0, "0"), ("TS1", 1, "1"), ("TS1", 2, "2"), ("TS2", 0, "5"),
    ]
    rows = census.wide(census.flatten(df), ["g", "c"]).collect()
    assert sorted((r["dataset_id"], r["c"], r["observation"]) for r in rows) == [("TS1", "p", "0"), ("TS1", "q", "1"), ("TS1", "r", "2"), ("TS2", "p", "5")]


def test_a_repeated_batch_is_an_error(spark):
    dims = [{"name": "g", "options": ["x"]}]
    df = responses(spark, *[("TS1", "la", 1, {"dimensions": dims, "observations": [i]}) for i in range(2)])
    for result in (census.combine_batches, census.flatten):
        with pytest.raises(Exception, match="repeated batch: TS1 / la / 1"):
            result(df).collect()


def test_topic_overflow_drops_the_incomplete_area(spark):
    dims = [{"id": "g", "items": ["x", "y"]}, {"name": "c", "values": [{"code": "1", "value": "p"}, "q"]}]
    df = responses(
        spark,
        ("TS1", "la", 1, {"dimensions": dims, "observations": [1, 2, 3, 4]}),
        ("TS1", "la", 2, None),
        ("TS1", "la", 3, {"dimensions": [{"name": "other", "options": ["z"]}], "observations": [5, 6, 7]}),
    )
    assert tidy(census.flatten(df, level(spark, "L1", "L2")), ["g", "c"]) == [
        ("Area 1", "L1", "p", "1", "1"), ("Area 1", "L1", "q", "q", "2"),
        ("Area 2", "L2", "p", "1", "3"), ("Area 2", "L2", "q", "q", "4"),
        ("Area 3", "AREA000003", "p", "1", "5"), ("Area 3", "AREA000003", "q", "q", "6"),
    ]


def test_areas_may_be_cut_by_batches(spark):
    dims = [{"name": "g", "options": ["x"]}, {"name": "c", "options": ["p", "q", "r"]}]
    df = responses(
        spark,
        ("TS1", "la", 1, {"dimensions": dims, "observations": [0, 1]}),
        ("TS1", "la", 2, {"observations": [2, 3, 4, 5, 6]}),
        ("TS1", "la", 3, {"observations": [7, 8]}),
    )
    rows = tidy(census.flatten(df, level(spark, "L1", "L2", "L3")), ["g", "c"])
    assert [r[4] for r in rows] == [str(i) for i in range(9)]
    assert [r[1] for r in rows] == ["L1"] * 3 + ["L2"] * 3 + ["L3"] * 3
    assert [r[2] for r in rows] == ["p", "q", "r"] * 3


def test_matrix_overflow_over_several_categories(spark):
    dims = [
        {"dimension_name": "g", "options": [{"id": "E", "label": "England"}]},
        {"dimension_name": "age", "options": [{"id": "1", "name": "young"}, {"code": "2"}]},
        {"dimension_name": "blank"},
        {"dimension_name": "sex", "options": ["M", "F"]},
    ]
    df = responses(spark, ("RM1", "la", 1, {"dimensions": dims, "observations": list(range(9))}))
    assert tidy(census.flatten(df, level(spark, "L1")), ["g", "age", "blank", "sex"]) == [
        ("Area 1", "L1", "young", "1", "", "", "M", "M", "0"), ("Area 1", "L1", "young", "1", "", "", "F", "F", "1"),
        ("Area 1", "L1", "", "2", "", "", "M", "M", "2"), ("Area 1", "L1", "", "2", "", "", "F", "F", "3"),
        ("Area 2", "AREA000002", "young", "1", "", "", "M", "M", "4"), ("Area 2", "AREA000002", "young", "1", "", "", "F", "F", "5"),
        ("Area 2", "AREA000002", "", "2", "", "", "M", "M", "6"), ("Area 2", "AREA000002", "", "2", "", "", "F", "F", "7"),
    ]


def test_matrix_cube_knows_only_label_and_id(spark):
    dims = [{"dimension_name": "age", "options": [{"id": "1", "name": "young"}, {"code": "2", "label": "old"}]}]
    df = responses(spark, ("RM1", "la", 1, {"dimensions": dims, "observations": [5, 6]}))
    assert tidy(census.flatten(df), ["age"]) == [("", "1", "5"), ("old", "", "6")]


def test_dimension_without_options_counts_as_one_blank(spark):
    dims = [{"name": "g"}, {"name": "c", "options": ["p", "q"]}]
    df = responses(spark, ("TS1", "la", 1, {"dimensions": dims, "observations": [1, 2]}))
    assert tidy(census.flatten(df), ["g", "c"]) == [("", "", "p", "p", "1"), ("", "", "q", "q", "2")]


def test_values_by_area_and_bare_rows(spark):
    one = {"dimensions": [{"name": "g", "options": ["x"]}], "observations": [1, 2, 3, 4, 5]}
    df = responses(spark, ("TS1", "la", 1, one), ("TS2", "oa", 1, one))
    flat = census.flatten(df, level(spark, "L1", "L2"))
    by_area = census.wide(flat.filter("dataset_id = 'TS1'"), ["la"]).orderBy("pos").collect()
    assert [tuple(r)[2:] for r in by_area] == [
        (0, "Area 1", "L1", "1"), (1, "Area 1", "L1", "2"), (2, "Area 2", "L2", "3"), (3, "Area 2", "L2", "4"),
    ]
    rows = flat.filter("dataset_id = 'TS2'").orderBy("pos").collect()
    assert [(r["shape"], r["value_index"], r["observation"]) for r in rows] == [
        ("rows", i, str(i + 1)) for i in range(5)
    ]


def test_more_areas_than_values_give_nothing(spark):
    one = {"dimensions": [{"name": "g", "options": ["x"]}], "observations": [1, 2]}
    flat = census.flatten(responses(spark, ("TS1", "la", 1, one)), level(spark, "L1", "L2", "L3"))
    assert flat.count() == 0


def test_key_presence_wins_even_when_null(spark):
    dims = [{"dimension_name": None, "name": "n", "options": ["x"]}, {"name": "c", "options": None, "items": ["p"]}]
    df = responses(spark, ("TS1", "la", 1, {"dimensions": dims, "observations": [7]}))
    assert tidy(census.flatten(df), ["c"]) == [("", "", "7")]


def test_no_dimensions_and_no_observations(spark):
    df = responses(
        spark, ("TS1", "la", 1, {"observations": [1]}), ("RM1", "la", 1, {"observations": [1]}),
        ("TS2", "la", 1, {"observations": []}), ("TS3", "la", 1, None),
    )
    assert [(r["dataset_id"], r["observation"]) for r in census.flatten(df).collect()] == [("TS1", "1")]
    assert census.observations(df).count() == 2


def test_headers_come_from_the_first_batch_that_has_them(spark):
    df = responses(
        spark,
        ("TS1", "la", 1, {"observations": [1]}),
        ("TS1", "la", 2, {"dimensions": [{"name": "g", "options": ["x"]}], "headers": [{"code": "a"}], "observations": [2]}),
        ("TS1", "la", 3, {"headers": [{"code": "b"}], "observations": [3]}),
    )
    row = census.combined_headers(df).first()
    assert (row["n_total"], row["dims"], row["headers"]) == (3, ["g"], '[{"code":"a"}]')


def test_ready_columns_zip_to_the_shortest(spark):
    df = responses(
        spark,
        ("TS1", "ctry", 1, {"ctry": ["E", "W", "S"], "ctry_code": ["1"], "religion_tb": ["a", "b"], "observations": [1, 2, 3]}),
        ("TS2", "ctry", 1, {"ctry": ["E"]}),
    )
    assert [tuple(r)[3:] for r in census.zip_columns(df).collect()] == [
        ("E", "1", "a", "", "1"), ("W", "", "b", "", "2"),
    ]


@pytest.mark.parametrize("dataset, kind", [("TS030", "TS"), ("RM097", "RM"), ("cpih01", "OTHER"), ("ts1", "OTHER")])
def test_dataset_type(spark, dataset, kind):
    df = spark.createDataFrame([(dataset,)], "id string")
    assert df.select(census.dataset_type(df["id"])).first()[0] == kind
