"""Census flattening queries.

Responses are built from the supplied tables: areas are suppliers, observations count their line
items by category, and four neighbouring suppliers share one response.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyscope.operators import census
from tallyscope.sources.tables import parquet_table

FLAGS = ["A", "N", "R"]
STATUSES = ["F", "O"]


def _supplier_counts(spark, folder, cells) -> DataFrame:
    """Per supplier one array of counts, in the order of ``cells`` (conditions on line items)."""
    lineitem = parquet_table(spark, folder, "lineitem")
    supplier = parquet_table(spark, folder, "supplier")
    counts = lineitem.groupBy("l_suppkey").agg(
        *[F.count(F.when(cell, 1)).alias(f"n{i}") for i, cell in enumerate(cells)]
    )
    values = F.array(*[F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("string") for i in range(len(cells))])
    return supplier.join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        "s_suppkey", "s_name", values.alias("counts")
    )


def _in_batches(areas: DataFrame, option, dataset, batch, dims, name_key: str) -> DataFrame:
    """Responses of four areas each (so a collected list has four entries)."""
    listed = (
        areas.withColumn("_batch", F.expr("s_suppkey div 4"))
        .groupBy("_batch")
        .agg(F.array_sort(F.collect_list(F.struct("s_suppkey", option.alias("option"), "counts"))).alias("rows"))
    )
    geography = F.struct(F.lit("supplier").alias(name_key), F.col("rows.option").alias("options"))
    others = [
        F.struct(F.lit(name).alias(name_key), F.array(*[F.struct(F.lit(str(i)).alias("id"), F.lit(v).alias("label")) for i, v in enumerate(values)]).alias("options"))
        for name, values in dims
    ]
    # dimensions differ in their options' fields, so each is written as JSON and the texts are joined
    dimensions = F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(d) for d in [geography, *others]]), F.lit("]"))
    values = F.to_json(F.flatten("rows.counts"))
    json = F.concat(F.lit('{"dimensions":'), dimensions, F.lit(',"observations":'), values, F.lit("}"))
    return listed.select(
        dataset.alias("dataset_id"), F.lit("la").alias("geo_level"), batch.alias("batch_no"), json.alias("json")
    )


def _object_option():
    return F.struct(F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))


def _flag_cells():
    return [F.col("l_returnflag") == flag for flag in FLAGS]


def _matrix_cells():
    return [
        (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status) for flag in FLAGS for status in STATUSES
    ]


def topic_responses(spark, folder, one_dataset: bool) -> DataFrame:
    """Supplier by return flag; either a data set per batch, or all batches of one data set."""
    batch = F.col("_batch").cast("bigint")
    dataset = F.lit("TS900") if one_dataset else F.format_string("TS%05d", batch)
    return _in_batches(
        _supplier_counts(spark, folder, _flag_cells()), _object_option(), dataset,
        batch if one_dataset else F.lit(1).cast("bigint"), [("returnflag", FLAGS)], "name",
    )


def matrix_responses(spark, folder, one_dataset: bool) -> DataFrame:
    """Supplier by return flag by line status."""
    batch = F.col("_batch").cast("bigint")
    dataset = F.lit("RM900") if one_dataset else F.format_string("RM%05d", batch)
    option = F.struct(F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("label"))
    return _in_batches(
        _supplier_counts(spark, folder, _matrix_cells()), option, dataset,
        batch if one_dataset else F.lit(1).cast("bigint"),
        [("returnflag", FLAGS), ("linestatus", STATUSES)], "dimension_name",
    )


def scattered_responses(spark, folder) -> DataFrame:
    """Topic responses of two levels, one of them null, with a null batch number, a failed batch and
    headers of their own in every batch."""
    topic = topic_responses(spark, folder, True)
    headers = F.concat(F.lit('{"headers":[{"code":"h'), F.col("batch_no"), F.lit('"}],'), F.expr("substring(json, 2)"))
    return topic.select(
        "dataset_id",
        F.when(F.col("batch_no") % 2 == 0, "la").alias("geo_level"),
        F.expr("nullif(batch_no, 0)").alias("batch_no"),
        F.when(F.col("batch_no") != 6, headers).alias("json"),
    )


def single_dimension_responses(spark, folder) -> DataFrame:
    """One unusable dimension: only the areas, or nothing, can name the values."""
    topic = topic_responses(spark, folder, True)
    json = F.concat(
        F.lit('{"dimensions":[{"id":"supplier","items":["all"]}],"observations":'),
        F.get_json_object("json", "$.observations"), F.lit("}"),
    )
    return topic.select("dataset_id", "geo_level", "batch_no", json.alias("json"))


def cut_responses(spark, folder) -> DataFrame:
    """Matrix responses whose last batch lacks its last two values, so the last area is incomplete."""
    matrix = matrix_responses(spark, folder, True)
    last = matrix.agg(F.max("batch_no")).scalar()
    listed = F.from_json(F.get_json_object("json", "$.observations"), "array<string>")
    json = F.concat(
        F.lit('{"dimensions":'), F.get_json_object("json", "$.dimensions"), F.lit(',"observations":'),
        F.to_json(F.slice(listed, 1, F.size(listed) - F.when(F.col("batch_no") == last, 2).otherwise(0))), F.lit("}"),
    )
    return matrix.select("dataset_id", "geo_level", "batch_no", json.alias("json"))


def areas(spark, folder) -> DataFrame:
    supplier = parquet_table(spark, folder, "supplier")
    return supplier.select(
        F.lit("la").alias("geo_level"), F.col("s_suppkey").alias("area_no"),
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("area_code"),
    )


def metadata_responses(spark, folder) -> DataFrame:
    """Topic responses that name their dimensions under ``dimension_metadata`` with text values."""
    topic = topic_responses(spark, folder, False)
    json = F.concat(
        F.lit('{"dimension_metadata":[{"name":"supplier","values":'),
        F.to_json(F.transform(F.from_json(F.get_json_object("json", "$.dimensions[0].options"), "array<struct<id:string,name:string>>"), lambda o: o["name"])),
        F.lit('},{"name":"returnflag","values":["A","N","R"]}],"observations":'),
        F.get_json_object("json", "$.observations"), F.lit("}"),
    )
    return topic.select("dataset_id", "geo_level", "batch_no", json.alias("json"))


def ready_columns(spark, folder) -> DataFrame:
    """Nations and their regions as ready columns, one response per customer segment and nation.

    The code lists are one short, so the last code is blank.
    """
    customer = parquet_table(spark, folder, "customer")
    nation = parquet_table(spark, folder, "nation")
    cells = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_nationkey", "n_name", "c_mktsegment")
        .agg(F.count(F.lit(1)).cast("string").alias("n"))
    )
    rows = cells.groupBy("n_nationkey", "n_name").agg(
        F.array_sort(F.collect_list(F.struct("c_mktsegment", "n"))).alias("rows")
    )
    size = F.size("rows")
    doc = F.struct(
        F.transform("rows", lambda r: F.col("n_name")).alias("ctry"),
        F.transform(F.slice("rows", 1, size - 1), lambda r: F.col("n_nationkey").cast("string")).alias("ctry_code"),
        F.col("rows.c_mktsegment").alias("religion_tb"),
        F.transform(F.slice("rows", 1, size - 1), lambda r: F.substring(r["c_mktsegment"], 1, 3)).alias("religion_tb_code"),
        F.col("rows.n").alias("observation"),
    )
    return rows.select(
        F.format_string("TS%05d", "n_nationkey").alias("dataset_id"), F.lit("ctry").alias("geo_level"),
        F.lit(1).cast("bigint").alias("batch_no"), F.to_json(doc).alias("json"),
    )


def _without_dimensions(responses: DataFrame) -> DataFrame:
    json = F.concat(F.lit('{"observations":'), F.get_json_object("json", "$.observations"), F.lit("}"))
    return responses.withColumn("json", json)


TOPIC = ["supplier", "returnflag"]
MATRIX = ["supplier", "returnflag", "linestatus"]


def _tidy(responses, dims, area_table=None):
    return census.wide(census.flatten(responses, area_table), dims)


def _no_dimensions(spark, folder):
    both = _without_dimensions(topic_responses(spark, folder, True)).unionByName(
        _without_dimensions(matrix_responses(spark, folder, True))
    )
    return census.flatten(both, areas(spark, folder)).select("dataset_id", "pos", "observation")


def _area_values(spark, folder):
    flat = census.flatten(single_dimension_responses(spark, folder), areas(spark, folder))
    return census.wide(flat, ["la"]).join(flat.select("pos", "value_index"), "pos")


def _row_values(spark, folder):
    flat = census.flatten(single_dimension_responses(spark, folder))
    return flat.select(F.col("value_index").alias("row_index"), "observation")


def _option_texts(spark, folder):
    rows = census.dimensions_table(topic_responses(spark, folder, False)).unionByName(
        census.dimensions_table(metadata_responses(spark, folder))
    )
    return rows.drop("kind", "batch_no", "geo_level")


QUERIES = {
    "census_observations": lambda s, d: census.observations(topic_responses(s, d, True)),
    "census_combined_batches": lambda s, d: census.combine_batches(topic_responses(s, d, True)),
    "census_scattered_batches": lambda s, d: census.combine_batches(scattered_responses(s, d)),
    "census_scattered_headers": lambda s, d: census.combined_headers(scattered_responses(s, d)),
    "census_combined_headers": lambda s, d: census.combined_headers(matrix_responses(s, d, True)),
    "census_topic_dimensions": lambda s, d: census.dimensions_table(topic_responses(s, d, False)),
    "census_matrix_dimensions": lambda s, d: census.dimensions_table(matrix_responses(s, d, False)),
    "census_option_texts": _option_texts,
    "census_topic_cube": lambda s, d: _tidy(topic_responses(s, d, False), TOPIC),
    "census_matrix_cube": lambda s, d: _tidy(matrix_responses(s, d, False), MATRIX),
    "census_metadata_cube": lambda s, d: _tidy(metadata_responses(s, d), TOPIC),
    "census_topic_overflow": lambda s, d: _tidy(topic_responses(s, d, True), TOPIC, areas(s, d)),
    "census_topic_overflow_unknown_areas": lambda s, d: _tidy(topic_responses(s, d, True), TOPIC),
    "census_matrix_overflow": lambda s, d: _tidy(matrix_responses(s, d, True), MATRIX, areas(s, d)),
    "census_matrix_overflow_incomplete": lambda s, d: _tidy(cut_responses(s, d), MATRIX, areas(s, d).filter("area_no % 3 <> 1")),
    "census_area_values": _area_values,
    "census_row_values": _row_values,
    "census_ready_columns": lambda s, d: census.zip_columns(ready_columns(s, d)),
    "census_no_dimensions": _no_dimensions,
}

_BASE = """WITH topic AS (
  SELECT s_suppkey, s_name, f.i AS i, f.flag AS flag, count(l_suppkey)::varchar AS n
  FROM supplier CROSS JOIN (VALUES (0, 'A'), (1, 'N'), (2, 'R')) AS f(i, flag)
  LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = flag GROUP BY ALL),
matrix AS (
  SELECT s_suppkey, s_name, f.i AS i, f.flag AS flag, t.j AS j, t.status AS status, count(l_suppkey)::varchar AS n
  FROM supplier CROSS JOIN (VALUES (0, 'A'), (1, 'N'), (2, 'R')) AS f(i, flag) CROSS JOIN (VALUES (0, 'F'), (1, 'O')) AS t(j, status)
  LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = flag AND l_linestatus = status GROUP BY ALL)
"""
_AREA = "'Area ' || (s_suppkey + 1) AS supplier"
_TOPIC_BATCH = "printf('TS%05d', s_suppkey // 4) AS dataset_id, 'la' AS geo_level, s_suppkey % 4 * 3 + i AS pos"
_TOPIC_ALL = "'TS900' AS dataset_id, 'la' AS geo_level, s_suppkey * 3 + i AS pos"
_MATRIX_ALL = "'RM900' AS dataset_id, 'la' AS geo_level, s_suppkey * 6 + i * 2 + j AS pos"


def _dimension_rows(prefix: str, dims: str, codes: bool = True) -> str:
    code, other = ("'S' || s_suppkey", "i::varchar") if codes else ("s_name", "v")
    return f"""SELECT printf('{prefix}%05d', s_suppkey // 4) AS dataset_id, 0::bigint AS dim_no, 'supplier' AS dim,
      s_suppkey % 4 AS option_no, s_name AS label, {code} AS code FROM supplier
      UNION ALL SELECT printf('{prefix}%05d', b), k::bigint, dim, i::bigint, v, {other}
      FROM (SELECT DISTINCT s_suppkey // 4 AS b FROM supplier) CROSS JOIN (VALUES {dims}) AS d(k, dim, i, v)"""


_FLAG_ROWS = "(1, 'returnflag', 0, 'A'), (1, 'returnflag', 1, 'N'), (1, 'returnflag', 2, 'R')"
_STATUS_ROWS = "(2, 'linestatus', 0, 'F'), (2, 'linestatus', 1, 'O')"

ORACLE = {
    "census_observations": _BASE + """SELECT 'TS900' AS dataset_id, 'la' AS geo_level, s_suppkey // 4 AS batch_no,
      s_suppkey % 4 * 3 + i AS pos, n AS observation FROM topic""",
    "census_combined_batches": _BASE + f"SELECT {_TOPIC_ALL}, n AS observation FROM topic",
    "census_scattered_batches": _BASE + """SELECT 'TS900' AS dataset_id, CASE WHEN b % 2 = 0 THEN 'la' END AS geo_level,
      row_number() OVER (PARTITION BY b % 2 ORDER BY s_suppkey, i) - 1 AS pos, n AS observation
      FROM (SELECT *, s_suppkey // 4 AS b FROM topic) WHERE b <> 6""",
    "census_scattered_headers": """SELECT 'TS900' AS dataset_id, CASE WHEN b % 2 = 0 THEN 'la' END AS geo_level, count(*) * 3 AS n_total,
      ['supplier', 'returnflag'] AS dims, '[{"code":"h' || min(b) || '"}]' AS headers
      FROM (SELECT s_suppkey // 4 AS b FROM supplier) WHERE b <> 6 GROUP BY b % 2""",
    "census_combined_headers": """SELECT 'RM900' AS dataset_id, 'la' AS geo_level, count(*) * 6 AS n_total,
      ['supplier', 'returnflag', 'linestatus'] AS dims, NULL::varchar AS headers FROM supplier""",
    "census_topic_dimensions": f"SELECT 'la' AS geo_level, 1::bigint AS batch_no, 'TS' AS kind, * FROM ({_dimension_rows('TS', _FLAG_ROWS)})",
    "census_matrix_dimensions": f"SELECT 'la' AS geo_level, 1::bigint AS batch_no, 'RM' AS kind, * FROM ({_dimension_rows('RM', _FLAG_ROWS + ', ' + _STATUS_ROWS)})",
    "census_option_texts": f"({_dimension_rows('TS', _FLAG_ROWS)}) UNION ALL ({_dimension_rows('TS', _FLAG_ROWS, False)})",
    "census_topic_cube": _BASE + f"""SELECT {_TOPIC_BATCH}, s_name AS supplier, 'S' || s_suppkey AS supplier_code,
      flag AS returnflag, i::varchar AS returnflag_code, n AS observation FROM topic""",
    "census_matrix_cube": _BASE + """SELECT printf('RM%05d', s_suppkey // 4) AS dataset_id, 'la' AS geo_level,
      s_suppkey % 4 * 6 + i * 2 + j AS pos, s_name AS supplier, 'S' || s_suppkey AS supplier_code, flag AS returnflag,
      i::varchar AS returnflag_code, status AS linestatus, j::varchar AS linestatus_code, n AS observation FROM matrix""",
    "census_metadata_cube": _BASE + f"""SELECT {_TOPIC_BATCH}, s_name AS supplier, s_name AS supplier_code,
      flag AS returnflag, flag AS returnflag_code, n AS observation FROM topic""",
    "census_topic_overflow": _BASE + f"""SELECT {_TOPIC_ALL}, {_AREA}, 'S' || s_suppkey AS supplier_code,
      flag AS returnflag, i::varchar AS returnflag_code, n AS observation FROM topic""",
    "census_topic_overflow_unknown_areas": _BASE + f"""SELECT {_TOPIC_ALL}, {_AREA}, printf('AREA%06d', s_suppkey + 1) AS supplier_code,
      flag AS returnflag, i::varchar AS returnflag_code, n AS observation FROM topic""",
    "census_matrix_overflow": _BASE + f"""SELECT {_MATRIX_ALL}, {_AREA}, 'S' || s_suppkey AS supplier_code, flag AS returnflag,
      i::varchar AS returnflag_code, status AS linestatus, j::varchar AS linestatus_code, n AS observation FROM matrix""",
    "census_matrix_overflow_incomplete": _BASE + f"""SELECT {_MATRIX_ALL}, {_AREA},
      CASE WHEN s_suppkey % 3 = 1 THEN printf('AREA%06d', s_suppkey + 1) ELSE 'S' || s_suppkey END AS supplier_code, flag AS returnflag,
      i::varchar AS returnflag_code, status AS linestatus, j::varchar AS linestatus_code, n AS observation FROM matrix
      WHERE s_suppkey < (SELECT max(s_suppkey) FROM supplier)""",
    "census_area_values": _BASE + f"""SELECT {_TOPIC_ALL}, 'Area ' || (s_suppkey + 1) AS la, 'S' || s_suppkey AS la_code,
      i::bigint AS value_index, n AS observation FROM topic""",
    "census_row_values": _BASE + "SELECT s_suppkey * 3 + i AS row_index, n AS observation FROM topic",
    "census_ready_columns": """WITH cells AS (SELECT n_nationkey, n_name, c_mktsegment, count(*)::varchar AS n
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_mktsegment) - 1 AS pos,
      count(*) OVER (PARTITION BY n_nationkey) AS size FROM cells)
      SELECT printf('TS%05d', n_nationkey) AS dataset_id, 'ctry' AS geo_level, pos, n_name AS ctry,
      CASE WHEN pos < size - 1 THEN n_nationkey::varchar ELSE '' END AS ctry_code, c_mktsegment AS religion_tb,
      CASE WHEN pos < size - 1 THEN left(c_mktsegment, 3) ELSE '' END AS religion_tb_code, n AS observation FROM numbered""",
    "census_no_dimensions": _BASE + "SELECT 'TS900' AS dataset_id, s_suppkey * 3 + i AS pos, n AS observation FROM topic",
}
