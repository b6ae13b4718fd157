"""Catalog and request queries.

Data sets are the parts, a hundred to a page; links come from line items and orders; areas are the
customers, with their nation's level; requests and outcomes come from customers and orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.operators import catalog as cat, requests as req
from tallyscope.session import fresh_path
from tallyscope.sources.tables import parquet_table

BASE = "https://api.example.org"
_PREFIX = {"ECONOMY": "TS", "STANDARD": "RM", "PROMO": "ts", "MEDIUM": "TS", "LARGE": "RM"}


def _part_id():
    prefix = F
    for kind, code in _PREFIX.items():
        prefix = prefix.when(F.col("p_type") == kind, code)
    return F.concat(prefix.otherwise("cpih"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))


def pages(spark, folder):
    """Catalog pages; a tenth of the items lack a title and a tenth a description."""
    part = parquet_table(spark, folder, "part")
    item = F.struct(
        "p_partkey",
        _part_id().alias("id"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_name")).alias("title"),
        F.when(F.col("p_size") % 10 != 1, F.repeat(F.concat("p_brand", F.lit(" ")), F.col("p_size"))).alias("description"),
    )
    grouped = part.groupBy(F.expr("p_partkey div 100").alias("page_no")).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    items = F.transform("_items", lambda i: F.struct(i["id"].alias("id"), i["title"].alias("title"), i["description"].alias("description")))
    return grouped.select("page_no", F.to_json(F.struct(items.alias("items"), F.size("_items").alias("total_count"))).alias("json"))


def links(spark, folder):
    lineitem = parquet_table(spark, folder, "lineitem")
    prefix = F.when(F.col("l_linestatus") == "O", "TS").when(F.col("l_returnflag") == "R", "cpih").otherwise("RM")
    dataset = F.concat(prefix, F.lpad(F.col("l_partkey").cast("string"), 6, "0"))
    path = F.when(F.col("l_returnflag") == "N", "/editions/2021/versions/1").otherwise("")
    return lineitem.select(
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit(f"{BASE}/code-lists/"), dataset))
        .otherwise(F.concat(F.lit(f"{BASE}/datasets/"), dataset, path))
        .alias("href")
    )


def observation_links(spark, folder):
    orders = parquet_table(spark, folder, "orders")
    number = F.lpad((F.col("o_custkey") * 2).cast("string"), 6, "0")
    return orders.select(F.concat(F.lit("/datasets/TS"), number, F.lit("/editions/2021")).alias("href"))


def metadata(spark, folder):
    part = parquet_table(spark, folder, "part")
    doc = F.to_json(
        F.struct(
            F.when(F.col("p_retailprice") > 950, F.col("p_name")).alias("title"),
            F.when(F.col("p_size") > 10, F.col("p_brand")).alias("description"),
        )
    )
    return part.filter(F.col("p_size") > 5).select(
        F.concat(F.lit("TS"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("dataset_id"), doc.alias("json")
    )


def catalog(spark, folder, sort=False):
    found = pages(spark, folder), links(spark, folder), metadata(spark, folder), observation_links(spark, folder)
    return cat.build_catalog(*found, sort=sort)


_LEVEL_NAMES = ["ctry", "rgn", "la", "msoa", "lsoa", "oa", "zz", ""]


def area_list(spark, folder):
    """Customers as areas of six levels, as JSON items of one document per nation and segment."""
    customer = parquet_table(spark, folder, "customer")
    level = F.get(F.array(*[F.lit(l) for l in _LEVEL_NAMES[:6]]), (F.col("c_nationkey") % 6).cast("int"))
    item = F.struct(
        F.format_string("E%08d", "c_custkey").alias("id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("label"),
    )
    block = F.expr("c_custkey div 100")
    return customer.groupBy(level.alias("geo_level"), block.alias("page_no")).agg(
        F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("json")
    )


def areas(spark, folder):
    listed = cat.explode_items(area_list(spark, folder), ("id", "label"), ["geo_level"])
    return listed.select("geo_level", F.col("id").alias("area_code"), F.col("label").alias("area_label"))


def _batches(spark, folder, size):
    return req.area_batches(req.number_areas(areas(spark, folder)), size)


def _parameters(spark, folder):
    batches = _batches(spark, folder, req.batch_size(F.col("geo_level"), F.lit(20)))
    param = req.area_param(F.col("geo_level"), F.col("area_codes"))
    url = req.request_url(BASE, F.lit("TS030"), param)
    return batches.select("geo_level", "batch_no", param.alias("param"), url.alias("url"))


def _payloads(spark, folder):
    extra = F.when(F.col("batch_no") == 1, F.array(F.lit("religion_tb"), F.lit("sex")))
    codes = F.when(F.col("geo_level") != "ctry", F.col("area_codes"))
    return _batches(spark, folder, 100).select(
        "geo_level", "batch_no", req.filter_payload(F.lit("TS030"), F.col("geo_level"), codes, extra).alias("payload")
    )


def requests(spark, folder):
    customer = parquet_table(spark, folder, "customer")
    number = F.col("c_custkey").cast("string")
    dataset = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("TS"), number))
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("rm"), number))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("XX"), number))
        .when((F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_acctbal") > 0), "TS")
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("RM"), number))
    )
    return customer.select(
        F.col("c_custkey").alias("request_no"),
        dataset.alias("dataset_id"),
        F.get(F.array(*[F.lit(l) for l in _LEVEL_NAMES]), (F.col("c_nationkey") % 8).cast("int")).alias("geo_level"),
        F.when(F.col("c_nationkey") > 20, F.concat(F.lit("out/"), number)).alias("output_dir"),
        F.when(F.col("c_nationkey") < 3, F.lit(25)).cast("bigint").alias("batch_size"),
        (F.col("c_acctbal") < 0).alias("use_filter"),
    )


def _expanded(spark, folder):
    valid = req.validate_requests(requests(spark, folder)).filter(F.col("reason").isNull()).drop("reason")
    expanded = req.expand_requests(valid)
    return expanded.withColumn("route", req.route(F.col("geo_level"), F.col("use_filter")))


def responses(spark, folder):
    """Outcome of one test request per order: data set by customer, level by order."""
    orders = parquet_table(spark, folder, "orders")
    levels = F.array(*[F.lit(l) for l in _LEVEL_NAMES[:6]])
    return orders.select(
        F.concat(F.lit("TS"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("dataset_id"),
        F.get(levels, (F.col("o_orderkey") % 6).cast("int")).alias("geo_level"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(5).cast("bigint").alias("n_areas"),
        F.when(F.col("o_orderpriority") == "2-HIGH", 404).when(F.col("o_orderpriority") == "3-MEDIUM", 500).otherwise(200).cast("bigint").alias("status"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(3).cast("bigint").alias("n_observations"),
        F.when(F.col("o_totalprice") > 200000, F.concat(F.lit("out/"), F.col("o_orderkey"), F.lit(".csv"))).alias("_file"),
    )


def outcomes(spark, folder):
    checked = req.availability(responses(spark, folder))
    return checked.select(
        "dataset_id", "geo_level", F.when(F.col("is_available"), F.col("_file")).alias("output_file"),
        "is_available", "error_message",
    )


def debug_files(spark, folder):
    """Debug documents per filter batch: some without dimensions, some with a sample response."""
    orders = parquet_table(spark, folder, "orders")
    dims = F.when(F.col("o_orderstatus") != "F", F.array(F.struct(F.concat(F.lit("d"), F.col("o_orderkey")).alias("name"))))
    doc = F.to_json(F.struct(dims.alias("dimensions"), F.when(F.col("o_orderpriority") == "1-URGENT", True).alias("sample_response")))
    return orders.select(
        F.concat(F.lit("TS"), F.col("o_custkey")).alias("dataset_id"), F.lit("oa").alias("geo_level"),
        F.col("o_orderkey").alias("file_no"), doc.alias("json"),
    )


def _combined_batches(spark, folder):
    orders = parquet_table(spark, folder, "orders")
    parts = {
        number: orders.filter(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("area"), F.col("o_totalprice").alias("observation"))
        for number, status in enumerate(("F", "O"), 1)
    }
    last = orders.filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("area"), F.col("o_orderpriority").alias("note"))
    return req.combine_filter_batches({**parts, 3: last})


def _read_batches(spark, folder):
    """Batch files whose columns come in two orders, read as one table."""
    path = fresh_path(spark, "batches")
    orders = parquet_table(spark, folder, "orders").select(F.col("o_orderkey").alias("area"), F.col("o_orderstatus").alias("status"))
    for status, columns in (("F", ["area", "status"]), ("O", ["status", "area"]), ("P", ["area", "status"])):
        orders.filter(F.col("status") == status).select(*columns).write.mode("append").option("header", True).csv(path)
    return req.read_filter_batches(spark, path).drop("file_name")


def _dimension_names(spark, folder):
    """Dimension names: nations, and the geographic levels in mixed case, one per customer."""
    customer = parquet_table(spark, folder, "customer")
    nation = parquet_table(spark, folder, "nation")
    levels = F.array(*[F.lit(l) for l in ("Ctry", "LA", "oa", "ltla")])
    name = F.when(F.col("c_acctbal") < 2000, F.get(levels, (F.col("c_custkey") % 4).cast("int"))).otherwise(F.col("n_name"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return cat.category_dims(joined.select("c_custkey", name.alias("name")))


QUERIES = {
    "catalog_build": lambda s, d: catalog(s, d, sort=True),
    "catalog_types": lambda s, d: cat.with_type(catalog(s, d)).select("id", "dataset_type"),
    "catalog_counts": lambda s, d: cat.catalog_counts(catalog(s, d)),
    "catalog_top_five": lambda s, d: cat.top_n_per_type(catalog(s, d), 5),
    "catalog_listing": lambda s, d: cat.top_n_per_type(catalog(s, d), 5, ["OTHER"]),
    "catalog_pages_of_ten": lambda s, d: cat.page_number(catalog(s, d), 10).select("dataset_type", "id", "page"),
    "catalog_truncated_descriptions": lambda s, d: catalog(s, d).select("id", cat.truncate_text(F.col("description")).alias("description")),
    "catalog_area_items": areas,
    "catalog_category_dimensions": _dimension_names,
    "request_area_batches": lambda s, d: _batches(s, d, 100),
    "request_filter_batches": lambda s, d: _batches(s, d, req.FILTER_BATCH_SIZE),
    "request_batch_sizes": lambda s, d: requests(s, d).select("request_no", req.batch_size(F.col("geo_level")).alias("default_size"), req.batch_size(F.col("geo_level"), F.col("batch_size")).alias("size")),
    "request_parameters": _parameters,
    "request_filter_payloads": _payloads,
    "request_validation": lambda s, d: req.validate_requests(requests(s, d)).select("request_no", "dataset_id", "geo_level", "reason"),
    "request_expansion": _expanded,
    "request_routes": lambda s, d: requests(s, d).select("request_no", req.route(F.col("geo_level"), F.col("use_filter")).alias("route")),
    "request_availability": lambda s, d: req.availability(responses(s, d)).drop("_file"),
    "request_level_status": lambda s, d: req.level_status(outcomes(s, d)),
    "request_run_summary": lambda s, d: req.run_summary(outcomes(s, d)),
    "request_combined_batches": _combined_batches,
    "request_read_batches": _read_batches,
    "request_picked_dimensions": lambda s, d: req.pick_dimensions(debug_files(s, d)).select(
        "dataset_id", "geo_level", "file_no", F.to_json("dimensions").alias("dimensions"), "sample_response"
    ),
}

_CASE = " ".join(f"WHEN '{kind}' THEN '{code}'" for kind, code in _PREFIX.items())
_CATALOG = f"""WITH listed AS (SELECT CASE p_type {_CASE} ELSE 'cpih' END || lpad(p_partkey::varchar, 6, '0') AS id,
  CASE WHEN p_size % 10 <> 0 THEN p_name ELSE '' END AS title,
  CASE WHEN p_size % 10 <> 1 THEN repeat(p_brand || ' ', p_size) ELSE '' END AS description FROM part),
linked AS (SELECT DISTINCT CASE WHEN l_linestatus = 'O' THEN 'TS' ELSE 'RM' END || lpad(l_partkey::varchar, 6, '0') AS id
  FROM lineitem WHERE l_linenumber <> 7 AND (l_linestatus = 'O' OR l_returnflag <> 'R')),
meta AS (SELECT 'TS' || lpad(p_partkey::varchar, 6, '0') AS id, CASE WHEN p_retailprice > 950 THEN p_name END AS title,
  CASE WHEN p_size > 10 THEN p_brand ELSE '' END AS description FROM part WHERE p_size > 5),
by_link AS (SELECT l.id, coalesce(m.title, 'Census 2021 - ' || l.id) AS title,
  CASE WHEN m.id IS NULL THEN 'Census 2021 dataset' ELSE m.description END AS description
  FROM linked l LEFT JOIN meta m ON m.id = l.id WHERE l.id NOT IN (SELECT id FROM listed)),
by_observation AS (SELECT DISTINCT 'TS' || lpad((o_custkey * 2)::varchar, 6, '0') AS id FROM orders),
catalog AS (SELECT * FROM listed UNION ALL SELECT * FROM by_link UNION ALL
  SELECT id, 'Census 2021 - ' || id, 'Census 2021 dataset discovered via census-observations' FROM by_observation
  WHERE id NOT IN (SELECT id FROM listed) AND id NOT IN (SELECT id FROM by_link)),
typed AS (SELECT *, CASE WHEN starts_with(id, 'TS') THEN 'TS' WHEN starts_with(id, 'RM') THEN 'RM' ELSE 'OTHER' END AS dataset_type FROM catalog),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_type ORDER BY id, title, description) AS no,
  count(*) OVER (PARTITION BY dataset_type) AS total FROM typed)
"""
_AREAS = """WITH areas AS (SELECT list_extract(['ctry', 'rgn', 'la', 'msoa', 'lsoa', 'oa'], c_nationkey % 6 + 1) AS geo_level,
  printf('E%08d', c_custkey) AS area_code, CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS area_label FROM customer),
numbered AS (SELECT *, row_number() OVER (PARTITION BY geo_level ORDER BY area_code) - 1 AS no FROM areas)
"""


def _batch_sql(size: int) -> str:
    return f"SELECT geo_level, no // {size} + 1 AS batch_no, list(area_code ORDER BY no) AS area_codes FROM numbered GROUP BY 1, 2"


_REQUESTS = """WITH requests AS (SELECT c_custkey AS request_no,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'TS' || c_custkey WHEN c_mktsegment = 'BUILDING' THEN 'rm' || c_custkey
  WHEN c_mktsegment = 'FURNITURE' THEN 'XX' || c_custkey WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 0 THEN 'TS'
  WHEN c_mktsegment = 'MACHINERY' THEN 'RM' || c_custkey END AS dataset_id,
  list_extract(['ctry', 'rgn', 'la', 'msoa', 'lsoa', 'oa', 'zz', ''], c_nationkey % 8 + 1) AS geo_level,
  CASE WHEN c_nationkey > 20 THEN 'out/' || c_custkey END AS output_dir,
  CASE WHEN c_nationkey < 3 THEN 25::bigint END AS batch_size, c_acctbal < 0 AS use_filter FROM customer),
checked AS (SELECT *, CASE WHEN dataset_id IS NULL THEN 'Dataset ID is required'
  WHEN length(dataset_id) < 3 THEN 'Invalid dataset ID format: ' || dataset_id
  WHEN upper(left(dataset_id, 2)) NOT IN ('TS', 'RM') THEN 'Unsupported dataset type: ' || upper(left(dataset_id, 2))
  WHEN geo_level NOT IN ('', 'ctry', 'rgn', 'la', 'msoa', 'lsoa', 'oa') THEN 'Invalid geographic level: ' || geo_level END AS reason FROM requests)
"""
_KNOWN = "('ctry', 'rgn', 'la', 'msoa', 'lsoa', 'oa')"
_ROUTE = "CASE WHEN use_filter OR geo_level IN ('lsoa', 'msoa', 'oa') THEN 'filter' ELSE 'batch' END AS route"
_RESPONSES = """WITH responses AS (SELECT 'TS' || lpad(o_custkey::varchar, 6, '0') AS dataset_id,
  list_extract(['ctry', 'rgn', 'la', 'msoa', 'lsoa', 'oa'], o_orderkey % 6 + 1) AS geo_level,
  (CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 5 END)::bigint AS n_areas,
  (CASE o_orderpriority WHEN '2-HIGH' THEN 404 WHEN '3-MEDIUM' THEN 500 ELSE 200 END)::bigint AS status,
  (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 3 END)::bigint AS n_observations,
  CASE WHEN o_totalprice > 200000 THEN 'out/' || o_orderkey || '.csv' END AS file FROM orders),
checked AS (SELECT *, CASE WHEN n_areas = 0 THEN 'No areas found for geographic level: ' || geo_level
  WHEN status = 404 THEN 'Dataset ' || dataset_id || ' not found at ' || geo_level || ' level (404)'
  WHEN status >= 400 THEN 'HTTP error ' || status || ' checking dataset ' || dataset_id || ' at ' || geo_level || ' level'
  WHEN n_observations = 0 THEN 'Dataset ' || dataset_id || ' doesn''t contain observations at ' || geo_level || ' level' END AS error_message FROM responses),
outcomes AS (SELECT dataset_id, geo_level, CASE WHEN error_message IS NULL THEN file END AS output_file,
  error_message IS NULL AS is_available, error_message FROM checked),
statuses AS (SELECT *, CASE WHEN output_file IS NOT NULL THEN 'done' WHEN NOT is_available THEN 'skipped' ELSE 'failed' END AS status,
  CASE WHEN output_file IS NULL AND NOT is_available THEN error_message END AS reason FROM outcomes)
"""

ORACLE = {
    "catalog_build": _CATALOG + "SELECT * FROM catalog",
    "catalog_types": _CATALOG + "SELECT id, dataset_type FROM typed",
    "catalog_counts": _CATALOG + """SELECT t AS dataset_type, count(id) AS datasets FROM (VALUES ('TS'), ('RM'), ('OTHER')) AS k(t)
      LEFT JOIN typed ON dataset_type = t GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM typed""",
    "catalog_top_five": _CATALOG + "SELECT dataset_type, id, title, description, greatest(total - 5, 0) AS more FROM ranked WHERE no <= 5",
    "catalog_listing": _CATALOG + """SELECT dataset_type, id, title, description,
      CASE WHEN dataset_type = 'OTHER' THEN greatest(total - 5, 0) ELSE 0 END::bigint AS more FROM ranked WHERE dataset_type <> 'OTHER' OR no <= 5""",
    "catalog_pages_of_ten": _CATALOG + "SELECT dataset_type, id, (no - 1) // 10 + 1 AS page FROM ranked",
    "catalog_truncated_descriptions": _CATALOG + """SELECT id, CASE WHEN length(description) > 200 THEN left(description, 197) || '...'
      ELSE description END AS description FROM catalog""",
    "catalog_area_items": _AREAS + "SELECT * FROM areas",
    "catalog_category_dimensions": "SELECT c_custkey, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 2000",
    "request_area_batches": _AREAS + _batch_sql(100),
    "request_filter_batches": _AREAS + _batch_sql(5000),
    "request_batch_sizes": _REQUESTS + f"""SELECT request_no, (CASE WHEN geo_level IN {_KNOWN} THEN 200 ELSE 50 END)::bigint AS default_size,
      (CASE WHEN geo_level IN {_KNOWN} THEN coalesce(batch_size, 200) ELSE 50 END)::bigint AS size FROM requests""",
    "request_parameters": _AREAS + f"""SELECT geo_level, batch_no, geo_level || ',' || array_to_string(area_codes, ',') AS param,
      '{BASE}/datasets/TS030/editions/2021/versions/1/json?area-type=' || geo_level || ',' || array_to_string(area_codes, ',') AS url
      FROM ({_batch_sql(20)})""",
    "request_filter_payloads": _AREAS + f"""SELECT geo_level, batch_no, '{{"dataset":{{"id":"TS030","edition":"2021","version":1}},"population_type":"UR","dimensions":['
      || concat_ws(',', CASE WHEN geo_level <> 'ctry' THEN '{{"name":"' || geo_level || '","is_area_type":true,"options":["' || array_to_string(area_codes, '","') || '"]}}' END,
      CASE WHEN batch_no = 1 THEN '{{"name":"religion_tb"}},{{"name":"sex"}}' END) || ']}}' AS payload FROM ({_batch_sql(100)})""",
    "request_validation": _REQUESTS + "SELECT request_no, dataset_id, geo_level, reason FROM checked",
    "request_expansion": _REQUESTS + f""", expanded AS (SELECT request_no, dataset_id,
      unnest(CASE WHEN geo_level = '' THEN ['ctry', 'rgn', 'la', 'msoa', 'lsoa', 'oa'] ELSE [geo_level] END) AS geo_level,
      coalesce(output_dir, 'data/' || dataset_id) AS output_dir, coalesce(batch_size, 200)::bigint AS batch_size, use_filter FROM checked WHERE reason IS NULL)
      SELECT *, {_ROUTE} FROM expanded""",
    "request_routes": _REQUESTS + f"SELECT request_no, {_ROUTE} FROM requests",
    "request_availability": _RESPONSES + "SELECT * EXCLUDE (file), error_message IS NULL AS is_available FROM checked",
    "request_level_status": _RESPONSES + "SELECT * FROM statuses",
    "request_run_summary": _RESPONSES + """, counted AS (SELECT dataset_id, count(*) AS levels, count(*) FILTER (status = 'done') AS done,
      count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, bool_and(geo_level = 'oa') AS oa FROM statuses GROUP BY 1)
      SELECT dataset_id, levels, done, skipped, failed, done > 0 AS succeeded, CASE WHEN done > 0 THEN NULL
      WHEN skipped > 0 AND failed = 0 THEN 'This dataset may not be available at the requested geographic levels.'
      WHEN levels = 1 AND oa AND skipped > 0 THEN 'Output Area (OA) level data is not available for all datasets.' END AS hint FROM counted""",
    "request_combined_batches": """SELECT o_orderkey AS area, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS observation,
      CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS file_no, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS note FROM orders""",
    "request_read_batches": "SELECT o_orderkey::varchar AS area, o_orderstatus AS status FROM orders",
    "request_picked_dimensions": """SELECT dataset_id, 'oa' AS geo_level, file_no, '["{\\"name\\":\\"d' || file_no || '\\"}"]' AS dimensions, sample_response FROM (
      SELECT 'TS' || o_custkey AS dataset_id, o_orderkey AS file_no, o_orderpriority = '1-URGENT' AS sample_response FROM orders WHERE o_orderstatus <> 'F'
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority <> '1-URGENT', o_orderkey) = 1)""",
}
