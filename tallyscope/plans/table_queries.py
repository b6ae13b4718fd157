"""Reporting-period and perturbation queries."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tallyscope.operators import periods, perturb
from tallyscope.session import fresh_path
from tallyscope.sources.files import renamed, touched
from tallyscope.sources.sinks import export_quoted, write_csv_by, write_named_csv
from tallyscope.sources.tables import checked_documents, csv_parts, csv_table, json_documents, parquet_table, text_csv

DATES = ["2023-06-30", "2022-09-14", "2021-03-01", "2020-02-29", "2017-12-31"]


def order_files(spark, folder):
    """Orders with the name of the yearly regional file each would arrive in."""
    orders = parquet_table(spark, folder, "orders")
    customer = parquet_table(spark, folder, "customer")
    nation = parquet_table(spark, folder, "nation")
    region = parquet_table(spark, folder, "region")
    name = F.concat(
        F.lit("kc63_"), F.lower("r_name"), F.lit("_"), F.date_format("o_orderdate", "yyyy"), F.lit(".csv")
    )
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("o_orderkey", "o_orderstatus", name.alias("source_file"))
    )


def counts_table(spark, folder):
    """All-text wide table with one row per supplier: integers, floats, words and blanks."""
    supplier = parquet_table(spark, folder, "supplier")
    nation = parquet_table(spark, folder, "nation")
    lineitem = parquet_table(spark, folder, "lineitem")
    lines = lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .select(
            F.col("s_suppkey").cast("string").alias("kc63_output_by_run_id"),
            F.concat(F.lit("line "), F.col("s_suppkey") % 8).alias("col_b"),
            F.col("n_name").alias("col_c"),
            F.coalesce("n", F.lit(0)).cast("string").alias("col_d"),
            F.col("s_acctbal").cast("string").alias("col_e"),
            # texts that look like numbers and are none stay as they are
            F.coalesce(F.get(F.array(F.lit("NaN"), F.lit("1e400"), F.lit("nan")), (F.col("s_suppkey") % 9).cast("int")), "s_name").alias("col_f"),
            F.lit(None).cast("string").alias("col_g"),
            (F.col("s_suppkey") % 12).cast("string").alias("col_h"),
        )
    )


def line_numbers(spark, folder):
    """A typed table: integer and floating cells per line item, keyed by all its identifiers."""
    lineitem = parquet_table(spark, folder, "lineitem")
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def _report(spark, folder):
    old = counts_table(spark, folder)
    return perturb.perturbation_report(
        perturb.perturb(old, seed=7), old, perturb.KEY_COLUMNS, ["col_d", "col_e", "col_h"]
    )


def _out_of_bounds(spark, folder):
    """Integer cells outside their bounds, floats outside 0..100, changed texts: all zero."""
    keys = list(perturb.KEY_COLUMNS)
    old = counts_table(spark, folder)
    new = perturb.perturb(old, seed=7).select(*keys, *[F.col(c).alias(f"new_{c}") for c in old.columns if c not in keys])
    both = old.join(new, keys)

    def outside(column):
        value, got = F.col(column).cast("bigint"), F.col(f"new_{column}").cast("bigint")
        low = F.when(value > 10, F.floor(value * 0.5)).otherwise(0)
        high = F.when(value > 10, F.floor(value * 1.5)).otherwise(10)
        return F.count(F.when(~got.between(low, high), 1)).alias(f"{column}_outside")

    return both.agg(
        F.count(F.lit(1)).alias("cells"),
        outside("col_d"),
        outside("col_h"),
        F.count(F.when(~F.col("new_col_e").cast("double").between(0, 100), 1)).alias("col_e_outside"),
        F.count(F.when(~F.col("new_col_f").eqNullSafe(F.col("col_f")), 1)).alias("col_f_changed"),
        F.count(F.when(F.col("new_col_g").isNotNull(), 1)).alias("col_g_changed"),
    )


def _exported(spark, folder):
    path = fresh_path(spark, "export")
    export_quoted(perturb.perturb(counts_table(spark, folder), seed=7), path)
    return spark.read.text(path).filter(~F.col("value").startswith('"kc63')).select(F.col("value").alias("line"))


def _copied(spark, folder):
    """Pass-through copy of a mapping table, all text, through CSV."""
    path = fresh_path(spark, "copy")
    nation = parquet_table(spark, folder, "nation")
    customer = parquet_table(spark, folder, "customer")
    mapping = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("gpp"), F.col("n_name").alias("bso")
    )
    mapping.write.option("header", True).csv(path)
    return text_csv(spark, path)


def _tagged_folders(spark, folder):
    """Yearly regional CSVs (one folder each) read as text, tagged, written again and read back."""
    source, target = fresh_path(spark, "yearly"), fresh_path(spark, "tagged")
    files = order_files(spark, folder).withColumn("source", periods.file_stem(F.col("source_file")))
    write_csv_by(files.drop("source_file"), source, "source")
    tagged = periods.with_reporting_period(text_csv(spark, source), "source")
    output = F.concat(F.col("source"), F.lit("_preprocessed"))
    write_csv_by(tagged.withColumn("output", output).drop("source"), target, "output")
    return text_csv(spark, target)


def _tagged_files(spark, folder):
    """Yearly regional CSV files with names of their own, tagged by the operator and read back."""
    yearly, source, target = (fresh_path(spark, name) for name in ("yearly", "named", "tagged"))
    files = order_files(spark, folder).withColumn("source", periods.file_stem(F.col("source_file")))
    files.drop("source_file").repartition("source").write.partitionBy("source").option("header", True).csv(yearly)
    for place in csv_parts(spark, yearly):
        stem = place.rsplit("source=", 1)[1].split("/")[0]
        renamed(spark, place, f"{source}/{stem}.csv")
    periods.tag_reporting_period(spark, source, target)
    return text_csv(spark, target)


def _named_files(spark, folder):
    """The same files, each tagged into one file of its own name, read back with their names."""
    source, target = fresh_path(spark, "named"), fresh_path(spark, "tagged")
    files = order_files(spark, folder).withColumnRenamed("source_file", "output")
    write_named_csv(files.withColumn("at", F.col("o_orderkey")), source, order=["at"])
    periods.tag_reporting_period(spark, source, target, single_files=True)
    return text_csv(spark, target, with_file=True)


def _scanned_declared(spark, folder):
    """Line items as 1,000 CSV files in two orders of columns, read by declared names and types."""
    path = fresh_path(spark, "declared")
    lines = parquet_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag")
    half = F.col("l_orderkey") % 2
    lines.filter(half == 0).repartition(500).write.option("header", True).csv(f"{path}/even")
    lines.filter(half == 1).select(*reversed(lines.columns)).repartition(500).write.option("header", True).csv(f"{path}/odd")
    return csv_table(spark, path, T.StructType([lines.schema[c] for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")]))


def _scanned_json(spark, folder):
    """A JSON document of its customers for each nation: some cut off, one file empty, one that is no object."""
    path = fresh_path(spark, "documents")
    customer, nation = (parquet_table(spark, folder, name) for name in ("customer", "nation"))
    of = customer.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))).alias("customers"))
    whole = nation.join(of, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        "n_nationkey", F.to_json(F.struct(F.col("n_name").alias("nation"), F.coalesce("customers", F.array()).alias("customers"))).alias("json")
    )
    cut = F.when(F.col("n_nationkey") % 5 == 0, F.expr("left(json, length(json) - 3)")).when(F.col("n_nationkey") == 7, "[1]").otherwise(F.col("json"))
    whole.select(cut.alias("json"), F.format_string("%02d.json", "n_nationkey").alias("output")).repartition("output").write.partitionBy("output").text(path)
    touched(spark, f"{path}/output=99.json/empty.txt")
    documents = checked_documents(json_documents(spark, f"{path}/*"), "nation string, customers array<struct<c_custkey:bigint,c_name:string>>")
    return documents.select("parsed.nation", F.size("parsed.customers").cast("bigint").alias("customers"), F.length("corrupt").cast("bigint").alias("corrupt_length"))


QUERIES = {
    "period_named_files": _named_files,
    "scan_declared_csv": _scanned_declared,
    "scan_json_documents": _scanned_json,
    "period_tagged_files": _tagged_files,
    "period_from_file_name": lambda s, d: periods.with_reporting_period(order_files(s, d)).withColumn(
        "year", periods.year_or_null(F.col("source_file"))
    ),
    "period_counts": lambda s, d: periods.with_reporting_period(order_files(s, d))
    .groupBy("reporting_period")
    .agg(F.count(F.lit(1)).alias("n")),
    "period_tagged_folders": _tagged_folders,
    "perturb_text_cells": lambda s, d: perturb.perturb(counts_table(s, d), seed=7),
    "perturb_typed_cells": lambda s, d: perturb.perturb(line_numbers(s, d), _LINE_KEY, seed=11),
    "perturb_other_parameters": lambda s, d: perturb.perturb(counts_table(s, d), threshold=600, smear=0.2, seed=3),
    "perturb_past_dates": lambda s, d: perturb.replicate_for_dates(counts_table(s, d), DATES, seed=7),
    "perturb_bounds": _out_of_bounds,
    "perturb_report": _report,
    "perturb_preview": lambda s, d: perturb.preview(
        perturb.perturb(counts_table(s, d), seed=7), ["kc63_output_by_run_id"]
    ),
    "perturb_quoted_export": _exported,
    "perturb_mapping_copy": _copied,
}

_FILES = """WITH files AS (SELECT o_orderkey, o_orderstatus, 'kc63_' || lower(r_name) || '_' || year(o_orderdate) || '.csv' AS source_file,
  year(o_orderdate)::int AS year, (year(o_orderdate) - 1) || '-' || year(o_orderdate) AS reporting_period
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def draw(key: str, name: str, seed) -> str:
    """SQL twin of the seeded draw."""
    seed = seed if str(seed).startswith("(") else f"'{seed}'"
    return f"(('0x' || substr(md5(concat_ws('|', {key}, '{name}', {seed})), 1, 13))::bigint / 4503599627370496.0::double)"


_COUNTS = """WITH counts AS (SELECT s_suppkey::varchar AS kc63_output_by_run_id, 'line ' || (s_suppkey % 8) AS col_b, n_name AS col_c,
  coalesce(n, 0)::varchar AS col_d, s_acctbal::varchar AS col_e, coalesce(list_extract(['NaN', '1e400', 'nan'], (s_suppkey % 9 + 1)::int), s_name) AS col_f, NULL::varchar AS col_g, (s_suppkey % 12)::varchar AS col_h
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)
"""
_ROW = "concat_ws('|', kc63_output_by_run_id, col_b, col_c)"


def _int(column: str, u: str, threshold: int = 10, smear: float = 0.5) -> str:
    v = f"{column}::bigint"
    low = f"greatest(0, trunc({v} - {v} * {smear}::double)::bigint)"
    high = f"trunc({v} + {v} * {smear}::double)::bigint"
    return f"""(CASE WHEN {v} > {threshold} THEN {low} + floor({u} * ({high} - {low} + 1))::bigint
      ELSE floor({u} * {threshold + 1})::bigint END)"""


def _noisy(seed, row: str = _ROW, **options) -> str:
    def u(column):
        return draw(row, column, seed)

    return f"""kc63_output_by_run_id, col_b, col_c, {_int('col_d', u('col_d'), **options)}::varchar AS col_d,
      round_even({u('col_e')} * 100, 2)::varchar AS col_e, col_f, col_g, {_int('col_h', u('col_h'), **options)}::varchar AS col_h"""


_QUOTED = " || ',' || ".join(f"'\"' || coalesce({c}, '') || '\"'" for c in "col_b col_c col_d col_e col_f col_g col_h".split())
_LINE = "concat_ws('|', l_orderkey, l_linenumber, l_partkey)"

ORACLE = {
    "period_named_files": _FILES + """SELECT o_orderkey::varchar AS o_orderkey, o_orderstatus, reporting_period,
      replace(source_file, '.csv', '_preprocessed.csv') AS file_name FROM files""",
    "scan_declared_csv": "SELECT l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem",
    "scan_json_documents": """WITH texts AS (
      SELECT n_nationkey, n_name, count(c_custkey) AS n, '{"nation":"' || n_name || '","customers":[' ||
        coalesce(string_agg('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}', ',') FILTER (c_custkey IS NOT NULL), '') || ']}' AS json
      FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name)
      SELECT CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey <> 7 THEN n_name END AS nation,
        CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey <> 7 THEN n END AS customers,
        CASE WHEN n_nationkey % 5 = 0 THEN length(json) - 3 WHEN n_nationkey = 7 THEN 3 END + 1 AS corrupt_length FROM texts""",
    "period_from_file_name": _FILES + "SELECT * FROM files",
    "period_counts": _FILES + "SELECT reporting_period, count(*) AS n FROM files GROUP BY 1",
    "period_tagged_files": _FILES + """SELECT o_orderkey::varchar AS o_orderkey, o_orderstatus, reporting_period,
      replace(source_file, '.csv', '_preprocessed') AS output FROM files""",
    "period_tagged_folders": _FILES + """SELECT o_orderkey::varchar AS o_orderkey, o_orderstatus, reporting_period,
      replace(source_file, '.csv', '_preprocessed') AS output FROM files""",
    "perturb_text_cells": _COUNTS + f"SELECT {_noisy(7)} FROM counts",
    "perturb_typed_cells": f"""SELECT l_orderkey, l_linenumber, l_partkey, {_int('l_suppkey', draw(_LINE, 'l_suppkey', 11))} AS l_suppkey,
      round_even({draw(_LINE, 'l_quantity', 11)} * 100, 2) AS l_quantity,
      round_even({draw(_LINE, 'l_extendedprice', 11)} * 100, 2) AS l_extendedprice FROM lineitem""",
    "perturb_other_parameters": _COUNTS + f"SELECT {_noisy(3, threshold=600, smear=0.2)} FROM counts",
    "perturb_past_dates": _COUNTS + f"""SELECT {_noisy(7, "concat_ws('|', kc63_output_by_run_id, col_b, col_c, as_of)")}, as_of
      FROM counts CROSS JOIN (VALUES {', '.join(f"('{d}')" for d in DATES)}) AS dates(as_of)""",
    "perturb_bounds": """SELECT count(*) AS cells, 0::bigint AS col_d_outside, 0::bigint AS col_h_outside, 0::bigint AS col_e_outside,
      0::bigint AS col_f_changed, 0::bigint AS col_g_changed FROM supplier""",
    "perturb_report": _COUNTS + f""", noisy AS (SELECT {_noisy(7)} FROM counts),
      diffs AS (SELECT c.*, abs(n.col_d::double - c.col_d::double) AS d, abs(n.col_e::double - c.col_e::double) AS e,
        abs(n.col_h::double - c.col_h::double) AS h FROM counts c JOIN noisy n USING (kc63_output_by_run_id)),
      long AS (SELECT 'col_d' AS col, d AS x FROM diffs UNION ALL SELECT 'col_e', e FROM diffs UNION ALL SELECT 'col_h', h FROM diffs)
      SELECT col AS "column", count(x) AS "count", round_even(avg(x), 0) AS mean, round_even(stddev_samp(x), 0) AS std, round_even(min(x), 0) AS min,
      round_even(quantile_cont(x, 0.25), 0) AS p25, round_even(quantile_cont(x, 0.5), 0) AS p50, round_even(quantile_cont(x, 0.75), 0) AS p75,
      round_even(max(x), 0) AS max FROM long GROUP BY 1""",
    "perturb_preview": _COUNTS + f"SELECT * FROM (SELECT {_noisy(7)} FROM counts) ORDER BY kc63_output_by_run_id LIMIT 3",
    "perturb_quoted_export": _COUNTS + f""", noisy AS (SELECT {_noisy(7)} FROM counts)
      SELECT kc63_output_by_run_id || ',' || {_QUOTED} AS line FROM noisy""",
    "perturb_mapping_copy": "SELECT c_custkey::varchar AS gpp, n_name AS bso FROM customer JOIN nation ON c_nationkey = n_nationkey",
}
