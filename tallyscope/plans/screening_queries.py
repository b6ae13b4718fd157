"""Screening metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.operators import screening
from tallyscope.session import fresh_path
from tallyscope.sources.tables import parquet_table

END = "2001-03-31"
FORMATS = ["dd/MM/yyyy", "dd-MMM-yyyy"]


def episodes(spark, folder):
    orders = parquet_table(spark, folder, "orders")
    customer = parquet_table(spark, folder, "customer")
    nation = parquet_table(spark, folder, "nation")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("o_custkey").alias("nhs_number"),
            F.col("o_orderkey").alias("episode_id"),
            # dates as different sites write them
            F.when(F.col("o_orderpriority") == "5-LOW", "not offered")
            .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
            .when(F.col("o_orderkey") % 3 == 2, F.date_format("o_orderdate", "dd-MMM-yyyy"))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
            .alias("date_of_foa"),
            F.when(
                F.col("o_orderstatus") != "F",
                F.date_format(F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 300 as int))"), "yyyy-MM-dd"),
            ).alias("date_of_as"),
            F.col("c_mktsegment").alias("bso_organisation_code"),
            F.col("n_name").alias("gp_practice_code"),
        )
    )


def _enriched(spark, folder):
    return screening.enrich(episodes(spark, folder), formats=FORMATS)


def _from_written(spark, folder):
    path = fresh_path(spark, "enriched")
    screening.write_enriched(_enriched(spark, folder), path)
    written = spark.read.parquet(path).filter(F.col("financial_year").isin(1999, 2000))
    return screening.calculate_uptake(written, "bso_organisation_code", END)


QUERIES = {
    "screening_uptake_flag": lambda s, d: screening.add_uptake_columns(episodes(s, d), FORMATS),
    "screening_round_length_flag": _enriched,
    "screening_uptake": lambda s, d: screening.calculate_uptake(screening.add_uptake_columns(episodes(s, d), FORMATS), "bso_organisation_code", END),
    "screening_round_length": lambda s, d: screening.calculate_round_length(_enriched(s, d), "bso_organisation_code", END),
    "screening_uptake_by_bso_and_gp": lambda s, d: screening.calculate_uptake(
        screening.add_uptake_columns(episodes(s, d), FORMATS), ["bso_organisation_code", "gp_practice_code"], END, "1997-01-01"
    ),
    "screening_round_length_by_bso_and_gp": lambda s, d: screening.calculate_round_length(
        _enriched(s, d), ["bso_organisation_code", "gp_practice_code"], END, "1997-01-01"
    ),
    "screening_metric_audit": lambda s, d: screening.metric_audit(_enriched(s, d)),
    "screening_uptake_from_written_years": _from_written,
    "screening_unparsed_dates": lambda s, d: screening.unparsed_dates(episodes(s, d), FORMATS),
}

_BASE = """WITH episodes AS (SELECT o_custkey AS nhs_number, o_orderkey AS episode_id,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS date_of_foa,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderdate + to_days((o_orderkey % 300)::int) END AS date_of_as,
  c_mktsegment AS bso_organisation_code, n_name AS gp_practice_code
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
up AS (SELECT *, CASE WHEN date_of_foa IS NOT NULL THEN coalesce(date_of_as <= date_of_foa + INTERVAL 183 DAY, false) END
  AS uptake_six_mth_threshold FROM episodes),
led AS (SELECT *, lead(date_of_as) OVER w AS prior_date_of_as, lead(date_of_foa) OVER w AS prior_date_of_foa FROM up
  WINDOW w AS (PARTITION BY nhs_number ORDER BY date_of_foa DESC NULLS LAST, episode_id DESC)),
enriched AS (SELECT *, coalesce(prior_date_of_as, prior_date_of_foa) AS prior_episode_date,
  date_of_foa <= coalesce(prior_date_of_as, prior_date_of_foa) + INTERVAL 1095 DAY AS round_length_three_yr_threshold FROM led)
"""


def _share(flag: str, name: str, keys: str, start: str) -> str:
    return _BASE + f"""SELECT {keys}, avg({flag}::int) * 100 AS {name} FROM enriched
      WHERE date_of_foa >= {start} AND date_of_foa <= TIMESTAMP '{END}' AND {flag} IS NOT NULL GROUP BY {keys}"""


_YEAR = f"TIMESTAMP '{END}' - INTERVAL 1 YEAR"
_UPTAKE = ("uptake_six_mth_threshold", "uptake_pct")
_ROUND = ("round_length_three_yr_threshold", "round_length_pct")

ORACLE = {
    "screening_uptake_flag": _BASE + "SELECT * FROM up",
    "screening_round_length_flag": _BASE + "SELECT * FROM enriched",
    "screening_uptake": _share(*_UPTAKE, "bso_organisation_code", _YEAR),
    "screening_round_length": _share(*_ROUND, "bso_organisation_code", _YEAR),
    "screening_uptake_by_bso_and_gp": _share(*_UPTAKE, "bso_organisation_code, gp_practice_code", "TIMESTAMP '1997-01-01'"),
    "screening_round_length_by_bso_and_gp": _share(*_ROUND, "bso_organisation_code, gp_practice_code", "TIMESTAMP '1997-01-01'"),
    "screening_metric_audit": _BASE + """SELECT nhs_number, date_of_foa, date_of_as, prior_date_of_foa, prior_date_of_as,
      uptake_six_mth_threshold, round_length_three_yr_threshold FROM enriched""",
    "screening_uptake_from_written_years": _share(*_UPTAKE, "bso_organisation_code", _YEAR),
    "screening_unparsed_dates": """SELECT 0::bigint AS date_of_as_unparsed, count(*) FILTER (o_orderpriority = '5-LOW') AS date_of_foa_unparsed
      FROM orders JOIN customer ON o_custkey = c_custkey""",
}
