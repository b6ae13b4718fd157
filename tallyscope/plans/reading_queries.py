"""Reader KPI queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.operators import charts, reading
from tallyscope.plans.reading_tables import reading_tables, sql


def _kpi(operator):
    return lambda spark, folder: operator(reading_tables(spark, folder))


def _on_summary(operator):
    return lambda spark, folder: operator(reading.summary_table(reading_tables(spark, folder)))


def _six_places(df):
    """Doubles that come from sums in no fixed order, to 6 places."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _funnel_points(spark, folder):
    tables = reading_tables(spark, folder)
    return charts.funnel_points(tables, reading.summary_table(tables))


def _funnel_limits(spark, folder):
    tables = reading_tables(spark, folder)
    summary = reading.summary_table(tables)
    points = charts.funnel_points(tables, summary)
    return _six_places(charts.funnel_limits(tables, points, summary))


def _funnel_limits_of_some(spark, folder):
    """Points of three BSOs, limits still from all readers, straight from the tables."""
    tables = reading_tables(spark, folder)
    points = charts.funnel_points(tables, _filtered(spark, folder))
    return _six_places(charts.funnel_limits(tables, points))


def _filtered(spark, folder):
    summary = reading.summary_table(reading_tables(spark, folder))
    return reading.filter_by_bso(summary, ["NATION_1", "NATION_7", "NATION_20"])


def _filtered_empty_list(spark, folder):
    return reading.filter_by_bso(reading.summary_table(reading_tables(spark, folder)), [])


QUERIES = {
    "reading_enriched_decisions": _kpi(reading.enrich_decisions),
    "reading_images_read": _kpi(reading.kpi_images_read),
    "reading_recalled": _kpi(reading.kpi_recalled),
    "reading_recall_pct": _kpi(reading.kpi_recall_pct),
    "reading_ppv": _kpi(reading.kpi_ppv),
    "reading_cancers_detected": _kpi(reading.kpi_cancers_detected),
    "reading_detection_rate": _kpi(reading.kpi_detection_rate),
    "reading_discrepant_cancers": _kpi(reading.kpi_discrepant),
    "reading_discrepant_rate": _kpi(reading.kpi_discrepant_rate),
    "reading_biopsies": _kpi(reading.kpi_biopsies),
    "reading_benign_biopsy_rate": _kpi(reading.kpi_benign_biopsy_rate),
    "reading_interval_cancers": _kpi(reading.kpi_interval_cancers),
    "reading_read_time": _kpi(reading.kpi_read_time),
    "reading_summary": _kpi(reading.summary_table),
    "reading_bso_filter": _filtered,
    "reading_bso_filter_empty": _filtered_empty_list,
    "reading_bso_codes": _on_summary(reading.bso_codes),
    "reading_ellipses": lambda spark, folder: _six_places(_on_summary(charts.ellipse_params)(spark, folder)),
    "reading_quadrants": lambda spark, folder: _six_places(_on_summary(charts.quadrants)(spark, folder)),
    "reading_quadrants_of_none": lambda spark, folder: charts.quadrants(_on_summary(lambda s: s.filter(F.col("BSO Code") == "nowhere"))(spark, folder)),
    "reading_ellipses_of_none": lambda spark, folder: charts.ellipse_params(_on_summary(lambda s: s.filter(F.col("BSO Code") == "nowhere"))(spark, folder)),
    "reading_funnel_points": _funnel_points,
    "reading_funnel_limits": _funnel_limits,
    "reading_funnel_limits_of_some": _funnel_limits_of_some,
}


def _share(top: str, bottom: str, scale: int) -> str:
    return f"coalesce(round_even({top} / nullif({bottom}, 0) * {scale}, 2), 0.0)"


def _limits(points: str) -> str:
    return f"""SELECT g::bigint AS grid_no, round(n, 6) AS number_of_first_reads, round(p * 1000, 6) AS centre,
        round(greatest((p - 1.96 * sqrt(greatest(p * (1 - p), 0) / n)) * 1000, 0), 6) AS lower_95,
        round((p + 1.96 * sqrt(greatest(p * (1 - p), 0) / n)) * 1000, 6) AS upper_95
        FROM (SELECT g, p, lo + g * ((hi - lo) / 299) AS n FROM range(300) AS t(g),
        (SELECT sum(detected)::double / sum(reads) AS p FROM all_counts),
        (SELECT greatest(1, min("Number of first reads"))::double AS lo, max("Number of first reads")::double AS hi FROM {points})
        WHERE lo IS NOT NULL)"""


ORACLE = {
    "reading_enriched_decisions": sql("SELECT * FROM enriched"),
    "reading_images_read": sql("SELECT reader_id, reads AS read_decision_count FROM all_counts"),
    "reading_recalled": sql("SELECT reader_id, recalls AS recalled_for_assessment_count FROM all_counts"),
    "reading_recall_pct": sql(
        f"""SELECT reader_id, reads AS read_decision_count, recalls AS recalled_for_assessment_count,
        {_share('recalls', 'reads', 100)} AS recalled_for_assessment_pct FROM all_counts"""
    ),
    "reading_ppv": sql(
        f"""SELECT reader_id, recalls AS recalled_for_assessment_count, detected AS cancers_detected_after_recall_count,
        {_share('detected', 'recalls', 100)} AS ppv_recall_for_assessment_pct FROM all_counts"""
    ),
    "reading_cancers_detected": sql("SELECT reader_id, detected AS cancers_detected_count FROM all_counts"),
    "reading_detection_rate": sql(
        f"""SELECT reader_id, reads AS read_decision_count, detected AS cancers_detected_count,
        {_share('detected', 'reads', 1000)} AS cancer_detection_rate_per_1000 FROM all_counts"""
    ),
    "reading_discrepant_cancers": sql("SELECT reader_id, discrepant AS discrepant_cancers_count FROM all_counts"),
    "reading_discrepant_rate": sql(
        f"""SELECT reader_id, detected AS cancers_detected_count, discrepant AS discrepant_cancers_count,
        detected + discrepant AS total_cancer_cases_for_reader,
        {_share('discrepant', '(detected + discrepant)', 100)} AS discrepant_cancer_rate_pct FROM all_counts"""
    ),
    "reading_biopsies": sql(
        """SELECT reader_id, coalesce(n, 0)::bigint AS biopsies_count FROM reader LEFT JOIN (
        SELECT reader_id, count(DISTINCT read_episode_id) AS n FROM recalled_pairs JOIN biopsies USING (read_episode_id) GROUP BY 1
        ) USING (reader_id)"""
    ),
    "reading_benign_biopsy_rate": sql(
        f"""SELECT reader_id, reads AS read_decision_count, coalesce(n, 0)::bigint AS benign_biopsies_count,
        {_share('coalesce(n, 0)', 'reads', 1000)} AS benign_biopsy_rate_per_1000 FROM all_counts LEFT JOIN (
        SELECT reader_id, count(DISTINCT read_episode_id) AS n FROM recalled_pairs JOIN biopsies USING (read_episode_id)
        WHERE lower(biopsy_result) = 'benign' GROUP BY 1) USING (reader_id)"""
    ),
    "reading_interval_cancers": sql(
        """SELECT reader_id, coalesce(n, 0)::bigint AS interval_cancers_count FROM reader LEFT JOIN (
        SELECT e.reader_id, count(DISTINCT e.screening_participant_id) AS n FROM enriched e
        JOIN interval_cancers c ON c.participant_id = e.screening_participant_id
        WHERE upper(interval_cancer_found) = 'TRUE' GROUP BY 1) USING (reader_id)"""
    ),
    "reading_read_time": sql(
        """SELECT reader_id, coalesce(m, 0.0) AS average_read_time_minutes, coalesce(n, 0)::bigint AS read_sessions_count
        FROM reader LEFT JOIN (
        SELECT reader_id, round_even(sum(us)::double / count(us) / 6e7, 2) AS m, count(us) AS n FROM (
        SELECT first_reader_id AS reader_id, epoch_us(first_reader_ended_at) - epoch_us(first_reader_started_at) AS us FROM read_episode
        UNION ALL SELECT second_reader_id, epoch_us(second_reader_ended_at) - epoch_us(second_reader_started_at) FROM read_episode)
        WHERE reader_id IS NOT NULL GROUP BY 1) USING (reader_id)"""
    ),
    "reading_summary": sql("SELECT * FROM summary"),
    "reading_bso_filter": sql("""SELECT * FROM summary WHERE "BSO Code" IN ('NATION_1', 'NATION_7', 'NATION_20')"""),
    "reading_bso_filter_empty": sql("SELECT * FROM summary"),
    "reading_bso_codes": sql('SELECT DISTINCT "BSO Code" FROM summary'),
    "reading_ellipses": sql(
        """SELECT sigma, round(xm, 6) AS x_mean, round(ym, 6) AS y_mean, round(xs, 6) AS x_std, round(ys, 6) AS y_std,
        round(2 * sigma * xs, 6) AS width, round(2 * sigma * ys, 6) AS height
        FROM (SELECT avg("Recall Rate") AS xm, avg("Discrepant Cancer Rate") AS ym, stddev_pop("Recall Rate") AS xs,
        stddev_pop("Discrepant Cancer Rate") AS ys FROM summary), (VALUES (1), (2), (3)) AS s(sigma)
        WHERE 2 * sigma * xs > 0 AND 2 * sigma * ys > 0"""
    ),
    "reading_quadrants": sql(
        """SELECT "Unique Code", "Recall Rate", "Cancer Detection Rate", round(x, 6) AS x_mean, round(y, 6) AS y_mean,
        CASE WHEN "Recall Rate" <= x AND "Cancer Detection Rate" >= y THEN 'better sensitivity and specificity'
        WHEN "Cancer Detection Rate" >= y THEN 'better sensitivity'
        WHEN "Recall Rate" <= x THEN 'better specificity' ELSE 'poorer sensitivity and specificity' END AS quadrant
        FROM summary, (SELECT avg("Recall Rate") AS x, avg("Cancer Detection Rate") AS y FROM summary)"""
    ),
    "reading_quadrants_of_none": sql(
        """SELECT "Unique Code", "Recall Rate", "Cancer Detection Rate", 0.0 AS x_mean, 0.0 AS y_mean, '' AS quadrant FROM summary WHERE "BSO Code" = 'nowhere'"""
    ),
    "reading_ellipses_of_none": sql(
        """SELECT 1 AS sigma, 0.0 AS x_mean, 0.0 AS y_mean, 0.0 AS x_std, 0.0 AS y_std, 0.0 AS width, 0.0 AS height FROM summary WHERE "BSO Code" = 'nowhere'"""
    ),
    "reading_funnel_points": sql("SELECT * FROM points"),
    "reading_funnel_limits": sql(_limits("points")),
    "reading_funnel_limits_of_some": sql(
        _limits("""(SELECT * FROM points WHERE "Unique Code" IN
        (SELECT reader_id FROM reader WHERE bso_code IN ('NATION_1', 'NATION_7', 'NATION_20')))""")
    ),
}
