"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tallyscope.operators import census, perturb  # noqa: E402
from tallyscope.plans import registry  # noqa: E402
from tallyscope.plans.table_queries import _LINE_KEY, line_numbers  # noqa: E402
from tallyscope.session import build_session, fresh_path  # noqa: E402
from tallyscope.sources.sinks import write_jsonl  # noqa: E402
from tallyscope.sources.tables import parquet_table  # noqa: E402

HEADLINE = [
    "reading_summary",
    "reading_enriched_decisions",
    "reading_interval_cancers",
    "reading_read_time",
    "reading_funnel_limits",
    "screening_round_length_flag",
    "screening_uptake",
    "screening_round_length",
    "census_matrix_cube",
    "census_matrix_overflow",
    "perturb_typed_cells",
    "perturb_past_dates",
    "period_counts",
    "synthetic_episodes",
    "synthetic_subjects",
    "catalog_build",
    "request_run_summary",
    "event_unnested",
]

RUNS = 2  # the better of two: the first run of a query also compiles its code
COPIES = 16


def run(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def best(work) -> float:
    """Seconds of the better of ``RUNS`` runs."""
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        work()
        times.append(time.perf_counter() - start)
    return min(times)


def staged(df):
    path = fresh_path(df.sparkSession, "bench")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def wide_cube(spark, folder):
    """Responses of about 10,000 cells: line item quantities, ``COPIES`` data sets of each list."""
    lineitem = parquet_table(spark, folder, "lineitem")
    options = json.dumps([{"id": str(i), "label": f"label {i}"} for i in range(100)])
    dims = f'[{{"dimension_name":"a","options":{options}}},{{"dimension_name":"b","options":{options}}}]'
    lists = lineitem.groupBy(F.expr("l_orderkey div 2500").alias("n")).agg(F.collect_list("l_quantity").alias("v"))
    copies = lists.select("n", "v", F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy"))
    return copies.repartition("n", "copy").select(
        F.format_string("RM%06d-%02d", "n", "copy").alias("dataset_id"), F.lit("la").alias("geo_level"),
        F.lit(1).cast("bigint").alias("batch_no"),
        F.concat(F.lit('{"dimensions":' + dims + ',"observations":'), F.to_json("v"), F.lit("}")).alias("json"),
    )


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__driver__memory="12g", spark__sql__shuffle__partitions=cpus,
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["reading_summary"](spark, folder.replace("sf0.1", "sf0.001")).collect()  # start the workers
    times = {}
    for name in HEADLINE:
        for _ in range(RUNS):
            start = time.perf_counter()
            run(queries[name](spark, folder))
            times[name] = round(min(times.get(name, 1e9), time.perf_counter() - start), 3)

    rates = {}
    cells = parquet_table(spark, folder, "lineitem").count()
    cube = staged(wide_cube(spark, folder))
    n = cube.select(F.sum(F.size(F.from_json("json", "observations array<string>")["observations"]))).first()[0]
    rates["flatten_cells"] = n
    rates["flatten_cells_per_sec"] = round(n / best(lambda: run(census.flatten(cube))))
    wide = line_numbers(spark, folder)
    for fast in (False, True):
        seconds = best(lambda: run(perturb.perturb(wide, _LINE_KEY, seed=1, fast=fast)))  # noqa: B023
        rates["perturb_cells_per_sec" + ("_fast" if fast else "")] = round(3 * cells / seconds)
    # 100,000 events of 100 pairs each as JSON lines, the events taken from the given table
    events = parquet_table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.col("ts").cast("string").alias("timestamp"), "props")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda j: F.create_map(F.concat(F.lit("key_"), j), F.concat(F.lit("value_"), j, F.col("props"))))
    rates["json_lines_events"] = events.count()
    rates["json_lines_sec"] = round(best(lambda: write_jsonl(events.select("id", "name", "timestamp", pairs.alias("payload")), fresh_path(spark, "lines"))), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": rates,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
