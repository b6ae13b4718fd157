"""The supplied tables seen as image-reading tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyscope.functions.rules import RECALL
from tallyscope.sources.tables import LazyTables, parquet_table


def reading_tables(spark: SparkSession, folder: str) -> LazyTables:
    def table(name: str) -> DataFrame:
        return parquet_table(spark, folder, name)

    decision_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("read_decision_id")

    def reader():
        return (
            table("supplier")
            .join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(F.col("s_suppkey").alias("reader_id"), F.col("n_name").alias("bso_code"))
        )

    def read_decision():
        return table("lineitem").select(
            decision_id,
            F.col("l_orderkey").alias("read_episode_id"),
            F.col("l_suppkey").alias("reader_id"),
            F.when(F.col("l_returnflag") == "R", RECALL).otherwise("Normal").alias("reader_decision"),
        )

    def read_episode():
        order_readers = table("lineitem").groupBy("l_orderkey").agg(
            F.min("l_suppkey").alias("first_reader_id"), F.max("l_suppkey").alias("_last")
        )
        return (
            table("orders")
            .join(order_readers, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(
                F.col("o_orderkey").alias("read_episode_id"),
                "first_reader_id",
                F.col("o_orderdate").alias("first_reader_started_at"),
                F.expr(
                    "o_orderdate + make_dt_interval(0, 0, cast(o_custkey % 45 + 1 as int), o_orderkey % 60)"
                ).alias("first_reader_ended_at"),
                F.when(F.col("_last") != F.col("first_reader_id"), F.col("_last")).alias("second_reader_id"),
                F.expr("o_orderdate + INTERVAL '1' DAY").alias("second_reader_started_at"),
                F.expr("o_orderdate + make_dt_interval(1, 0, cast(o_custkey % 30 + 1 as int), 0)").alias(
                    "second_reader_ended_at"
                ),
            )
        )

    def image():
        """Two views per order; the right view of a finished order has no appointment."""
        views = table("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", F.explode(F.array(F.lit("L"), F.lit("R"))).alias("view")
        )
        unbooked = (F.col("o_orderstatus") == "F") & (F.col("view") == "R")
        return views.select(
            F.concat_ws("-", "o_orderkey", "view").alias("image_id"),
            F.when(~unbooked, F.col("o_orderkey")).alias("appointment_id"),
            F.col("o_custkey").alias("participant_id"),
            F.col("o_orderkey").alias("read_episode_id"),
        )

    def appointment():
        return table("orders").select(
            F.col("o_orderkey").alias("appointment_id"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey") + 1000000).alias("screening_episode_id"),
        )

    def screening_episode():
        return table("orders").select(
            (F.col("o_orderkey") + 1000000).alias("screening_episode_id"), F.col("o_custkey").alias("participant_id")
        )

    def participant():
        return table("customer").select(F.col("c_custkey").alias("participant_id"))

    def cancer_presence():
        priority = F.col("o_orderpriority")
        present = F.when(priority == "1-URGENT", "TRUE").when(priority == "2-HIGH", "true").when(priority == "3-MEDIUM", "False")
        return table("orders").select(F.col("o_orderkey").alias("read_episode_id"), present.alias("cancer_present"))

    def biopsies():
        result = F.when(F.col("o_orderstatus") == "F", "Benign").otherwise("malignant")
        return table("orders").filter(F.col("o_orderstatus").isin("F", "P")).select(
            F.col("o_orderkey").alias("read_episode_id"), result.alias("biopsy_result")
        )

    def interval_cancers():
        return table("customer").select(
            F.col("c_custkey").alias("participant_id"),
            F.when(F.col("c_acctbal") < 0, "True").otherwise("FALSE").alias("interval_cancer_found"),
        )

    def arbitration_decision():
        decision = F.when(F.col("l_tax") > 0.05, RECALL).otherwise("Normal")
        return table("lineitem").filter(F.col("l_linestatus") == "O").select(
            decision_id, decision.alias("arbitration_decision")
        )

    return LazyTables(
        {
            "Reader": reader,
            "ReadDecision": read_decision,
            "ReadEpisode": read_episode,
            "Image": image,
            "Appointment": appointment,
            "ScreeningEpisode": screening_episode,
            "Participant": participant,
            "CancerPresence": cancer_presence,
            "Biopsies": biopsies,
            "IntervalCancers": interval_cancers,
            "ArbitrationDecision": arbitration_decision,
        }
    )


CTES: dict[str, str] = {
    "reader": "SELECT s_suppkey AS reader_id, n_name AS bso_code FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    "read_decision": f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS read_decision_id,
        l_orderkey AS read_episode_id, l_suppkey AS reader_id,
        CASE WHEN l_returnflag = 'R' THEN '{RECALL}' ELSE 'Normal' END AS reader_decision FROM lineitem""",
    "read_episode": """SELECT o_orderkey AS read_episode_id, f AS first_reader_id,
        o_orderdate AS first_reader_started_at,
        o_orderdate + to_minutes(o_custkey % 45 + 1) + to_seconds(o_orderkey % 60) AS first_reader_ended_at,
        CASE WHEN l <> f THEN l END AS second_reader_id,
        o_orderdate + INTERVAL 1 DAY AS second_reader_started_at,
        o_orderdate + INTERVAL 1 DAY + to_minutes(o_custkey % 30 + 1) AS second_reader_ended_at
        FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS f, max(l_suppkey) AS l FROM lineitem GROUP BY 1)
        ON o_orderkey = l_orderkey""",
    "image": """SELECT o_orderkey || '-' || v AS image_id,
        CASE WHEN NOT (o_orderstatus = 'F' AND v = 'R') THEN o_orderkey END AS appointment_id,
        o_custkey AS participant_id, o_orderkey AS read_episode_id
        FROM orders CROSS JOIN (VALUES ('L'), ('R')) AS views(v)""",
    "appointment": """SELECT o_orderkey AS appointment_id,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey + 1000000 END AS screening_episode_id FROM orders""",
    "screening_episode": "SELECT o_orderkey + 1000000 AS screening_episode_id, o_custkey AS participant_id FROM orders",
    "participant": "SELECT c_custkey AS participant_id FROM customer",
    "cancer_presence": """SELECT o_orderkey AS read_episode_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'TRUE'
        WHEN '2-HIGH' THEN 'true' WHEN '3-MEDIUM' THEN 'False' END AS cancer_present FROM orders""",
    "biopsies": """SELECT o_orderkey AS read_episode_id,
        CASE WHEN o_orderstatus = 'F' THEN 'Benign' ELSE 'malignant' END AS biopsy_result
        FROM orders WHERE o_orderstatus IN ('F', 'P')""",
    "interval_cancers": """SELECT c_custkey AS participant_id,
        CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'FALSE' END AS interval_cancer_found FROM customer""",
    "arbitration_decision": f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS read_decision_id,
        CASE WHEN l_tax > 0.05 THEN '{RECALL}' ELSE 'Normal' END AS arbitration_decision
        FROM lineitem WHERE l_linestatus = 'O'""",
    "enriched": """SELECT d.*, i.appointment_id, i.participant_id, a.screening_episode_id,
        s.participant_id AS screening_participant_id, p.participant_id AS participant_id_participant
        FROM read_decision d JOIN read_episode e USING (read_episode_id)
        LEFT JOIN image i ON i.read_episode_id = d.read_episode_id
        LEFT JOIN appointment a ON a.appointment_id = i.appointment_id
        LEFT JOIN screening_episode s ON s.screening_episode_id = a.screening_episode_id
        LEFT JOIN participant p ON p.participant_id = s.participant_id""",
    "k1": "SELECT reader_id, count(DISTINCT read_decision_id) AS n FROM enriched GROUP BY 1",
    "k2": f"SELECT reader_id, count(DISTINCT read_decision_id) AS n FROM enriched WHERE reader_decision = '{RECALL}' GROUP BY 1",
    "recalled_pairs": f"SELECT DISTINCT reader_id, read_episode_id FROM enriched WHERE reader_decision = '{RECALL}'",
    "k5": """SELECT reader_id, count(DISTINCT read_episode_id) AS n FROM recalled_pairs JOIN cancer_presence USING (read_episode_id)
        WHERE lower(cancer_present) = 'true' GROUP BY 1""",
    "positive_rows": f"""SELECT DISTINCT read_episode_id, reader_id, reader_decision, (reader_decision = '{RECALL}')::int AS own
        FROM read_decision SEMI JOIN (SELECT read_episode_id FROM cancer_presence WHERE lower(cancer_present) = 'true') USING (read_episode_id)""",
    "arbitrated": f"""SELECT read_episode_id, bool_or(arbitration_decision = '{RECALL}') AS a
        FROM arbitration_decision LEFT JOIN read_decision USING (read_decision_id) GROUP BY 1""",
    "k7": """SELECT reader_id, count(DISTINCT read_episode_id) AS n FROM positive_rows
        LEFT JOIN (SELECT read_episode_id, sum(own) AS c FROM positive_rows GROUP BY 1) USING (read_episode_id)
        LEFT JOIN arbitrated USING (read_episode_id)
        WHERE own = 0 AND (c - own > 0 OR coalesce(a, false)) GROUP BY 1""",
    "all_counts": """SELECT r.reader_id, r.bso_code, coalesce(k1.n, 0)::bigint AS reads, coalesce(k2.n, 0)::bigint AS recalls,
        coalesce(k5.n, 0)::bigint AS detected, coalesce(k7.n, 0)::bigint AS discrepant
        FROM reader r LEFT JOIN k1 USING (reader_id) LEFT JOIN k2 USING (reader_id)
        LEFT JOIN k5 USING (reader_id) LEFT JOIN k7 USING (reader_id)""",
    "summary": """SELECT reader_id AS "Unique Code", coalesce(bso_code, '0') AS "BSO Code",
        reads AS "Total Cases Reported as First & Second Reader", recalls AS "Total Recalled to assessment",
        coalesce(round_even(recalls / nullif(reads, 0) * 100, 2), 0.0) AS "Recall Rate",
        detected AS "Total Cancers Detected",
        coalesce(round_even(detected / nullif(reads, 0) * 1000, 2), 0.0) AS "Cancer Detection Rate",
        coalesce(round_even(detected / nullif(recalls, 0) * 100, 2), 0.0) AS "PPV",
        discrepant AS "Total Discrepant Cancers",
        coalesce(round_even(discrepant / nullif(detected + discrepant, 0) * 100, 2), 0.0) AS "Discrepant Cancer Rate"
        FROM all_counts""",
    "points": """SELECT "Unique Code", "Cancer Detection Rate", coalesce(n, 0)::bigint AS "Number of first reads"
        FROM summary LEFT JOIN (SELECT first_reader_id, count(*) AS n FROM read_episode WHERE first_reader_id IS NOT NULL GROUP BY 1)
        ON first_reader_id = "Unique Code" WHERE coalesce(n, 0) > 0""",
}


def sql(body: str) -> str:
    """The body preceded by all reading expressions (unused ones cost nothing)."""
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in CTES.items()) + "\n" + body
