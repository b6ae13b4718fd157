"""Reader KPIs: recall, detection, discrepancy, biopsy, interval-cancer and read-time measures.

``tables`` maps domain table names to DataFrames.  Counting runs on pairs that are first made
distinct by a grouped aggregate (combined map-side), so neither a busy reader nor a busy episode
is ever gathered whole in one task.  Every KPI has one row per ``Reader`` row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window as W, functions as F

from tallyscope.functions.rules import count_true, is_recall, micros_between, ratio, says_true

Tables = Mapping[str, DataFrame]


def enrich_decisions(tables: Tables, null_safe: bool = False) -> DataFrame:
    """Decisions of known episodes with image, appointment, screening episode and participant.

    Several images per episode repeat the decision.  ``null_safe`` lets null keys match null keys
    on the appointment and screening-episode joins.

    An episode meets its images and what hangs on them first, so the decisions, which are more and
    wider, move once, and the rows repeated for each image not at all.
    """

    # rows without a key match nothing, so each gets a key of its own: they spread over all tasks
    nothing = F.concat(F.lit("\0"), F.xxhash64("read_episode_id", "participant_id").cast("string"))

    def same(left: str, right: str):
        if null_safe:
            return F.col(left).eqNullSafe(F.col(right))
        return F.coalesce(F.col(left).cast("string"), nothing) == F.col(right).cast("string")

    image = tables["Image"].select("read_episode_id", "appointment_id", "participant_id")
    appointment = tables["Appointment"].select(
        F.col("appointment_id").alias("_appointment"), "screening_episode_id"
    )
    screening = tables["ScreeningEpisode"].select(
        F.col("screening_episode_id").alias("_screening"),
        F.col("participant_id").alias("screening_participant_id"),
    )
    participant = tables["Participant"].select(
        F.col("participant_id").alias("participant_id_participant")
    )
    # an episode without images keeps a row, as a decision's nulls may match null keys
    episodes = (
        tables["ReadEpisode"]
        .select("read_episode_id")
        .join(image, "read_episode_id", "left")
        .join(appointment, same("appointment_id", "_appointment"), "left")
        .join(screening, same("screening_episode_id", "_screening"), "left")
        .join(
            participant,
            same("screening_participant_id", "participant_id_participant"),
            "left",
        )
        .drop("_appointment", "_screening")
    )
    return tables["ReadDecision"].join(episodes, "read_episode_id")


# --- shared sub-plans ------------------------------------------------------------------------


def _known_episodes(tables: Tables) -> DataFrame:
    return tables["ReadEpisode"].select("read_episode_id")


def _cancer_episodes(tables: Tables) -> DataFrame:
    return tables["CancerPresence"].filter(says_true(F.col("cancer_present"))).select("read_episode_id")


def _decision_counts(tables: Tables) -> DataFrame:
    """Distinct decisions and distinct recalled decisions per reader, in one pass."""
    per_decision = (
        tables["ReadDecision"]
        .select("read_episode_id", "reader_id", "read_decision_id", "reader_decision")
        .filter(F.col("reader_id").isNotNull() & F.col("read_decision_id").isNotNull())
        .join(_known_episodes(tables), "read_episode_id", "left_semi")
        .groupBy("reader_id", "read_decision_id")
        .agg(F.bool_or(is_recall(F.col("reader_decision"))).alias("_recalled"))
    )
    return per_decision.groupBy("reader_id").agg(
        F.count(F.lit(1)).alias("read_decision_count"),
        count_true(F.col("_recalled")).alias("recalled_for_assessment_count"),
    )


def _reader_episodes(tables: Tables) -> DataFrame:
    """One row per (episode, reader): did the reader recall, and did the reader not recall."""
    recalled = is_recall(F.col("reader_decision"))
    return (
        tables["ReadDecision"]
        .groupBy("read_episode_id", "reader_id")
        .agg(F.bool_or(recalled).alias("_recalled"), F.bool_or(~recalled).alias("_passed"))
        .filter(F.col("read_episode_id").isNotNull())
    )


def _recalled_pairs(tables: Tables) -> DataFrame:
    """Distinct (reader, episode) with a recall, episode known."""
    return (
        tables["ReadDecision"]
        .filter(is_recall(F.col("reader_decision")) & F.col("reader_id").isNotNull())
        .select("reader_id", "read_episode_id")
        .distinct()
        .join(_known_episodes(tables), "read_episode_id", "left_semi")
    )


def _arbitrated_recalls(tables: Tables) -> DataFrame:
    """Episodes that some arbitration recalled."""
    recalled = (
        tables["ArbitrationDecision"]
        .filter(is_recall(F.col("arbitration_decision")))
        .select("read_decision_id")
    )
    return tables["ReadDecision"].select("read_decision_id", "read_episode_id").join(
        recalled, "read_decision_id", "left_semi"
    )


def _detected_counts(tables: Tables, name: str) -> DataFrame:
    return (
        _recalled_pairs(tables)
        .join(_cancer_episodes(tables), "read_episode_id", "left_semi")
        .groupBy("reader_id")
        .agg(F.count(F.lit(1)).alias(name))
    )


def _outcome_counts(tables: Tables) -> DataFrame:
    """Detected and discrepant cancers per reader from one pass over the decisions.

    An episode has at most one row per reader here, so the window over an episode is bounded by
    the number of readers.
    """
    no = F.lit(False)
    facts = (
        _cancer_episodes(tables).select("read_episode_id", F.lit(True).alias("_cancer"), no.alias("_known"), no.alias("_arbitrated"))
        .unionByName(_known_episodes(tables).select("read_episode_id", no.alias("_cancer"), F.lit(True).alias("_known"), no.alias("_arbitrated")))
        .unionByName(_arbitrated_recalls(tables).select("read_episode_id", no.alias("_cancer"), no.alias("_known"), F.lit(True).alias("_arbitrated")))
        .groupBy("read_episode_id")
        .agg(*[F.bool_or(c).alias(c) for c in ("_cancer", "_known", "_arbitrated")])
        .filter("_cancer")
    )
    in_episode = W.partitionBy("read_episode_id")
    rows = (
        _reader_episodes(tables)
        .join(facts, "read_episode_id")
        .withColumn("_any_recall", F.bool_or("_recalled").over(in_episode))
        .filter(F.col("reader_id").isNotNull())
    )
    return rows.groupBy("reader_id").agg(
        count_true(F.col("_recalled") & F.col("_known")).alias("cancers_detected_count"),
        count_true(F.col("_passed") & (F.col("_any_recall") | F.col("_arbitrated"))).alias(
            "discrepant_cancers_count"
        ),
    )


def _for_all_readers(tables: Tables, counts: DataFrame, *columns: str) -> DataFrame:
    """Counts for every ``Reader`` row, 0 where the reader has none."""
    return (
        tables["Reader"]
        .select("reader_id")
        .join(counts, "reader_id", "left")
        .select("reader_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in columns])
    )


def _ranked(df: DataFrame, measure: str) -> DataFrame:
    return df.orderBy(F.desc(measure), F.asc("reader_id"))


# --- KPIs ------------------------------------------------------------------------------------


def kpi_images_read(tables: Tables) -> DataFrame:
    out = _for_all_readers(tables, _decision_counts(tables), "read_decision_count")
    return _ranked(out, "read_decision_count")


def kpi_recalled(tables: Tables) -> DataFrame:
    out = _for_all_readers(tables, _decision_counts(tables), "recalled_for_assessment_count")
    return _ranked(out, "recalled_for_assessment_count")


def kpi_recall_pct(tables: Tables) -> DataFrame:
    counts = _for_all_readers(
        tables, _decision_counts(tables), "read_decision_count", "recalled_for_assessment_count"
    )
    rate = ratio(F.col("recalled_for_assessment_count"), F.col("read_decision_count"), 100)
    return _ranked(counts.withColumn("recalled_for_assessment_pct", rate), "recalled_for_assessment_pct")


def kpi_ppv(tables: Tables) -> DataFrame:
    """Recalled *episodes* with cancer over recalled *decisions*."""
    hits = _detected_counts(tables, "cancers_detected_after_recall_count")
    counts = _for_all_readers(
        tables,
        _decision_counts(tables).join(hits, "reader_id", "left"),
        "recalled_for_assessment_count",
        "cancers_detected_after_recall_count",
    )
    rate = ratio(F.col("cancers_detected_after_recall_count"), F.col("recalled_for_assessment_count"), 100)
    return _ranked(counts.withColumn("ppv_recall_for_assessment_pct", rate), "ppv_recall_for_assessment_pct")


def kpi_cancers_detected(tables: Tables) -> DataFrame:
    counts = _detected_counts(tables, "cancers_detected_count")
    return _ranked(_for_all_readers(tables, counts, "cancers_detected_count"), "cancers_detected_count")


def kpi_detection_rate(tables: Tables) -> DataFrame:
    hits = _detected_counts(tables, "cancers_detected_count")
    counts = _for_all_readers(
        tables,
        _decision_counts(tables).join(hits, "reader_id", "left"),
        "read_decision_count",
        "cancers_detected_count",
    )
    rate = ratio(F.col("cancers_detected_count"), F.col("read_decision_count"), 1000)
    return _ranked(counts.withColumn("cancer_detection_rate_per_1000", rate), "cancer_detection_rate_per_1000")


def kpi_discrepant(tables: Tables) -> DataFrame:
    """Cancers a reader passed although a recall exists on the episode (any reader, or arbitration).

    A reader with both a recall and a pass on one episode counts as discrepant.
    """
    counts = _for_all_readers(tables, _outcome_counts(tables), "discrepant_cancers_count")
    return _ranked(counts, "discrepant_cancers_count")


def kpi_discrepant_rate(tables: Tables) -> DataFrame:
    counts = _for_all_readers(
        tables, _outcome_counts(tables), "cancers_detected_count", "discrepant_cancers_count"
    )
    total = F.col("cancers_detected_count") + F.col("discrepant_cancers_count")
    out = counts.withColumn("total_cancer_cases_for_reader", total).withColumn(
        "discrepant_cancer_rate_pct", ratio(F.col("discrepant_cancers_count"), total, 100)
    )
    return _ranked(out, "discrepant_cancer_rate_pct")


def kpi_biopsies(tables: Tables) -> DataFrame:
    biopsied = tables["Biopsies"].select("read_episode_id")
    counts = (
        _recalled_pairs(tables)
        .join(biopsied, "read_episode_id", "left_semi")
        .groupBy("reader_id")
        .agg(F.count(F.lit(1)).alias("biopsies_count"))
    )
    return _ranked(_for_all_readers(tables, counts, "biopsies_count"), "biopsies_count")


def kpi_benign_biopsy_rate(tables: Tables) -> DataFrame:
    benign = tables["Biopsies"].filter(F.lower("biopsy_result") == "benign").select("read_episode_id")
    hits = (
        _recalled_pairs(tables)
        .join(benign, "read_episode_id", "left_semi")
        .groupBy("reader_id")
        .agg(F.count(F.lit(1)).alias("benign_biopsies_count"))
    )
    counts = _for_all_readers(
        tables,
        _decision_counts(tables).join(hits, "reader_id", "left"),
        "read_decision_count",
        "benign_biopsies_count",
    )
    rate = ratio(F.col("benign_biopsies_count"), F.col("read_decision_count"), 1000)
    return _ranked(counts.withColumn("benign_biopsy_rate_per_1000", rate), "benign_biopsy_rate_per_1000")


def kpi_interval_cancers(tables: Tables) -> DataFrame:
    """Readers' screening participants with a confirmed interval cancer.

    The participants are cut down to positives before the chain meets the decisions, and both
    sides are distinct by then.
    """
    positive = (
        tables["IntervalCancers"]
        .filter(says_true(F.col("interval_cancer_found")))
        .select(F.col("participant_id").alias("_participant"))
    )
    screening = tables["ScreeningEpisode"].select(
        "screening_episode_id", F.col("participant_id").alias("_participant")
    )
    episode_participant = (
        screening.join(positive, "_participant", "left_semi")
        .join(tables["Appointment"].select("appointment_id", "screening_episode_id"), "screening_episode_id")
        .select("appointment_id", "_participant")
        .join(tables["Image"].select("read_episode_id", "appointment_id"), "appointment_id")
        .select("read_episode_id", "_participant")
        .distinct()
    )
    counts = (
        tables["ReadDecision"]
        .filter(F.col("reader_id").isNotNull())
        .select("read_episode_id", "reader_id")
        .distinct()
        .join(_known_episodes(tables), "read_episode_id", "left_semi")
        .join(episode_participant, "read_episode_id")
        .select("reader_id", "_participant")
        .distinct()
        .groupBy("reader_id")
        .agg(F.count(F.lit(1)).alias("interval_cancers_count"))
    )
    return _ranked(_for_all_readers(tables, counts, "interval_cancers_count"), "interval_cancers_count")


def kpi_read_time(tables: Tables) -> DataFrame:
    """Mean minutes and number of timed reads, first and second reader alike.

    Both spans come from one scan; the sum is over whole microseconds, so it is exact.
    """
    spans = (
        tables["ReadEpisode"]
        .select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.col(f"{who}_reader_id").alias("reader_id"),
                            F.col(f"{who}_reader_started_at").alias("started_at"),
                            F.col(f"{who}_reader_ended_at").alias("ended_at"),
                        )
                        for who in ("first", "second")
                    ]
                )
            ).alias("read")
        )
        .select("read.*")
        .filter(F.col("reader_id").isNotNull())
        .withColumn("_micros", micros_between(F.col("started_at"), F.col("ended_at")))
    )
    per_reader = spans.groupBy("reader_id").agg(
        F.sum("_micros").alias("_total"), F.count("_micros").alias("read_sessions_count")
    )
    minutes = F.bround(F.col("_total") / F.nullif(F.col("read_sessions_count"), F.lit(0)) / F.lit(6e7), 2)
    out = (
        tables["Reader"]
        .select("reader_id")
        .join(per_reader, "reader_id", "left")
        .select(
            "reader_id",
            F.coalesce(minutes, F.lit(0.0)).alias("average_read_time_minutes"),
            F.coalesce("read_sessions_count", F.lit(0)).cast("bigint").alias("read_sessions_count"),
        )
    )
    return _ranked(out, "average_read_time_minutes")


# --- summary ---------------------------------------------------------------------------------


def summary_table(tables: Tables) -> DataFrame:
    """Ten-column reader summary from one decision count and one outcome count per reader."""
    counts = (
        tables["Reader"]
        .select("reader_id", "bso_code")
        .join(_decision_counts(tables), "reader_id", "left")
        .join(_outcome_counts(tables), "reader_id", "left")
        .na.fill(0)
    )
    # fixed values: the column names of the summary
    reads, recalls = F.col("read_decision_count"), F.col("recalled_for_assessment_count")
    detected, discrepant = F.col("cancers_detected_count"), F.col("discrepant_cancers_count")
    return counts.select(
        F.col("reader_id").alias("Unique Code"),
        F.coalesce(F.col("bso_code").cast("string"), F.lit("0")).alias("BSO Code"),
        reads.alias("Total Cases Reported as First & Second Reader"),
        recalls.alias("Total Recalled to assessment"),
        ratio(recalls, reads, 100).alias("Recall Rate"),
        detected.alias("Total Cancers Detected"),
        ratio(detected, reads, 1000).alias("Cancer Detection Rate"),
        ratio(detected, recalls, 100).alias("PPV"),
        discrepant.alias("Total Discrepant Cancers"),
        ratio(discrepant, detected + discrepant, 100).alias("Discrepant Cancer Rate"),
    ).orderBy("Unique Code")


def filter_by_bso(df: DataFrame, codes: list | None) -> DataFrame:
    """Rows of the given BSO codes; no codes means all rows.  Codes are compared as text."""
    if not codes:
        return df
    return df.filter(F.col("BSO Code").cast("string").isin([str(code) for code in codes]))


def bso_codes(summary: DataFrame) -> DataFrame:
    """Pick list of BSO codes as sorted text."""
    code = F.col("BSO Code").cast("string").alias("BSO Code")
    return summary.select(code).filter(F.col("BSO Code").isNotNull()).distinct().orderBy("BSO Code")
