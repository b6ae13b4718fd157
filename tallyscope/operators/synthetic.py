"""Screening episodes and subjects: drawn columns and derived columns.

Every rule takes a DataFrame and returns it with one more column.  Draws are keyed by episode or
by person (see ``functions.draws``), so any part of a table can be made again on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyscope.functions.draws import bernoulli, choose, uniform_date, uniform_int, unit
from tallyscope.functions.rules import add_months
from tallyscope.operators.positions import number_rows, running_offset

# Fixed values of the generator.
FIRST_OFFER, LAST_OFFER = "2024-04-01", "2025-03-31"
OFFER_GAPS = ((35, 0.9), (37, 0.1))
END_POINT = "S-,W+,H-"
AUTHORISERS = ("GP", "SCREENING_OFFICE")
RADIOTHERAPY_REASONS = ("RADIOTHERAPY_BELOW_30", "RADIOTHERAPY_LOWER", "RADIOTHERAPY_UPPER")
GENE_REASONS = ("BRCA_RISK", "BRCA_TESTED", "HR_GENE_UNTESTED", "OTHER_GENE_MUTATIONS")

# Entries of a code list that is drawn from in a projection; longer lists are joined by slot.
MOST_CODES = 100_000
# Parts of equal chance that every group of rows to draw from is cut into.
SLOTS = 256

EPISODE, PERSON = "episode_id", "nhs_number"


# --- general operators -----------------------------------------------------------------------


def explode_by(df: DataFrame, count: str, order: str, n: int | None = None, position: str = "position") -> DataFrame:
    """Each row ``count`` times, numbered from 0 in ``order`` (an integer column), first ``n`` kept."""
    placed = running_offset(df, count, order, name="_offset")
    if n is not None:
        placed = placed.filter(F.col("_offset") < n)
    copies = placed.filter(F.col(count) > 0).select("*", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("_copy"))
    numbered = copies.withColumn(position, F.col("_offset") + F.col("_copy") - 1).drop("_offset", "_copy")
    return numbered if n is None else numbered.filter(F.col(position) < n)


def _slots(dim: DataFrame, columns: Sequence[str], match: str | None) -> DataFrame:
    """(_group, _slot, _first, _size, _rows): for each slot of a group's chances the rows it may hit, in order.

    A group of n rows has n / ``SLOTS`` of them in a slot, and a small group the same row in several."""
    keys = [match] if match else []
    numbered = number_rows(dim, [F.col(c) for c in columns], keys, "_number")
    sizes = dim.groupBy(*[F.col(k).alias("_of") for k in keys]).agg(F.count(F.lit(1)).alias("_size"))
    sized = numbered.join(sizes, F.col(match) == F.col("_of")) if match else numbered.withColumn("_size", F.lit(sizes.scalar()))
    # one slot more at either end, as a product may round up to the next row
    low = F.greatest(F.expr(f"-((-_number * {SLOTS}L) div _size) - 2"), F.lit(0))
    high = F.least(F.expr(f"((_number + 1) * {SLOTS}L) div _size"), F.lit(SLOTS - 1))
    placed = sized.select(*[F.col(k).alias("_group") for k in keys], "_size", "_number", F.struct(*columns).alias("_row"), F.explode(F.sequence(low, high)).alias("_slot"))
    listed = F.sort_array(F.collect_list(F.struct("_number", "_row")))
    return placed.groupBy(*["_group" for _ in keys], "_slot").agg(
        F.min("_number").alias("_first"), F.first("_size").alias("_size"), F.transform(listed, lambda x: x["_row"]).alias("_rows")
    )


def assign_from(
    df: DataFrame, dim: DataFrame, key: Column, name: str, seed, match: str | None = None
) -> DataFrame:
    """One row of ``dim`` per key, drawn evenly; with ``match``, among the rows of the same group.

    Drawn in two steps: the draw falls into one of ``SLOTS`` slots of its group, which the rows of ``df``
    know without looking anything up, and a join by (group, slot) fetches the few rows that the slot can
    hit.  A group with most of ``df`` is so spread over its slots, and ``dim`` may be of any size.
    Nulls where the group is empty.
    """
    columns = [c for c in dim.columns if c != match]
    drawn = df.withColumn("_draw", unit(key, name, seed)).withColumn("_at", F.floor(F.col("_draw") * SLOTS).cast("bigint"))
    same = F.col("_at") == F.col("_slot")
    if match:
        same = same & (F.col(match) == F.col("_group"))
    joined = drawn.join(_slots(dim, columns, match), same, "left")
    place = (F.floor(F.col("_draw") * F.col("_size")).cast("bigint") - F.col("_first")).cast("int")
    found = joined.withColumn("_row", F.get("_rows", place))
    return found.withColumns({c: F.col(f"_row.{c}") for c in columns}).drop("_draw", "_at", "_slot", "_group", "_first", "_size", "_rows", "_row")


def drawn_code(codes: DataFrame, key: Column, name: str, seed) -> Column:
    """One value of a single-column code list, drawn evenly by the key: a projection without a join.

    The list is one sorted array; a list of more than ``MOST_CODES`` entries is an error here (see
    ``assign_from``).  Repeated codes are drawn as often as they occur, nulls are no codes, and an empty
    list gives null."""
    some = codes.limit(MOST_CODES + 1)  # no more is ever gathered
    listed = some.agg(F.sort_array(F.collect_list(codes.columns[0])).alias("codes"), F.count(F.lit(1)).alias("n"))
    too_long = F.raise_error(F.lit(f"more than {MOST_CODES} codes")).cast("array<string>")
    listed = listed.select(F.when(F.col("n") > MOST_CODES, too_long).otherwise(F.col("codes")).alias("codes")).scalar()
    return F.get(listed, F.floor(unit(key, name, seed) * F.size(listed)).cast("int"))


def with_code(df: DataFrame, codes: DataFrame, key: Column, name: str, seed, column: str) -> DataFrame:
    """``column``: a code drawn as by ``drawn_code``, from a list of any length.

    Lists of up to ``MOST_CODES`` entries are drawn from in a projection, longer ones by ``assign_from``;
    the draws are the same."""
    listed = codes.select(F.col(codes.columns[0]).alias(column)).filter(F.col(column).isNotNull())
    if listed.limit(MOST_CODES + 1).count() <= MOST_CODES:
        return df.withColumn(column, drawn_code(listed, key, name, seed))
    return assign_from(df, listed, key, name, seed)


def _code_from(df, mapping, name, seed, when: Column, otherwise: Column | None, skip: str | None = None, key=EPISODE):
    """Column ``name``: a drawn code of the mapping where ``when`` holds, else ``otherwise``."""
    codes = mapping.select("code")
    if skip is not None:
        codes = codes.filter(F.col("code") != skip)
    other = F.lit(None).cast("string") if otherwise is None else otherwise
    drawn = with_code(df, codes, F.col(key), f"{name}_code", seed, "_code")
    return drawn.withColumn(name, F.when(when, F.col("_code")).otherwise(other)).drop("_code")


# --- episodes --------------------------------------------------------------------------------


def appointment_made(df: DataFrame, seed, p: float = 0.95) -> DataFrame:
    return df.withColumn("appointment_made", bernoulli(F.col(EPISODE), "appointment_made", p, seed))


def date_of_foa(df: DataFrame, seed) -> DataFrame:
    """First offered appointments of a person's first three episodes, going back in time.

    Each step is 35 or 37 months before the previous one; steps count also where no appointment was
    made, and only then is the date blank.  Later episodes have none.  The window only ever holds
    three rows per person: the ranking filter is applied before the shuffle as well.
    """
    by_episode = W.partitionBy(PERSON).orderBy(EPISODE)
    gaps, weights = zip(*OFFER_GAPS)
    first_three = (
        df.select(PERSON, EPISODE)
        .withColumn("_turn", F.row_number().over(by_episode))
        .filter(F.col("_turn") <= 3)
        .withColumn("_gap", choose(F.col(EPISODE), "offer_gap", gaps, seed, weights))
        .withColumn("_gap_before", F.lag("_gap").over(by_episode))
    )
    first = uniform_date(F.col(PERSON), "first_offer", FIRST_OFFER, LAST_OFFER, seed)
    dated = first_three.select(
        F.col(EPISODE).alias("_episode"),
        F.when(F.col("_turn") == 1, first)
        .when(F.col("_turn") == 2, add_months(first, -F.col("_gap")))
        .otherwise(add_months(add_months(first, -F.col("_gap_before")), -F.col("_gap")))
        .alias("_date"),
    )
    joined = df.join(dated, F.col(EPISODE) == F.col("_episode"), "left")
    return joined.withColumn("date_of_foa", F.when(F.col("appointment_made"), F.col("_date"))).drop("_episode", "_date")


def date_of_as(df: DataFrame, seed) -> DataFrame:
    """Attendance: none for 15%, 6 to 7 months after the offer for 5%, else 0 to 6 months."""
    key, offer = F.col(EPISODE), F.col("date_of_foa")
    u = unit(key, "attendance", seed)
    late = uniform_int(key, "late_months", 6, 7, seed)
    normal = uniform_int(key, "months", 0, 6, seed)
    attended = F.when(u < 0.15, None).when(u < 0.20, add_months(offer, late)).otherwise(add_months(offer, normal))
    return df.withColumn("date_of_as", F.when(offer.isNotNull(), attended))


def episode_date(df: DataFrame, seed) -> DataFrame:
    """Two weeks before the offer, or any day of the year without one."""
    drawn = uniform_date(F.col(EPISODE), "episode_date", FIRST_OFFER, LAST_OFFER, seed)
    return df.withColumn("episode_date", F.coalesce(F.date_sub("date_of_foa", 14), drawn))


def early_recall_date(df: DataFrame, seed) -> DataFrame:
    recalled = bernoulli(F.col(EPISODE), "early_recall", 0.05, seed)
    return df.withColumn("early_recall_date", F.when(recalled, F.col("date_of_foa")))


def change_db_date_time(df: DataFrame, seed) -> DataFrame:
    """Any second of the episode date."""
    second = uniform_int(F.col(EPISODE), "change_second", 0, 86399, seed)
    moment = F.col("episode_date").cast("timestamp_ntz") + F.make_dt_interval(secs=second)
    return df.withColumn("change_db_date_time", moment)


def episode_type(df: DataFrame, mapping: DataFrame, seed) -> DataFrame:
    routine = bernoulli(F.col(EPISODE), "routine", 0.8, seed)
    return _code_from(df, mapping, "episode_type", seed, ~routine, F.lit("R"), skip="R")


def end_code(df: DataFrame) -> DataFrame:
    code = (
        F.when(~F.coalesce("appointment_made", F.lit(False)), "DNR")
        .when(F.col("date_of_as").isNotNull(), "SC")
        .otherwise("DNA")
    )
    return df.withColumn("end_code", code)


def call_recall_status_authorised_by(df: DataFrame, seed) -> DataFrame:
    who = choose(F.col(EPISODE), "authorised_by", AUTHORISERS, seed)
    return df.withColumn("call_recall_status_authorised_by", F.when(F.col("episode_type") == "R", who))


def end_code_last_updated(df: DataFrame) -> DataFrame:
    return df.withColumn("end_code_last_updated", add_months(F.col("change_db_date_time"), 8))


def bso_organisation_code(df: DataFrame, organisations: DataFrame, seed) -> DataFrame:
    """One organisation per person."""
    codes = organisations.select("bso_organisation_code")
    return with_code(df, codes, F.col(PERSON), "bso", seed, "bso_organisation_code")


def bso_batch_id(df: DataFrame, seed) -> DataFrame:
    """Organisation, six digits, a capital letter."""
    digits = F.lpad(uniform_int(F.col(EPISODE), "batch_digits", 0, 999999, seed).cast("string"), 6, "0")
    letter = F.char(65 + uniform_int(F.col(EPISODE), "batch_letter", 0, 25, seed))
    return df.withColumn("bso_batch_id", F.concat("bso_organisation_code", digits, letter))


def reason_closed_code(df: DataFrame) -> DataFrame:
    code = F.when(F.col("end_code").isin("DNR", "DNA"), "NA").when(F.col("end_code") == "SC", "R")
    return df.withColumn("reason_closed_code", code)


def end_point(df: DataFrame) -> DataFrame:
    return df.withColumn("end_point", F.lit(END_POINT))


def final_action_code(df: DataFrame, mapping: DataFrame, seed) -> DataFrame:
    closed = F.col("reason_closed_code") == "R"
    routine = bernoulli(F.col(EPISODE), "routine_recall", 0.9, seed)
    return _code_from(
        df, mapping, "final_action_code", seed, closed & ~routine, F.when(closed, F.lit("RR")), skip="RR"
    )


# --- subjects --------------------------------------------------------------------------------


def subject_base(df: DataFrame) -> DataFrame:
    """One subject row per episode; ``episode_id`` stays as the key that ties both tables."""
    empty = F.lit(None).cast("string")
    return df.select(
        PERSON, "change_db_date_time", "bso_organisation_code", "early_recall_date", "date_of_as",
        "date_of_foa", "episode_date", EPISODE,
        empty.alias("superseded_nhs_number"),
        empty.alias("removal_reason"),
        F.lit(None).cast("date").alias("removal_date"),
        F.lit("Normal").alias("subject_status_code"),
        F.lit("Routine").alias("ntdd_calculation_method"),
    )


def is_higher_risk(df: DataFrame, seed) -> DataFrame:
    return df.withColumn("is_higher_risk", bernoulli(F.col(EPISODE), "higher_risk", 0.05, seed))


def preferred_language(df: DataFrame, mapping: DataFrame, seed) -> DataFrame:
    english = bernoulli(F.col(EPISODE), "english", 0.9, seed)
    return _code_from(df, mapping, "preferred_language", seed, ~english, F.lit("EN"), skip="EN")


def gp_practice_code(df: DataFrame, mapping: DataFrame, seed) -> DataFrame:
    """One practice per person among those of the person's organisation; null if it has none."""
    practices = mapping.select("bso_organisation_code", "gp_practice_code")
    person_in_bso = F.concat_ws("/", F.col(PERSON).cast("string"), "bso_organisation_code")
    return assign_from(df, practices, person_in_bso, "gp", seed, "bso_organisation_code")


def next_test_due_date(df: DataFrame) -> DataFrame:
    return df.withColumn("next_test_due_date", add_months(F.coalesce("date_of_as", "episode_date"), 36))


def latest_invitation_date(df: DataFrame) -> DataFrame:
    return df.withColumn("latest_invitation_date", F.coalesce("date_of_foa", "episode_date"))


def latest_episodes(df: DataFrame) -> DataFrame:
    """``episode_id`` of each person's last change (the lowest id on a tie), by partial aggregation."""
    newest = F.max(F.struct("change_db_date_time", (-F.col(EPISODE)).alias("_back")))
    known = df.filter(F.col(PERSON).isNotNull() & F.col("change_db_date_time").isNotNull())
    return known.groupBy(PERSON).agg(newest.alias("_newest")).select((-F.col("_newest._back")).alias(EPISODE))


def reason_for_ceasing_code(df: DataFrame, mapping: DataFrame, seed) -> DataFrame:
    """On a person's latest row only, for 5%, a drawn code."""
    latest = latest_episodes(df).select(F.col(EPISODE).alias("_latest"))
    marked = df.join(latest, F.col(EPISODE) == F.col("_latest"), "left")
    ceased = F.col("_latest").isNotNull() & bernoulli(F.col(EPISODE), "ceased", 0.05, seed)
    return _code_from(marked, mapping, "reason_for_ceasing_code", seed, ceased, None).drop("_latest")


def higher_risk_next_test_due_date(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "higher_risk_next_test_due_date", F.when(F.col("is_higher_risk"), F.col("next_test_due_date"))
    )


def hr_recall_due_date(df: DataFrame) -> DataFrame:
    return df.withColumn("hr_recall_due_date", F.when(F.col("is_higher_risk"), F.col("early_recall_date")))


def higher_risk_referral_reason_code(df: DataFrame, mapping: DataFrame, seed) -> DataFrame:
    return _code_from(df, mapping, "higher_risk_referral_reason_code", seed, F.col("is_higher_risk"), None)


def date_irradiated(df: DataFrame) -> DataFrame:
    by_radiotherapy = F.col("higher_risk_referral_reason_code").isin(*RADIOTHERAPY_REASONS)
    return df.withColumn("date_irradiated", F.when(by_radiotherapy, add_months(F.col("date_of_as"), 1)))


def is_higher_risk_active(df: DataFrame) -> DataFrame:
    """The opposite of ``is_higher_risk``, as specified (the name suggests otherwise)."""
    return df.withColumn("is_higher_risk_active", ~F.coalesce("is_higher_risk", F.lit(False)))


def gene_code(df: DataFrame, mapping: DataFrame, seed) -> DataFrame:
    genetic = F.col("higher_risk_referral_reason_code").isin(*GENE_REASONS)
    return _code_from(df, mapping, "gene_code", seed, genetic, None)


def subject_postcode(df: DataFrame, mapping: DataFrame, order: Sequence[str]) -> DataFrame:
    """Postcode of the practice's first mapping row by ``order``."""
    first = F.min(F.struct(*order, F.col("gp_practice_postcode").alias("subject_postcode")))
    practices = mapping.groupBy(F.col("gp_practice_code").alias("_practice")).agg(first.alias("_first"))
    right = practices.select("_practice", "_first.subject_postcode")
    return df.join(right, F.col("gp_practice_code") == F.col("_practice"), "left").drop("_practice")


# --- tables ----------------------------------------------------------------------------------


def complete_episodes(ids: DataFrame, mappings: Mapping[str, DataFrame], seed) -> DataFrame:
    """All episode columns for a table of (nhs_number, episode_id)."""
    df = date_of_foa(appointment_made(ids, seed), seed)
    df = change_db_date_time(early_recall_date(episode_date(date_of_as(df, seed), seed), seed), seed)
    df = end_code(episode_type(df, mappings["EpisodeType"], seed))
    df = end_code_last_updated(call_recall_status_authorised_by(df, seed))
    df = bso_batch_id(bso_organisation_code(df, mappings["bso_organisations"], seed), seed)
    return final_action_code(end_point(reason_closed_code(df)), mappings["FinalActionCode"], seed)


def gen_subjects(
    episodes: DataFrame, mappings: Mapping[str, DataFrame], seed=0, postcode_order: Sequence[str] = ("gp_practice_postcode",)
) -> DataFrame:
    """Subject table, one row per episode, helper dates dropped; ``episode_id`` is kept as key."""
    df = preferred_language(is_higher_risk(subject_base(episodes), seed), mappings["Language"], seed)
    df = gp_practice_code(df, mappings["bso_gp_mapping"], seed)
    df = latest_invitation_date(next_test_due_date(df))
    df = reason_for_ceasing_code(df, mappings["CeaseReason"], seed)
    df = hr_recall_due_date(higher_risk_next_test_due_date(df))
    df = higher_risk_referral_reason_code(df, mappings["higher_risk_referral_reasons"], seed)
    df = is_higher_risk_active(date_irradiated(df))
    df = gene_code(df, mappings["higher_risk_genes"], seed)
    df = subject_postcode(df, mappings["bso_gp_mapping"], postcode_order)
    return df.drop("date_of_as", "date_of_foa", "episode_date")


def combine(subjects: DataFrame, episodes: DataFrame) -> DataFrame:
    """Subjects and episodes side by side; a column in both comes from the subjects."""
    left = subjects.withColumnRenamed("change_db_date_time", "s_change_db_date_time")
    right = episodes.withColumnRenamed("change_db_date_time", "e_change_db_date_time")
    taken = [c for c in left.columns if c != EPISODE]
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(EPISODE, *extra), EPISODE).select(*taken, EPISODE, *extra)
