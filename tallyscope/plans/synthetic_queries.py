"""Queries for drawn and derived screening columns.

People and episodes are the customers and their orders; mapping tables come from the other tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.functions.draws import bernoulli, choose, uniform_date, uniform_int, unit
from tallyscope.functions.rules import add_months
from tallyscope.operators import synthetic as syn
from tallyscope.plans.table_queries import draw
from tallyscope.session import fresh_path
from tallyscope.sources.tables import LazyTables, check_header, parquet_table

SEED = 5

# Referral reasons by nation number; later nations get a code of their own.
REASONS = [*syn.RADIOTHERAPY_REASONS, *syn.GENE_REASONS]


def ids(spark, folder):
    orders = parquet_table(spark, folder, "orders")
    return orders.select(F.col("o_custkey").alias("nhs_number"), F.col("o_orderkey").alias("episode_id"))


def mappings(spark, folder):
    def table(name):
        return parquet_table(spark, folder, name)

    def codes(name, column):
        return lambda: table(name).select(F.col(column).alias("code")).distinct()

    def reasons():
        known = F.get(F.array(*[F.lit(r) for r in REASONS]), F.col("n_nationkey"))
        code = F.coalesce(known, F.concat(F.lit("OTHER_"), F.col("n_nationkey")))
        return table("nation").select(code.alias("code"))

    def practices():
        return table("customer").select(
            F.col("c_custkey").alias("row_no"),
            F.col("c_mktsegment").alias("bso_organisation_code"),
            F.concat(F.lit("GP"), F.expr("c_custkey div 2")).alias("gp_practice_code"),
            F.concat(F.lit("PC"), F.col("c_custkey")).alias("gp_practice_postcode"),
        )

    return LazyTables(
        {
            "EpisodeType": codes("lineitem", "l_returnflag"),
            "FinalActionCode": codes("part", "p_type"),
            "Language": codes("nation", "n_name"),
            "CeaseReason": codes("events", "event_type"),
            "higher_risk_referral_reasons": reasons,
            "higher_risk_genes": codes("part", "p_brand"),
            "bso_organisations": lambda: table("customer").select(F.col("c_mktsegment").alias("bso_organisation_code")).distinct(),
            "bso_gp_mapping": practices,
        }
    )


def episodes(spark, folder):
    return syn.complete_episodes(ids(spark, folder), mappings(spark, folder), SEED)


def subjects(spark, folder):
    return syn.gen_subjects(episodes(spark, folder), mappings(spark, folder), SEED, ["row_no"])


def _offers(spark, folder):
    made = syn.appointment_made(ids(spark, folder), SEED)
    return syn.date_of_foa(made, SEED)


def _attended(spark, folder):
    return syn.episode_date(syn.date_of_as(_offers(spark, folder), SEED), SEED)


def _changed(spark, folder):
    return syn.change_db_date_time(syn.early_recall_date(_attended(spark, folder), SEED), SEED)


def _typed(spark, folder):
    return syn.episode_type(ids(spark, folder), mappings(spark, folder)["EpisodeType"], SEED)


def _in_bso(spark, folder):
    return syn.bso_organisation_code(ids(spark, folder), mappings(spark, folder)["bso_organisations"], SEED)


def _closed(spark, folder):
    return syn.reason_closed_code(syn.end_code(_attended(spark, folder)))


def _risk(spark, folder):
    return syn.is_higher_risk(_changed(spark, folder), SEED)


def _reasons(spark, folder):
    mapping = mappings(spark, folder)["higher_risk_referral_reasons"]
    return syn.higher_risk_referral_reason_code(_risk(spark, folder), mapping, SEED)


def _practices(spark, folder):
    return syn.gp_practice_code(_in_bso(spark, folder), mappings(spark, folder)["bso_gp_mapping"], SEED)


# query name -> (columns, the smallest chain of rules that makes them)
_RULES = {
    "synthetic_appointment_made": (["appointment_made"], lambda s, d: syn.appointment_made(ids(s, d), SEED)),
    "synthetic_date_of_foa": (["date_of_foa"], _offers),
    "synthetic_date_of_as": (["date_of_as"], lambda s, d: syn.date_of_as(_offers(s, d), SEED)),
    "synthetic_episode_date": (["episode_date"], lambda s, d: syn.episode_date(_offers(s, d), SEED)),
    "synthetic_early_recall_date": (["early_recall_date"], lambda s, d: syn.early_recall_date(_offers(s, d), SEED)),
    "synthetic_change_db_date_time": (["change_db_date_time"], _changed),
    "synthetic_episode_type": (["episode_type"], _typed),
    "synthetic_end_code": (["end_code"], lambda s, d: syn.end_code(_attended(s, d))),
    "synthetic_authorised_by": (["call_recall_status_authorised_by"], lambda s, d: syn.call_recall_status_authorised_by(_typed(s, d), SEED)),
    "synthetic_end_code_last_updated": (["end_code_last_updated"], lambda s, d: syn.end_code_last_updated(_changed(s, d))),
    "synthetic_bso_organisation_code": (["bso_organisation_code"], _in_bso),
    "synthetic_bso_batch_id": (["bso_batch_id"], lambda s, d: syn.bso_batch_id(_in_bso(s, d), SEED)),
    "synthetic_reason_closed_code": (["reason_closed_code"], _closed),
    "synthetic_end_point": (["end_point"], lambda s, d: syn.end_point(ids(s, d))),
    "synthetic_final_action_code": (["final_action_code"], lambda s, d: syn.final_action_code(_closed(s, d), mappings(s, d)["FinalActionCode"], SEED)),
    "synthetic_is_higher_risk": (["is_higher_risk"], lambda s, d: syn.is_higher_risk(ids(s, d), SEED)),
    "synthetic_preferred_language": (["preferred_language"], lambda s, d: syn.preferred_language(ids(s, d), mappings(s, d)["Language"], SEED)),
    "synthetic_gp_practice_code": (["gp_practice_code"], _practices),
    "synthetic_next_test_due_date": (["next_test_due_date"], lambda s, d: syn.next_test_due_date(_attended(s, d))),
    "synthetic_latest_invitation_date": (["latest_invitation_date"], lambda s, d: syn.latest_invitation_date(_attended(s, d))),
    "synthetic_reason_for_ceasing_code": (["reason_for_ceasing_code"], lambda s, d: syn.reason_for_ceasing_code(_changed(s, d), mappings(s, d)["CeaseReason"], SEED)),
    "synthetic_higher_risk_dates": (["higher_risk_next_test_due_date", "hr_recall_due_date"], lambda s, d: syn.hr_recall_due_date(syn.higher_risk_next_test_due_date(syn.next_test_due_date(_risk(s, d))))),
    "synthetic_referral_reason": (["higher_risk_referral_reason_code"], _reasons),
    "synthetic_date_irradiated": (["date_irradiated"], lambda s, d: syn.date_irradiated(_reasons(s, d))),
    "synthetic_is_higher_risk_active": (["is_higher_risk_active"], lambda s, d: syn.is_higher_risk_active(syn.is_higher_risk(ids(s, d), SEED))),
    "synthetic_gene_code": (["gene_code"], lambda s, d: syn.gene_code(_reasons(s, d), mappings(s, d)["higher_risk_genes"], SEED)),
    "synthetic_subject_postcode": (["subject_postcode"], lambda s, d: syn.subject_postcode(_practices(s, d), mappings(s, d)["bso_gp_mapping"], ["row_no"])),
}


def _rule(columns, chain):
    return lambda spark, folder: chain(spark, folder).select("episode_id", *columns)


# The columns of the two tables, in order.
EPISODE_COLUMNS = """nhs_number episode_id appointment_made date_of_foa date_of_as episode_date early_recall_date
 change_db_date_time episode_type end_code call_recall_status_authorised_by end_code_last_updated
 bso_organisation_code bso_batch_id reason_closed_code end_point final_action_code""".split()
SUBJECT_COLUMNS = """nhs_number change_db_date_time bso_organisation_code early_recall_date episode_id superseded_nhs_number
 removal_reason removal_date subject_status_code ntdd_calculation_method is_higher_risk preferred_language
 gp_practice_code next_test_due_date latest_invitation_date reason_for_ceasing_code
 higher_risk_next_test_due_date hr_recall_due_date higher_risk_referral_reason_code date_irradiated
 is_higher_risk_active gene_code subject_postcode""".split()


def _combined(spark, folder):
    """The episodes are written once, as a table that the subjects are made from and joined to."""
    path = fresh_path(spark, "episodes")
    episodes(spark, folder).write.parquet(path)
    made = spark.read.parquet(path)
    return syn.combine(syn.gen_subjects(made, mappings(spark, folder), SEED, ["row_no"]), made)


def _exploded(spark, folder):
    """Each order once per line item, numbered through, cut to the number of line items less 10."""
    lineitem = parquet_table(spark, folder, "lineitem")
    lines = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return syn.explode_by(lines, "n", "l_orderkey", lineitem.count() - 10).select("l_orderkey", "position")


def _draws(spark, folder):
    """Every kind of draw on the orders, keyed by order."""
    orders, key = parquet_table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderkey")
    return orders.select(
        "o_orderkey",
        unit(key, "u", 1).alias("u"),
        bernoulli(key, "flag", 0.25, 1).alias("flag"),
        choose(key, "even", ["a", "b", "c"], 1).alias("even"),
        choose(key, "weighted", ["a", "b", "c"], 1, [0.5, 0.3, 0.2]).alias("weighted"),
        uniform_int(key, "whole", -5, 20, 1).alias("whole"),
        uniform_date(key, "day", "2024-04-01", "2025-03-31", 1).alias("day"),
        add_months(F.col("o_orderdate"), uniform_int(key, "months", -24, 24, 1)).alias("shifted"),
    )


def _assigned(spark, folder):
    """A supplier for each order, and a customer of the same nation for each of them."""
    orders = parquet_table(spark, folder, "orders").select("o_orderkey")
    suppliers = parquet_table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    customers = parquet_table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    placed = syn.assign_from(orders, suppliers, F.col("o_orderkey"), "supplier", 1)
    return syn.assign_from(placed, customers, F.col("o_orderkey"), "customer", 1, "nation")


QUERIES = {
    "synthetic_draws": _draws,
    "synthetic_assignment": _assigned,
    **{name: _rule(*rule) for name, rule in _RULES.items()},
    "synthetic_subject_base": lambda s, d: syn.subject_base(syn.bso_organisation_code(_changed(s, d), mappings(s, d)["bso_organisations"], SEED)),
    "synthetic_episodes": lambda s, d: check_header(episodes(s, d), EPISODE_COLUMNS),
    "synthetic_subjects": lambda s, d: check_header(subjects(s, d), SUBJECT_COLUMNS),
    "synthetic_combined": _combined,
    "synthetic_explode_by_count": _exploded,
}


# --- SQL -------------------------------------------------------------------------------------


def _u(name, key="episode_id"):
    return draw(key, name, SEED)


def _day(name, key):
    return f"(DATE '{syn.FIRST_OFFER}' + floor({_u(name, key)} * 365)::int)"


def _numbered(table, column, where="true"):
    return f"(SELECT *, row_number() OVER (ORDER BY {column}) - 1 AS no FROM (SELECT {column} FROM {table} WHERE {where}))"


def _pick(alias, table, name, key="episode_id", column="code", where="true"):
    """Join that draws one row of a code table per key."""
    size = f"(SELECT count(*) FROM {table} WHERE {where})"
    return f"LEFT JOIN {_numbered(table, column, where)} {alias} ON {alias}.no = floor({_u(name, key)} * {size})::bigint"


_MAPS = f"""episode_types AS (SELECT DISTINCT l_returnflag AS code FROM lineitem),
actions AS (SELECT DISTINCT p_type AS code FROM part),
languages AS (SELECT n_name AS code FROM nation),
ceasing AS (SELECT DISTINCT event_type AS code FROM events),
reasons AS (SELECT coalesce(list_extract({REASONS}, n_nationkey + 1), 'OTHER_' || n_nationkey) AS code FROM nation),
genes AS (SELECT DISTINCT p_brand AS code FROM part),
organisations AS (SELECT DISTINCT c_mktsegment AS bso FROM customer),
gps AS (SELECT c_custkey AS row_no, c_mktsegment AS bso, 'GP' || (c_custkey // 2) AS gp, 'PC' || c_custkey AS postcode FROM customer),
numbered_gps AS (SELECT bso, gp, row_number() OVER (PARTITION BY bso ORDER BY gp) - 1 AS no FROM gps),
gp_sizes AS (SELECT bso, count(*) AS size FROM gps GROUP BY 1),
practice_postcodes AS (SELECT gp, min_by(postcode, row_no) AS postcode FROM gps GROUP BY 1)"""

_REAL_IDS = "SELECT o_custkey AS nhs_number, o_orderkey AS episode_id FROM orders"

def _chain(id_query: str) -> str:
    return f"""WITH {_MAPS},
ids AS ({id_query}),
turns AS (SELECT *, {_u('appointment_made')} < 0.95 AS appointment_made,
  row_number() OVER (PARTITION BY nhs_number ORDER BY episode_id) AS turn,
  CASE WHEN {_u('offer_gap')} < 0.9 THEN 35 ELSE 37 END AS gap, {_day('first_offer', 'nhs_number')} AS first FROM ids),
gaps AS (SELECT *, lag(gap) OVER (PARTITION BY nhs_number ORDER BY episode_id) AS gap_before FROM turns),
offers AS (SELECT nhs_number, episode_id, appointment_made, CASE WHEN NOT appointment_made THEN NULL WHEN turn = 1 THEN first
  WHEN turn = 2 THEN (first - to_months(gap))::date WHEN turn = 3 THEN (first - to_months(gap_before) - to_months(gap))::date END AS date_of_foa FROM gaps),
attended AS (SELECT *, CASE WHEN date_of_foa IS NULL OR {_u('attendance')} < 0.15 THEN NULL
  WHEN {_u('attendance')} < 0.2 THEN (date_of_foa + to_months(6 + floor({_u('late_months')} * 2)::int))::date
  ELSE (date_of_foa + to_months(floor({_u('months')} * 7)::int))::date END AS date_of_as FROM offers),
dated AS (SELECT *, coalesce(date_of_foa - 14, {_day('episode_date', 'episode_id')}) AS episode_date,
  CASE WHEN {_u('early_recall')} < 0.05 THEN date_of_foa END AS early_recall_date FROM attended),
changed AS (SELECT *, episode_date::timestamp + to_seconds(floor({_u('change_second')} * 86400)::bigint) AS change_db_date_time FROM dated),
coded AS (SELECT c.*, CASE WHEN {_u('routine')} < 0.8 THEN 'R' ELSE t.code END AS episode_type,
  CASE WHEN NOT appointment_made THEN 'DNR' WHEN date_of_as IS NOT NULL THEN 'SC' ELSE 'DNA' END AS end_code,
  (change_db_date_time + to_months(8)) AS end_code_last_updated, o.bso AS bso_organisation_code
  FROM changed c {_pick('t', 'episode_types', 'episode_type_code', where="code <> 'R'")}
  {_pick('o', 'organisations', 'bso', 'nhs_number', 'bso')}),
closed AS (SELECT *, CASE WHEN episode_type = 'R' THEN CASE floor({_u('authorised_by')} * 2) WHEN 0 THEN 'GP' ELSE 'SCREENING_OFFICE' END END AS call_recall_status_authorised_by,
  bso_organisation_code || lpad(floor({_u('batch_digits')} * 1000000)::int::varchar, 6, '0') || chr(65 + floor({_u('batch_letter')} * 26)::int) AS bso_batch_id,
  CASE WHEN end_code = 'SC' THEN 'R' ELSE 'NA' END AS reason_closed_code, '{syn.END_POINT}' AS end_point FROM coded),
episodes AS (SELECT c.*, CASE WHEN reason_closed_code = 'R' THEN CASE WHEN {_u('routine_recall')} < 0.9 THEN 'RR' ELSE a.code END END AS final_action_code
  FROM closed c {_pick('a', 'actions', 'final_action_code_code', where="code <> 'RR'")}),
risk AS (SELECT e.*, {_u('higher_risk')} < 0.05 AS is_higher_risk,
  CASE WHEN {_u('english')} < 0.9 THEN 'EN' ELSE l.code END AS preferred_language,
  (coalesce(date_of_as, episode_date) + to_months(36))::date AS next_test_due_date,
  coalesce(date_of_foa, episode_date) AS latest_invitation_date,
  row_number() OVER (PARTITION BY nhs_number ORDER BY change_db_date_time DESC, episode_id) = 1 AS latest
  FROM episodes e {_pick('l', 'languages', 'preferred_language_code', where="code <> 'EN'")}),
referred AS (SELECT r.*, CASE WHEN latest AND {_u('ceased')} < 0.05 THEN c.code END AS reason_for_ceasing_code,
  CASE WHEN is_higher_risk THEN next_test_due_date END AS higher_risk_next_test_due_date,
  CASE WHEN is_higher_risk THEN early_recall_date END AS hr_recall_due_date,
  CASE WHEN is_higher_risk THEN f.code END AS higher_risk_referral_reason_code, NOT is_higher_risk AS is_higher_risk_active,
  p.gp AS gp_practice_code
  FROM risk r {_pick('c', 'ceasing', 'reason_for_ceasing_code_code')}
  {_pick('f', 'reasons', 'higher_risk_referral_reason_code_code')}
  LEFT JOIN gp_sizes z ON z.bso = r.bso_organisation_code
  LEFT JOIN numbered_gps p ON p.bso = r.bso_organisation_code
    AND p.no = floor({draw("concat_ws('/', nhs_number, bso_organisation_code)", 'gp', SEED)} * z.size)::bigint),
everything AS (SELECT r.*, CASE WHEN higher_risk_referral_reason_code IN {syn.RADIOTHERAPY_REASONS} THEN (date_of_as + to_months(1))::date END AS date_irradiated,
  CASE WHEN higher_risk_referral_reason_code IN {syn.GENE_REASONS} THEN g.code END AS gene_code, q.postcode AS subject_postcode,
  NULL::varchar AS superseded_nhs_number, NULL::varchar AS removal_reason, NULL::date AS removal_date,
  'Normal' AS subject_status_code, 'Routine' AS ntdd_calculation_method
  FROM referred r {_pick('g', 'genes', 'gene_code_code')} LEFT JOIN practice_postcodes q ON q.gp = r.gp_practice_code)
"""


_REAL = _chain(_REAL_IDS)
_BASE_COLUMNS = """nhs_number, change_db_date_time, bso_organisation_code, early_recall_date, date_of_as, date_of_foa, episode_date,
  episode_id, superseded_nhs_number, removal_reason, removal_date, subject_status_code, ntdd_calculation_method"""
_COMBINED = [c for c in SUBJECT_COLUMNS if c != "change_db_date_time"] + [
    c for c in EPISODE_COLUMNS if c not in SUBJECT_COLUMNS
]

def _one(name, key="o_orderkey"):
    return draw(key, name, 1)


ORACLE = {
    "synthetic_draws": f"""SELECT o_orderkey, {_one('u')} AS u, {_one('flag')} < 0.25 AS flag,
      list_extract(['a', 'b', 'c'], floor({_one('even')} * 3)::int + 1) AS even,
      CASE WHEN {_one('weighted')} < 0.5 THEN 'a' WHEN {_one('weighted')} < 0.8 THEN 'b' ELSE 'c' END AS weighted,
      -5 + floor({_one('whole')} * 26)::bigint AS whole, DATE '2024-04-01' + floor({_one('day')} * 365)::int AS day,
      o_orderdate + to_months(-24 + floor({_one('months')} * 49)::int) AS shifted FROM orders""",
    "synthetic_assignment": f"""WITH s AS (SELECT s_suppkey, s_nationkey AS nation, row_number() OVER (ORDER BY s_suppkey) - 1 AS no FROM supplier),
      c AS (SELECT c_custkey, c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS no,
        count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer)
      SELECT o_orderkey, s_suppkey, o.nation, c_custkey FROM (SELECT o_orderkey, s.* FROM orders
        LEFT JOIN s ON s.no = floor({_one('supplier')} * (SELECT count(*) FROM supplier))::bigint) o
      LEFT JOIN c ON c.nation = o.nation AND c.no = floor({_one('customer')} * c.size)::bigint""",
    **{name: _REAL + f"SELECT episode_id, {', '.join(columns)} FROM everything" for name, (columns, _) in _RULES.items()},
    "synthetic_subject_base": _REAL + f"SELECT {_BASE_COLUMNS} FROM everything",
    "synthetic_episodes": _REAL + f"SELECT {', '.join(EPISODE_COLUMNS)} FROM episodes",
    "synthetic_subjects": _REAL + f"SELECT {', '.join(SUBJECT_COLUMNS)} FROM everything",
    "synthetic_combined": _REAL + f"""SELECT {', '.join(_COMBINED)}, change_db_date_time AS s_change_db_date_time,
      change_db_date_time AS e_change_db_date_time FROM everything""",
    "synthetic_explode_by_count": """SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS position FROM lineitem
      QUALIFY position < (SELECT count(*) - 10 FROM lineitem)""",
}
