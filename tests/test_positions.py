import random

import pytest
from pyspark.sql import functions as F

from tallyscope.operators.positions import following, number_rows, running_offset


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), i, rng.randint(0, 5)) for i in range(500)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(7)


def test_row_numbers_within_groups(skewed):
    rows, df = skewed
    got = {(r["k"], r["i"]): r["n"] for r in number_rows(df, [F.col("i").desc()], ["k"], "n").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, row in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: -r[1])):
            want[(key, row[1])] = n
    assert got == want


def test_row_numbers_over_everything(skewed):
    rows, df = skewed
    got = {r["i"]: r["n"] for r in number_rows(df, [F.col("i")], name="n").collect()}
    assert got == {i: i for i in range(len(rows))}


def test_numbering_everything_moves_rows_once(spark, skewed):
    """The numbered rows are read where they were written: only the rows per partition are sent."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = number_rows(skewed[1], [F.col("i")], name="n")
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
        assert numbered.count() == len(skewed[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("step", [1, 1_000_003])
def test_running_offsets(spark, skewed, step):
    """Null keys and orders, and orders far apart."""
    rows = [(k, i * step if i else None, v) for k, i, v in skewed[0]]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(7)
    got = {(r["k"], r["i"]): r["offset"] for r in running_offset(df, "v", "i", ["k"]).collect()}
    want, sums = {}, {}
    for key, i, value in sorted(rows, key=lambda r: -1 if r[1] is None else r[1]):
        want[(key, i)] = sums.get(key, 0)
        sums[key] = sums.get(key, 0) + value
    assert got == want
    over_all = {r["i"]: r["offset"] for r in running_offset(df, "v", "i").collect()}
    assert len(over_all) == len(rows) and over_all[None] == 0 and max(over_all.values()) <= sum(r[2] for r in rows)


@pytest.mark.parametrize("bucket", ["0", "cast(i div 7 as int)", "cast(i as int)", "if(k is null, hash(i), cast(i div 100 as int))"])
def test_following(skewed, bucket):
    rows, df = skewed
    found = following(df, "k", [F.col("i").desc()], ["v"], "next", F.expr(bucket))
    assert found.columns == [*df.columns, "next"]
    got = {r["i"]: r["next"] and r["next"]["v"] for r in found.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: -r[1])
        for row, after in zip(mine, [*mine[1:], None]):
            want[row[1]] = after[2] if after and key is not None else None
    assert got == want


def test_following_moves_the_rows_once(skewed):
    """One exchange of all columns; what else moves has the looked-up field only."""
    rows, df = skewed
    found = following(df.withColumn("wide", F.lit("x")), "k", [F.col("i").desc()], ["v"], "next", F.expr("cast(i div 7 as int)"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and "checkpoint" not in plan.lower()
    executed = found._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in executed.splitlines() if "Exchange" in line and "REPARTITION_BY_COL" in line]
    assert len(wide) <= 2, executed
