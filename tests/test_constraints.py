"""Uniqueness and references of contracts."""

from conftest import rows
from pyspark.sql import functions as F

from tidemark.model import Contract, FieldRule
from tidemark.operators.constraints import check_constraints, duplicate_keys, orphan_keys
from tidemark.operators.contracts import find_orphans

PARENTS = Contract("parents", (FieldRule("id", "bigint"), FieldRule("code")), unique=(("id",), ("code",)))
CHILDREN = Contract(
    "children",
    (FieldRule("n", "bigint"), FieldRule("parent", "bigint"), FieldRule("day", "date", required=False)),
    unique=(("n",), ("parent", "day")),
    references=(("parent", "parents", "id"),),
)
CONTRACTS = {"parents": PARENTS, "children": CHILDREN}


def tables(spark):
    return {
        "parents": spark.createDataFrame([("1", "a"), ("02", "b"), ("2", "c"), (None, "d"), ("x", "c")], "id string, code string"),
        "children": spark.createDataFrame(
            [("1", "1", "2024-01-01"), ("2", "01", "19723"), ("3", "1", None), ("4", "9", None), ("4", None, "2024-01-01"), (None, "2", None)],
            "n string, parent string, day string",
        ),
    }


def test_keys_are_compared_by_type_and_null_parts_are_exempt(spark):
    checked = check_constraints(tables(spark), CONTRACTS)
    valid, broken = checked["parents"]
    assert rows(broken.selectExpr("id", "code", "array_join(violations, '; ')")) == sorted(
        [("02", "b", "id: not unique"), ("2", "c", "id: not unique; code: not unique"), ("x", "c", "code: not unique")], key=repr
    )
    assert rows(valid) == sorted([("1", "a"), (None, "d")], key=repr)
    valid, broken = checked["children"]
    found = {(r["n"], r["parent"]): r["violations"] for r in broken.collect()}
    assert found == {
        ("1", "1"): ["parent, day: not unique"],  # 19723 days after 1970-01-01 is the same day
        ("2", "01"): ["parent, day: not unique"],
        ("4", "9"): ["n: not unique", "parent: not in parents"],
        ("4", None): ["n: not unique"],
    }
    assert {r["n"] for r in valid.collect()} == {"3", None}


def test_one_kind_of_constraint_and_empty_tables(spark):
    given = tables(spark)
    assert check_constraints(given, CONTRACTS, unique=False)["parents"][1].count() == 0
    _, broken = check_constraints(given, CONTRACTS, unique=False)["children"]
    assert [(r["n"], r["violations"]) for r in broken.collect()] == [("4", ["parent: not in parents"])]
    empty = {name: df.limit(0) for name, df in given.items()}
    assert all(v.count() == b.count() == 0 for v, b in check_constraints(empty, CONTRACTS).values())
    orphans = check_constraints({**given, "parents": empty["parents"]}, CONTRACTS, unique=False)["children"][1]
    assert orphans.count() == 5


def test_all_constraints_share_one_partial_aggregate_and_hot_keys_are_one_row_a_task(spark):
    many = spark.range(0, 300_000, 1, 6).selectExpr("cast(if(id % 3 = 0, 7, id) as string) as id", "'same' as code")
    found = duplicate_keys(many, PARENTS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 300000") == 1 and plan.count("partial_count") == 1
    assert rows(found) == [("code: not unique", ["same"], 300_000), ("id: not unique", ["7"], 100_001)]


def test_rows_meet_broken_keys_by_a_long_and_only_where_there_are_any(spark):
    rule = {"parents": PARENTS}
    sound = spark.range(1000).selectExpr("cast(id as string) as id", "cast(id as string) as code")
    valid, broken = check_constraints({"parents": sound}, rule)["parents"]
    plan = broken._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "Join" not in plan  # no row is read again to find that none is broken
    assert (valid.count(), broken.count(), broken.columns) == (1000, 0, ["id", "code", "violations"])
    twice = sound.unionByName(sound.where("id % 2 = 0").withColumn("code", F.concat("id", F.lit("x"))))
    twice = twice.unionByName(spark.createDataFrame([(None, "n"), ("x", "o")], "id string, code string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        valid, broken = check_constraints({"parents": twice}, rule)["parents"]
        sorts = [line for line in broken._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line]
        assert sorts and all("xxhash64" in line or "Sort [__digest" in line for line in sorts) and len(sorts) == 2
        assert (valid.count(), broken.count()) == (502, 1000)
        assert rows(broken.selectExpr("explode(violations) as v").groupBy("v").count()) == [("id: not unique", 1000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_parents_are_never_broadcast(spark):
    """However small Spark takes a derived parent table to be: the driver would hold all its keys."""
    parents = spark.range(1, 3).selectExpr("cast(id as string) as id", "'c' as code")
    given = {**tables(spark), "parents": parents}
    orphans = find_orphans(given["children"], "parent", parents, "id")
    broken = orphan_keys(given, "children", CONTRACTS)
    for found in (orphans, broken):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(orphans, "n") == [("2",), ("4",)]
    assert rows(broken, "violation", "key", "copies") == [("parent: not in parents", ["9"], 1)]
