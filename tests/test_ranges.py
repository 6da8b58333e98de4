import pytest
from pyspark.sql import functions as F

from tidemark.operators.ranges import places


def test_places_equal_one_window(spark):
    rows = [(n * 7919 % 1000, "k" if n % 3 else None if n % 2 else "other", n) for n in range(1000)]
    df = spark.createDataFrame(rows, "v int, k string, part int").repartition(6)  # a column of a helper's name
    got = {r.v: r.place for r in places(df, ["v"]).collect()}
    assert got == {v: v + 1 for v in range(1000)}
    down = {r.v: r.at for r in places(df, [F.desc("v")], "at", start=0).collect()}
    assert down == {v: 999 - v for v in range(1000)}
    within = places(df, ["v"], "n", within=["k"]).collect()
    for k in ("k", "other", None):
        assert [r.n for r in sorted((r for r in within if r.k == k), key=lambda r: r.v)] == list(range(1, sum(r[1] == k for r in rows) + 1))


def test_equal_rows_are_dealt_over_ranges(spark):
    """Nine tenths of the rows are one key: places are gapless and no range holds them all."""
    df = spark.createDataFrame([("hot",)] * 9000 + [(f"{n:04}",) for n in range(1000)], "k string").repartition(5)
    got = places(df, ["k"], "n", start=0)
    assert sorted(r.n for r in got.collect()) == list(range(10_000))
    assert got.filter("k = 'hot'").agg(F.min("n")).first()[0] == 1000


@pytest.mark.parametrize("within", [[], ["k"]])
def test_places_of_nothing(spark, within):
    assert places(spark.createDataFrame([], "k string, v int"), ["v"], within=within).count() == 0


def test_scratch_deletes_the_cuts_made_inside(spark):
    from pathlib import Path

    from tidemark.session import cut, scratch, shared_dir

    root = Path(shared_dir(spark).removeprefix("file://"))
    before = set(root.iterdir()) if root.exists() else set()
    outside = cut(spark.range(3), "outside")
    with scratch(spark):
        with scratch(spark):
            assert sorted(r.id for r in places(spark.range(5), ["id"]).collect()) == list(range(5))
        assert len(set(root.iterdir()) - before) == 1
        cut(spark.range(2), "inside")
    assert {p.name.split("-")[0] for p in set(root.iterdir()) - before} == {"outside"} and outside.count() == 3


def test_helper_columns_clash_with_no_caller(spark):
    from tidemark.operators import experiments, splits

    rows = spark.createDataFrame([(f"s{n:02}", n, n % 2, n, n, n) for n in range(20)], "stem string, o int, b int, n int, i int, at int")
    for got in (splits.ranked(rows, splits.seeded(1, F.col("stem"))), experiments.pages(rows, 6), splits.ranked_within(rows, "b", splits.seeded(1, F.col("stem")))):
        assert got.count() == 20 and set(rows.columns) < set(got.columns)
    pages = {r.stem: (r.sheet, r.slot) for r in experiments.pages(rows, 6).collect()}
    assert pages["s00"] == (1, 1) and pages["s05"] == (1, 6) and pages["s06"] == (2, 1)
