"""The bucketed table and the refresh of changed keys."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from matchlight.operators import rollup
from matchlight.sources.buckets import BucketTable


def table_of(spark, path):
    return BucketTable(spark, str(path), ["player_id", "game_id"], ["player_id"], buckets=8)


def numbers(spark, start, end, value):
    return spark.range(start, end).select(
        F.col("id").alias("player_id"), (F.col("id") % 3).cast("int").alias("game_id"), F.lit(value).alias("n")
    )


def files(df):
    return {f.rsplit("data/", 1)[1] for f in df.inputFiles()}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = table_of(spark, tmp_path)
    assert table.read() is None
    table.create(numbers(spark, 0, 100, "a"), 0)
    before = files(table.read())
    assert table.upsert(numbers(spark, 7, 8, "b").unionByName(numbers(spark, 500, 501, "b")), 1) in (1, 2)
    after = files(table.read())
    assert 6 <= len(before & after) < len(before) and all(f.startswith("v=1/") for f in after - before)
    got = {r.player_id: r.n for r in table.read().collect()}
    assert len(got) == 101 and {i for i, n in got.items() if n == "b"} == {7, 500}
    assert {r.n for r in table.read(before=1).collect()} == {"a"}
    assert table.upsert(numbers(spark, 0, 0, "c"), 2) == 0 and files(table.read()) == after


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.create(numbers(spark, 0, 50, "a"), 0)
    broken = numbers(spark, 0, 50, "b").withColumn("n", F.when(F.col("player_id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken, 1)
    assert {r.n for r in table.read().collect()} == {"a"} and table.read().count() == 50
    table.upsert(numbers(spark, 0, 50, "b"), 1)
    assert {r.n for r in table.read().collect()} == {"b"} and table.read().count() == 50


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.create(numbers(spark, 0, 60, "a"), 0)
    for v in (1, 2, 3):
        table.upsert(numbers(spark, v, v + 1, str(v)), v)
    want = rows(table.read(), "player_id")
    table.vacuum(3)
    assert rows(table.read(), "player_id") == want and table.read(before=3) is None
    held = {str(p.relative_to(tmp_path / "data").parent) for p in (tmp_path / "data").rglob("*.parquet")}
    assert held == {folder for _, _, folder in table.manifest()}


def test_refresh_equals_the_full_roll_up(spark, small):
    full = rollup.player_game_stats(small.matches, small.moves)
    keys = full.select("player_id", "game_id").where("player_id <> 2").unionByName(
        spark.createDataFrame([(2, 3)], "player_id bigint, game_id int")
    )
    got = rollup.refresh_keys(keys, small.matches, small.moves)
    columns = full.columns
    want = [r for r in rows(full.select(*columns), "player_id", "game_id") if r[0] != 2]
    zero = (2, 3, 0, 0, 0, 0, 0, 0, None, None)
    assert sorted(rows(got.select(*columns)), key=str) == sorted([*want, zero], key=str)
