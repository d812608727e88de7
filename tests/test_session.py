"""Owners of folders in the shared folder."""

import pathlib

from graphloom.session import cut, fresh_dir, scratch, settled, shared_dir


def held(spark):
    at = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "graphloom"
    return {p.name for p in at.iterdir()} if at.exists() else set()


def test_scratch_deletes_what_was_made_inside(spark):
    kept = cut(spark.range(3), "outer")
    before = held(spark)
    with scratch():
        made = cut(spark.range(5), "inner")
        with scratch():
            cut(spark.range(2), "innermost")
        assert made.count() == 5 and len(held(spark)) == len(before) + 1
    assert held(spark) == before and kept.count() == 3


def test_settled_keeps_only_the_result(spark):
    before = held(spark)
    out = settled(spark, "result", lambda: cut(spark.range(7), "step").where("id > 2"))
    assert sorted(r.id for r in out.collect()) == [3, 4, 5, 6]
    assert [n.split("-")[0] for n in held(spark) - before] == ["result"]
    with scratch():
        fresh_dir(spark, "never-written")
