"""Stages that are skipped, resumed and redone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidentia.sources.stages import Folder, Stages


def test_stages_skip_resume_and_redo(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.range(5).write.parquet(source)
    made = []

    def run(factor, broken=False):
        stages = Stages(spark, f"file://{tmp_path}/run")
        first = spark.read.parquet(source)

        def one():
            made.append("one")
            return first.select((F.col("id") * factor).alias("id"))

        def two(rows):
            made.append("two")
            if broken:
                return rows.select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
            return rows.filter("id > 0")

        kept = stages.run("one", one, [first], factor=factor)
        return stages, stages.run("two", lambda: two(kept), [kept])

    with pytest.raises(Exception, match="stop"):
        run(2, broken=True)
    stages = Stages(spark, f"file://{tmp_path}/run")
    assert [(r.stage, r.status) for r in stages.table(["one", "two", "three"]).collect()] == [("one", "done"), ("two", "error"), ("three", "pending")]
    assert "stop" in stages.status("two").error and made == ["one", "two"]
    assert sorted(r.id for r in run(2)[1].collect()) == [2, 4, 6, 8] and made == ["one", "two", "two"]
    assert sorted(r.id for r in run(2)[1].collect()) == [2, 4, 6, 8] and len(made) == 3
    assert sorted(r.id for r in run(3)[1].collect()) == [3, 6, 9, 12] and made[3:] == ["one", "two"]
    spark.range(5, 7).write.mode("append").parquet(source)
    stages, rows = run(3)
    assert rows.count() == 6 and made[5:] == ["one", "two"]
    left = sorted(p.name.split("-")[0] for p in (tmp_path / "run").iterdir() if not p.name.startswith("."))
    assert left == ["one", "one.json", "two", "two.json"]
    (tmp_path / "run" / stages.status("two").path / "_SUCCESS").unlink()
    run(3)
    assert made[7:] == ["two"]
    stages.drop("two")
    assert stages.status("two").status == "pending"


def test_files_appear_as_a_whole(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/x")
    assert folder.read("a.json") is None
    folder.write("a.json", "é")
    folder.write("a.json", "né")
    assert folder.read("a.json") == "né" and folder.exists("a.json") and not folder.exists("b")
    folder.delete()
    assert not folder.exists("")
