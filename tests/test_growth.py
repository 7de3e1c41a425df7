"""Steps whose work must not grow faster than their input."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import slides, units
from paperloom.queries import QUERIES


def most_rows(df):
    """The most rows that any node of df's plan put out, once df was collected."""

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().get("numOutputRows")
        children = node.children()
        return max([own.get().value() if own.isDefined() else 0, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_placeholders_meet_the_first_of_each_kind(spark):
    """a part with many placeholders of one index and type is not met in pairs."""
    n = 300
    shapes = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("z"), F.lit(1).alias("slide_no"), F.lit(True).alias("ph"), F.when(F.col("id") % 3 == 0, "9").when(F.col("id") % 3 == 1, "1").alias("ph_idx"), F.when(F.col("id") == 5, "none").otherwise("body").alias("ph_type"))
    pages = spark.createDataFrame([(1, 1, "L", "M")], "doc_id int, slide_no int, layout string, master string")
    k = F.col("id")
    holders = spark.range(n).select(F.lit(1).alias("doc_id"), F.when(k % 2 == 0, "L").otherwise("M").alias("part"), k.alias("seq"), F.when(k > 10, "1").alias("idx"), F.when(k > 3, "body").otherwise("title").alias("type"), k.alias("y"), k.alias("x"), F.array(F.lit(0)).alias("levels"))
    found = slides.inherited(shapes, pages, holders)
    got = {r.z: (r.l.y, r.m.y) for r in found.collect()}
    # Index 1 begins at 11; index 9 and none are nowhere, so the type decides; 5 has neither.
    assert got == {z: (12, 11) if z % 3 == 1 else (4, 5) for z in range(n) if z != 5}
    assert most_rows(found) <= 8 * n


@pytest.mark.parametrize("stretch", [1, 7, 10_000])
def test_warned_neighbours(spark, monkeypatch, stretch):
    """nearest units with warnings, also where they lie stretches away; a document is not one task's."""
    monkeypatch.setattr(units, "STRETCH", stretch, raising=False)
    have = {("a", n): n in (5, 33, 34) for n in range(60)} | {(None, n): n % 50 == 3 for n in range(0, 110, 2)} | {("c", 1): False}
    df = spark.createDataFrame([(d, n, ["w"] if w else []) for (d, n), w in have.items()], "doc_id string, unit_no long, warnings array<string>")
    found = units.next_warned(df)
    got = {(r.doc_id, r.unit_no): (r.previous_warned, r.next_warned) for r in found.collect()}
    assert found.columns == [*df.columns, "previous_warned", "next_warned"]
    at = lambda doc: [n for (d, n), w in have.items() if d == doc and w]
    assert got == {(d, n): (max((x for x in at(d) if x < n), default=None), min((x for x in at(d) if x > n), default=None)) for d, n in have}
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "stretch" in plan


def test_letters_are_dealt_over_cores(spark):
    """a small file of many customers is not one task's to mask."""
    made = QUERIES["mask_composed"](spark, "/root/testdata/sf0.001")
    rows = made.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(rows) >= 16 and max(rows) <= 2 * sum(rows) / len(rows)
