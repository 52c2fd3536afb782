"""What the plans of the polygon queries read, send and run in Python."""

from emberline.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def reads(text):
    return text.count("Relation [o_orderkey")


def test_relations_read_polygons_once(spark):
    got = plan(spark, "j_polygon_relations")
    assert reads(got) == 1 and "MapInPandas" not in got  # no second copy of the parts, which would be sent to all tasks
    assert not any("array_max" in line for line in got.splitlines() if "Filter" in line)  # bounds are computed once


def test_class_clip_keeps_the_year(spark):
    got = plan(spark, "r_polygon_class_clip")
    assert reads(got) == 2 and "MapInPandas" not in got  # cut once, and the keys of polygons without cover


def test_overlay_reads_polygons_once(spark):
    got = plan(spark, "r_polygon_overlay")
    assert reads(got) == 1 and "MapInPandas" not in got


def test_measures_take_whole_batches(spark):
    assert "MapInPandas" not in plan(spark, "r_make_valid")


def test_relations_are_computed_once(spark):
    got = plan(spark, "j_polygon_intersects_not_within")
    assert reads(got) == 1 and got.count("MapIn") == 1


def test_cascade_keeps_its_attempts(spark):
    got = plan(spark, "j_polygon_country_cascade")
    assert "MapIn" not in got  # each attempt was stored and is not computed anew for each use
