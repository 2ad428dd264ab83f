"""Rays end where they leave the mask's box, before they are shuffled."""

from __future__ import annotations

from curvora.operators import geometry as G


def test_rays_over_a_long_thin_mask_are_not_shuffled_at_full_length(spark):
    pixels = spark.createDataFrame([(1, x, y, 1 <= y <= 3) for x in range(300) for y in range(5)], "image_id int, x int, y int, mask boolean")
    center = spark.createDataFrame([(1, x, 2.0) for x in range(300)], "image_id int, x int, y double")
    centers = G.interpolated(G.with_normals(center), G.positions(center)).localCheckpoint()
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled(run):
        written = lambda: sum(store.executorList(True).apply(i).totalShuffleWrite() for i in range(store.executorList(True).size()))
        before = written()
        return run(), written() - before

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, own = shuffled(lambda: pixels.where("mask").repartition(4, "x", "y").collect())
        rows, bytes_ = shuffled(lambda: G.lines_across(centers, pixels, edge_trim=0.0).orderBy("sample_id").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r.y_start, r.y_end, r.line_length_px) for r in rows] == [(1.0, 3.0, 2.0)] * 5  # halves are rounded to even: 0.5 and 3.5 are outside
    assert bytes_ < 4 * own
