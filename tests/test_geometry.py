import math

import pytest
from pyspark.sql import functions as F

from vellumgrid.functions import geometry as G

BOX = G.BOX


def one(spark, column):
    r = spark.range(1).select(column.alias("v")).first()["v"]
    return tuple(r) if hasattr(r, "asDict") else r


def b(*v):
    return G.box(*v)


@pytest.mark.parametrize("v,area", [((0, 0, 2, 3), 6), ((1, 1, 6, 6), 25), ((0, 0, 1, 1), 1), ((0, 0, 5, 0), 0), ((3, 3, 1, 1), 4)])
def test_area_keeps_its_sign(spark, v, area):
    assert one(spark, G.area(b(*v))) == area


def test_unary_functions(spark):
    assert one(spark, G.center(b(10, 20, 14, 26))) == (12, 23)
    assert one(spark, G.from_center_size(100, 200, 50, 80)) == (75, 160, 125, 240)
    assert one(spark, G.from_center_size(5, 7, 0, 0)) == (5, 7, 5, 7)
    assert one(spark, G.from_center_size(0, 0, -2, 2)) == (1, -1, -1, 1)
    assert one(spark, G.from_min_size(1, 1, 5, 5)) == (1, 1, 6, 6)
    assert one(spark, G.to_cartesian(b(0, 0, 20, 10), 100)) == (0, 90, 20, 100)
    assert one(spark, G.to_pdf_rect(b(1, 2, 3, 4), 10)) == (6, 1, 8, 3)
    assert one(spark, G.clamp(b(-10, -5, 1030, 1030), 0, 0, 1023, 1023)) == (0, 0, 1023, 1023)
    assert one(spark, G.clamp(b(20, 20, 30, 30), 0, 0, 10, 10)) == (20, 20, 10, 10)
    assert one(spark, G.translate(G.scale(b(1, 2, 3, 4), 2), 10, 5)) == (12, 9, 16, 13)


@pytest.mark.parametrize(
    "a,c,inter,iou,ratio",
    [
        ((0, 0, 4, 4), (2, 2, 6, 6), 4, 1 / 7, 0.25),
        ((0, 0, 2, 2), (3, 3, 5, 5), 0, 0, 0),
        ((0, 0, 2, 2), (2, 0, 4, 2), 0, 0, 0),
        ((0, 0, 10, 10), (2, 3, 5, 7), 12, 0.12, 1),
        ((0, 0, 5, 0), (0, 0, 5, 0), 0, 0, 0),
        ((-4, -4, 0, 0), (-2, -2, 2, 2), 4, 1 / 7, 0.25),
    ],
)
def test_binary_functions_are_symmetric(spark, a, c, inter, iou, ratio):
    for x, y in ((a, c), (c, a)):
        assert one(spark, G.intersection(b(*x), b(*y))) == inter
        assert one(spark, G.iou(b(*x), b(*y))) == pytest.approx(iou, abs=1e-6)
        assert one(spark, G.overlap_ratio(b(*x), b(*y))) == pytest.approx(ratio, abs=1e-6)


def test_union_contains_distance(spark):
    assert one(spark, G.union(b(-5, -3, -1, 1), b(-2, -1, 3, 4))) == (-5, -3, 3, 4)
    assert one(spark, G.contains(b(0, 0, 10, 10), b(2, 3, 7, 8))) and not one(spark, G.contains(b(2, 3, 7, 8), b(0, 0, 10, 10)))
    assert one(spark, G.contains(b(0, 0, 10, 10), b(5, 5, 5, 5)))
    assert one(spark, G.distance(b(0, 0, 1, 1), b(4, 5, 6, 6))) == 5
    assert one(spark, G.distance(b(0, 0, 3, 3), b(1, 1, 2, 2))) == 0


def test_thresholds_are_floats(spark):
    """A double 0.45 would lie on the other side of the float 0.45."""
    assert one(spark, G.f32(0.45) > G.f32(0.45)) is False
    assert one(spark, F.lit(0.45).cast("float") < F.lit(0.45)) is True


def test_fits_and_crops(spark):
    assert one(spark, G.fit(612, 792, 1024, 1024)) == pytest.approx((1024 / 792, 791, 1024), abs=1e-4)
    assert one(spark, G.fit_truncated(1000, 800, 960, 960))[1:] == (960, 768)
    assert one(spark, G.fit_height(80, 35, 48)) == 109
    assert one(spark, G.crop_rect(b(100, 50, 700, 550), 800, 600)) == (100, 50, 600, 500, False)
    assert one(spark, G.crop_rect(b(900, 50, 950, 60), 800, 600)) == (900, 50, 0, 10, True)
    assert one(spark, G.crop_rect(b(10.9, 5.5, 10.95, 40), 100, 48)) == (10, 5, 1, 34, False)
    assert one(spark, G.whole(F.lit(float("nan")).cast("float"))) == 0
    assert one(spark, G.whole(F.lit(1e20).cast("float"))) > 2_000_000_000


def test_padding_example(spark):
    got = one(spark, G.padded_bounds(100, 100, 200, 150, 1000, 800, 960, 720, 5))
    assert got == pytest.approx((99.17, 106.11, 213.33, 171.67), abs=0.01)


def test_last_of_equal_maxima(spark):
    a = lambda *v: F.array(*[G.f32(x) for x in v])
    assert one(spark, G.argmax_last(a(0.2, 0.7, 0.7, 0.1))) == 2
    assert one(spark, G.argmax_last(a(0.9))) == 0
    assert math.isclose(one(spark, G.f32(0.1)), 0.1, rel_tol=1e-6)
