"""Column functions and table functions against plain Python."""

import pytest
from pyspark.sql import functions as F

from patchlake.functions import geometry as g
from patchlake.functions import identity as n
from patchlake.functions import scoring as s
from patchlake.functions import udtf


def values(spark, inputs, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_labels_stay_apart(spark):
    names = ["scratch", "Scratch", "SCRATCH", "_default", "", None, "  ", " scratch ", "傷", "汚れ", "a b", "a_b", "a-b", "a.b", "__", "-"]
    out = values(spark, names, n.safe_label)
    assert out[0] == out[7] == "scratch" and out[3] == out[4] == out[5] == out[6] == "_default"
    apart = [o for i, o in enumerate(out) if i not in (4, 5, 6, 7)]
    assert len({o.lower() for o in apart}) == len(apart) and all(o == o.lower() for o in out)
    assert out[8].startswith("c-") and out[11] == "a_b" and out[12] == "a-b"


def test_date_groups(spark):
    cases = {
        "OK_170104_094937_cam1.png": "170104", "OK_0002-08-02-0008.jpg": "", "ok_Image__2017-05-16__09-33-06.bmp": "20170516", "20260804_094937.png": "20260804",
        "OK_a02_02_170302164558368.png": "170302", "x20171016y.png": "20171016", "0002-08-02_20170516.png": "20170516", "plain.png": "", "99999999.png": "", "2017.13.01.png": "", "1899-01-01.png": "",
    }
    assert values(spark, list(cases), n.date_group) == list(cases.values())


def test_prefix_groups(spark):
    names = ["LOTA_170104_1.png", "dir\\sub/LOTA_x.png", "noext", "a_b_c.tar.gz"]
    assert values(spark, names, lambda x: n.prefix_group(x, "_", 2)) == ["LOTA_170104", "LOTA_x", "noext", "a_b"]
    assert values(spark, names, lambda x: n.prefix_group(x, "", 2)) == ["LOTA_170104_1", "LOTA_x", "noext", "a_b_c.tar"]
    assert values(spark, ["a.b.c.png"], lambda x: n.prefix_group(x, ".", 2)) == ["a.b"]
    with pytest.raises(ValueError, match="unknown group mode"):
        n.group_key(F.col("x"), "other")


def test_natural_order(spark):
    names = ["img10", "img2", "IMG1", "img2b10", "img2b9", "a", "img"]
    df = spark.createDataFrame([(x,) for x in names], "x string")
    assert [r.x for r in df.orderBy(n.natural_key(F.col("x"))).collect()] == ["a", "img", "IMG1", "img2", "img2b9", "img2b10", "img10"]


def offsets(h, w):
    def axis(size):
        out = list(range(0, size - 518 + 1, 388))
        return out if out[-1] == size - 518 else [*out, size - 518]

    return [(0, 0)] if h < 518 or w < 518 else [(y, x) for y in axis(h) for x in axis(w)]


SIDES = [(300, 400), (300, 900), (800, 1000), (798, 994), (518, 518), (906, 1294), (517, 2000)]


def test_windows(spark):
    df = spark.createDataFrame(SIDES, "h int, w int")
    for r in df.select("h", "w", g.window_offsets(F.col("h"), F.col("w")).alias("o"), g.expected_rows(F.col("h"), F.col("w")).alias("n")).collect():
        assert [(o.y, o.x) for o in r.o] == offsets(r.h, r.w)
        assert r.n == len(offsets(max(r.h, 518), max(r.w, 518))) * 1369
    udtf.register(spark)
    df.createOrReplaceTempView("sides")
    found = spark.sql("select h, w, win, y, x from sides, lateral window_offsets(h, w)").collect()
    assert sorted((r.h, r.w, r.win, r.y, r.x) for r in found) == sorted((h, w, i, y, x) for h, w in SIDES for i, (y, x) in enumerate(offsets(h, w)))


def test_rectangles(spark):
    rects = [(0.1, 0.2, 0.3, 0.05), (0.0, 0.0, 0.0, 1.0), (0.95, 0.95, 0.2, 0.2)]
    df = spark.createDataFrame([(h, w, rects) for h, w in SIDES], "h int, w int, r array<struct<x:double,y:double,w:double,h:double>>")
    for r in df.select("h", "w", g.rows_for_rects(F.col("h"), F.col("w"), F.col("r")).alias("rows")).collect():
        want = set()
        for x, y, w, h in rects:
            for i, (wy, wx) in enumerate(offsets(max(r.h, 518), max(r.w, 518))):
                for py in range(37):
                    for px in range(37):
                        top, left = wy + 14 * py, wx + 14 * px
                        if w > 0 and h > 0 and top < (y + h) * r.h and top + 14 > y * r.h and left < (x + w) * r.w and left + 14 > x * r.w:
                            want.add(i * 1369 + py * 37 + px)
        assert r.rows == sorted(want)


def test_statistics_of_lists(spark):
    df = spark.createDataFrame([([5.0, 3.0, 1.0], [1.0, 0.0, 3.0], 300, 4.9, 5.0), ([], [], 0, 0.0, 7.0), ([2.0, 1.0], [1.0], 2, 1.5, 2.0)], "top array<double>, cmin array<double>, patches int, p99 double, high double")
    args = [F.col(c) for c in ("top", "cmin", "patches", "p99", "high")]
    got = df.select(s.stat_with_alpha(*args, "topk", 2, 2.0).alias("a"), s.stat_with_alpha(*args, "p99", 2, 2.0).alias("b"), s.stat_with_alpha(*args, "topk", 2, 0.0).alias("c")).collect()
    assert [r.a for r in got] == [(6.0 + 5.0) / 2, 7.0, 1.5] and [r.b for r in got] == [1.5, 0.0, 1.5] and [r.c for r in got] == [4.0, 7.0, 1.5]


def test_quantised_within_half_a_step(spark):
    df = spark.createDataFrame([([1.0, -2.0, 0.5],), ([0.3, 2.0, 0.0],)], "v array<double>").withColumn("s", F.array(F.lit(1 / 127), F.lit(2 / 127), F.lit(0.5 / 127)))
    for r in df.withColumn("q", s.quantised(F.col("v"), F.col("s"))).withColumn("b", s.dequantised(F.col("q"), F.col("s"))).collect():
        assert all(abs(a - b) <= x / 2 + 1e-12 and -127 <= c <= 127 for a, b, x, c in zip(r.v, r.b, r.s, r.q, strict=True))
