"""Column expressions against hand-written expectations (one Spark job per test)."""

from pyspark.sql import functions as F

from inkstone.functions import markup as MX
from inkstone.functions import text as TX


def one(spark, col, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_strip_and_norm(spark):
    assert one(spark, TX.clean_prompt("v"), ["  a b\x1c", None, "\tx\n"]) == ["a b", "", "x"]
    assert one(spark, TX.prompt_norm("v"), ["A  \tB"]) == ["a b"]


def test_truncate_prompt(spark):
    out = one(spark, TX.truncate_prompt("v", 10), ["short", "hello world again", "abcdefghijklmno"])
    assert out == ["short", "hello", "abcdefghij"]


def test_extract_markup(spark):
    cases = [
        ("text <SVG a='1'><g></g></svg> more <svg></svg>", "<SVG a='1'><g></g></svg>"),
        ("<svg><svg></svg></svg>", "<svg><svg></svg>"),                     # non-greedy: inner close
        ("x <svg width='1'><g><g ><path d='M0'/>", "<svg width='1'><g><g ><path d='M0'/></g></g></svg>"),
        ("<svg>", ""),                                                      # last '>' before index 10
        ("no markup", ""),
    ]
    assert one(spark, TX.extract_markup("v"), [c[0] for c in cases]) == [c[1] for c in cases]


def test_parse_color_and_visibility(spark):
    vals = ["#abc", "#AABBCC", "#ggg", "#aabbccdd", "rgb(300,0,0)", "rgb(10%,0,0)", "currentColor", "white",
            "#f5f5f5", "none", " Red ", "#F4F4F4"]
    rgb = one(spark, MX.parse_color(F.col("v")), vals)
    assert [tuple(x) if x else None for x in rgb] == [
        (170, 187, 204), (170, 187, 204), None, None, (255, 0, 0), None, None, (255, 255, 255),
        (245, 245, 245), None, (255, 0, 0), (244, 244, 244)]
    vis = one(spark, MX.is_visible_paint(F.col("v")), vals)
    assert vis == [True, True, True, True, True, True, True, False, False, False, True, True]


def test_paint_stats_bounds_coverage(spark):
    doc = ('<svg width="256" height="256" viewBox="0 0 256 256"><g fill="red"><rect width="10" height="10" /></g>'
           '<circle cx="100" cy="100" r="10" fill="#FFF" stroke="#ffffff" />'
           '<path d="M10 20 L30 40" style="fill: blue" /><line x1="5" x2="7" stroke="none" />'
           '<polygon points="1,2 3" fill="green" /></svg>')
    df = spark.createDataFrame([(doc,)], "m string")
    r = MX.with_parsed(df, "m").collect()[0]
    s = r["stats"]
    # rect is unpainted (paint on the parent g), #FFF and #ffffff are two distinct colours
    assert (s.drawable_count, s.painted_count, s.visible_paint_count, s.distinct_colors) == (5, 3, 2, 4)
    b = r["bounds"]
    assert (b.min_x, b.min_y, b.max_x, b.max_y) == (0.0, 0.0, 110.0, 110.0)
    assert abs(r["coverage"] - 110 * 110 / 65536) < 1e-12 and r["valid"]


def test_bounds_edge_cases(spark):
    docs = ['<svg><rect x="5" y="5" width="10%" height="3" /></svg>',      # unparseable width: no box
            '<svg><path d="M.01.04 1e3 2" /></svg>',
            '<svg><text>1 2</text></svg>']
    df = spark.createDataFrame([(d,) for d in docs], "m string")
    rows = MX.with_parsed(df, "m").select("bounds").collect()
    assert rows[0][0] is None
    assert tuple(rows[1][0]) == (0.01, 0.04, 1000.0, 2.0)
    assert rows[2][0] is None


def test_rescale(spark):
    doc = ('<svg xmlns="http://www.w3.org/2000/svg" width="256" height="256" viewBox="0 0 256 256">'
           '<rect x="2" y="2" width="20" height="20" fill="red" /></svg>')
    df = spark.createDataFrame([(doc,)], "m string").withColumn("e", MX.parse_elements("m"))
    out = df.select(MX.rescaled_from("m", "e")).collect()[0][0]
    assert 'viewBox="0.2353 0.2353 23.5294 23.5294"' in out and out.count("xmlns=") == 1


def test_rich_colors(spark):
    docs = ['<svg><rect fill="Red" /><circle stroke="blue" /></svg>',
            '<svg><rect fill="red" /><circle style="fill: RED" /></svg>',
            '<svg><rect fill="red" /></svg>']
    df = spark.createDataFrame([(d,) for d in docs], "m string")
    out = [tuple(r[0]) for r in df.select(MX.rich_colors(MX.parse_elements("m"))).collect()]
    assert out == [(2, 2), (2, 1), (1, 1)]


def test_rescale_threshold(spark):
    # content width w: scale = 217.6 / w acts only when >= 1.8, i.e. w <= 120.888...
    def doc(w):
        return ('<svg xmlns="http://www.w3.org/2000/svg" width="256" height="256" viewBox="0 0 256 256">'
                f'<rect x="0" y="0" width="{w}" height="{w}" fill="red" /></svg>')
    df = spark.createDataFrame([(doc(120),), (doc(121),)], "m string").withColumn("e", MX.parse_elements("m"))
    out = [r[0] for r in df.select(MX.rescaled_from("m", "e")).collect()]
    assert 'viewBox="0 0 256 256"' not in out[0] and 'viewBox="0 0 256 256"' in out[1]
