"""Column expressions over *canonical* markup text.

Canonical text (output of :func:`inkstone.operators.markup.canonicalise`) has no
comments, CDATA or processing instructions and escapes ``<``, ``>`` and ``"``
inside attribute values, so ``<[A-Za-z][^>]*>`` finds every start tag exactly
once and in document order.  All per-document statistics are therefore array
expressions on one row: no explode, no shuffle, no Python.  (Spark evaluates
higher-order functions without generated code, so these projections run
interpreted inside the JVM; binding repeated sub-expressions once keeps that
cost linear in the document size.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone import constants as K
from inkstone.functions.cache import cached
from inkstone.functions.text import WS, WS_CHARS, strip_ws

START_TAG = r"<[A-Za-z][^>]*>"
NUMBER = r"[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?"
FLOAT_LITERAL = r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def start_tags(markup) -> Column:
    """array<string> of every start tag, in document order."""
    return F.regexp_extract_all(F.coalesce(_c(markup), F.lit("")), F.lit(START_TAG), 0)


def tag_name(element: Column) -> Column:
    return F.regexp_extract(element, r"^<([A-Za-z]+)", 1)


ATTR_PAIR = r'\s([A-Za-z_][-A-Za-z0-9_:.]*)="([^"]*)"'


@cached
def parse_elements(markup) -> Column:
    """array<struct<tag, names, vals>>: every start tag parsed once (two regex scans).

    All per-document statistics read this column, so attribute regexes are not
    re-run per statistic (Catalyst has no common-subexpression elimination
    inside higher-order functions).
    """
    return F.transform(start_tags(markup), lambda e: F.struct(
        tag_name(e).alias("tag"),
        F.regexp_extract_all(e, F.lit(ATTR_PAIR), 1).alias("names"),
        F.regexp_extract_all(e, F.lit(ATTR_PAIR), 2).alias("vals")))


def get_attr(el: Column, name: str) -> Column:
    """Unescaped value of attribute ``name`` of a parsed element ("" when absent)."""
    pos = F.array_position(el["names"], F.lit(name)).cast("int")
    return unescape_attr(F.coalesce(F.get(el["vals"], pos - 1), F.lit("")))


def unescape_attr(v: Column) -> Column:
    """Undo the serialiser's attribute escaping (``&amp;`` last)."""
    for ent, ch in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#10;", "\n"),
                    ("&#13;", "\r"), ("&#09;", "\t"), ("&amp;", "&")):
        v = F.replace(v, F.lit(ent), F.lit(ch))
    return v


def attr(element: Column, name: str) -> Column:
    """Unescaped value of attribute ``name`` of one start tag ("" when absent)."""
    pat = r'\s' + name.replace("-", r"\-") + r'="([^"]*)"'
    return unescape_attr(F.regexp_extract(element, pat, 1))


def compact(v: Column) -> Column:
    """Remove every white-space character (lower-cased)."""
    return F.lower(F.translate(v, WS_CHARS, ""))


def is_non_paint(v: Column) -> Column:
    return compact(v).isin(*K.NON_PAINT_VALUES)


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    Catalyst does not eliminate common sub-expressions inside higher-order
    functions; binding keeps generated code small (and under the 64 KB limit).
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def _hex_pair(p: Column) -> Column:
    mag = F.conv(F.regexp_replace(p, r"^[+-]", ""), 16, 10).cast("int")
    return F.when(p.startswith("-"), -mag).otherwise(mag)


_PAIR_OK = r"^(?:[0-9a-f]{2}|[+-][0-9a-f])$"
_RGB_RE = r"^rgb\((\d{1,3}),(\d{1,3}),(\d{1,3})\)$"
_RGB_T = "struct<r:int,g:int,b:int>"


def _color_of_compact(c: Column) -> Column:
    """Colour struct of an already compacted, lower-cased paint value."""
    def hexed(x):
        pairs = [F.substring(x, i, 2) for i in (2, 4, 6)]
        ok = pairs[0].rlike(_PAIR_OK) & pairs[1].rlike(_PAIR_OK) & pairs[2].rlike(_PAIR_OK)
        return F.when(ok, F.struct(_hex_pair(pairs[0]).alias("r"), _hex_pair(pairs[1]).alias("g"),
                                   _hex_pair(pairs[2]).alias("b")))

    def rgb(x):
        ch = [F.least(F.regexp_extract(x, _RGB_RE, i).cast("int"), F.lit(255)) for i in (1, 2, 3)]
        return F.when(x.rlike(_RGB_RE), F.struct(ch[0].alias("r"), ch[1].alias("g"), ch[2].alias("b")))

    names = F.create_map(*[x for name, (r, g, b) in K.COLOR_RGB
                           for x in (F.lit(name), F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")))])
    expanded = F.when(F.length(c) == 4,
                      F.concat(F.lit("#"), F.regexp_replace(F.substring(c, 2, 3), r"(.)", "$1$1"))).otherwise(c)
    null_rgb = F.lit(None).cast(_RGB_T)
    return (F.when((F.length(c) == 0) | c.isin(*K.NON_PAINT_VALUES), null_rgb)
            .when(c.startswith("#"), let(expanded, lambda x: F.when(F.length(x) == 7, hexed(x)).otherwise(null_rgb)))
            .when(c.startswith("rgb("), rgb(c))
            .otherwise(F.try_element_at(names, c)))


def parse_color(v: Column) -> Column:
    """M3: ``#rgb``, ``#rrggbb``, ``rgb(r,g,b)`` (clamped) or a colour name -> struct<r,g,b>, else null."""
    return let(compact(v), _color_of_compact)


def is_visible_paint(v: Column) -> Column:
    """M5: non-paint -> false; unknown paint -> true; parsed colour -> min channel < 245."""
    return let(compact(v), _visible_compact)


def _visible_compact(c: Column) -> Column:
    """M5 of an already compacted paint value."""
    return (F.when(c.isin(*K.NON_PAINT_VALUES), F.lit(False))
            .otherwise(let(_color_of_compact(c), lambda rgb: F.when(rgb.isNull(), F.lit(True)).otherwise(
                F.least(rgb["r"], rgb["g"], rgb["b"]) < K.VISIBLE_CHANNEL_LIMIT))))


def _style_values(style: Column, lower_key: bool = True) -> Column:
    """fill/stroke values declared in a style text (None entries removed)."""
    def one(p):
        key = strip_ws(F.substring_index(p, ":", 1))
        key = F.lower(key) if lower_key else key
        return F.when(F.contains(p, F.lit(":")) & key.isin("fill", "stroke"),
                      strip_ws(F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1)))
    return F.filter(F.transform(F.split(style, ";"), one), lambda x: x.isNotNull())


def element_paints(el: Column) -> Column:
    """Paint values of one parsed element, compacted: fill, stroke, then style fill/stroke; non-paints removed."""
    styled = let(get_attr(el, "style"), lambda s: F.when(F.length(s) > 0, F.transform(_style_values(s), compact))
                 .otherwise(F.array().cast("array<string>")))
    vals = F.concat(F.array(compact(get_attr(el, "fill")), compact(get_attr(el, "stroke"))), styled)
    return F.filter(vals, lambda x: ~x.isin(*K.NON_PAINT_VALUES))


def drawables(els: Column) -> Column:
    return F.filter(els, lambda el: el["tag"].isin(*K.DRAWABLE_TAGS))


def paint_stats(els: Column) -> Column:
    """M4 on parsed elements: struct(drawable_count, painted_count, visible_paint_count, distinct_colors).

    The distinct set holds the compacted lower-cased paint text (``#FFF`` and
    ``#ffffff`` differ).
    """
    def per_element(el):
        return let(element_paints(el), lambda p: F.struct(
            (F.size(p) > 0).alias("painted"),
            F.exists(p, _visible_compact).alias("visible"),
            p.alias("colors")))

    # one pass over the drawables; every per-element value is bound once
    return let(F.transform(drawables(els), per_element), lambda d: F.struct(
        F.size(d).alias("drawable_count"),
        F.size(F.filter(d, lambda x: x["painted"])).alias("painted_count"),
        F.size(F.filter(d, lambda x: x["visible"])).alias("visible_paint_count"),
        F.size(F.array_distinct(F.flatten(F.transform(d, lambda x: x["colors"])))).alias("distinct_colors")))


def rich_colors(els: Column) -> Column:
    """F4 on parsed elements: drawables and distinct paints (lower-cased, spaces kept,
    style key matched without lower-casing)."""
    def one(el):
        attrs = F.array(F.lower(strip_ws(get_attr(el, "fill"))), F.lower(strip_ws(get_attr(el, "stroke"))))
        st = F.transform(_style_values(get_attr(el, "style"), lower_key=False), F.lower)
        return F.filter(F.concat(attrs, st), lambda x: ~x.isin(*K.NON_PAINT_VALUES))

    return let(drawables(els), lambda draw: F.struct(
        F.size(draw).alias("drawables"), F.size(F.array_distinct(F.flatten(F.transform(draw, one)))).alias("colors")))


def path_count(els: Column) -> Column:
    return F.size(F.filter(els, lambda el: el["tag"] == "path"))


@cached
def tag_histogram(markup) -> Column:
    """M6 as a per-row map tag -> count (no shuffle)."""
    return let(F.transform(start_tags(markup), tag_name), lambda tags: F.map_from_entries(
        F.transform(F.array_distinct(tags), lambda t: F.struct(
            t.alias("key"), F.size(F.filter(tags, lambda x: x == t)).alias("value")))))


def _float(v: Column) -> Column:
    """Python ``float()`` of a stripped attribute text, null when it does not parse."""
    return let(strip_ws(v), lambda s: F.when(s.rlike(FLOAT_LITERAL), s.cast("double")))


def _numbers(v: Column) -> Column:
    return F.transform(F.regexp_extract_all(v, F.lit(NUMBER), 0), lambda x: x.cast("double"))


def element_xs_ys(el: Column) -> Column:
    """M8 per parsed element: struct(xs, ys) of the coordinates that count for the content box."""
    tag = el["tag"]
    dbl = "array<double>"
    empty = F.array().cast(dbl)

    def num(name, default=None):
        x = _float(get_attr(el, name))
        return F.coalesce(x, F.lit(default)) if default is not None else x

    def evens(a):
        return F.filter(a, lambda _v, i: i % 2 == 0)

    def odds(a):
        return F.filter(a, lambda _v, i: i % 2 == 1)

    def present(*cols):
        return F.filter(F.array(*cols), lambda q: q.isNotNull())

    def rect():
        return let(F.struct(num("x", 0.0).alias("x"), num("y", 0.0).alias("y"), num("width").alias("w"),
                            num("height").alias("h")),
                   lambda v: F.when(v["w"].isNotNull() & v["h"].isNotNull(),
                                    F.struct(F.array(v["x"], v["x"] + v["w"]).alias("xs"),
                                             F.array(v["y"], v["y"] + v["h"]).alias("ys"))))

    def round_shape(rx_name, ry_name):
        return let(F.struct(num("cx", 0.0).alias("cx"), num("cy", 0.0).alias("cy"), num(rx_name, 0.0).alias("rx"),
                            num(ry_name, 0.0).alias("ry")),
                   lambda v: F.struct(F.array(v["cx"] - v["rx"], v["cx"] + v["rx"]).alias("xs"),
                                      F.array(v["cy"] - v["ry"], v["cy"] + v["ry"]).alias("ys")))

    def listed(attr_name):
        return let(_numbers(get_attr(el, attr_name)), lambda a: F.struct(evens(a).alias("xs"), odds(a).alias("ys")))

    none = F.struct(empty.alias("xs"), empty.alias("ys"))
    out = (F.when(tag == "rect", F.coalesce(rect(), none))
           .when(tag == "circle", round_shape("r", "r"))
           .when(tag == "ellipse", round_shape("rx", "ry"))
           .when(tag == "line", F.struct(present(num("x1"), num("x2")).alias("xs"), present(num("y1"), num("y2")).alias("ys")))
           .when(tag.isin("polyline", "polygon"), listed("points"))
           .when(tag == "path", listed("d"))
           .otherwise(none))
    return F.struct(out["xs"].cast(dbl).alias("xs"), out["ys"].cast(dbl).alias("ys"))


def content_bounds(els: Column) -> Column:
    """M8 on parsed elements: struct(min_x, min_y, max_x, max_y); null when xs or ys is empty."""
    per = F.transform(els, element_xs_ys)

    def box(p):
        xs = F.flatten(F.transform(p, lambda s: s["xs"]))
        ys = F.flatten(F.transform(p, lambda s: s["ys"]))
        return let(F.struct(xs.alias("xs"), ys.alias("ys")), lambda a: F.when(
            (F.size(a["xs"]) > 0) & (F.size(a["ys"]) > 0),
            F.struct(F.array_min(a["xs"]).alias("min_x"), F.array_min(a["ys"]).alias("min_y"),
                     F.array_max(a["xs"]).alias("max_x"), F.array_max(a["ys"]).alias("max_y"))))

    return let(per, box)


def coverage(bounds: Column) -> Column:
    """M9: canvas-clipped box area / 65536 clamped to [0, 1]; 0 without a box."""
    cw = F.greatest(F.lit(0.0), F.least(F.lit(256.0), bounds["max_x"]) - F.greatest(F.lit(0.0), bounds["min_x"]))
    ch = F.greatest(F.lit(0.0), F.least(F.lit(256.0), bounds["max_y"]) - F.greatest(F.lit(0.0), bounds["min_y"]))
    cov = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cw * ch / 65536.0))
    return F.when(bounds.isNull(), F.lit(0.0)).otherwise(cov)


def rescaled_viewbox(bounds: Column, canvas: int = K.CANVAS, target_fill: float = 0.85,
                     min_scale: float = 1.8) -> Column:
    """New viewBox text when content fills less than 1/min_scale of the canvas, else null."""
    cw = F.greatest(bounds["max_x"] - bounds["min_x"], F.lit(1.0))
    chh = F.greatest(bounds["max_y"] - bounds["min_y"], F.lit(1.0))
    scale = F.least(F.lit(canvas * target_fill) / cw, F.lit(canvas * target_fill) / chh)
    pad = (F.lit(float(canvas)) / scale) * (1.0 - target_fill) / 2.0
    vb = F.format_string("%.4f %.4f %.4f %.4f", bounds["min_x"] - pad, bounds["min_y"] - pad,
                         cw + 2 * pad, chh + 2 * pad)
    return F.when(bounds.isNotNull() & (scale >= min_scale), vb)


def rescale_markup(markup, bounds: Column) -> Column:
    """M10 applied: replace the root viewBox, keep the text when not needed or too long."""
    m = _c(markup)
    return let(F.struct(bounds.alias("b")), lambda bb: let(rescaled_viewbox(bb["b"]), lambda vb: let(
        F.regexp_replace(m, r'^(<svg\b[^>]*?\sviewBox=")[^"]*(")', F.concat(F.lit("$1"), vb, F.lit("$2"))),
        lambda new: F.when((F.length(m) > 0) & vb.isNotNull() & (F.length(new) <= K.MAX_MARKUP_CHARS), new).otherwise(m))))


def is_internal_reference(v: Column) -> Column:
    """Compacted value is ``#...`` or exactly ``url(#id)``."""
    c = F.regexp_replace(v, f"{WS}+", "")
    return (F.length(c) > 0) & (c.startswith("#") | c.rlike(r"^url\(#[-\w:.]+\)$"))


def validity(markup, els: Column, stats: Column) -> Column:
    """M7 on canonical text: non-empty, <= 16000 chars, <= 256 paths, drawable and visible paint."""
    m = F.coalesce(_c(markup), F.lit(""))
    return ((F.length(m) > 0) & (F.length(m) <= K.MAX_MARKUP_CHARS) & (path_count(els) <= K.MAX_PATHS)
            & (stats["drawable_count"] > 0) & (stats["visible_paint_count"] > 0))


_PARSED_CACHE: dict = {}
_P = ("__pm", "__pels", "__pstats", "__pbounds", "__ppath", "__pcov", "__pvalid")


def _parsed_columns():
    """Column expressions of :func:`with_parsed` over fixed internal column names,
    built once per process (building them costs thousands of Py4J calls; an
    unresolved Column is reusable across plans)."""
    from pyspark import SparkContext
    key = id(SparkContext._gateway)
    if key not in _PARSED_CACHE:
        m, e, st, bd, pc, cv, va = _P
        _PARSED_CACHE[key] = (
            parse_elements(m),
            {st: paint_stats(F.col(e)), bd: content_bounds(F.col(e)), pc: path_count(F.col(e))},
            {cv: coverage(F.col(bd)), va: validity(F.col(m), F.col(e), F.col(st))},
        )
    return _PARSED_CACHE[key]


def with_parsed(df, col: str, prefix: str = ""):
    """Add ``{prefix}els`` (parsed elements), ``{prefix}stats``, ``{prefix}bounds``,
    ``{prefix}path_count``, ``{prefix}coverage`` and ``{prefix}valid`` in three
    projection steps (each expression computed once per row)."""
    els, step2, step3 = _parsed_columns()
    out = df.withColumn(_P[0], F.col(col)).withColumn(_P[1], els).withColumns(step2).withColumns(step3)
    names = ["els", "stats", "bounds", "path_count", "coverage", "valid"]
    return out.drop(_P[0]).withColumnsRenamed({p: prefix + n for p, n in zip(_P[1:], names)})


@cached
def rescaled_from(col: str, els_col: str) -> Column:
    """M10 for a canonical text column and its parsed-elements column (built once)."""
    return rescale_markup(F.col(col), content_bounds(F.col(els_col)))
