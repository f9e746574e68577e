"""DuckDB SQL fragments for the oracle queries.

An independent implementation of the same rules in DuckDB SQL (RE2 regexes,
1-based list lambdas), used only to build ``oracle_sql()`` texts.
"""

from __future__ import annotations

from inkstone import constants as K
from inkstone.functions.text import WS

NUMBER = r"[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?"
FLOAT_LITERAL = r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def clean(x: str) -> str:
    return strip(f"coalesce(CAST({x} AS VARCHAR), '')")


def norm(x: str) -> str:
    return f"regexp_replace(lower({x}), {q(f'{WS}+')}, ' ', 'g')"


def count_sub(x: str, sub: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, {q(sub)}, ''))) // {len(sub)} AS INTEGER)"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def prompt_complexity(p: str) -> str:
    hits = " + ".join(f"CAST(contains(lower({p}), {q(h)}) AS INTEGER)" for h in K.COMPLEXITY_HINTS)
    return f"least({hits} + CAST(length({p}) >= {K.COMPLEX_PROMPT_CHARS} AS INTEGER), 2)"


def prompt_is_complex(p: str) -> str:
    return f"({contains_any(f'lower({p})', K.COMPLEXITY_HINTS)} OR length({p}) >= {K.COMPLEX_PROMPT_CHARS})"


def markup_complexity(s: str) -> str:
    t = [f"CAST(length({s}) >= 1800 AS INTEGER)",
         f"CAST({count_sub(s, '<path')} >= 12 AS INTEGER)",
         f"CAST({count_sub(s, '<g')} >= 4 AS INTEGER)",
         f"CAST(({count_sub(s, '<linearGradient')} + {count_sub(s, '<radialGradient')}) > 0 AS INTEGER)",
         f"CAST(({count_sub(s, '<circle')} + {count_sub(s, '<rect')} + {count_sub(s, '<polygon')}) >= 8 AS INTEGER)"]
    return f"least({' + '.join(t)}, 2)"


def color_tokens(p: str) -> str:
    """list of colour words present as whole words, fixed order."""
    items = ", ".join(
        f"CASE WHEN regexp_matches(lower({p}), {q(f'(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])')}) THEN {q(w)} END"
        for w in K.COLOR_WORDS)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def D(x) -> str:
    """A DOUBLE literal (DuckDB reads 0.6 as an exact DECIMAL)."""
    return f"CAST({x} AS DOUBLE)"


def structural_score(s: str) -> str:
    n = f"length({s})"
    paths = count_sub(s, "<path")
    vb1, vb2 = q('viewBox="0 0 256 256"'), q("viewBox='0 0 256 256'")
    body = (f"(CASE WHEN {n} BETWEEN 160 AND 9000 THEN {D(12.0)} WHEN {n} BETWEEN 80 AND 12000 THEN {D(6.0)} ELSE {D(0.0)} END"
            f" + least({paths}, 12) * {D(0.6)} + least({count_sub(s, '<rect')}, 10) * {D(0.4)}"
            f" + least({count_sub(s, '<circle')}, 10) * {D(0.4)} + least({count_sub(s, '<g')}, 10) * {D(0.25)}"
            f" + least({count_sub(s, 'fill=')}, 16) * {D(0.15)} - greatest({paths} - 64, 0) * {D(0.15)}"
            f" + CASE WHEN contains({s}, {vb1}) OR contains({s}, {vb2}) THEN {D(6.0)} ELSE {D(0.0)} END)")
    return f"(CASE WHEN coalesce({n}, 0) = 0 THEN {D(-1000.0)} ELSE {body} END)"


def prompt_bonus(p: str, s: str) -> str:
    parts = [f"CASE WHEN contains(lower({p}), {q(w)}) AND contains(lower({s}), {q(m)}) THEN {D(1.25)} ELSE {D(0.0)} END"
             for w, m in K.SHAPE_HINTS]
    parts += [f"CASE WHEN contains(lower({p}), {q(w)}) AND contains(lower({s}), {q(w)}) THEN {D(0.25)} ELSE {D(0.0)} END"
              for w in K.COLOR_WORDS]
    return f"({D(0.0)} + " + " + ".join(parts) + ")"


# ---------------------------------------------------------------- markup
def start_tags(m: str) -> str:
    return f"regexp_extract_all(coalesce({m}, ''), '<[A-Za-z][^>]*>')"


def tag_name(e: str) -> str:
    return f"regexp_extract({e}, '^<([A-Za-z]+)', 1)"


def unescape(v: str) -> str:
    for ent, ch in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#10;", "chr(10)"),
                    ("&#13;", "chr(13)"), ("&#09;", "chr(9)"), ("&amp;", "&")):
        rep = ch if ch.startswith("chr(") else q(ch)
        v = f"replace({v}, {q(ent)}, {rep})"
    return v


def attr(e: str, name: str) -> str:
    pat = r"\s" + name.replace("-", r"\-") + r'="([^"]*)"'
    return unescape(f"regexp_extract({e}, {q(pat)}, 1)")


def compact(v: str) -> str:
    return f"lower(regexp_replace({v}, {q(f'{WS}+')}, '', 'g'))"


def _hex(pair: str) -> str:
    return (f"(CASE WHEN starts_with({pair}, '-') THEN -CAST(('0x' || substr({pair}, 2)) AS INTEGER) "
            f"WHEN starts_with({pair}, '+') THEN CAST(('0x' || substr({pair}, 2)) AS INTEGER) "
            f"ELSE CAST(('0x' || {pair}) AS INTEGER) END)")


def visible_paint(v: str) -> str:
    c = compact(v)
    exp = (f"(CASE WHEN length({c}) = 4 THEN '#' || regexp_replace(substr({c}, 2, 3), '(.)', '\\1\\1', 'g') "
           f"ELSE {c} END)")
    pairs = [f"substr({exp}, {i}, 2)" for i in (2, 4, 6)]
    ok = " AND ".join(f"regexp_matches({p}, '^(?:[0-9a-f]{{2}}|[+-][0-9a-f])$')" for p in pairs)
    rgb_re = r"^rgb\((\d{1,3}),(\d{1,3}),(\d{1,3})\)$"
    chans = [f"least(CAST(regexp_extract({c}, {q(rgb_re)}, {i}) AS INTEGER), 255)" for i in (1, 2, 3)]
    invisible_names = [n for n, rgb in K.COLOR_RGB if min(rgb) >= K.VISIBLE_CHANNEL_LIMIT]
    hexes = ", ".join(_hex(p) for p in pairs)
    return (f"(CASE WHEN {c} IN {in_list(K.NON_PAINT_VALUES)} THEN false "
            f"WHEN starts_with({c}, '#') AND length({exp}) = 7 THEN "
            f"(CASE WHEN {ok} THEN least({hexes}) < {K.VISIBLE_CHANNEL_LIMIT} ELSE true END) "
            f"WHEN regexp_matches({c}, {q(rgb_re)}) THEN least({', '.join(chans)}) < {K.VISIBLE_CHANNEL_LIMIT} "
            f"WHEN {c} IN {in_list(invisible_names)} THEN false ELSE true END)")


def element_paints(e: str) -> str:
    style_parts = f"string_split({attr(e, 'style')}, ';')"
    key = strip("split_part(p, chr(58), 1)")
    value = strip("regexp_extract(p, " + q("(?s)^[^:]*:(.*)$") + ", 1)")
    style_vals = (f"list_transform(list_filter({style_parts}, lambda p: contains(p, ':') AND "
                  f"lower({key}) IN ('fill', 'stroke')), lambda p: {value})")
    vals = f"list_concat([{strip(attr(e, 'fill'))}, {strip(attr(e, 'stroke'))}], {style_vals})"
    return f"list_filter({vals}, lambda v: NOT ({compact('v')} IN {in_list(K.NON_PAINT_VALUES)}))"


def drawables(m: str) -> str:
    return f"list_filter({start_tags(m)}, lambda e: {tag_name('e')} IN {in_list(K.DRAWABLE_TAGS)})"


def paint_stats_cols(m: str, prefix: str = "") -> str:
    """SELECT-list items: drawable_count, painted_count, visible_paint_count, distinct_colors."""
    paints = f"list_transform({drawables(m)}, lambda e: {element_paints('e')})"
    return (f"CAST(len({drawables(m)}) AS INTEGER) AS {prefix}drawable_count, "
            f"CAST(len(list_filter({paints}, lambda a: len(a) > 0)) AS INTEGER) AS {prefix}painted_count, "
            f"CAST(len(list_filter({paints}, lambda a: len(list_filter(a, lambda v: {visible_paint('v')})) > 0)) AS INTEGER)"
            f" AS {prefix}visible_paint_count, "
            f"CAST(len(list_distinct(list_transform(flatten({paints}), lambda v: {compact('v')}))) AS INTEGER)"
            f" AS {prefix}distinct_colors")


def path_count(m: str) -> str:
    return f"len(list_filter({start_tags(m)}, lambda e: {tag_name('e')} = 'path'))"


def validity(m: str, drawable: str, visible: str) -> str:
    return (f"(length(coalesce({m}, '')) > 0 AND length({m}) <= {K.MAX_MARKUP_CHARS} "
            f"AND {path_count(m)} <= {K.MAX_PATHS} AND {drawable} > 0 AND {visible} > 0)")


def _float(v: str) -> str:
    s = strip(v)
    return f"(CASE WHEN regexp_matches({s}, {q(FLOAT_LITERAL)}) THEN CAST({s} AS DOUBLE) END)"


def element_xs_ys(e: str) -> tuple[str, str]:
    tag = tag_name(e)

    def num(name, default=None):
        x = _float(attr(e, name))
        return f"coalesce({x}, {default})" if default is not None else x

    x, y = num("x", "0.0"), num("y", "0.0")
    w, h = num("width"), num("height")
    cx, cy, r, rx, ry = num("cx", "0.0"), num("cy", "0.0"), num("r", "0.0"), num("rx", "0.0"), num("ry", "0.0")
    pts = f"list_transform(regexp_extract_all({attr(e, 'points')}, {q(NUMBER)}), lambda t: CAST(t AS DOUBLE))"
    dn = f"list_transform(regexp_extract_all({attr(e, 'd')}, {q(NUMBER)}), lambda t: CAST(t AS DOUBLE))"

    def evens(a):
        return f"list_filter({a}, lambda _v, i: i % 2 = 1)"

    def odds(a):
        return f"list_filter({a}, lambda _v, i: i % 2 = 0)"

    def present(a, b):
        return f"list_filter([{a}, {b}], lambda z: z IS NOT NULL)"

    has_wh = f"({w} IS NOT NULL AND {h} IS NOT NULL)"
    xs = (f"CAST(CASE WHEN {tag} = 'rect' AND {has_wh} THEN [{x}, {x} + {w}] "
          f"WHEN {tag} = 'circle' THEN [{cx} - {r}, {cx} + {r}] "
          f"WHEN {tag} = 'ellipse' THEN [{cx} - {rx}, {cx} + {rx}] "
          f"WHEN {tag} = 'line' THEN {present(num('x1'), num('x2'))} "
          f"WHEN {tag} IN ('polyline', 'polygon') THEN {evens(pts)} "
          f"WHEN {tag} = 'path' THEN {evens(dn)} ELSE [] END AS DOUBLE[])")
    ys = (f"CAST(CASE WHEN {tag} = 'rect' AND {has_wh} THEN [{y}, {y} + {h}] "
          f"WHEN {tag} = 'circle' THEN [{cy} - {r}, {cy} + {r}] "
          f"WHEN {tag} = 'ellipse' THEN [{cy} - {ry}, {cy} + {ry}] "
          f"WHEN {tag} = 'line' THEN {present(num('y1'), num('y2'))} "
          f"WHEN {tag} IN ('polyline', 'polygon') THEN {odds(pts)} "
          f"WHEN {tag} = 'path' THEN {odds(dn)} ELSE [] END AS DOUBLE[])")
    return xs, ys


def bounds_lists(m: str) -> tuple[str, str]:
    xs, ys = element_xs_ys("e")
    allx = f"flatten(list_transform({start_tags(m)}, lambda e: {xs}))"
    ally = f"flatten(list_transform({start_tags(m)}, lambda e: {ys}))"
    return allx, ally


def coverage(min_x: str, min_y: str, max_x: str, max_y: str) -> str:
    cw = f"greatest({D(0.0)}, least({D(256.0)}, {max_x}) - greatest({D(0.0)}, {min_x}))"
    ch = f"greatest({D(0.0)}, least({D(256.0)}, {max_y}) - greatest({D(0.0)}, {min_y}))"
    return f"(CASE WHEN {min_x} IS NULL THEN {D(0.0)} ELSE greatest({D(0.0)}, least({D(1.0)}, {cw} * {ch} / {D(65536.0)})) END)"


def extract_markup(t: str, root: str = "svg") -> str:
    t = f"coalesce({t}, '')"
    full = f"regexp_extract({t}, {q(f'(?is)<{root}.*?</{root}>')}, 0)"
    start = f"instr(lower({t}), {q('<' + root)})"
    partial = f"substr({t}, {start})"
    upto = f"regexp_extract({partial}, '(?s)^.*>', 0)"
    low = f"lower({upto})"
    open_g = f"({count_sub(low, '<g ')} + {count_sub(low, '<g>')} - {count_sub(low, '</g>')})"
    salvaged = (f"CASE WHEN {start} = 0 OR length({upto}) - 1 < 10 THEN '' ELSE "
                f"{strip(f'{upto} || repeat({q(chr(60) + '/g>')}, least(greatest({open_g}, 0), 10)) || {q(f'</{root}>')}')} END")
    return f"(CASE WHEN length({full}) > 0 THEN {strip(full)} ELSE {salvaged} END)"


def fallback_markup(p: str) -> str:
    pl = f"lower(coalesce({p}, ''))"
    fill = "CASE " + " ".join(f"WHEN contains({pl}, {q(w)}) THEN {q(h)}" for w, h in K.FALLBACK_COLORS) + \
           f" ELSE {q(K.FALLBACK_DEFAULT_FILL)} END"
    bg = f"(CASE WHEN ({fill}) = {q(K.FALLBACK_LIGHT_BG)} THEN {q(K.FALLBACK_DARK_BG)} ELSE {q(K.FALLBACK_LIGHT_BG)} END)"

    def f(prefix):
        return f"{q(prefix + ' fill=' + chr(34))} || ({fill}) || {q(chr(34) + ' />')}"

    shapes = {
        "circle": f('<circle cx="128" cy="128" r="80"'),
        "triangle": f('<polygon points="128,48 208,208 48,208"'),
        "bars": " || ".join([f('<rect x="36" y="72" width="184" height="18"'),
                             f('<rect x="36" y="119" width="184" height="18"'),
                             f('<rect x="36" y="166" width="184" height="18"')]),
        "star": f(f'<polygon points="{K.STAR_POINTS}"'),
    }
    default = f('<rect x="40" y="40" width="176" height="176" rx="20"')
    shape = "CASE " + " ".join(f"WHEN {contains_any(pl, words)} THEN {shapes[name]}"
                               for name, words in K.FALLBACK_SHAPE_WORDS) + f" ELSE {default} END"
    head = f'<svg xmlns="{K.SVG_NAMESPACE}" width="256" height="256" viewBox="0 0 256 256"><rect width="256" height="256" fill="'
    return f"({q(head)} || {bg} || {q(chr(34) + ' />')} || ({shape}) || '</svg>')"


def bounds_cols(m: str, prefix: str = "") -> str:
    """SELECT-list items min_x, min_y, max_x, max_y (null without coordinates)."""
    xs, ys = bounds_lists(m)
    ok = f"(len({xs}) > 0 AND len({ys}) > 0)"
    return (f"CASE WHEN {ok} THEN list_min({xs}) END AS {prefix}min_x, CASE WHEN {ok} THEN list_min({ys}) END AS {prefix}min_y, "
            f"CASE WHEN {ok} THEN list_max({xs}) END AS {prefix}max_x, CASE WHEN {ok} THEN list_max({ys}) END AS {prefix}max_y")


def rescaled(m: str, min_x: str, min_y: str, max_x: str, max_y: str) -> str:
    """M10 on canonical text given its bounds columns (same double arithmetic order)."""
    cw = f"greatest({max_x} - {min_x}, {D(1.0)})"
    ch = f"greatest({max_y} - {min_y}, {D(1.0)})"
    fill = D(256 * 0.85)
    scale = f"least({fill} / {cw}, {fill} / {ch})"
    pad = f"((({D(256.0)} / {scale}) * {D(1.0 - 0.85)}) / {D(2.0)})"
    vb = f"printf('%.4f %.4f %.4f %.4f', {min_x} - {pad}, {min_y} - {pad}, {cw} + {D(2.0)} * {pad}, {ch} + {D(2.0)} * {pad})"
    new = f"regexp_replace({m}, '^(<svg\\b[^>]*?\\sviewBox=\")[^\"]*(\")', '\\1' || {vb} || '\\2')"
    return (f"(CASE WHEN length({m}) > 0 AND {min_x} IS NOT NULL AND {scale} >= {D(1.8)} "
            f"AND length({new}) <= {K.MAX_MARKUP_CHARS} THEN {new} ELSE {m} END)")


def candidate_score(prompt: str, m: str, valid: str, visible: str, colors: str, cov: str) -> str:
    """X12 with the reference's sequential summation order, in doubles."""
    target = f"(CASE WHEN {prompt_is_complex(prompt)} THEN {D(4200.0)} ELSE {D(1400.0)} END)"
    fit = f"exp(-abs(ln((length({m}) + {D(50.0)}) / ({target} + {D(50.0)}))))"
    pen = (f"(CASE WHEN {cov} < {D(0.01)} THEN {D(250.0)} WHEN {cov} < {D(0.03)} THEN {D(120.0)} "
           f"WHEN {cov} < {D(0.08)} THEN {D(40.0)} ELSE {D(0.0)} END)")

    def g(x):
        return f"(CASE WHEN {valid} THEN {x} ELSE {D(0.0)} END)"

    return (f"((CASE WHEN {valid} THEN {D(1000.0)} ELSE {D(-400.0)} END) + {structural_score(m)} + {prompt_bonus(prompt, m)}"
            f" + {g(f'least({visible}, 8) * {D(1.5)}')} + {g(f'least({colors}, 6) * {D(0.15)}')}"
            f" + {g(f'least({cov}, {D(0.35)}) * {D(95.0)}')} - {g(pen)} + {g(f'{fit} * {D(3.0)}')})")


def rich_counts(m: str) -> tuple[str, str]:
    """(drawable count, distinct paints) — paints lower-cased with spaces kept,
    style keys matched without lower-casing."""
    key = strip("split_part(p, chr(58), 1)")
    value = f"lower({strip('regexp_extract(p, ' + q('(?s)^[^:]*:(.*)$') + ', 1)')})"
    style = (f"list_transform(list_filter(string_split({attr('e', 'style')}, ';'), lambda p: contains(p, ':') AND "
             f"{key} IN ('fill', 'stroke')), lambda p: {value})")
    vals = f"list_concat([lower({strip(attr('e', 'fill'))}), lower({strip(attr('e', 'stroke'))})], {style})"
    per = f"list_filter({vals}, lambda v: NOT (v IN {in_list(K.NON_PAINT_VALUES)}))"
    colors = f"len(list_distinct(flatten(list_transform({drawables(m)}, lambda e: {per}))))"
    return f"len({drawables(m)})", colors
