"""Text projections as Catalyst column expressions (no Python per row).

Patterns are written so that the same string also runs in DuckDB (RE2):
explicit character classes instead of ``\\s``/``\\b`` whose meaning differs
between Java, RE2 and Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone import constants as K
from inkstone.functions.cache import cached

# Characters Python's str.strip() / ``\s`` treat as white space, derived from the
# rule itself (str.isspace) rather than listed by hand.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WS_CHARS) + "]"
# Python ``\w`` for lower-cased text (letters, digits, underscore).
WORD = r"[\p{L}\p{N}_]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing white space of every kind
    (``TRIM(BOTH chars FROM s)``, no regex)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


@cached
def clean_prompt(c) -> Column:
    """Null -> "", strip."""
    return strip_ws(F.coalesce(_c(c).cast("string"), F.lit("")))


@cached
def prompt_norm(c) -> Column:
    """Lower case, collapse every white-space run to one space (map every
    white-space character to a space, then collapse runs of two or more)."""
    spaced = F.translate(F.lower(_c(c)), WS_CHARS, " " * len(WS_CHARS))
    return F.regexp_replace(spaced, "  +", " ")


def char_length(c) -> Column:
    """Code-point length (Spark ``length`` counts code points)."""
    return F.length(_c(c))


@cached
def csv_safe_text(c) -> Column:
    """CR/LF/TAB -> space, 2+ white space -> one space, strip, double quote -> single quote."""
    t = F.translate(_c(c), "\r\n\t", "   ")
    t = F.regexp_replace(t, rf"{WS}{{2,}}", " ")
    t = strip_ws(t)
    return F.replace(t, F.lit('"'), F.lit("'"))


@cached
def csv_safe_markup(c) -> Column:
    """P4 for canonical markup (attribute values in double quotes): apostrophes become character references first, so that the quote swap
    cannot end an attribute value early and a document that parses still parses."""
    return csv_safe_text(F.replace(_c(c), F.lit("'"), F.lit("&apos;")))


@cached
def truncate_prompt(c, max_chars: int = K.MAX_PROMPT_CHARS) -> Column:
    """P5: cut to ``max_chars`` and drop the last partial word (unchanged if no space)."""
    col = _c(c)
    cut = F.substring(col, 1, max_chars)
    return F.when(F.length(col) > max_chars, F.regexp_replace(cut, r" [^ ]*\z", "")).otherwise(col)


def count_sub(c, sub: str) -> Column:
    """Non-overlapping count of a literal substring (Python ``str.count``)."""
    col = _c(c)
    return ((F.length(col) - F.length(F.replace(col, F.lit(sub), F.lit("")))) / F.lit(len(sub))).cast("int")


def _any_contains(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


@cached
def prompt_complexity(c) -> Column:
    """Number of hint substrings present + (length >= 120), capped at 2."""
    low = F.lower(_c(c))
    hits = F.size(F.filter(F.array(*[F.lit(h) for h in K.COMPLEXITY_HINTS]), lambda h: F.contains(low, h)))
    return F.least(hits + (F.length(_c(c)) >= K.COMPLEX_PROMPT_CHARS).cast("int"), F.lit(2))


@cached
def prompt_is_complex(c) -> Column:
    """Any hint present or length >= 120."""
    return _any_contains(F.lower(_c(c)), K.COMPLEXITY_HINTS) | (F.length(_c(c)) >= K.COMPLEX_PROMPT_CHARS)


@cached
def markup_complexity(c) -> Column:
    """P10: five size/structure tests on markup text, capped at 2."""
    s = _c(c)
    tests = [
        F.length(s) >= 1800,
        count_sub(s, "<path") >= 12,
        count_sub(s, "<g") >= 4,
        (count_sub(s, "<linearGradient") + count_sub(s, "<radialGradient")) > 0,
        (count_sub(s, "<circle") + count_sub(s, "<rect") + count_sub(s, "<polygon")) >= 8,
    ]
    total = tests[0].cast("int")
    for t in tests[1:]:
        total = total + t.cast("int")
    return F.least(total, F.lit(2))


@cached
def color_tokens_literal(c) -> Column:
    """Colour words present as whole words, in the fixed colour order (one rlike per word)."""
    low = F.lower(_c(c))
    parts = [F.when(low.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])"), F.lit(w)) for w in K.COLOR_WORDS]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


@cached
def prompt_bonus(prompt, markup) -> Column:
    """+1.25 per (shape word in prompt and marker in markup), +0.25 per colour substring in both."""
    pl = F.lower(_c(prompt))
    sl = F.lower(_c(markup))
    total = F.lit(0.0)
    for word, marker in K.SHAPE_HINTS:
        total = total + F.when(F.contains(pl, F.lit(word)) & F.contains(sl, F.lit(marker)), 1.25).otherwise(0.0)
    for word in K.COLOR_WORDS:
        total = total + F.when(F.contains(pl, F.lit(word)) & F.contains(sl, F.lit(word)), 0.25).otherwise(0.0)
    return total


@cached
def structural_score(c) -> Column:
    """Additive structure score of markup text (plain case-sensitive counts)."""
    s = _c(c)
    n = F.length(s)
    paths = count_sub(s, "<path")
    base = (F.when((n >= 160) & (n <= 9000), 12.0).when((n >= 80) & (n <= 12000), 6.0).otherwise(0.0)
            + F.least(paths, F.lit(12)) * 0.6
            + F.least(count_sub(s, "<rect"), F.lit(10)) * 0.4
            + F.least(count_sub(s, "<circle"), F.lit(10)) * 0.4
            + F.least(count_sub(s, "<g"), F.lit(10)) * 0.25
            + F.least(count_sub(s, "fill="), F.lit(16)) * 0.15
            - F.greatest(paths - 64, F.lit(0)) * 0.15
            + F.when(F.contains(s, F.lit('viewBox="0 0 256 256"')) | F.contains(s, F.lit("viewBox='0 0 256 256'")), 6.0).otherwise(0.0))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(-1000.0)).otherwise(base)


@cached
def extract_markup(c, root_tag: str = "svg") -> Column:
    """First complete ``<root ...</root>`` (case-insensitive), else salvage a cut one.

    Salvage: from the first ``<root`` cut after the last ``>`` (empty when that is
    before index 10), close up to 10 open ``<g>`` groups, then close the root.
    """
    from inkstone.functions.markup import let
    t = F.coalesce(_c(c), F.lit(""))
    full = F.regexp_extract(t, rf"(?is)<{root_tag}.*?</{root_tag}>", 0)
    start = F.instr(F.lower(t), f"<{root_tag}")

    def salvage(s):
        upto = F.regexp_extract(F.substring(t, s["start"], 1 << 30), r"(?s)^.*>", 0)

        def close(u):
            low = F.lower(u)
            open_g = let(low, lambda lw: count_sub(lw, "<g ") + count_sub(lw, "<g>") - count_sub(lw, "</g>"))
            closers = F.repeat(F.lit("</g>"), F.least(F.greatest(open_g, F.lit(0)), F.lit(10)))
            return F.when((s["start"] == 0) | (F.length(u) - 1 < 10), F.lit("")).otherwise(
                strip_ws(F.concat(u, closers, F.lit(f"</{root_tag}>"))))
        return let(upto, close)

    return let(full, lambda f: F.when(F.length(f) > 0, strip_ws(f)).otherwise(
        let(F.struct(start.alias("start")), salvage)))


def preview(c, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(_c(c), 1, n)


@cached
def fallback_markup(prompt) -> Column:
    """Canonical fallback document from colour and shape words of the prompt."""
    pl = F.lower(F.coalesce(_c(prompt), F.lit("")))
    fill = F.lit(K.FALLBACK_DEFAULT_FILL)
    for word, hexv in reversed(K.FALLBACK_COLORS):
        fill = F.when(F.contains(pl, F.lit(word)), F.lit(hexv)).otherwise(fill)
    bg = F.when(fill == K.FALLBACK_LIGHT_BG, F.lit(K.FALLBACK_DARK_BG)).otherwise(F.lit(K.FALLBACK_LIGHT_BG))

    def _fill(prefix: str) -> Column:
        return F.concat(F.lit(prefix + ' fill="'), fill, F.lit('" />'))

    shapes = {
        "circle": _fill('<circle cx="128" cy="128" r="80"'),
        "triangle": _fill('<polygon points="128,48 208,208 48,208"'),
        "bars": F.concat(_fill('<rect x="36" y="72" width="184" height="18"'),
                         _fill('<rect x="36" y="119" width="184" height="18"'),
                         _fill('<rect x="36" y="166" width="184" height="18"')),
        "star": _fill(f'<polygon points="{K.STAR_POINTS}"'),
    }
    shape = _fill('<rect x="40" y="40" width="176" height="176" rx="20"')
    for name, words in reversed(K.FALLBACK_SHAPE_WORDS):
        shape = F.when(_any_contains(pl, words), shapes[name]).otherwise(shape)
    return F.concat(
        F.lit(f'<svg xmlns="{K.SVG_NAMESPACE}" width="256" height="256" viewBox="0 0 256 256">'),
        F.lit('<rect width="256" height="256" fill="'), bg, F.lit('" />'),
        shape, F.lit("</svg>"))


@cached
def unsafe_value(c) -> Column:
    """value contains one of the unsafe tokens (case-insensitive)."""
    return _any_contains(F.lower(_c(c)), K.UNSAFE_TOKENS)
