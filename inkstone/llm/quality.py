"""Operator 5: quality rules by distribution divergence.

Two histograms of a document are compared with references of its language by the
Jensen-Shannon distance (square root of the base-2 divergence):

* code points by class: lower, upper, digit, white space, punctuation, other ASCII, non-ASCII;
* the COMMON_WORDS most frequent words with a letter of the language, and all other words.

The references are counted over all given documents in one scan, words in lower case.  A
language has a reference when it holds MIN_REFERENCE_WORDS words.  Languages with more than
1 / HOT_SHARE of all words or rows (so at most 2 * HOT_SHARE) travel to the workers whole; rows
of all others meet their reference in a join by language.

A short text scatters more.  The word distance less the mean distance of as many words drawn from
the reference itself is taken over the distinct texts of a language (one more scan); the
limit is their median and SPREADS times their spread, the scaled step from lower quartile to
median, which junk above the median does not widen.  A language of under MIN_LIMIT_TEXTS
such texts is too small for a spread and takes the fixed word limit.  The limits of characters and
the fixed word limit widen with the root of the length.  A distance counts only from a minimum length on:
verdicts on shorter texts and on texts of a language without a reference are good.  Base rules
reject texts of under 10 words and those with over 20 % of their words in repeated 5-word windows.

Defined results: a null text has no words and fails the base rules; a null language is a
language of its own; repeated rows get equal rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import HOT_SHARE, id_column, materialise, text_runs

# words of any length can be common ones
COMMON_WORDS, SHORT_WORD = 100, float("inf")
MIN_REFERENCE_WORDS = 2000
# limit of the word distance less the mean distance of a draw: median + SPREADS spreads, in steps of 1 / BINS
SPREADS, MIN_SPREAD, MIN_LIMIT_TEXTS, BINS = 6, 0.01, 200, 1000
DRAWS = 64
CLASSES = 7
# limit = base + slope / sqrt(length); length in words or in code points
WORD_LIMIT, WORD_SLOPE, MIN_WORDS = 0.38, 1.2, 30
CHAR_LIMIT, CHAR_SLOPE, MIN_CHARS = 0.22, 1.2, 150
# FIXED VALUES: the rules' symbols and window
SYMBOLS, WINDOW = b"#*$%&|<>", 5
STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
         "char_distance double, word_distance double, kept boolean")


def byte_classes():
    """Class of each byte; continuation bytes get CLASSES, which is cut off."""
    import numpy as np

    out = np.full(256, 6, np.int64)
    for i in range(128):
        c = chr(i)
        out[i] = (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\n\x0b\x0c\r"
                  else 4 if c in ".,;:'\"?!-()" else 5)
    out[0x80:0xC0] = CLASSES
    return out


def language_table(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, n (words), documents, chars (class counts) and top (its common words) of every language of ``df``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = byte_classes()
        classes, totals, documents = defaultdict(lambda: np.zeros(CLASSES, np.int64)), Counter(), Counter()
        words: dict = defaultdict(Counter)

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in
                                               enumerate((pa.string(), pa.int32(), pa.binary(), pa.int64()))],
                                              ["lang", "class", "word", "n"])

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, _, texts in text_runs(batch.column(0)):
                for lang, text in zip(langs[a:], texts):
                    found = text.split()
                    classes[lang] += np.bincount(table[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
                    totals[lang] += len(found)
                    documents[lang] += 1
                    words[lang].update(found)
                if sum(map(len, words.values())) > 200_000:
                    yield rows([(k, None, lower(w), n) for k, c in words.items() for w, n in c.items()])
                    words.clear()
        found = [(k, None, lower(w), n) for k, c in words.items() for w, n in c.items()]
        found += [(k, i, None, int(n)) for k, c in classes.items() for i, n in enumerate(c)]
        yield rows(found + [(k, -1, None, n) for k, n in totals.items()] + [(k, -2, None, n) for k, n in documents.items()])

    text, lang = id_column(df, text_col), id_column(df, lang_col).cast("string")
    sums = df.select(text.alias("text"), lang.alias("lang")).mapInArrow(
        count, "lang string, class int, word binary, n long").groupBy("lang", "class", "word").agg(F.sum("n").alias("n"))
    sums = sums.filter(F.col("word").isNull() | F.decode("word", "UTF-8").rlike(r"\p{L}"))
    # the top rows of each map task are cut before the shuffle (WindowGroupLimit); the rows of classes are fewer
    place = F.row_number().over(Window.partitionBy("lang", F.col("word").isNull()).orderBy(F.desc("n"), "word"))
    kept = sums.withColumn("place", place).filter(F.col("place") <= COMMON_WORDS)
    of = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0))
    top = F.sort_array(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("place", "word", "n"))))
    return kept.groupBy("lang").agg(of(-1).alias("n"), of(-2).alias("documents"),
                                    F.array(*[of(i) for i in range(CLASSES)]).alias("chars"), top.alias("top"))


def hot_languages(langs: DataFrame) -> Column:
    """True for languages of ``langs`` with more than 1 / HOT_SHARE of all words or of all rows."""
    words, rows = langs.agg(F.sum("n"), F.sum("documents")).first()
    return (F.col("n") * HOT_SHARE >= (words or 0)) | (F.col("documents") * HOT_SHARE >= (rows or 0))


def reference(row) -> tuple:
    """(class counts, [common words], their counts, words in all) of a row of a language table."""
    return row["chars"], [bytes(x["word"]) for x in row["top"]], [x["n"] for x in row["top"]], row["n"]


def has_reference() -> Column:
    return F.col("n") >= MIN_REFERENCE_WORDS


def fit_references(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """{lang: reference} of the hot languages of ``df``."""
    langs = materialise(language_table(df, text_col, lang_col), "quality-languages")
    return {r["lang"]: reference(r) for r in langs.filter(hot_languages(langs) & has_reference()).collect()}


def lower(word: bytes) -> bytes:
    return word.lower() if word.isascii() else word.decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape")


def js_distance(counts, reference):
    """Jensen-Shannon distance of each row of ``counts`` to ``reference``; rows without counts get 0."""
    import numpy as np

    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(counts.sum(axis=1) > 0, np.sqrt(np.maximum(parts / 2, 0)), 0.0)


class Scorer:
    """Scores texts against ``references``; ``limits`` are those of languages with a limit of their own."""

    def __init__(self, references: dict, limits: dict | None = None):
        self.classes, self.langs, self.means, self.limits = byte_classes(), {}, {}, limits or {}
        self.own = set(references)
        for lang, found in references.items():
            self.put(lang, found)

    def put(self, lang, found: tuple, limit: float | None = None) -> None:
        import numpy as np

        chars, words, counts, n = found
        self.langs[lang] = (np.array(chars, float), {w: i for i, w in enumerate(words)},
                            np.array([*counts, n - sum(counts)], float))
        if limit is not None:
            self.limits[lang] = limit

    def take(self, langs: list, rows) -> None:
        """Languages that came with the rows, in place of those of the batch before."""
        for lang in self.langs.keys() - self.own:
            del self.langs[lang]
            self.limits.pop(lang, None)
            self.means.pop(lang, None)
        for i, lang in enumerate(langs):
            if lang not in self.langs and rows[i].is_valid:
                row = rows[i].as_py()
                self.put(lang, reference(row), row["limit"])

    def mean_distance(self, lang, n_words):
        """Mean word distance of texts of ``n_words`` words drawn from the reference of ``lang``."""
        import numpy as np

        grid = np.unique(np.round(2 ** np.arange(4, 20.1, 0.5)).astype(np.int64))
        if lang not in self.means:
            words, rng = self.langs[lang][2], np.random.default_rng(0)
            self.means[lang] = [js_distance(rng.multinomial(g, words / words.sum(), DRAWS).astype(float), words).mean() for g in grid]
        return np.interp(np.log2(np.maximum(n_words, 1)), np.log2(grid), self.means[lang])

    def word_histograms(self, lang, own, doc, codes, lowered, k):
        """Counts of the common words and of all others, for the documents ``own``."""
        import numpy as np

        common = self.langs[lang][1]
        place = np.full(k, -1)
        place[own] = np.arange(len(own))
        index = np.array([common.get(w, len(common)) for w in lowered], np.int64)
        mine = place[doc] >= 0
        flat = place[doc[mine]] * (len(common) + 1) + index[codes[mine]]
        return np.bincount(flat, minlength=len(own) * (len(common) + 1)).reshape(len(own), -1).astype(float)

    def excess(self, texts: list[bytes], langs: list):
        """Word distance less the mean distance of a draw; NaN for short texts and without a reference."""
        import numpy as np
        import pandas as pd

        k, split = len(texts), [t.split() for t in texts]
        n_words = np.array([len(w) for w in split], np.int64)
        doc = np.repeat(np.arange(k), n_words)
        codes, names = pd.factorize(np.array([w for ws in split for w in ws], object))
        lowered, out = [lower(w) for w in names] if len(names) else [], np.full(k, np.nan)
        for lang in {x for x in langs if x in self.langs}:
            own = np.flatnonzero([x == lang for x in langs])
            hist = self.word_histograms(lang, own, doc, codes.astype(np.int64), lowered, k)
            out[own] = js_distance(hist, self.langs[lang][2]) - self.mean_distance(lang, n_words[own])
        out[n_words < MIN_WORDS] = np.nan
        return out

    def repeats(self, codes, doc):
        """Words in windows that occur again in the same document, by document."""
        import numpy as np
        import pandas as pd

        n = len(codes)
        if n < WINDOW:
            return np.zeros(n, bool)
        rank = lambda x: pd.factorize(x)[0].astype(np.int64)
        pair = rank(codes[:-1] * (codes.max() + 1) + codes[1:])
        four = rank(pair[:-2] * (pair.max() + 1) + pair[2:])
        five = rank(four[:-1] * (codes.max() + 1) + codes[4:])
        inside = doc[:n - 4] == doc[4:]
        again = pd.Series(five * (int(doc.max()) + 1) + doc[:n - 4])[inside].duplicated(keep=False).to_numpy()
        starts = np.flatnonzero(inside)[again]
        hit = np.zeros(n + 1, np.int64)
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + WINDOW, -1)
        return np.cumsum(hit)[:n] > 0

    def score(self, texts: list[bytes], langs: list) -> list:
        import numpy as np
        import pandas as pd

        k, split = len(texts), [t.split() for t in texts]
        n_words = np.array([len(w) for w in split], np.int64)
        doc = np.repeat(np.arange(k), n_words)
        codes, names = pd.factorize(np.array([w for ws in split for w in ws], object))
        codes = codes.astype(np.int64)
        repeat = np.bincount(doc[self.repeats(codes, doc)], minlength=k)
        spaces = np.zeros(k, np.int64)
        chars = np.zeros((k, CLASSES))
        dup = np.zeros(k, np.int64)
        for i, t in enumerate(texts):
            chars[i] = np.bincount(self.classes[np.frombuffer(t, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
            spaces[i] = chars[i][3]
            lines = [x for x in t.split(b"\n") if x.strip()]
            dup[i] = len(lines) - len(set(lines))
        n_chars = chars.sum(axis=1).astype(np.int64)
        symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
        char_d, word_d = np.full(k, np.nan), np.full(k, np.nan)
        limit = WORD_LIMIT + WORD_SLOPE / np.sqrt(np.maximum(n_words, 1))
        lowered = [lower(w) for w in names] if len(names) else []
        for lang in {x for x in langs if x in self.langs}:
            own = np.flatnonzero([x == lang for x in langs])
            ref_chars, _, ref_words = self.langs[lang]
            hist = self.word_histograms(lang, own, doc, codes, lowered, k)
            char_d[own], word_d[own] = js_distance(chars[own], ref_chars), js_distance(hist, ref_words)
            if lang in self.limits:
                limit[own] = self.limits[lang] + self.mean_distance(lang, n_words[own])
        base = (n_words < 10) | (100 * repeat > 20 * n_words)
        with np.errstate(invalid="ignore"):
            bad = (n_chars >= MIN_CHARS) & (char_d > CHAR_LIMIT + CHAR_SLOPE / np.sqrt(np.maximum(n_chars, 1)))
            bad |= (n_words >= MIN_WORDS) & (word_d > limit)
        return [n_words, n_chars - spaces, symbols, dup, repeat, base, char_d, word_d, ~base & ~bad]


def scorer(references: dict, limits: dict | None = None):
    """Column function (text, lang[, reference row]) -> struct of STATS."""
    fields = [x.split() for x in STATS.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    @F.arrow_udf(f"struct<{', '.join(f'{a}: {b}' for a, b in fields)}>")
    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        import numpy as np

        own = Scorer(references, limits)
        for text, lang, *more in batches:
            langs = lang.to_pylist()
            if more:
                own.take(langs, more[0])
            runs = [own.score(texts, langs[a:b]) for a, b, texts in text_runs(text)]
            columns = [np.concatenate([r[i] for r in runs]) if runs else np.zeros(0) for i in range(len(fields))]
            yield pa.StructArray.from_arrays([pa.array(c, kinds[b], from_pandas=True) for c, (_, b) in zip(columns, fields)],
                                             names=[a for a, _ in fields])
    return score


def excess(references: dict):
    """Column function (text, lang[, reference row]) -> word distance less the mean distance of a draw."""
    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        import numpy as np

        own = Scorer(references)
        for text, lang, *more in batches:
            langs = lang.to_pylist()
            if more:
                own.take(langs, more[0])
            runs = [own.excess(texts, langs[a:b]) for a, b, texts in text_runs(text)]
            yield pa.array(np.concatenate(runs) if runs else np.zeros(0), pa.float64(), from_pandas=True)
    return score


def with_references(df: DataFrame, lang: Column, langs: DataFrame, hot: Column, cold: DataFrame, name: str, put) -> DataFrame:
    """``df`` with column ``name``: put() on rows of hot languages, put(reference row) on those of all others,
    which meet the rows of ``cold`` in a join by language."""
    names = F.broadcast(langs.filter(hot).select(F.col("lang").alias("__lang")))  # at most 2 * HOT_SHARE rows
    same = lang.eqNullSafe(F.col("__lang"))
    near = df.join(names, same, "left_semi").withColumn(name, put())
    rest = df.join(names, same, "left_anti").withColumn("__own", lang)
    found = cold.select(F.col("lang").alias("__lang"), F.struct("chars", "top", "n", "limit").alias("__reference"))
    far = rest.join(found, F.col("__own").eqNullSafe(F.col("__lang")), "left").withColumn(name, put(F.col("__reference")))
    return near.unionByName(far.drop("__own", "__lang", "__reference"))


def word_limits(rows: DataFrame) -> DataFrame:
    """lang and limit from the distinct (lang, digest, excess) of ``rows``, for languages of enough texts."""
    bins = rows.filter("excess IS NOT NULL").select("lang", "digest", F.floor(F.col("excess") * BINS).alias("bin")).distinct()
    bins = bins.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))  # a few thousand bins a language at most
    whole = Window.partitionBy("lang")
    bins = bins.withColumn("texts", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(whole.orderBy("bin")))
    at = lambda part: F.min(F.when(F.col("upto") >= part * F.col("texts"), F.col("bin")))
    sums = bins.groupBy("lang").agg(F.max("texts").alias("texts"), at(0.25).alias("low"), at(0.5).alias("mid"))
    spread = F.greatest((F.col("mid") - F.col("low")) / 0.6745, F.lit(MIN_SPREAD * BINS))  # a normal law's quartile
    return sums.filter(F.col("texts") >= MIN_LIMIT_TEXTS).select("lang", ((F.col("mid") + 1 + SPREADS * spread) / BINS).alias("limit"))


def quality_rules(df: DataFrame, text_col: str = "text", lang_col: str = "lang", name: str = "quality") -> DataFrame:
    """``df`` with a struct column ``name`` of counts, distances and the verdict ``kept``."""
    text, lang = id_column(df, text_col), id_column(df, lang_col).cast("string")
    langs = materialise(language_table(df, text_col, lang_col), "quality-languages")
    hot = hot_languages(langs)
    references = {r["lang"]: reference(r) for r in langs.filter(hot & has_reference()).collect()}
    cold = langs.filter(~hot & has_reference()).withColumn("limit", F.lit(None).cast("double"))
    any_cold = bool(cold.take(1))

    plain = df.select(text.alias("text"), lang.alias("lang"))
    distance = excess(references)
    if any_cold:
        plain = with_references(plain, plain["lang"], langs, hot, cold, "excess", lambda *r: distance("text", "lang", *r))
    else:
        plain = plain.withColumn("excess", distance("text", "lang"))
    limits = materialise(word_limits(plain.select("lang", F.xxhash64("text").alias("digest"), "excess")), "quality-limits")
    own = {r["lang"]: r["limit"] for r in limits.join(F.broadcast(langs.filter(hot).select(F.col("lang").alias("k"))),
                                                      F.col("lang").eqNullSafe(F.col("k")), "left_semi").collect()}
    verdict = scorer(references, own)
    if not any_cold:
        return df.withColumn(name, verdict(text, lang))
    cold = cold.drop("limit").join(limits.withColumnRenamed("lang", "k"), F.col("lang").eqNullSafe(F.col("k")), "left")
    return with_references(df, lang, langs, hot, cold, name, lambda *r: verdict(text, lang, *r))
