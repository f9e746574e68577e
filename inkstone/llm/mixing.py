"""Operator 4: mixing to target weights with soft memberships.

A domain is one combination of the labels' quality and toxic columns ("q1t0").  A softmax
regression, fitted on at most SAMPLE_ROWS labelled documents (the smallest by a hash of the
id; of rows that repeat an id one), gives every document a posterior over the domains.  Its features are the presence of
FEATURES words, chosen by chi-square on the sample, and shares of character classes.

Document i with t_i words and posterior p_i gets a rate r_i >= 0 such that the expected domain
totals sum_i r_i t_i p_i match the targets: the weights times a budget of words.  The rates minimise the
squared distances sum_d (total_d - target_d)^2 by projected gradient: they start at 1, and a step takes
sum_d p_id (total_d - target_d) / free_d from each document, where free_d are the words of domain d in
documents whose rate is not at a bound (the largest step per domain that never overshoots while the same
documents stay free).  The projection on [0, max_rate] is lazy: steps add up before it, so that

    r_i = min(max_rate, max(0, 1 - sum_d p_id dual_d))

with one sum of steps ("dual") per domain, and no rates are stored or shuffled: a step is one aggregation
over a narrow table.  Steps carry momentum, which restarts when it points uphill.  They end when each total is
within TOLERANCE of its own target, or when neither the squares nor the largest miss fell by a tenth in PATIENCE
steps (targets that no rates can meet); then the rates with the smallest squares stay.  The final rates
are computed beside the texts.  Missed targets are warned of and are in the report.

Copies of a document: floor(rate + u).  With draw="random" u is a uniform hash of id and text, so
totals match in expectation; with draw="nearest" it is one half.

Defined results: null texts count as empty (no words, rate as computed); labels with a null id or
a null label are left out, repeated ones give the largest label; weights of domains without
labels are dropped and the others scaled up; without any usable label or weight every rate
is 1 and the domain is "none"; an empty table gives no rows.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_rows, id_column, materialise, text_runs
from inkstone.llm.quality import CLASSES, byte_classes

SAMPLE_ROWS, FEATURES, MIN_DOCUMENTS = 10_000, 400, 5
STEPS, PATIENCE, TOLERANCE = 1000, 20, 1e-4
DENSE = CLASSES + 3
MARKS = (b"", b".", b",", b";", b":", b"!", b"?", b"!!")
NO_DOMAIN = "none"


def dense_features(text: bytes, words: list, table) -> list[float]:
    """Shares of character classes, logarithm of the word count, shares of distinct words and of "|" words."""
    import numpy as np

    n = max(len(words), 1)
    shares = np.bincount(table[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
    return [*(shares / max(shares.sum(), 1)).tolist(), float(np.log1p(len(words))), len(set(words)) / n, words.count(b"|") / n]


def bare(words: list) -> set:
    return {w.rstrip(b".,;:!?") or w for w in words}


def labelled_sample(df: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(domain, text) of at most ``rows`` labelled documents; an id gives one row, the least by a hash of the text."""
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.struct("quality", "toxic")).alias("l"))
    named = one.select(F.col("doc_id").alias("id"), F.format_string("q%dt%d", "l.quality", "l.toxic").alias("domain"))
    known = named.join(df.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    found = df.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # at most ``rows`` rows are broadcast
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t")
    return found.groupBy("id", "domain").agg(one).select("domain", "t.text")


def choose_words(sample: DataFrame, sizes: dict) -> list[bytes]:
    """The FEATURES words with the largest chi-square between presence and domain."""
    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        found: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()),
                                               pa.array(list(found.values()), pa.int64())], ["domain", "word", "n"])

        for batch in batches:
            for domain, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found.update((domain, w) for w in bare((text or b"").lower().split()))
                if len(found) > 200_000:
                    yield rows()
                    found.clear()
        yield rows()

    names, total = sorted(sizes), sum(sizes.values())
    counts = sample.mapInArrow(presence, "domain string, word binary, n long").groupBy("word").agg(
        *[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(names)],
        F.sum("n").alias("n")).filter(F.col("n") >= MIN_DOCUMENTS)
    chi = sum((F.pow(F.col(f"n{i}") - F.col("n") * (sizes[d] / total), F.lit(2)) / (F.col("n") * (sizes[d] / total))
               for i, d in enumerate(names)), F.lit(0.0))
    return [bytes(r["word"]) for r in counts.orderBy(chi.desc(), "word").limit(FEATURES).collect()]


class Model:
    """Softmax regression over word presence and dense features; pickles to executors as numbers only."""

    def __init__(self, domains: list[str], words: list[bytes]):
        self.domains, self.words = domains, words
        self.place = {w + m: i for i, w in enumerate(words) for m in MARKS}
        for i, w in enumerate(words):
            self.place[w] = i  # a word of its own wins over another one with a mark
        self.weights = self.mean = self.scale = None

    def features(self, text: bytes, table) -> tuple[list[int], list[float]]:
        words = text.lower().split()
        present = {self.place[w] for w in self.place.keys() & set(words)}
        return sorted(present), dense_features(text, words, table)

    def matrix(self, rows: list):
        import numpy as np

        x = np.zeros((len(rows), len(self.words) + DENSE + 1), np.float32)
        for i, (present, dense) in enumerate(rows):
            x[i, present] = 1
            x[i, len(self.words):-1] = dense
        x[:, -1] = 1
        return x

    def fit(self, rows: list, domains: list[str], steps: int = 400, decay: float = 1e-4) -> None:
        """Full-batch accelerated gradient descent on the driver, over the bounded sample."""
        import numpy as np

        x, own = self.matrix(rows), {d: i for i, d in enumerate(self.domains)}
        first = len(self.words)
        self.mean, self.scale = x[:, first:-1].mean(axis=0), x[:, first:-1].std(axis=0) + 1e-6
        x[:, first:-1] = (x[:, first:-1] - self.mean) / self.scale
        y = np.eye(len(own), dtype=np.float32)[[own[d] for d in domains]]
        w = np.zeros((x.shape[1], len(own)), np.float32)
        mean = np.zeros_like(w)
        square = np.zeros_like(w)
        for k in range(1, steps + 1):
            g = x.T @ (self.softmax(x @ w) - y) / len(x) + decay * w
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            w -= 0.1 * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-8)
        self.weights = w

    @staticmethod
    def softmax(z):
        import numpy as np

        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posteriors(self, rows: list):
        first, x = len(self.words), self.matrix(rows)
        x[:, first:-1] = (x[:, first:-1] - self.mean) / self.scale
        return self.softmax(x @ self.weights)


def fit_model(df: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The classifier of the labelled table; None without labels of at least two domains."""
    sample = materialise(labelled_sample(df, labels, rows), "labelled-sample")
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    model = Model(sorted(sizes), choose_words(sample, sizes) if len(sizes) > 1 else [])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_classes()
        for batch in batches:
            found = [model.features(t or b"", table) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int32())),
                                              pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["domain", "present", "dense"])

    found = sample.mapInArrow(extract, "domain string, present array<int>, dense array<double>").collect()  # at most ``rows`` rows
    found.sort(key=lambda r: (r["domain"], r["present"], r["dense"]))
    model.fit([(r["present"], r["dense"]) for r in found], [r["domain"] for r in found])
    return model


def memberships(model: Model):
    """Column function text -> struct<words, posterior>."""
    @F.arrow_udf("struct<words: long, posterior: array<double>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = byte_classes()
        for batch in batches:
            words, out = [], []
            for _, _, texts in text_runs(batch):
                words += [len(t.split()) for t in texts]
                out += model.posteriors([model.features(t, table) for t in texts]).tolist()
            yield pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(out, pa.list_(pa.float64()))],
                                             names=["words", "posterior"])
    return score


def rate_column(member, history: list[list[float]], max_rate: float | None):
    """Rate of a document from its posterior and the steps of the duals, clipped after each."""
    if not history:
        return F.lit(1.0)
    steps = F.from_json(F.lit(json.dumps(history)), "array<array<double>>")

    def step(rate, g):
        new = rate - sum((member["posterior"][i] * g[i] for i in range(len(history[0]))), F.lit(0.0))
        new = F.greatest(new, F.lit(0.0))
        return F.least(new, F.lit(float(max_rate))) if max_rate is not None else new
    return F.aggregate(steps, F.lit(1.0), step)


def fit_duals(measure, available: list[float], targets: list[float]) -> tuple[list[float], list[float]]:
    """(duals, domain totals); ``measure`` gives totals and free words of the domains at given duals."""
    import numpy as np

    a, target = np.array(available), np.array(targets)
    used, floor = a > 0, np.maximum(target, TOLERANCE * a)
    scale = np.where(used, a, 1)
    duals = before = ahead = np.zeros(len(a))
    age, part, last = 1.0, 1.0, np.inf
    best, seen = (np.inf, duals, a), []
    for _ in range(STEPS):
        totals, free = (np.array(x) for x in measure(ahead.tolist()))
        error = np.where(used, totals - target, 0.0)
        squares, miss = (error ** 2 / scale).sum(), (np.abs(error) / np.where(used, floor, 1)).max()
        if miss <= TOLERANCE:
            return ahead.tolist(), totals.tolist()
        if squares < best[0]:
            best = squares, ahead, totals
        seen.append((best[0], min(miss, seen[-1][1] if seen else miss)))
        if len(seen) > 2 * PATIENCE and all(new > 0.9 * old for new, old in zip(seen[-1], seen[-1 - PATIENCE])):
            break
        if squares > 4 * last:  # too far: documents at a bound came free; back, with half the step
            part, age, duals, ahead = part / 2, 1.0, before, before
            continue
        new = ahead + part * error / np.maximum(free, 1e-3 * scale)
        if (error * (new - duals)).sum() < 0:
            age = 1.0
        older, age = age, (1 + np.sqrt(1 + 4 * age * age)) / 2
        before, duals, ahead, last = duals, new, new + (older - 1) / age * (new - duals), squares
    return best[1].tolist(), best[2].tolist()


def missed(report: dict) -> dict:
    """The rows of a report whose total is not within TOLERANCE of its target."""
    return {d: r for d, r in report.items() if abs(r[2] - r[1]) > TOLERANCE * r[1]}


def fit_rates(members: DataFrame, domains: list[str], weights: dict, budget: float | None = None,
              max_rate: float | None = None) -> tuple[list[list[float]], dict]:
    """(steps of the duals, {domain: (available, target, total)}) for a table with a struct column m of memberships.

    ``budget`` is the number of words to mix; by default as many as there are, or with
    ``max_rate`` as many as the scarcest domain allows.
    """
    n, p, t = len(domains), F.col("m.posterior"), F.col("m.words")
    dot = lambda x: sum((p[i] * float(x[i]) for i in range(n)), F.lit(0.0))
    top = F.lit(float("inf") if max_rate is None else float(max_rate))

    def measure(duals):
        raw, rate = F.lit(1.0) - dot(duals), F.least(F.greatest(F.col("raw"), F.lit(0.0)), top)
        free = F.when((F.col("raw") >= 0) & (F.col("raw") <= top), t).otherwise(0)
        row = members.select("m", raw.alias("raw")).withColumn("rate", rate).agg(
            *[F.sum(t * F.col("rate") * p[i]) for i in range(n)], *[F.sum(free * p[i]) for i in range(n)]).first()
        row = [x or 0.0 for x in row]
        return row[:n], row[n:]

    available = [x or 0.0 for x in members.agg(*[F.sum(t * p[i]) for i in range(n)]).first()]
    shares = [max(0.0, weights.get(d, 0.0)) if available[i] > 0 else 0.0 for i, d in enumerate(domains)]
    if not sum(shares):
        return [], {d: (a, a, a) for d, a in zip(domains, available)}
    shares = [s / sum(shares) for s in shares]
    if budget is None:
        budget = sum(available) if max_rate is None else max_rate * min(a / s for a, s in zip(available, shares) if s)
    targets = [s * budget for s in shares]
    duals, totals = fit_duals(measure, available, targets)
    report = {d: (a, x, y) for d, a, x, y in zip(domains, available, targets, totals)}
    if missed(report):
        warnings.warn("mixing targets not met, domain (available, target, total): "
                      + ", ".join(f"{d} ({a:.1f}, {x:.1f}, {y:.1f})" for d, (a, x, y) in missed(report).items()), stacklevel=2)
    return [duals], report


def mix(df: DataFrame, labels: DataFrame, weights: dict, budget: float | None = None, max_rate: float | None = None,
        draw: str = "random", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS,
        report: dict | None = None) -> DataFrame:
    """A struct ``row`` of the columns of ``df`` beside words, domain (the likeliest), posterior, rate and copies.

    A given ``report`` takes {domain: (available, target, total)} of the fitted rates.
    """
    text, key = id_column(df, text_col), id_column(df, id_col)
    plain = df.select(key.cast("long").alias("doc_id"), text.alias("text"))
    packed = df.select(F.struct(*[id_column(df, c).alias(c) for c in df.columns]).alias("row"), key.alias("id"), text.alias("text"))
    model = fit_model(plain, labels, rows)
    if model is None:
        return packed.select("row", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
                             F.lit(NO_DOMAIN).alias("domain"), F.array(F.lit(1.0)).alias("posterior"), F.lit(1.0).alias("rate"),
                             F.lit(1).alias("copies"))
    score = memberships(model)
    with arrow_rows(df.sparkSession):
        members = materialise(plain.select(score("text").alias("m")), "memberships")
    history, found = fit_rates(members, model.domains, weights, budget, max_rate)
    if report is not None:
        report.update(found)
    scored = packed.withColumn("m", score("text")).withColumn("rate", rate_column(F.col("m"), history, max_rate))
    u = F.lit(0.5) if draw == "nearest" else F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(1 << 53)) / float(1 << 53)
    names = F.array(*[F.lit(d) for d in model.domains])
    likeliest = F.element_at(names, F.array_position("m.posterior", F.array_max("m.posterior")).cast("int"))
    return scored.select("row", "m.words", likeliest.alias("domain"), "m.posterior", "rate",
                         F.floor(F.col("rate") + u).cast("int").alias("copies"))
