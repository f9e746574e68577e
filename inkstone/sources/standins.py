"""Stand-in inputs built from the driver tables.

The driver tables hold no markup, so the markup corpus is *built* from
``part`` by string concatenation.  The builders below only produce rows in the
schema the jobs expect (``id, prompt, svg`` ...); they do none of the jobs'
work, and the jobs take nothing from how the rows were made.

Each builder is one SQL text that runs unchanged in Spark SQL and in DuckDB
(``dialect`` only switches the row-multiplying clause), so the Spark job and
the DuckDB oracle see byte-identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# a row of ``part`` has some ten bytes in its file and becomes documents of hundreds of bytes, parsed and scored: splits by
# file size would leave a table of millions of rows to a few tasks
ROWS_PER_TASK, LEAST_ROWS_PER_TASK = 10_000, 1_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to tasks of at most ROWS_PER_TASK rows, to fewer rows each while cores would idle.

    The rows are counted from the file footers; a table too small to deal out stays as it is.
    """
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-rows // ROWS_PER_TASK), min(cores, -(-rows // LEAST_ROWS_PER_TASK)))
    return df.repartition(tasks) if tasks > 1 else df


def register(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register driver tables as temp views (same names as the oracle's views)."""
    for n in names or TABLES:
        df = load(spark, sf_dir, n)
        (spread(df) if n == "part" else df).createOrReplaceTempView(n)


def _choices(seed: str) -> str:
    """Per-row markup choices derived from an integer seed expression."""
    return f"""
    CASE ({seed}) % 8 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN '#fff' WHEN 3 THEN 'none'
         WHEN 4 THEN 'rgb(0, 128, 0)' WHEN 5 THEN 'gold' WHEN 6 THEN '#abc' ELSE 'url(#g)' END AS paint,
    (p_size + ({seed})) % 6 AS shape,
    CASE ({seed}) % 3 WHEN 0 THEN '24' WHEN 1 THEN '110' ELSE '240' END AS e,
    CASE ({seed}) % 3 WHEN 0 THEN '12' WHEN 1 THEN '55' ELSE '120' END AS eh,
    CASE ({seed}) % 3 WHEN 0 THEN '10' WHEN 1 THEN '53' ELSE '118' END AS er,
    CASE ({seed}) % 3 WHEN 0 THEN '8' WHEN 1 THEN '36' ELSE '80' END AS et,
    CASE ({seed}) % 3 WHEN 0 THEN '22' WHEN 1 THEN '108' ELSE '238' END AS em,
    CASE ({seed}) % 3 WHEN 0 THEN '20' WHEN 1 THEN '106' ELSE '236' END AS ew,
    ({seed}) % 7 AS defect,
    ({seed}) % 11 AS styled,
    ({seed}) % 5 AS wrap"""


_SHAPE = """
    CASE shape WHEN 0 THEN '<circle cx="' || eh || '" cy="' || eh || '" r="' || er || '"'
               WHEN 1 THEN '<rect x="2" y="2" width="' || ew || '" height="' || ew || '"'
               WHEN 2 THEN '<ellipse cx="' || eh || '" cy="' || eh || '" rx="' || er || '" ry="' || et || '"'
               WHEN 3 THEN '<line x1="2" y1="2" x2="' || em || '" y2="' || em || '"'
               WHEN 4 THEN '<polygon points="' || eh || ',2 ' || em || ',' || em || ' 2,' || em || '"'
               ELSE '<path d="M2 2 L' || em || ' 2 L' || eh || ' ' || em || ' Z"' END AS shape_open,
    CASE WHEN shape = 3 THEN 'stroke' ELSE 'fill' END AS paint_attr"""

# raw markup, as a corpus would hold it
_RAW = """
    '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ' || e || ' ' || e || '" width="' || e || '">'
    || '<title>' || p_name || '</title>'
    || '<g id="grp">' || shape_open
    || CASE WHEN styled = 0 THEN ' style="' || paint_attr || ': ' || paint || '; opacity: 1"'
            ELSE ' ' || paint_attr || '="' || paint || '"' END
    || CASE WHEN defect = 4 THEN ' onclick="go()"' ELSE '' END || '/></g>'
    || CASE WHEN defect = 3 THEN '<script>alert(1)</script>' ELSE '' END
    || CASE WHEN defect = 5 THEN '<use href="http://example.com/a.svg#x"/>' ELSE '' END
    || CASE WHEN defect = 6 THEN '' ELSE '</svg>' END"""

# what canonicalisation (train variant) must give for _RAW
_EXPECTED_TRAIN = """
    CASE WHEN defect = 6 THEN '' ELSE
      '<svg viewBox="0 0 256 256" width="256" height="256">'
      || '<title>' || p_name || '</title>'
      || '<g id="grp">' || shape_open
      || CASE WHEN styled = 0 AND paint = 'url(#g)' THEN ''
              WHEN styled = 0 THEN ' style="' || paint_attr || ':' || paint || ';opacity:1"'
              ELSE ' ' || paint_attr || '="' || paint || '"' END
      || ' /></g>'
      || CASE WHEN defect = 5 THEN '<use />' ELSE '' END
      || '</svg>' END"""

# what the train variant gives for extracted model output (a cut document is
# salvaged by closing it)
_EXPECTED_TRAIN_EXTRACTED = """
      '<svg viewBox="0 0 256 256" width="256" height="256">'
      || '<title>' || p_name || '</title>'
      || '<g id="grp">' || shape_open
      || CASE WHEN styled = 0 AND paint = 'url(#g)' THEN ''
              WHEN styled = 0 THEN ' style="' || paint_attr || ':' || paint || ';opacity:1"'
              ELSE ' ' || paint_attr || '="' || paint || '"' END
      || ' /></g>'
      || CASE WHEN defect = 5 THEN '<use />' ELSE '' END
      || '</svg>'"""

# what the infer variant gives after extraction (a cut document is salvaged by
# closing it, so every built document canonicalises)
_EXPECTED_INFER = """
      '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 256 256" width="256" height="256">'
      || '<title>' || p_name || '</title>'
      || '<g id="grp">' || shape_open
      || CASE WHEN styled = 0 AND paint = 'url(#g)' THEN ''
              WHEN styled = 0 THEN ' style="' || paint_attr || ':' || paint || ';opacity:1"'
              ELSE ' ' || paint_attr || '="' || paint || '"' END
      || ' /></g>'
      || CASE WHEN defect = 5 THEN '<use />' ELSE '' END
      || '</svg>'"""

_WRAP = """
    CASE WHEN wrap = 0 THEN raw_svg
         ELSE 'Sure! Here is the drawing:' || chr(10) || raw_svg || chr(10) || 'Hope it helps.' END"""


def markup_pairs_sql(expected: bool = False) -> str:
    """(id, prompt, svg[, raw_text, expected_norm]) — one built document per ``part`` row."""
    extra = f", {_WRAP} AS raw_text, {_EXPECTED_TRAIN} AS expected_norm" if expected else ""
    return f"""
    SELECT CAST(p_partkey AS STRING) AS id, p_name AS prompt, raw_svg AS svg{extra}
    FROM (SELECT *, {_RAW} AS raw_svg
          FROM (SELECT *, {_SHAPE} FROM (SELECT p_partkey, p_name, p_size, {_choices('p_partkey')} FROM part) c0) c1) c2"""


def predictions_sql(expected: bool = False) -> str:
    """(checkpoint, id, raw_text) — free text with markup inside, one per part row and checkpoint."""
    parts = []
    extra = f", {_EXPECTED_TRAIN_EXTRACTED} AS expected_svg" if expected else ""
    for shift, name in ((1, "ckpt-100"), (2, "ckpt-200")):
        parts.append(f"""
    SELECT '{name}' AS checkpoint, CAST(p_partkey AS STRING) AS id, {_WRAP} AS raw_text{extra}
    FROM (SELECT *, {_RAW} AS raw_svg
          FROM (SELECT *, {_SHAPE}
                FROM (SELECT p_partkey, p_name, p_size, {_choices(f'p_partkey + {shift}')}
                      FROM part) c0) c1) c2""")
    return " UNION ALL ".join(parts)


def candidates_sql(dialect: str = "spark", expected: bool = False) -> str:
    """(prompt_id, prompt, seq, source, raw_text) — 1 to 4 generated candidates for every
    ``part`` row (each row is a test prompt)."""
    if dialect == "spark":
        rows = "SELECT p.*, s.seq FROM part p LATERAL VIEW explode(sequence(0, CAST(p_partkey % 4 AS INT))) s AS seq"
    else:
        rows = "SELECT p.*, s.seq FROM part p, LATERAL (SELECT unnest(range(0, p.p_partkey % 4 + 1)) AS seq) s"
    extra = f", {_EXPECTED_INFER} AS expected_canon" if expected else ""
    return f"""
    SELECT CAST(p_partkey AS STRING) AS prompt_id, p_name AS prompt, CAST(seq AS INT) AS seq,
           CASE WHEN seq = 0 THEN 'greedy' ELSE 'sampled' END AS source, {_WRAP} AS raw_text{extra}
    FROM (SELECT *, {_RAW} AS raw_svg
          FROM (SELECT *, {_SHAPE}
                FROM (SELECT p_partkey, p_name, p_size, seq, {_choices('p_partkey + seq')}
                      FROM ({rows}) r) c0) c1) c2"""


def test_prompts_sql() -> str:
    """(prompt_id, prompt) — the test prompts of the ranking job: every ``part`` row."""
    return "SELECT CAST(p_partkey AS STRING) AS prompt_id, p_name AS prompt FROM part"


def train_pairs_sql(expected: bool = False) -> str:
    """(id, prompt, svg[, expected_canon]) — the retrieval corpus: every ``part`` row as a
    (prompt, markup) training pair."""
    extra = f", {_EXPECTED_INFER} AS expected_canon" if expected else ""
    return f"""
    SELECT CAST(p_partkey AS STRING) AS id, p_name AS prompt, raw_svg AS svg{extra}
    FROM (SELECT *, {_RAW} AS raw_svg
          FROM (SELECT *, {_SHAPE} FROM (SELECT p_partkey, p_name, p_size, {_choices('p_partkey')} FROM part) c0) c1) c2"""


def markup_pairs(spark: SparkSession, sf_dir: str, expected: bool = False) -> DataFrame:
    register(spark, sf_dir, ["part"])
    return spark.sql(markup_pairs_sql(expected))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["part"])
    return spark.sql(predictions_sql())


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["part"])
    return spark.sql(candidates_sql("spark"))


def test_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["part"])
    return spark.sql(test_prompts_sql())


def train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["part"])
    return spark.sql(train_pairs_sql())


def images_sql(dialect: str = "spark") -> tuple[str, str]:
    """(reference images, predicted images) from ``embeddings``: 8 x 8 gray images,
    value (v + 1) / 2; the prediction of checkpoint c for row i is the image of row i + shift."""
    lam = "v -> (CAST(v AS DOUBLE) + 1) / 2" if dialect == "spark" else "lambda v: (CAST(v AS DOUBLE) + 1) / 2"
    fn = "transform" if dialect == "spark" else "list_transform"
    refs = f"SELECT CAST(vec_id AS STRING) AS id, {fn}(embedding, {lam}) AS pixels FROM embeddings"
    preds = " UNION ALL ".join(
        f"SELECT '{name}' AS checkpoint, CAST(a.vec_id AS STRING) AS id, {fn}(b.embedding, {lam}) AS pixels "
        f"FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + {shift}"
        for shift, name in ((1, "ckpt-100"), (2, "ckpt-200")))
    return refs, preds


def images(spark: SparkSession, sf_dir: str):
    register(spark, sf_dir, ["embeddings"])
    refs, preds = images_sql("spark")
    return spark.sql(refs), spark.sql(preds)


def candidate_images_sql(dialect: str = "spark") -> str:
    """(prompt_id, seq, pixels, image_vec, text_vec): a rendered image per candidate and a text
    embedding per prompt, both taken from ``embeddings`` (image of row prompt + seq, text of row prompt)."""
    lam = "v -> (CAST(v AS DOUBLE) + 1) / 2" if dialect == "spark" else "lambda v: (CAST(v AS DOUBLE) + 1) / 2"
    fn = "transform" if dialect == "spark" else "list_transform"
    return f"""
    SELECT c.prompt_id, c.seq, {fn}(e.embedding, {lam}) AS pixels,
           CAST(e.embedding AS {'ARRAY<DOUBLE>' if dialect == 'spark' else 'DOUBLE[]'}) AS image_vec,
           CAST(t.embedding AS {'ARRAY<DOUBLE>' if dialect == 'spark' else 'DOUBLE[]'}) AS text_vec
    FROM ({candidates_sql(dialect)}) c
    JOIN embeddings e ON e.vec_id = CAST(c.prompt_id AS BIGINT) + c.seq
    JOIN embeddings t ON t.vec_id = CAST(c.prompt_id AS BIGINT)"""


def candidate_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["part", "embeddings"])
    return spark.sql(candidate_images_sql("spark"))


def rgb_images_sql(dialect: str = "spark") -> str:
    """(id, r, g, b): colour images whose channels are the gray images of three
    neighbouring ``embeddings`` rows."""
    lam = "v -> (CAST(v AS DOUBLE) + 1) / 2" if dialect == "spark" else "lambda v: (CAST(v AS DOUBLE) + 1) / 2"
    fn = "transform" if dialect == "spark" else "list_transform"
    return f"""
    SELECT CAST(a.vec_id AS STRING) AS id, {fn}(a.embedding, {lam}) AS r, {fn}(b.embedding, {lam}) AS g,
           {fn}(c.embedding, {lam}) AS b
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2"""


def color_planes_sql(dialect: str = "spark") -> str:
    """(vec_id, n, r, g, b, a): 64 pixels of 8-bit colour planes with alpha per ``embeddings`` row, from the row and the three
    after it (the last is followed by the first).  Values are spread so that channels saturate; every
    seventh image is fully transparent, the others are opaque but for some pixels."""
    if dialect == "spark":
        fn, args = "transform", lambda v: f"{v} ->"
    else:
        fn, args = "list_transform", lambda v: f"lambda {v}:"
    byte = f"{fn}(embedding, {args('v')} CAST(greatest(0, least(255, floor(128 + 900 * CAST(v AS DOUBLE)))) AS INTEGER))"
    alpha = f"{fn}(w.c, {args('v')} CASE WHEN x.vec_id % 7 = 0 THEN 0 WHEN v < 200 THEN 255 ELSE v END)"
    src = f"(SELECT vec_id, {byte} AS c, (SELECT count(*) FROM embeddings) AS n FROM embeddings)"
    return f"""
    SELECT x.vec_id, x.n, x.c AS r, y.c AS g, z.c AS b, {alpha} AS a
    FROM {src} x JOIN {src} y ON y.vec_id = (x.vec_id + 1) % x.n JOIN {src} z ON z.vec_id = (x.vec_id + 2) % x.n
    JOIN {src} w ON w.vec_id = (x.vec_id + 3) % x.n"""


# FIXED VALUES: checkpoints of the predicted images and how far their images lie from the reference's
_IMAGE_SHIFTS = (("ckpt-100", 0), ("ckpt-200", 1))


def color_images_sql(dialect: str = "spark") -> tuple[str, str]:
    """((id, width, r, g, b, a), (checkpoint, id, width, r, g, b, a)): a colour image of every ``part`` row as reference and per
    checkpoint, 8 or 16 pixels wide by id.  Every eleventh prediction of the second checkpoint has another width, so that its
    pair cannot be compared."""
    planes = color_planes_sql(dialect)
    width = "CASE WHEN p_partkey % 3 = 0 THEN 16 ELSE 8 END"
    part = "(SELECT p_partkey, (SELECT count(*) FROM embeddings) AS m FROM part)"
    refs = f"""SELECT CAST(p_partkey AS STRING) AS id, {width} AS width, r, g, b, a
               FROM {part} p JOIN ({planes}) i ON i.vec_id = p.p_partkey % p.m"""
    preds = " UNION ALL ".join(f"""
               SELECT '{name}' AS checkpoint, CAST(p_partkey AS STRING) AS id,
                      {width if not shift else f"CASE WHEN p_partkey % 11 = 0 THEN 4 ELSE {width} END"} AS width, r, g, b, a
               FROM {part} p JOIN ({planes}) i ON i.vec_id = (p.p_partkey * {1 + shift} + {shift}) % p.m""" for name, shift in _IMAGE_SHIFTS)
    return refs, preds


def packed_image(planes: DataFrame) -> DataFrame:
    """``image`` (see functions.raster) in place of the columns width, r, g, b, a."""
    image = F.expr("""named_struct('width', width, 'height', CAST(size(r) div width AS INT), 'rgba', unhex(array_join(transform(
        r, (v, i) -> concat(lpad(hex(v), 2, '0'), lpad(hex(g[i]), 2, '0'), lpad(hex(b[i]), 2, '0'), lpad(hex(a[i]), 2, '0'))), '')))""")
    return planes.withColumn("image", image).drop("width", "r", "g", "b", "a")


def color_images(spark: SparkSession, sf_dir: str):
    """(reference images (id, image), predicted images (checkpoint, id, image))."""
    register(spark, sf_dir, ["embeddings", "part"])
    refs, preds = color_images_sql("spark")
    return packed_image(spark.sql(refs)), packed_image(spark.sql(preds))


def level_candidates_sql(dialect: str = "spark", expected: bool = False) -> str:
    """(prompt_id, prompt, seq, source, model, model_label, model_path, n, temperature, raw_text): for every ``part`` row 1 to 4
    candidates of two models in turn and 3 retries.  Every ninth prompt's first generation broke off (null
    text), every tenth's candidates hold no markup, and of three prompts in four the first one or all retries hold none."""
    rows = ("SELECT p.*, s.seq FROM part p LATERAL VIEW explode(concat(sequence(0, CAST(p_partkey % 4 AS INT)), array(100, 101, 102))) s AS seq"
            if dialect == "spark" else
            "SELECT p.*, s.seq FROM part p, LATERAL (SELECT unnest(list_concat(range(0, p.p_partkey % 4 + 1), [100, 101, 102])) AS seq) s")
    broken = "seq = 0 AND p_partkey % 9 = 0"
    bare = "seq < 100 AND p_partkey % 10 = 1 OR seq = 100 AND p_partkey % 4 > 0 OR seq > 100 AND p_partkey % 4 > 1"
    extra = f", CASE WHEN {broken} OR {bare} THEN '' ELSE {_EXPECTED_INFER} END AS expected_canon" if expected else ""
    label = "CASE WHEN seq % 2 = 0 THEN 'base' ELSE 'tuned' END"
    return f"""
    SELECT CAST(p_partkey AS STRING) AS prompt_id, p_name AS prompt, CAST(seq AS INT) AS seq,
           CASE WHEN seq >= 100 THEN 'retry' WHEN seq < 2 THEN 'greedy' ELSE 'sampled' END AS source,
           CASE WHEN seq < 100 THEN CAST(seq % 2 AS INT) END AS model, CASE WHEN seq < 100 THEN {label} END AS model_label,
           CASE WHEN seq < 100 THEN '/models/' || {label} END AS model_path, CAST(floor(seq / 2) AS INT) AS n,
           CASE seq WHEN 100 THEN CAST(0.9 AS DOUBLE) WHEN 101 THEN CAST(0.96 AS DOUBLE) WHEN 102 THEN CAST(1.05 AS DOUBLE) END AS temperature,
           CASE WHEN {broken} THEN NULL WHEN {bare} THEN 'Sorry, no drawing.' ELSE {_WRAP} END AS raw_text{extra}
    FROM (SELECT *, {_RAW} AS raw_svg
          FROM (SELECT *, {_SHAPE}
                FROM (SELECT p_partkey, p_name, p_size, seq, {_choices('p_partkey + seq')}
                      FROM ({rows}) r) c0) c1) c2"""


def level_train_sql(expected: bool = False) -> str:
    """The retrieval corpus of the query above: two rows in five have a prompt that no test prompt equals."""
    return train_pairs_sql(expected).replace("p_name AS prompt", "CASE WHEN p_partkey % 5 < 2 THEN p_name || ' sketch' ELSE p_name END AS prompt")


def level_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    register(spark, sf_dir, ["part"])
    return spark.sql(level_candidates_sql()), spark.sql(level_train_sql())
