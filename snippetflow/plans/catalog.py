"""Registered queries: each is a Spark job over the driver's tables, paired
with DuckDB SQL that computes the same result (the correctness oracle).

Test-data mapping (FIXTURES.md): ``documents`` stands in for a sample table
with ``id = doc_id``, ``code = text``, ``language = lang`` and ``label`` = the
index of ``lang`` in (de, en, es, fr).  Doubles are rounded to 6 places on
both sides so the comparison does not hinge on summation order.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snippetflow.functions import text as X
from snippetflow.functions.cues import TEXT_CUES, CueTable
from snippetflow.functions.cues import CODE_CUE_TABLE, CODE_CUES, CODE_LANGUAGES, TEXT_CUE_TABLE
from snippetflow.functions.rand import sql_uniform
from snippetflow.operators import classify as C
from snippetflow.operators import clean, detect, metrics
from snippetflow.operators import ensemble, labels, profile, sampling, softmax
from snippetflow.plans import jobs
from snippetflow.schema import file_row_ids, with_file_order, with_row_key
from snippetflow.session import cut_lineage
from snippetflow.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The label order of the test mapping (label = index).
LANGS = ["de", "en", "es", "fr"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------- inputs ---

# Row-id column per table: thin scans are spread by it (sources.io.spread).
TABLE_KEYS = {"documents": "doc_id", "labels": "doc_id", "events": "event_id",
              "conversations": "conv_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from snippetflow.sources.io import read_table
    return read_table(spark, f"{sf_dir}/{name}.parquet", TABLE_KEYS.get(name))


def label_of(lang_col) -> "F.Column":
    expr = None
    for i, lang in enumerate(LANGS):
        expr = F.when(lang_col == lang, F.lit(i)) if expr is None else expr.when(lang_col == lang, F.lit(i))
    return expr


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("code"),
                    F.col("lang").alias("language"), label_of(F.col("lang")).alias("label"))


LABEL_SQL = "CASE lang " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LANGS)) + " END"
SAMPLES_SQL = f"(SELECT doc_id AS id, text AS code, lang AS language, {LABEL_SQL} AS label FROM documents)"


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def scored(spark, sf_dir) -> DataFrame:
    """Preprocessed samples with the cue classifier's integer prediction."""
    s = clean.preprocess(samples(spark, sf_dir))
    return TEXT_CUE_TABLE.apply(s, "code", "predicted_label", "index")


PRE_SQL = f"(SELECT * FROM {SAMPLES_SQL} WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY id) = 1)"
SCORED_SQL = TEXT_CUE_TABLE.sql_classify(PRE_SQL, "id", "code", "predicted_label", "label, language, code")
CONF_SQL = f"(SELECT label AS true_label, predicted_label, count(*) AS n FROM {SCORED_SQL} GROUP BY 1, 2)"
PC_SQL = f"""(WITH conf AS {CONF_SQL},
  sup AS (SELECT true_label AS label, sum(n) AS support,
                 sum(CASE WHEN true_label = predicted_label THEN n ELSE 0 END) AS tp FROM conf GROUP BY 1),
  prd AS (SELECT predicted_label AS label, sum(n) AS n_pred FROM conf GROUP BY 1),
  tot AS (SELECT coalesce(sup.label, prd.label) AS label, coalesce(tp, 0)::BIGINT AS tp,
                 coalesce(support, 0)::BIGINT AS support, coalesce(n_pred, 0)::BIGINT AS n_pred
          FROM sup FULL OUTER JOIN prd ON sup.label = prd.label)
  SELECT label, tp, support, n_pred,
         CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0 END AS recall,
         CASE WHEN support + n_pred > 0 THEN 2.0 * tp / (support + n_pred) ELSE 0.0 END AS f1
  FROM tot)"""
LABEL_MAP_SQL = f"""(SELECT label, arg_max(language, first_ord) AS name FROM
  (SELECT label, language, min(id) AS first_ord FROM {SAMPLES_SQL} GROUP BY 1, 2) GROUP BY 1)"""


# ------------------------------------------------------- first slice -------

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string"


@register("scan_samples", f"SELECT * FROM {SAMPLES_SQL}")
def q_scan_samples(spark, sf_dir):
    """S1 with a declared schema: only its columns are read, and no file is opened to infer one."""
    d = spark.read.schema(DOCUMENT_SCHEMA).parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("code"), F.col("lang").alias("language"), label_of(F.col("lang")).alias("label"))


@register("preprocess", f"SELECT * FROM {PRE_SQL}")
def q_preprocess(spark, sf_dir):
    return clean.preprocess(samples(spark, sf_dir))


@register("detect_language",
          "SELECT * FROM " + TEXT_CUE_TABLE.sql_detect(SAMPLES_SQL, "id", "code", "detected_language"))
def q_detect_language(spark, sf_dir):
    return detect.detect_language(samples(spark, sf_dir)).select("id", "detected_language")


@register("language_distribution", f"""
SELECT detected_language AS language, count(*) AS n
FROM {TEXT_CUE_TABLE.sql_detect(SAMPLES_SQL, "id", "code", "detected_language")} GROUP BY 1""")
def q_language_distribution(spark, sf_dir):
    return detect.language_distribution(detect.detect_language(samples(spark, sf_dir)))


@register("confusion_counts", f"SELECT * FROM {CONF_SQL}")
def q_confusion_counts(spark, sf_dir):
    return metrics.confusion_counts(scored(spark, sf_dir))


@register("accuracy", f"""
SELECT round(sum(CASE WHEN true_label = predicted_label THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS accuracy,
       sum(n)::BIGINT AS n FROM {CONF_SQL}""")
def q_accuracy(spark, sf_dir):
    a = metrics.accuracy(_conf(spark, sf_dir))
    return a.select(r6("accuracy").alias("accuracy"), "n")


@register("per_class_metrics", f"""
WITH pc AS {PC_SQL}, lm AS {LABEL_MAP_SQL}
SELECT pc.label, coalesce(lm.name, 'Class_' || pc.label::VARCHAR) AS class_name,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM pc LEFT JOIN lm ON pc.label = lm.label""")
def q_per_class_metrics(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    pc = metrics.per_class_metrics(ev["confusion"])
    pc = metrics.with_class_name(pc, ev["label_map"], "label", "class_name")
    return pc.select("label", "class_name", r6("precision").alias("precision"),
                     r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@register("macro_metrics", f"""
SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
       round(avg(f1), 6) AS macro_f1 FROM {PC_SQL}""")
def q_macro_metrics(spark, sf_dir):
    m = metrics.macro_metrics(metrics.per_class_metrics(_conf(spark, sf_dir)))
    return m.select(*[r6(c).alias(c) for c in m.columns])


@register("weighted_f1", f"""
SELECT round(CASE WHEN sum(support) > 0 THEN sum(f1 * support) / sum(support) ELSE 0.0 END, 6) AS weighted_f1
FROM {PC_SQL}""")
def q_weighted_f1(spark, sf_dir):
    w = metrics.weighted_f1(metrics.per_class_metrics(_conf(spark, sf_dir)))
    return w.select(r6("weighted_f1").alias("weighted_f1"))


def evaluation(spark, sf_dir) -> dict:
    """One text pass: preprocess + score, materialize the narrow scored keys,
    then the K^2 confusion table and the K-row label map from those keys."""
    from snippetflow.plans.jobs import evaluate_job
    return evaluate_job(samples(spark, sf_dir))


def flagship(spark, sf_dir):
    """entry(): classification report of the cue classifier on preprocessed documents."""
    rep = evaluation(spark, sf_dir)["report"]
    return rep.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


# ------------------------------------------- cleaning, order, sampling -----


# Nulls are injected for every row of one source (50 rows at sf0.01).
NULL_SOURCE = "src3"


def samples_with_nulls(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"),
                    F.when(F.col("source") == NULL_SOURCE, F.lit(None).cast("string"))
                     .otherwise(F.col("text")).alias("code"),
                    F.col("lang").alias("language"), label_of(F.col("lang")).alias("label"))


NULL_SAMPLES_SQL = (f"(SELECT doc_id AS id, CASE WHEN source = '{NULL_SOURCE}' THEN NULL ELSE text END AS code, "
                    f"lang AS language, {LABEL_SQL} AS label FROM documents)")


@register("drop_null_code", f"SELECT id, code FROM {NULL_SAMPLES_SQL} WHERE code IS NOT NULL")
def q_drop_null_code(spark, sf_dir):
    return clean.handle_null_code(samples_with_nulls(spark, sf_dir)).select("id", "code")


@register("preprocess_stringify", f"""
SELECT id, code, language, label FROM (SELECT id, coalesce(code, 'None') AS code, language, label FROM {NULL_SAMPLES_SQL})
QUALIFY row_number() OVER (PARTITION BY code ORDER BY id) = 1""")
def q_preprocess_stringify(spark, sf_dir):
    return clean.preprocess(samples_with_nulls(spark, sf_dir), null_policy="stringify")


@register("dedup_first", f"""
SELECT id, language, label FROM {SAMPLES_SQL} QUALIFY row_number() OVER (PARTITION BY code ORDER BY id) = 1""")
def q_dedup_first(spark, sf_dir):
    return clean.dedup_first(samples(spark, sf_dir)).select("id", "language", "label")


@register("short_codes", f"SELECT id, code, length(code)::INTEGER AS code_length FROM {SAMPLES_SQL} WHERE length(code) < 10")
def q_short_codes(spark, sf_dir):
    return clean.short_codes(samples(spark, sf_dir)).select("id", "code", X.code_length("code").alias("code_length"))


@register("row_ids", "SELECT doc_id AS row_id, doc_id FROM documents")
def q_row_ids(spark, sf_dir):
    # the table is read as if it had no id: positions come from file order
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return file_row_ids(d, "row_id").select("row_id", "doc_id")


@register("row_ids_ordered", "SELECT doc_id AS row_id, doc_id FROM documents")
def q_row_ids_ordered(spark, sf_dir):
    """W2 over an explicit order column (range cells + per-cell window)."""
    d = with_file_order(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.dense_row_ids(d, "_ord", out="row_id").select("row_id", "doc_id")


SAMPLE_N = 500   # the sampling operator's cap in this query


@register("sample_exact", f"""
SELECT id FROM {SAMPLES_SQL} ORDER BY {sql_uniform(42, 'id')}, id LIMIT {SAMPLE_N}""")
def q_sample_exact(spark, sf_dir):
    return sampling.sample_exact(samples(spark, sf_dir), SAMPLE_N, seed=42).select("id")


VAL_CAP = 300
SPLITS = {"train": "documents", "val": "conversations", "test": "pages"}


@register("load_splits", f"""
SELECT 'train' AS split, doc_id AS id, length(text) AS n FROM documents
UNION ALL (SELECT 'val', conv_id * 1000 + turn, length(text) FROM conversations
           ORDER BY {sql_uniform(42, 'conv_id * 1000 + turn')}, conv_id * 1000 + turn LIMIT {VAL_CAP})
UNION ALL SELECT 'test', page_id, length(html) FROM pages""")
def q_load_splits(spark, sf_dir):
    """Three tables as the three files of a split, the second capped (the operator's own cap)."""
    cols = {"train": ("doc_id", "text"), "val": ("conv_id * 1000 + turn", "text"), "test": ("page_id", "html")}
    paths = {}
    for k, t in SPLITS.items():
        paths[k] = io.scratch_path(spark, f"split-{k}")
        io.save_parquet(table(spark, sf_dir, t).selectExpr(f"{cols[k][0]} AS id", f"{cols[k][1]} AS code"), paths[k])
    s = sampling.load_splits(spark, paths, {"train": None, "val": VAL_CAP}, seed=42, schema="id bigint, code string")
    return s.select("split", "id", X.code_length("code").cast("long").alias("n"))


def _split_sql(source_sql: str, label_expr: str, val_size=0.2, test_size=0.1, seed=42, key="id") -> str:
    vf = repr(val_size / (1 - test_size))
    def mode(src, cnt, draws):
        return f"""(SELECT *, (fl + CASE WHEN rk <= need THEN 1 ELSE 0 END)::BIGINT AS alloc FROM (
            SELECT *, draws - sum(fl) OVER () AS need,
                   row_number() OVER (ORDER BY cont - fl DESC, label NULLS FIRST) AS rk FROM (
              SELECT *, floor(cont)::BIGINT AS fl FROM (
                SELECT *, ({cnt}::DOUBLE / sum({cnt}) OVER ()) * ({draws})::DOUBLE AS cont,
                       ({draws}) AS draws FROM {src}))))"""
    cc = f"(SELECT label, count(*) AS c FROM r GROUP BY 1)"
    first = mode(cc, "c", f"sum(c) OVER () - CAST(ceil({test_size}::DOUBLE * sum(c) OVER ()) AS BIGINT)")
    q1 = f"(SELECT label, c, alloc AS trainval FROM {first})"
    second = mode(q1, "trainval",
                  f"sum(trainval) OVER () - CAST(ceil({vf}::DOUBLE * sum(trainval) OVER ()) AS BIGINT)")
    q2 = f"(SELECT label, c, trainval, alloc AS n_train, trainval - alloc AS n_val FROM {second})"
    return f"""WITH r AS (SELECT id, {label_expr} AS label,
        row_number() OVER (PARTITION BY {label_expr} ORDER BY {sql_uniform(seed, key)}, id) - 1 AS rank
        FROM {source_sql}), q AS {q2}
SELECT r.id, CASE WHEN rank < n_train THEN 'train' WHEN rank < n_train + n_val THEN 'val' ELSE 'test' END AS split
FROM r JOIN q ON r.label IS NOT DISTINCT FROM q.label"""


@register("stratified_split", _split_sql(SAMPLES_SQL, "label"))
def q_stratified_split(spark, sf_dir):
    return sampling.stratified_split(samples(spark, sf_dir), "label", "id", seed=42).select("id", "split")


@register("split_unstratified", _split_sql(SAMPLES_SQL, "0"))
def q_split_unstratified(spark, sf_dir):
    s = samples(spark, sf_dir).drop("label")
    return sampling.stratified_split(s, None, "id", seed=42).select("id", "split")


@register("split_counts", f"SELECT split, count(*) AS n FROM ({_split_sql(SAMPLES_SQL, 'label')}) GROUP BY 1")
def q_split_counts(spark, sf_dir):
    return sampling.split_counts(sampling.stratified_split(samples(spark, sf_dir), "label", "id", seed=42))


# Rows without an id or a label must not get lost.
HOLES_SQL = (f"(SELECT CASE WHEN id % 7 = 3 THEN NULL ELSE id END AS id, id AS pos, substring(code, 1, 2) AS code, "
             f"CASE WHEN id % 5 = 1 THEN NULL ELSE label END AS label FROM {SAMPLES_SQL})")


def samples_with_holes(spark, sf_dir) -> DataFrame:
    """Every seventh id and every fifth label is null; the code is its first two characters, so that many are equal."""
    s = samples(spark, sf_dir)
    return s.select(F.when(F.col("id") % 7 != 3, F.col("id")).alias("id"), F.col("id").alias("pos"),
                    F.substring("code", 1, 2).alias("code"), F.when(F.col("id") % 5 != 1, F.col("label")).alias("label"))


@register("dedup_null_ids", f"""
SELECT id, code, (SELECT count(*) FROM {HOLES_SQL}) AS n_rows FROM {HOLES_SQL}
QUALIFY row_number() OVER (PARTITION BY code ORDER BY id NULLS LAST, label NULLS FIRST, pos) = 1""")
def q_dedup_null_ids(spark, sf_dir):
    s = samples_with_holes(spark, sf_dir)
    return clean.dedup_first(s).select("id", "code").withColumn("n_rows", s.agg(F.count(F.lit(1))).scalar())


@register("split_null_labels", _split_sql(f"(SELECT pos AS id, label FROM {HOLES_SQL})", "label"))
def q_split_null_labels(spark, sf_dir):
    s = samples_with_holes(spark, sf_dir).select(F.col("pos").alias("id"), "label")
    return sampling.stratified_split(s, "label", "id", seed=42).select("id", "split")


# Tables whose ids are repeated or null: exact counts, whichever of the tied rows are taken.
TIED = {"repeated": ("doc_id % 40", "id"), "null": ("CASE WHEN doc_id % 2 = 1 THEN doc_id END", "id IS NULL, id")}
TIED_N = 733   # not a multiple of a group's rows, and beyond the rows that have an id at sf0.01


def _tied(spark, sf_dir, kind: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.expr(TIED[kind][0]).alias("id"), F.col("doc_id").alias("pos"), label_of(F.col("lang")).alias("label"))


def _tied_sql(kind: str) -> str:
    late = "id IS NULL, " if kind == "null" else ""
    return f"""SELECT id, count(*) AS n FROM (SELECT {TIED[kind][0]} AS id FROM documents
  ORDER BY {late}{sql_uniform(42, '(' + TIED[kind][0] + ')')}, id LIMIT {TIED_N}) GROUP BY id"""


@register("sample_repeated_ids", _tied_sql("repeated"))
def q_sample_repeated_ids(spark, sf_dir):
    """T1 where 40 ids share all rows: the id at the cut gives exactly the rows still missing."""
    got = sampling.sample_exact(_tied(spark, sf_dir, "repeated"), TIED_N, seed=42)
    return got.groupBy("id").agg(F.count_distinct("pos").alias("n"))


@register("sample_null_ids", _tied_sql("null"))
def q_sample_null_ids(spark, sf_dir):
    """T1 where every second id is null: these rows come last and are taken as far as they are needed."""
    got = sampling.sample_exact(_tied(spark, sf_dir, "null"), TIED_N, seed=42)
    return got.groupBy("id").agg(F.count_distinct("pos").alias("n"))


@register("split_null_ids", f"""
SELECT label, split, count(*) AS n FROM {SAMPLES_SQL} JOIN ({_split_sql(SAMPLES_SQL, 'label')}) USING (id) GROUP BY ALL
UNION ALL SELECT 100 + label, split, count(*) FROM {SAMPLES_SQL} JOIN ({_split_sql(SAMPLES_SQL, 'label')}) USING (id) GROUP BY ALL""")
def q_split_null_ids(spark, sf_dir):
    """W3 where all ids are null, and where 40 ids share all rows (labels from 100 on): the exact quotas of each class."""
    s = _tied(spark, sf_dir, "repeated")
    parts = [(s.withColumn("id", F.lit(None).cast("long")), 0), (s, 100)]
    out = [sampling.stratified_split(t, "label", "id", seed=42).groupBy((F.col("label") + n).alias("label"), "split").agg(F.count_distinct("pos").alias("n")) for t, n in parts]
    return out[0].unionByName(out[1])


# ------------------------------------------------------------- labels ------

@register("label_map", f"SELECT * FROM {LABEL_MAP_SQL}")
def q_label_map(spark, sf_dir):
    return labels.label_map(samples(spark, sf_dir))


@register("label_map_generic", f"SELECT DISTINCT label, 'Language_' || label::VARCHAR AS name FROM {SAMPLES_SQL}")
def q_label_map_generic(spark, sf_dir):
    return labels.label_map(samples(spark, sf_dir).drop("language"))


@register("class_weights", """
SELECT quality AS label, count(*) AS n,
       (sum(count(*)) OVER ())::DOUBLE / (count(*) OVER () * count(*)) AS weight
FROM labels GROUP BY 1""")
def q_class_weights(spark, sf_dir):
    return labels.class_weights(table(spark, sf_dir, "labels"), "quality")


WEIGHTS_SQL = """(SELECT quality AS label, (sum(count(*)) OVER ())::DOUBLE / (count(*) OVER () * count(*)) AS weight
                  FROM labels GROUP BY 1)"""


def training_rows(spark, sf_dir) -> DataFrame:
    """Binary task: documents with a quality label (labels.quality)."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return samples(spark, sf_dir).drop("label").join(lab, "id")


TRAIN_ROWS_SQL = f"(SELECT s.id, s.code, s.language, l.quality AS label FROM {SAMPLES_SQL} s JOIN labels l ON s.id = l.doc_id)"


@register("weighted_train_rows", f"""
SELECT t.id, t.label, round(w.weight, 6) AS weight FROM {TRAIN_ROWS_SQL} t JOIN {WEIGHTS_SQL} w ON t.label = w.label""")
def q_weighted_train_rows(spark, sf_dir):
    t = training_rows(spark, sf_dir)
    w = labels.class_weights(t, "label")
    return labels.with_class_weight(t, w).select("id", "label", r6("weight").alias("weight"))


# ------------------------------------------------------------ profile ------

@register("label_counts", f"SELECT label, count(*) AS n FROM {SAMPLES_SQL} WHERE label IS NOT NULL GROUP BY 1")
def q_label_counts(spark, sf_dir):
    return profile.label_counts(samples(spark, sf_dir))


@register("class_balance", f"""
SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM {SAMPLES_SQL} WHERE label IS NOT NULL GROUP BY 1""")
def q_class_balance(spark, sf_dir):
    return profile.class_balance(samples(spark, sf_dir)).select("label", "n", r6("pct").alias("pct"))


ORACLE["missing_values"] = f"""
WITH m AS (SELECT count(*) - count(id) AS a, count(*) - count(code) AS b,
                  count(*) - count(language) AS c, count(*) - count(label) AS d FROM {NULL_SAMPLES_SQL})
SELECT 'id' AS "column", 0 AS position, a::BIGINT AS n_missing FROM m
UNION ALL SELECT 'code', 1, b::BIGINT FROM m
UNION ALL SELECT 'language', 2, c::BIGINT FROM m
UNION ALL SELECT 'label', 3, d::BIGINT FROM m"""


@register("duplicate_count", f"SELECT (count(*) - count(DISTINCT code))::BIGINT AS n_duplicates FROM {SAMPLES_SQL}")
def q_duplicate_count(spark, sf_dir):
    return profile.duplicate_count(samples(spark, sf_dir))


@register("length_describe", f"""
SELECT count(l)::BIGINT AS count, round(avg(l), 6) AS mean, round(stddev_samp(l), 6) AS std, min(l)::BIGINT AS min,
       round(quantile_cont(l, 0.25), 6) AS q25, round(quantile_cont(l, 0.5), 6) AS q50,
       round(quantile_cont(l, 0.75), 6) AS q75, max(l)::BIGINT AS max
FROM (SELECT length(code) AS l FROM {SAMPLES_SQL})""")
def q_length_describe(spark, sf_dir):
    d = profile.length_describe(samples(spark, sf_dir))
    return d.select("count", *[r6(c).alias(c) for c in ("mean", "std")], "min",
                    *[r6(c).alias(c) for c in ("q25", "q50", "q75")], "max")


@register("length_histogram", f"""
WITH l AS (SELECT length(code) AS len FROM {SAMPLES_SQL} WHERE code IS NOT NULL),
s AS (SELECT min(len) AS mn, max(len) AS mx FROM l),
p AS (SELECT CASE WHEN mx > mn THEN mn::DOUBLE ELSE mn - 0.5 END AS lo,
             CASE WHEN mx > mn THEN (mx - mn)::DOUBLE ELSE 1.0 END AS w FROM s),
c AS (SELECT least(floor((len - lo) * 50.0 / w), 49)::INTEGER AS bin, count(*) AS n FROM l, p GROUP BY 1),
g AS (SELECT range::INTEGER AS bin, lo, w FROM range(50), p)
SELECT g.bin, round(lo + w * g.bin / 50, 6) AS lo, round(lo + w * (g.bin + 1) / 50, 6) AS hi,
       coalesce(c.n, 0)::BIGINT AS n FROM g LEFT JOIN c ON g.bin = c.bin""")
def q_length_histogram(spark, sf_dir):
    h = profile.length_histogram(samples(spark, sf_dir))
    return h.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@register("length_box_by_label", f"""
WITH l AS (SELECT label, length(code) AS len FROM {SAMPLES_SQL}),
q AS (SELECT label, quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.5) AS median,
             quantile_cont(len, 0.75) AS q3 FROM l GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.label, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(CASE WHEN len >= lo AND len <= hi THEN len END)::BIGINT AS whisker_low,
       max(CASE WHEN len >= lo AND len <= hi THEN len END)::BIGINT AS whisker_high,
       sum(CASE WHEN len >= lo AND len <= hi THEN 0 ELSE 1 END)::BIGINT AS n_outliers, count(*) AS n
FROM l JOIN f ON l.label = f.label GROUP BY f.label, q1, median, q3""")
def q_length_box_by_label(spark, sf_dir):
    b = profile.length_box_by_label(samples(spark, sf_dir))
    return b.select("label", r6("q1").alias("q1"), r6("median").alias("median"), r6("q3").alias("q3"),
                    "whisker_low", "whisker_high", "n_outliers", "n")


ORACLE["table_info"] = f"""
WITH m AS (SELECT count(id) AS a, count(code) AS b, count(language) AS c, count(label) AS d FROM {NULL_SAMPLES_SQL})
SELECT 0 AS position, 'id' AS "column", 'bigint' AS type, a::BIGINT AS non_null FROM m
UNION ALL SELECT 1, 'code', 'string', b::BIGINT FROM m
UNION ALL SELECT 2, 'language', 'string', c::BIGINT FROM m
UNION ALL SELECT 3, 'label', 'int', d::BIGINT FROM m"""


@register("table_info")
def q_table_info(spark, sf_dir):
    return profile.table_info(samples_with_nulls(spark, sf_dir))


@register("missing_values")
def q_missing_values(spark, sf_dir):
    return profile.missing_values(samples_with_nulls(spark, sf_dir))


EVENT_WEIGHT = "CAST(get_json_object(props, '$.k') AS INT)"


@register("running_average", """
SELECT event_id, user_id,
       round(CASE WHEN sum(k) OVER w <> 0 THEN (sum(v * k) OVER w)::DOUBLE / (sum(k) OVER w)::DOUBLE END, 6) AS running_avg
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value::DECIMAL(12, 2) AS v FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_average(spark, sf_dir):
    ev = (table(spark, sf_dir, "events").withColumn("k", F.expr(EVENT_WEIGHT))
          .withColumn("v", F.col("value").cast("decimal(12,2)")))
    ra = profile.running_average(ev, "user_id", ["ts", "event_id"], "v", "k")
    return ra.select("event_id", "user_id", r6("running_avg").alias("running_avg"))


@register("code_length", f"SELECT id, length(code)::INTEGER AS code_length FROM {SAMPLES_SQL}")
def q_code_length(spark, sf_dir):
    return samples(spark, sf_dir).select("id", X.code_length("code").alias("code_length"))


# ----------------------------------------------------- evaluation tables ---

def _conf(spark, sf_dir):
    return metrics.confusion_table(scored(spark, sf_dir))


REPORT_SQL = f"""
WITH pc AS {PC_SQL}, lm AS {LABEL_MAP_SQL},
s AS (SELECT avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
             CASE WHEN sum(support) > 0 THEN sum(precision * support) / sum(support) ELSE 0.0 END AS wp,
             CASE WHEN sum(support) > 0 THEN sum(recall * support) / sum(support) ELSE 0.0 END AS wr,
             CASE WHEN sum(support) > 0 THEN sum(f1 * support) / sum(support) ELSE 0.0 END AS wf,
             CASE WHEN sum(support) > 0 THEN sum(tp)::DOUBLE / sum(support) ELSE 0.0 END AS acc,
             sum(support)::BIGINT AS n FROM pc)
SELECT coalesce(lm.name, 'Class_' || pc.label::VARCHAR) AS class, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pc LEFT JOIN lm ON pc.label = lm.label
UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 6), n FROM s
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), n FROM s
UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), n FROM s"""


@register("classification_report", REPORT_SQL)
def q_classification_report(spark, sf_dir):
    return flagship(spark, sf_dir)


@register("metrics_long", f"""
WITH pc AS {PC_SQL}, lm AS {LABEL_MAP_SQL},
s AS (SELECT avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
             CASE WHEN sum(support) > 0 THEN sum(f1 * support) / sum(support) ELSE 0.0 END AS wf,
             CASE WHEN sum(support) > 0 THEN sum(tp)::DOUBLE / sum(support) ELSE 0.0 END AS acc FROM pc)
SELECT 'test_accuracy' AS metric, round(acc, 6) AS value FROM s
UNION ALL SELECT 'test_macro_f1', round(mf, 6) FROM s
UNION ALL SELECT 'test_weighted_f1', round(wf, 6) FROM s
UNION ALL SELECT 'test_macro_precision', round(mp, 6) FROM s
UNION ALL SELECT 'test_macro_recall', round(mr, 6) FROM s
UNION ALL SELECT 'test_f1_' || coalesce(lm.name, 'Class_' || pc.label::VARCHAR), round(f1, 6)
FROM pc LEFT JOIN lm ON pc.label = lm.label""")
def q_metrics_long(spark, sf_dir):
    m = evaluation(spark, sf_dir)["metrics"]
    return m.select("metric", r6("value").alias("value"))


@register("per_class_long", f"""
SELECT label, 'precision' AS metric, round(precision, 6) AS value FROM {PC_SQL}
UNION ALL SELECT label, 'recall', round(recall, 6) FROM {PC_SQL}
UNION ALL SELECT label, 'f1', round(f1, 6) FROM {PC_SQL}""")
def q_per_class_long(spark, sf_dir):
    return metrics.per_class_long(_conf(spark, sf_dir)).select("label", "metric", r6("value").alias("value"))


@register("confusion_matrix_dense", f"""
WITH c AS {CONF_SQL}, u AS (SELECT true_label AS l FROM c UNION SELECT predicted_label FROM c)
SELECT a.l AS true_label, b.l AS predicted_label, coalesce(c.n, 0)::BIGINT AS n
FROM u a CROSS JOIN u b LEFT JOIN c ON c.true_label = a.l AND c.predicted_label = b.l""")
def q_confusion_matrix_dense(spark, sf_dir):
    return metrics.confusion_dense(_conf(spark, sf_dir))


@register("label_universe", f"""
SELECT true_label AS label FROM {CONF_SQL} UNION SELECT predicted_label FROM {CONF_SQL}""")
def q_label_universe(spark, sf_dir):
    return metrics.label_universe(_conf(spark, sf_dir))


@register("align_predictions", f"""
SELECT s.id, s.label, p.predicted_label FROM {SAMPLES_SQL} s
JOIN {TEXT_CUE_TABLE.sql_classify(SAMPLES_SQL, "id", "code")} p ON s.id = p.id""")
def q_align_predictions(spark, sf_dir):
    s = samples(spark, sf_dir)
    preds = TEXT_CUE_TABLE.apply(s.select("id", "code"), "code", "predicted_label", "index").drop("code")
    return metrics.align_predictions(s.select("id", "label"), preds, "id")


@register("align_checked", ORACLE["align_predictions"])
def q_align_checked(spark, sf_dir):
    """J1 where the predictions come from another table; misaligned ones must be refused."""
    s = samples(spark, sf_dir)
    preds = io.save_parquet(TEXT_CUE_TABLE.apply(s.select("id", "code"), "code", "predicted_label", "index").drop("code"),
                            io.scratch_path(spark, "predictions"))
    preds = spark.read.parquet(preds)
    try:
        metrics.align_predictions(s.select("id", "label"), preds.where("id % 2 = 0"), "id")
    except ValueError:
        return metrics.align_predictions(s.select("id", "label"), preds, "id")
    raise AssertionError("misaligned predictions were accepted")


MIS_SQL = f"(SELECT id, code, label AS true_label, predicted_label FROM {SCORED_SQL} WHERE label IS DISTINCT FROM predicted_label)"


@register("misclassified", f"SELECT id, true_label, predicted_label FROM {MIS_SQL}")
def q_misclassified(spark, sf_dir):
    return metrics.misclassified(scored(spark, sf_dir)).select("id", "true_label", "predicted_label")


@register("misclassified_named", f"""
WITH lm AS {LABEL_MAP_SQL}
SELECT m.id, m.true_label, m.predicted_label, a.name AS true_class, b.name AS predicted_class
FROM {MIS_SQL} m LEFT JOIN lm a ON m.true_label = a.label LEFT JOIN lm b ON m.predicted_label = b.label""")
def q_misclassified_named(spark, sf_dir):
    ev = evaluation(spark, sf_dir)
    return metrics.misclassified(ev["scored"], label_map=ev["label_map"]).select(
        "id", "true_label", "predicted_label", "true_class", "predicted_class")


MIS_TOP = 100   # the reference's max_samples for the error table


@register("misclassified_top", f"SELECT id, code, true_label, predicted_label FROM {MIS_SQL} ORDER BY id LIMIT {MIS_TOP}")
def q_misclassified_top(spark, sf_dir):
    return metrics.misclassified_top(scored(spark, sf_dir), "id", MIS_TOP).select(
        "id", "code", "true_label", "predicted_label")


@register("preview", f"SELECT id, label, length(code)::INTEGER AS code_length, substring(code, 1, 300) || '...' AS preview "
                     f"FROM {SAMPLES_SQL} ORDER BY id LIMIT 3")
def q_preview(spark, sf_dir):
    return sampling.preview(samples(spark, sf_dir), 3, "id").select(
        "id", "label", X.code_length("code").alias("code_length"), X.preview("code").alias("preview"))


# ------------------------------------------------------ text functions ------

CROP = X.CROP_CHARS


@register("crop_head", f"SELECT id, substring(code, 1, {CROP}) AS view_text FROM {SAMPLES_SQL}")
def q_crop_head(spark, sf_dir):
    return samples(spark, sf_dir).select("id", X.crop_head("code", CROP).alias("view_text"))


@register("crop_tail", f"SELECT id, CASE WHEN length(code) <= {CROP} THEN code ELSE right(code, {CROP}) END AS view_text FROM {SAMPLES_SQL}")
def q_crop_tail(spark, sf_dir):
    return samples(spark, sf_dir).select("id", X.crop_tail("code", CROP).alias("view_text"))


def _sql_window(n, seed=42, keys=("id",)):
    start = f"floor({sql_uniform(seed, *keys)} * (greatest(length(code) - {n}, 0) + 1))::BIGINT"
    return f"CASE WHEN length(code) <= {n} THEN code ELSE substring(code, {start} + 1, {n}) END"


@register("crop_window", f"SELECT id, {_sql_window(CROP)} AS view_text FROM {SAMPLES_SQL}")
def q_crop_window(spark, sf_dir):
    return samples(spark, sf_dir).select("id", X.crop_window("code", CROP, 42, ("id",)).alias("view_text"))


def _sql_choice(seed=42):
    u = sql_uniform(seed, "'crop'", "id")
    return f"CASE WHEN {u} < 0.45 THEN 'head' WHEN {u} < 0.9 THEN 'tail' ELSE 'middle' END"


@register("crop_augment", f"""
SELECT id, view, CASE view WHEN 'head' THEN substring(code, 1, {CROP})
                 WHEN 'tail' THEN (CASE WHEN length(code) <= {CROP} THEN code ELSE right(code, {CROP}) END)
                 ELSE {_sql_window(CROP)} END AS view_text
FROM (SELECT *, {_sql_choice()} AS view FROM {SAMPLES_SQL})""")
def q_crop_augment(spark, sf_dir):
    return samples(spark, sf_dir).select("id", X.crop_choice(42, ("id",)).alias("view"),
                                         X.crop_augment("code", CROP, 42, ("id",)).alias("view_text"))


@register("two_view_expand", f"""
SELECT id, 'head' AS view, substring(code, 1, {CROP}) AS view_text FROM {SAMPLES_SQL}
UNION ALL SELECT id, 'tail', CASE WHEN length(code) <= {CROP} THEN code ELSE right(code, {CROP}) END FROM {SAMPLES_SQL}""")
def q_two_view_expand(spark, sf_dir):
    return ensemble.two_view_expand(samples(spark, sf_dir).select("id", "code")).select("id", "view", "view_text")


@register("prompt_build", f"""
SELECT id, 2 AS n_turns, '{X.system_prompt(CODE_LANGUAGES).replace("'", "''")}' AS system_content, 'Code snippet:' || chr(10) || chr(10) || substring(code, 1, 2048) || chr(10) || chr(10)
       || 'Identify the language:' AS user_content FROM {SAMPLES_SQL}""")
def q_prompt_build(spark, sf_dir):
    p = samples(spark, sf_dir).select("id", X.chat_prompt(CODE_LANGUAGES, "code").alias("prompt"))
    return p.select("id", F.size("prompt").alias("n_turns"), F.col("prompt")[0]["content"].alias("system_content"), F.col("prompt")[1]["content"].alias("user_content"))


# Python str.strip() white space, listed for RE2 (whose \\s is ASCII only)
_PY_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@register("response_clean", f"""
SELECT conv_id, turn, replace(replace(regexp_replace(regexp_replace(text, '^{_PY_WS}+', ''), '{_PY_WS}+$', ''),
       '''', ''), '"', '') AS response FROM conversations""")
def q_response_clean(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.clean_response("text").alias("response"))


@register("format_duration", """
SELECT event_id, CASE WHEN h > 0 THEN h::VARCHAR || 'h ' || m::VARCHAR || 'm ' || s::VARCHAR || 's'
                      WHEN m > 0 THEN m::VARCHAR || 'm ' || s::VARCHAR || 's' ELSE s::VARCHAR || 's' END AS duration
FROM (SELECT event_id, floor(x / 3600)::BIGINT AS h, floor((x - floor(x / 3600) * 3600) / 60)::BIGINT AS m,
             floor(x - floor(x / 60) * 60)::BIGINT AS s FROM (SELECT event_id, value * 120 AS x FROM events))""")
def q_format_duration(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", X.format_duration(F.col("value") * 120).alias("duration"))


@register("tokens_truncated", f"""
SELECT id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (
  SELECT id, list_filter(regexp_split_to_array(lower(code), '{X.TOKEN_SPLIT}'), lambda x: x <> '')[1:{X.MAX_TOKENS}] AS t
  FROM {SAMPLES_SQL})""")
def q_tokens_truncated(spark, sf_dir):
    t = samples(spark, sf_dir).select("id", X.tokens_truncated("code").alias("t"))
    return t.select("id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


# ----------------------------------------------------------- stage 2 -------


NB_SPLIT_SQL = C.NB_SPLIT


def nb_sql(train: str, docs: str, alpha: float) -> str:
    """SELECT id, predicted_label of ``docs`` (id, code) by Naive Bayes on ``train`` (id, code, label)."""
    words = f"unnest(regexp_split_to_array(lower(code), '{NB_SPLIT_SQL}')) AS token"
    return f"""WITH tr AS {train}, docs AS {docs},
cnt AS (SELECT token, label, count(*) AS cnt FROM (SELECT label, {words} FROM tr) WHERE token <> '' GROUP BY 1, 2),
v AS (SELECT count(DISTINCT token) AS nv FROM cnt),
cls AS (SELECT d.label, ln((d.n_c + {alpha}) / (sum(d.n_c) OVER () + count(*) OVER () * {alpha})) AS prior,
               ln(coalesce(t.tot, 0) + {alpha} * v.nv) AS norm
        FROM (SELECT label, count(*) AS n_c FROM tr GROUP BY 1) d
        LEFT JOIN (SELECT label, sum(cnt) AS tot FROM cnt GROUP BY 1) t USING (label) CROSS JOIN v),
w AS (SELECT token, label, ln(cnt + {alpha}) - ln({alpha}) AS w FROM cnt),
dt AS (SELECT id, token, count(*) AS x FROM (SELECT id, {words} FROM docs) WHERE token <> '' GROUP BY 1, 2),
known AS (SELECT * FROM dt WHERE token IN (SELECT token FROM cnt)),
nk AS (SELECT id, sum(x) AS n_known FROM known GROUP BY 1),
sp AS (SELECT known.id, w.label, sum(x * w.w) AS s FROM known JOIN w USING (token) GROUP BY 1, 2),
sc AS (SELECT s.id, c.label, c.prior + coalesce(nk.n_known, 0) * (ln({alpha}) - c.norm) + coalesce(sp.s, 0) AS score
       FROM docs s CROSS JOIN cls c LEFT JOIN nk ON nk.id = s.id
       LEFT JOIN sp ON sp.id = s.id AND sp.label = c.label)
SELECT id, label AS predicted_label FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, label) = 1"""


@register("classify_nb", nb_sql(TRAIN_ROWS_SQL, SAMPLES_SQL, 1.0))
def q_classify_nb(spark, sf_dir):
    model = C.fit_naive_bayes(training_rows(spark, sf_dir))
    return C.predict_naive_bayes(model, samples(spark, sf_dir)).select("id", "predicted_label")


@register("classify_external", f"SELECT id, length(code) % 4 AS predicted_label FROM {NULL_SAMPLES_SQL}")
def q_classify_external(spark, sf_dir):
    """M5 with an external model over Arrow batches; a null text scores null."""
    scorer = C.batch_scores_udf(lambda: lambda texts: [len(t) % 4 for t in texts])
    return C.classify(samples_with_nulls(spark, sf_dir), scorer).select("id", F.col("predicted_label").cast("long").alias("predicted_label"))


@register("classify_nb_repeated_ids", f"SELECT pos, predicted_label FROM ({nb_sql(TRAIN_ROWS_SQL, SAMPLES_SQL, 1.0)}) p JOIN (SELECT doc_id AS id, doc_id AS pos FROM documents) USING (id)")
def q_classify_nb_repeated_ids(spark, sf_dir):
    """M5 where ids are repeated or null: every row is scored by its own text."""
    model = C.fit_naive_bayes(training_rows(spark, sf_dir))
    s = samples(spark, sf_dir).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("id"), F.col("id").alias("pos"), "code")
    return C.classify(s, model).select("pos", "predicted_label")


def nb_language_sql(train: str, docs: str, alpha: float) -> str:
    """``nb_sql`` with the likelihood of the row's language beside the tokens."""
    base = nb_sql(train, docs, alpha)
    head, tail = base.split("sc AS (SELECT s.id, c.label, c.prior")
    tables = f"""lv AS (SELECT label, language, count(*) AS n FROM tr WHERE language IS NOT NULL GROUP BY 1, 2),
ll AS (SELECT v.language, c.label, ln((coalesce(lv.n, 0) + {alpha}) / (coalesce((SELECT sum(n) FROM lv x WHERE x.label = c.label), 0)
              + {alpha} * (SELECT count(DISTINCT language) FROM lv))) AS w
       FROM (SELECT DISTINCT language FROM lv) v CROSS JOIN cls c LEFT JOIN lv ON lv.language = v.language AND lv.label = c.label),
"""
    tail = tail.replace("+ coalesce(sp.s, 0) AS score", "+ coalesce(sp.s, 0) + coalesce(ll.w, 0) AS score")
    tail = tail.replace("AND sp.label = c.label)", "AND sp.label = c.label LEFT JOIN ll ON ll.language = s.language AND ll.label = c.label)")
    return f"{head}{tables}sc AS (SELECT s.id, c.label, c.prior{tail}"


# Languages of one source are unknown to stage 2.
LANGUAGE_SQL = f"(SELECT id, code, CASE WHEN id % 11 <> 5 THEN language END AS language, label FROM {SAMPLES_SQL})"


@register("classify_nb_language", nb_language_sql(TRAIN_ROWS_SQL, LANGUAGE_SQL, 1.0))
def q_classify_nb_language(spark, sf_dir):
    """M9: tokens and the row's language, each with its likelihood table; some rows have no language."""
    model = C.fit_naive_bayes(training_rows(spark, sf_dir), language="language")
    s = samples(spark, sf_dir).withColumn("language", F.when(F.col("id") % 11 != 5, F.col("language")))
    return C.predict_naive_bayes(model, s, language="language").select("id", "predicted_label")


VIEW_CHARS = 300


def _two_view_nb_sql() -> str:
    """Scores of both views, each turned into probabilities, averaged."""
    sides = {0: f"substring(code, 1, {VIEW_CHARS})", 1: f"CASE WHEN length(code) <= {VIEW_CHARS} THEN code ELSE right(code, {VIEW_CHARS}) END"}
    docs = "(" + " UNION ALL ".join(f"SELECT 2 * id + {v} AS id, {t} AS code FROM {SAMPLES_SQL}" for v, t in sides.items()) + ")"
    scores = nb_sql(TRAIN_ROWS_SQL, docs, 1.0).split("SELECT id, label AS predicted_label FROM sc")[0]
    return f"""{scores}, e AS (SELECT id, label, exp(score - max(score) OVER (PARTITION BY id)) AS e FROM sc),
pr AS (SELECT id // 2 AS id, label, e / sum(e) OVER (PARTITION BY id) AS p FROM e),
av AS (SELECT id, label, sum(p) / 2 AS p FROM pr GROUP BY 1, 2)
SELECT id, label AS predicted_label FROM av QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, label) = 1"""


@register("two_view_nb", _two_view_nb_sql())
def q_two_view_nb(spark, sf_dir):
    """M6 with a fitted model: head and tail of every document, class probabilities averaged."""
    model = C.fit_naive_bayes(training_rows(spark, sf_dir))
    return C.predict_two_views(model, samples(spark, sf_dir), VIEW_CHARS).select("id", "predicted_label")


# ----------------------------------------------------------- ensembles -----


# Three "models" for the ensemble queries, derived from the cue table by rule:
# all cues, the first three cues of each label, the last three of each label.
MODELS = {
    "m0": TEXT_CUE_TABLE,
    "m1": CueTable({k: v[:3] for k, v in TEXT_CUES.items()}),
    "m2": CueTable({k: v[-3:] for k, v in TEXT_CUES.items()}),
}


def _model_preds_sql(source=SAMPLES_SQL):
    return " UNION ALL ".join(
        f"SELECT id, '{m}' AS model, predicted_label FROM {t.sql_classify(source, 'id', 'code')}"
        for m, t in MODELS.items())


@register("ensemble_vote", f"""
WITH p AS ({_model_preds_sql()}), c AS (SELECT id, predicted_label, count(*) AS n FROM p GROUP BY 1, 2)
SELECT id, predicted_label FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, predicted_label) = 1""")
def q_ensemble_vote(spark, sf_dir):
    # all models score the same rows in one pass; the vote is per row (no shuffle)
    wide = ensemble.score_all(samples(spark, sf_dir).select("id", "code"), MODELS)
    return wide.select("id", ensemble.vote_columns([f"pred_{m}" for m in MODELS]).alias("predicted_label"))


@register("ensemble_vote_stacked", ORACLE["ensemble_vote"])
def q_ensemble_vote_stacked(spark, sf_dir):
    """J2/U2/A10 long form, for models that run separately: stack, then vote per id."""
    s = samples(spark, sf_dir).select("id", "code")
    preds = {m: C.classify(s, t) for m, t in MODELS.items()}
    return ensemble.majority_vote(ensemble.stack_predictions(preds))


ENSEMBLE_WEIGHTS = {"detect": 0.5, "classify": 0.5}   # config: LLM, BERT


@register("ensemble_weighted", f"""
WITH lm AS {LABEL_MAP_SQL}, inv AS (SELECT name, min(label) AS label FROM lm GROUP BY 1),
d AS {TEXT_CUE_TABLE.sql_detect(SAMPLES_SQL, "id", "code", "detected_language")},
p AS (SELECT d.id, inv.label AS predicted_label, 0.5 AS weight FROM d JOIN inv ON d.detected_language = inv.name
      UNION ALL SELECT id, predicted_label, 0.5 FROM {MODELS["m1"].sql_classify(SAMPLES_SQL, "id", "code")}),
w AS (SELECT id, predicted_label, sum(weight) AS w FROM p GROUP BY 1, 2)
SELECT id, predicted_label FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, predicted_label) = 1""")
def q_ensemble_weighted(spark, sf_dir):
    s = samples(spark, sf_dir)
    inv = labels.inverse_label_map(labels.label_map(s))
    det = detect.detect_language(s.select("id", "code"))
    stage1 = det.join(inv, det["detected_language"] == inv["name"]).select("id", "label")
    stage2 = C.classify(s.select("id", "code"), MODELS["m1"])
    stacked = ensemble.stack_predictions({"detect": stage1.withColumnRenamed("label", "predicted_label"),
                                          "classify": stage2}, weights=ENSEMBLE_WEIGHTS)
    return ensemble.weighted_vote(stacked)


def _candidate_sql():
    parts = []
    for i, (m, t) in enumerate(MODELS.items()):
        conf = f"(SELECT label AS true_label, predicted_label, count(*) AS n FROM {t.sql_classify(PRE_SQL, 'id', 'code', 'predicted_label', 'label')} GROUP BY 1, 2)"
        pc = PC_SQL.replace(CONF_SQL, conf)
        parts.append(f"SELECT {i} AS candidate, avg(f1) AS macro_f1, sum(tp)::DOUBLE / sum(support) AS accuracy FROM {pc}")
    return " UNION ALL ".join(parts)


@register("best_candidate", f"""
SELECT candidate, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy FROM ({_candidate_sql()})
QUALIFY row_number() OVER (ORDER BY macro_f1 DESC, candidate) = 1""")
def q_best_candidate(spark, sf_dir):
    pre = clean.preprocess(samples(spark, sf_dir))
    wide = pre.select("label", "code")
    for i, t in enumerate(MODELS.values()):
        wide = t.apply(wide, "code", f"p{i}", "index")
    wide = wide.drop("code")
    long = wide.unpivot("label", [f"p{i}" for i in range(len(MODELS))], "model", "predicted_label") \
        .withColumn("candidate", F.substring("model", 2, 8).cast("int"))
    cands = metrics.grouped_summary(long, "candidate").select("candidate", "macro_f1", "accuracy")
    best = ensemble.best_candidate(cands, "candidate", "macro_f1")
    return best.select("candidate", r6("macro_f1").alias("macro_f1"), r6("accuracy").alias("accuracy"))


def _two_view_sql(n=X.CROP_CHARS):
    t = TEXT_CUE_TABLE
    head = t.sql_scores(f"substring(code, 1, {n})")
    tail = t.sql_scores(f"(CASE WHEN length(code) <= {n} THEN code ELSE right(code, {n}) END)")
    names = [f"_a{i}" for i in range(len(head))]
    cols = ", ".join(f"({h} + {tl})::DOUBLE / 2.0 AS {nm}" for h, tl, nm in zip(head, tail, names))
    return f"SELECT id, {t.sql_argmax(names)} AS predicted_label FROM (SELECT id, {cols} FROM {SAMPLES_SQL})"


@register("two_view_predict", _two_view_sql())
def q_two_view_predict(spark, sf_dir):
    return ensemble.two_view_predict(samples(spark, sf_dir), TEXT_CUE_TABLE).select("id", "predicted_label")


# ------------------------------------------------------------- jobs ---------

@register("detect_unknown", "SELECT * FROM " + TEXT_CUE_TABLE.sql_detect(NULL_SAMPLES_SQL, "id", "code"))
def q_detect_unknown(spark, sf_dir):
    return detect.detect_language(samples_with_nulls(spark, sf_dir)).select("id", "detected_language")


PAGES_SQL = "(SELECT page_id AS id, html AS code FROM pages)"


@register("detect_code_language", "SELECT * FROM " + CODE_CUE_TABLE.sql_detect(SAMPLES_SQL, "id", "code"))
def q_detect_code_language(spark, sf_dir):
    """M1 with the product's own label set (programming languages) over every document."""
    return detect.detect_language(samples(spark, sf_dir), CODE_CUE_TABLE).select("id", "detected_language")


@register("detect_code_language_pages", "SELECT * FROM " + CODE_CUE_TABLE.sql_detect(PAGES_SQL, "id", "code"))
def q_detect_code_language_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("code"))
    return detect.detect_language(p, CODE_CUE_TABLE).select("id", "detected_language")


@register("detect_external", f"""
SELECT id, CASE WHEN code IS NULL OR length(code) % 5 = 0 THEN 'Unknown' ELSE 'L' || (length(substring(code, 1, 2048)) % 3)::VARCHAR END AS detected_language,
       code IS NOT NULL AND length(code) % 5 = 0 AS failed FROM {NULL_SAMPLES_SQL}""")
def q_detect_external(spark, sf_dir):
    """M1(b)/M2: an external model that is given the chat prompt (X6) and fails on some rows; failures are named."""
    s = samples_with_nulls(spark, sf_dir)
    ok = F.length("code") % 5 != 0
    model = detect.BatchModel(_answer_by_length, labels=tuple(CODE_LANGUAGES))
    # the failing rows' prompts carry a mark the model refuses
    s = s.withColumn("code", F.when(ok, F.col("code")).otherwise(F.concat(F.lit("FAIL"), F.col("code"))))
    out = detect.detect_language(s, model, error="error")
    return out.select("id", "detected_language", F.col("error").isNotNull().alias("failed"))


def _answer_by_length():
    import json

    def predict(prompts):
        out = []
        for p in prompts:
            code = json.loads(p)[1]["content"][len("Code snippet:\n\n"):-len("\n\nIdentify the language:")]
            if code.startswith("FAIL"):
                raise ValueError("refused")
            out.append(f" 'L{len(code) % 3}'\n")
        return out
    return predict


@register("predict_detect_only", "SELECT * FROM " + TEXT_CUE_TABLE.sql_detect(SAMPLES_SQL, "id", "code"))
def q_predict_detect_only(spark, sf_dir):
    out = jobs.predict_job(samples(spark, sf_dir), stages=("detect",))
    assert "predicted_label" not in out.columns
    return out.select("id", "detected_language")


@register("predict_job", f"""
SELECT id, detected_language, predicted_label FROM
  {TEXT_CUE_TABLE.sql_detect(SAMPLES_SQL, "id", "code")} JOIN {TEXT_CUE_TABLE.sql_classify(SAMPLES_SQL, "id", "code")} USING (id)""")
def q_predict_job(spark, sf_dir):
    return jobs.predict_job(samples(spark, sf_dir)).select("id", "detected_language", "predicted_label")


@register("submission", f"SELECT id, predicted_label AS label FROM {TEXT_CUE_TABLE.sql_classify(SAMPLES_SQL, 'id', 'code')}")
def q_submission(spark, sf_dir):
    path = io.scratch_path(spark, "submission")
    jobs.submission_job(samples(spark, sf_dir), path)
    return io.read_csv(spark, path, io.SUBMISSION)


@register("evaluate_job", ORACLE["metrics_long"])
def q_evaluate_job(spark, sf_dir):
    out = jobs.evaluate_job(samples(spark, sf_dir), output_dir=io.scratch_path(spark, "eval"))
    return out["metrics"].select("metric", r6("value").alias("value"))


@register("processed_roundtrip", f"SELECT * FROM {PRE_SQL}")
def q_processed_roundtrip(spark, sf_dir):
    path = io.scratch_path(spark, "processed")
    io.save_parquet(clean.preprocess(samples(spark, sf_dir)), path)
    return spark.read.parquet(path)


ERRORS_SCHEMA = "id bigint, code string, true_label int, predicted_label int"


@register("errors_csv_roundtrip", f"SELECT id, code, true_label, predicted_label FROM {MIS_SQL}")
def q_errors_csv_roundtrip(spark, sf_dir):
    path = io.scratch_path(spark, "errors")
    io.write_csv(metrics.misclassified(scored(spark, sf_dir)).select("id", "code", "true_label", "predicted_label"), path)
    return io.read_csv(spark, path, ERRORS_SCHEMA)


def _without_ids(spark, sf_dir, name: str | None = None) -> DataFrame:
    """The samples as files without an id, or with one of another name."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = [F.col("text").alias("code"), F.col("lang").alias("language"), label_of(F.col("lang")).alias("label")]
    return d.select(*([F.col("doc_id").alias(name)] if name else []), *cols)


@register("evaluate_job_without_ids", f"""
SELECT 'none' AS ids, metric, value FROM ({ORACLE["metrics_long"]})
UNION ALL SELECT 'ID', metric, value FROM ({ORACLE["metrics_long"]})""")
def q_evaluate_job_without_ids(spark, sf_dir):
    """M11 on tables that have no id column (rows go by file and place in it) or call it ID."""
    out = None
    for name in (None, "ID"):
        m = jobs.evaluate_job(_without_ids(spark, sf_dir, name), output_dir=io.scratch_path(spark, "eval"))["metrics"]
        m = m.select(F.lit(name or "none").alias("ids"), "metric", r6("value").alias("value"))
        out = m if out is None else out.unionByName(m)
    return out


PLACE_SQL = "'{0, ' || id::VARCHAR || '}'"     # the row key of a table of one file, as text


@register("train_job_without_ids", f"""
WITH s AS ({_split_sql(PRE_SQL, 'label', key=PLACE_SQL)}), r AS (SELECT p.*, s.split FROM {PRE_SQL} p JOIN s USING (id))
SELECT split, sha256(code) AS code_sha256, detected_language FROM r
JOIN {TEXT_CUE_TABLE.sql_detect(SAMPLES_SQL, "id", "code", "detected_language")} d USING (id) WHERE split <> 'test'""")
def q_train_job_without_ids(spark, sf_dir):
    """W1, W3 and M12 on a table without ids: one row key, made at load, orders the copies, draws the split and goes through the job."""
    rows = with_row_key(_without_ids(spark, sf_dir))
    sp = cut_lineage(sampling.stratified_split(clean.preprocess(rows), "label", seed=42))
    base = io.scratch_path(spark, "train")
    jobs.train_job(sp.where("split = 'train'"), sp.where("split = 'val'"), base, stages=("detect",))
    both = [spark.read.parquet(f"{base}/{k}_with_languages.parquet") for k in ("train", "val")]
    return both[0].unionByName(both[1]).select("split", F.sha2("code", 256).alias("code_sha256"), "detected_language")


@register("evaluate_selected", f"SELECT * FROM ({ORACLE['metrics_long']}) WHERE metric IN ('test_accuracy', 'test_macro_f1')")
def q_evaluate_selected(spark, sf_dir):
    """The evaluation with chosen metrics."""
    out = jobs.evaluate_job(samples(spark, sf_dir), metric_names=["accuracy", "macro_f1"])
    return out["metrics"].select("metric", r6("value").alias("value"))


@register("profile_job", ORACLE["length_box_by_label"])
def q_profile_job(spark, sf_dir):
    """The box statistics of the whole profile."""
    b = jobs.profile_job(samples(spark, sf_dir))["length_box"]
    return b.select("label", r6("q1").alias("q1"), r6("median").alias("median"), r6("q3").alias("q3"),
                    "whisker_low", "whisker_high", "n_outliers", "n")


@register("metrics_json", f"""
SELECT 'metrics' AS section, metric AS name, 'value' AS field, value FROM ({ORACLE["metrics_long"]})
UNION ALL SELECT 'classification_report', class, f, v FROM (
  SELECT class, unnest(['precision', 'recall', 'f1', 'support']) AS f, unnest([precision, recall, f1, support::DOUBLE]) AS v FROM ({REPORT_SQL}))""")
def q_metrics_json(spark, sf_dir):
    """The metrics document written, read back with its schema and unfolded."""
    base = io.scratch_path(spark, "eval-json")
    jobs.evaluate_job(samples(spark, sf_dir), output_dir=base)
    doc = io.read_json(spark, f"{base}/test_metrics.json", jobs.METRICS_SCHEMA)
    flat = doc.select(F.explode("metrics").alias("name", "value")).select(F.lit("metrics").alias("section"), "name", F.lit("value").alias("field"), r6("value").alias("value"))
    rep = doc.select(F.explode("classification_report").alias("name", "r")).select("name", "r.*").withColumn("support", F.col("support").cast("double"))
    rep = rep.unpivot("name", ["precision", "recall", "f1", "support"], "field", "value")
    return flat.unionByName(rep.select(F.lit("classification_report").alias("section"), "name", "field", r6("value").alias("value")))


@register("metrics_json_repeated_names", f"""
WITH pc AS {PC_SQL}, lm AS (SELECT label, CASE WHEN label < 2 THEN 'both_' || label::VARCHAR ELSE name END AS name FROM {LABEL_MAP_SQL})
SELECT 'metrics' AS section, 'test_f1_' || name AS name, round(f1, 6) AS value FROM pc JOIN lm USING (label)
UNION ALL SELECT 'classification_report', name, round(f1, 6) FROM pc JOIN lm USING (label)""")
def q_metrics_json_repeated_names(spark, sf_dir):
    """S6 where two labels share a name: the document keeps both, told apart by their labels."""
    base = io.scratch_path(spark, "eval-names")
    s = samples(spark, sf_dir).withColumn("language", F.when(F.col("label") < 2, F.lit("both")).otherwise(F.col("language")))
    jobs.evaluate_job(s, output_dir=base)
    doc = io.read_json(spark, f"{base}/test_metrics.json", jobs.METRICS_SCHEMA)
    flat = doc.select(F.explode("metrics").alias("name", "value")).where("name like 'test_f1_%'").select(F.lit("metrics").alias("section"), "name", r6("value").alias("value"))
    rep = doc.select(F.explode("classification_report").alias("name", "r")).where("name not in ('accuracy', 'macro avg', 'weighted avg')")
    return flat.unionByName(rep.select(F.lit("classification_report").alias("section"), "name", r6("r.f1").alias("value")))


# ------------------------------------------- train, validate, choose, save ----

SPLIT_ROWS_SQL = f"(SELECT p.*, s.split FROM {PRE_SQL} p JOIN ({_split_sql(PRE_SQL, 'label')}) s USING (id))"
ALPHAS = C.NB_ALPHAS


def _part_sql(split: str) -> str:
    return f"(SELECT id, code, label FROM {SPLIT_ROWS_SQL} WHERE split = '{split}')"


def _alpha_sql(docs: str, alpha: float) -> str:
    return f"({nb_sql(_part_sql('train'), docs, alpha)})"


def _search_sql() -> str:
    """candidate, alpha, val_macro_f1, val_accuracy"""
    rows = []
    for i, a in enumerate(ALPHAS):
        conf = (f"(SELECT v.label AS true_label, p.predicted_label, count(*) AS n FROM {_part_sql('val')} v "
                f"JOIN {_alpha_sql(_part_sql('val'), a)} p USING (id) GROUP BY 1, 2)")
        rows.append(f"SELECT {i} AS candidate, {a}::DOUBLE AS alpha, avg(f1) AS val_macro_f1, "
                    f"sum(tp)::DOUBLE / sum(support) AS val_accuracy FROM {PC_SQL.replace(CONF_SQL, conf)}")
    return " UNION ALL ".join(rows)


BEST_SQL = f"(SELECT * FROM ({_search_sql()}) QUALIFY row_number() OVER (ORDER BY val_macro_f1 DESC, candidate) = 1)"


def _search(spark, sf_dir) -> C.NaiveBayesSearch:
    """Fit and choose on the train and validation parts of the preprocessed documents."""
    sp = cut_lineage(sampling.stratified_split(clean.preprocess(samples(spark, sf_dir)), "label", "id", seed=42))
    return C.search_naive_bayes(sp.where("split = 'train'"), sp.where("split = 'val'"), ALPHAS)


@register("train_job_enriched", f"""
SELECT split, id, detected_language FROM {SPLIT_ROWS_SQL} r
JOIN {TEXT_CUE_TABLE.sql_detect(SAMPLES_SQL, "id", "code", "detected_language")} d USING (id) WHERE split <> 'test'""")
def q_train_job_enriched(spark, sf_dir):
    """M12 train up to its saved tables: both splits preprocessed, with stage 1's language, read back."""
    sp = cut_lineage(sampling.stratified_split(clean.preprocess(samples(spark, sf_dir)), "label", "id", seed=42))
    base = io.scratch_path(spark, "train")
    jobs.train_job(sp.where("split = 'train'"), sp.where("split = 'val'"), base, stages=("detect",))
    both = [spark.read.parquet(f"{base}/{k}_with_languages.parquet") for k in ("train", "val")]
    return both[0].unionByName(both[1]).select("split", "id", "detected_language")


def _rounded(t: DataFrame) -> DataFrame:
    return t.select("candidate", "alpha", r6("val_macro_f1").alias("val_macro_f1"), r6("val_accuracy").alias("val_accuracy"))


_ROUND = "candidate, alpha, round(val_macro_f1, 6) AS val_macro_f1, round(val_accuracy, 6) AS val_accuracy"


@register("train_classifier", f"SELECT {_ROUND} FROM {BEST_SQL}")
def q_train_classifier(spark, sf_dir):
    return _rounded(_search(spark, sf_dir).best)


@register("validate_candidates", f"SELECT {_ROUND} FROM ({_search_sql()})")
def q_validate_candidates(spark, sf_dir):
    return _rounded(_search(spark, sf_dir).candidates)


_EVERY = " UNION ALL ".join(f"SELECT {i} AS candidate, id, predicted_label FROM {_alpha_sql(SAMPLES_SQL, a)}" for i, a in enumerate(ALPHAS))


@register("classify", f"SELECT e.id, s.label, e.predicted_label FROM ({_EVERY}) e JOIN {BEST_SQL} b USING (candidate) JOIN {SAMPLES_SQL} s USING (id)")
def q_classify(spark, sf_dir):
    """Every document by the chosen model."""
    return C.classify(samples(spark, sf_dir), _search(spark, sf_dir).model).select("id", "label", "predicted_label")


@register("model_roundtrip", f"SELECT e.id, e.predicted_label FROM ({_EVERY}) e JOIN {BEST_SQL} b USING (candidate)")
def q_model_roundtrip(spark, sf_dir):
    """The chosen model saved, read back and applied to every document."""
    path = io.scratch_path(spark, "model")
    C.save_naive_bayes(_search(spark, sf_dir).model, path)
    return C.classify(samples(spark, sf_dir), C.load_naive_bayes(spark, path)).select("id", "predicted_label")


@register("ensemble_checkpoints", f"""
WITH c AS (SELECT id, predicted_label, count(*) AS n FROM ({_EVERY}) GROUP BY 1, 2)
SELECT id, predicted_label FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, predicted_label) = 1""")
def q_ensemble_checkpoints(spark, sf_dir):
    """M8: every candidate saved, loaded back and applied to every document; majority vote.
    The models are stacked into one weight table: one scan, one tokenization, one join."""
    loaded = []
    for i, m in enumerate(_search(spark, sf_dir).models):
        path = io.scratch_path(spark, f"ckpt{i}")
        C.save_naive_bayes(m, path)
        loaded.append(C.load_naive_bayes(spark, path))
    stack = C.stack_naive_bayes(loaded)
    votes = C.predict_stack(stack, samples(spark, sf_dir).select("id", "code"))
    return votes.select("id", ensemble.vote_columns([F.col("predicted_labels")[i] for i in range(stack.size)]).alias("predicted_label"))


TIE_WEIGHTS = {"m0": 0.1, "m1": 0.2, "m2": 0.3, "other": 0.6}


@register("ensemble_weighted_ties", f"""
WITH p AS (SELECT id, id % 3 AS predicted_label, w AS weight FROM {SAMPLES_SQL}, (SELECT unnest([0.1, 0.2, 0.3])::DECIMAL(18, 9) AS w)
           UNION ALL SELECT id, (id + 1) % 3, 0.6 FROM {SAMPLES_SQL}),
w AS (SELECT id, predicted_label, sum(weight) AS w FROM p GROUP BY 1, 2)
SELECT id, predicted_label::INTEGER AS predicted_label FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, predicted_label) = 1""")
def q_ensemble_weighted_ties(spark, sf_dir):
    """Three models of weights .1, .2 and .3 against one of .6 are a tie, in whatever order rows arrive."""
    s = samples(spark, sf_dir).select("id")
    low = s.select("id", (F.col("id") % 3).cast("int").alias("predicted_label"))
    high = s.select("id", ((F.col("id") + 1) % 3).cast("int").alias("predicted_label"))
    return ensemble.weighted_vote(ensemble.stack_predictions({"m0": low, "m1": low, "m2": low, "other": high}, weights=TIE_WEIGHTS))


PRED_SCHEMA = "id bigint, code string, language string, label int, detected_language string, predicted_label int"


@register("predictions_csv_roundtrip", f"""
SELECT s.id, s.code, s.language, s.label, d.detected_language, p.predicted_label FROM {SAMPLES_SQL} s
JOIN {TEXT_CUE_TABLE.sql_detect(SAMPLES_SQL, "id", "code")} d USING (id)
JOIN {TEXT_CUE_TABLE.sql_classify(SAMPLES_SQL, "id", "code")} p USING (id)""")
def q_predictions_csv_roundtrip(spark, sf_dir):
    """Every column of the predictions (multi-line text included) as CSV and back."""
    path = io.scratch_path(spark, "predictions")
    io.write_csv(jobs.predict_job(samples(spark, sf_dir)), path)
    return io.read_csv(spark, path, PRED_SCHEMA)


# Python str.strip() white space again, for the stripped preview
@register("preview_stripped", f"""
SELECT id, substring(regexp_replace(regexp_replace(code, '^{_PY_WS}+', ''), '{_PY_WS}+$', ''), 1, 80) || '...' AS preview
FROM {SAMPLES_SQL}""")
def q_preview_stripped(spark, sf_dir):
    """X9 (demo form): code.strip()[:80] + '...' for every row."""
    return samples(spark, sf_dir).select("id", X.preview("code", 80, strip=True).alias("preview"))


STREAM_DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@register("stream_predict", ORACLE["predict_job"])
def q_stream_predict(spark, sf_dir):
    """The per-row stages as a Structured Streaming query over the documents
    file (available-now trigger, exactly-once parquet sink), read back."""
    from snippetflow.streaming import stream as S
    src = S.read_samples_stream(spark, f"{sf_dir}/documents*.parquet", STREAM_DOC_SCHEMA)
    sink = io.scratch_path(spark, "stream-predict")
    q = S.predict_stream(S.samples_view(src), sink)
    q.awaitTermination()
    return spark.read.parquet(sink).select("id", "detected_language", "predicted_label")


@register("stream_language_distribution", ORACLE["language_distribution"])
def q_stream_language_distribution(spark, sf_dir):
    """A8 as a stateful streaming aggregate over the documents file, published
    to a parquet table after each micro-batch, read back."""
    from snippetflow.streaming import stream as S
    src = S.read_samples_stream(spark, f"{sf_dir}/documents*.parquet", STREAM_DOC_SCHEMA)
    path = io.scratch_path(spark, "stream-langs")
    S.language_counts_table_stream(S.samples_view(src), path).awaitTermination()
    return S.latest_counts(spark, path).select("language", "n")


# ------------------------------------ counted cues, failures, partitioned tables ----

def _counted_sql(source: str) -> str:
    """No cue overlaps itself, so what replacing removes is every occurrence."""
    sums = ", ".join("(" + " + ".join(f"(length(code) - length(replace(code, '{w}', ''))) // {len(w)}" for w in ws) + f") AS n{i}" for i, ws in enumerate(CODE_CUES.values()))
    names = [f"n{i}" for i in range(len(CODE_CUES))]
    return f"""SELECT id, {CODE_CUE_TABLE.sql_pick(names, "code")} AS detected_language, ({" + ".join(names)})::BIGINT AS n_cues
FROM (SELECT id, code, {sums} FROM {source})"""


@register("detect_code_language_counts", f"{_counted_sql(NULL_SAMPLES_SQL)} UNION ALL {_counted_sql('(SELECT -1 - page_id AS id, html AS code FROM pages)')}")
def q_detect_code_language_counts(spark, sf_dir):
    """M1 by all occurrences of all cues, found by one automaton in one pass, over documents and raw pages (ids below 0)."""
    pages = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("code"))
    both = samples_with_nulls(spark, sf_dir).select("id", "code").unionByName(pages)
    got = detect.CountedCues(CODE_CUE_TABLE).apply(both, "code", "detected_language", "counts")
    return got.select("id", "detected_language", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_cues"))


@register("detect_accounting", f"""
SELECT name, n FROM (SELECT count(*) AS r, count(*) FILTER (code IS NULL OR length(code) % 5 = 0) AS u, count(*) FILTER (code IS NOT NULL AND length(code) % 5 = 0) AS f
  FROM {NULL_SAMPLES_SQL}) x, LATERAL (VALUES ('rows', r), ('unknown', u), ('failed', f), ('dead_letters', f)) v(name, n)""")
def q_detect_accounting(spark, sf_dir):
    """Failures of an external model counted in the pass that writes the table, and the rows of the dead-letter table."""
    s = samples_with_nulls(spark, sf_dir)
    s = s.withColumn("code", F.when(F.length("code") % 5 != 0, F.col("code")).otherwise(F.concat(F.lit("FAIL"), F.col("code"))))
    model = detect.BatchModel(_answer_by_length, labels=tuple(CODE_LANGUAGES))
    _, dead, counts = jobs.detect_job(s, io.scratch_path(spark, "detect"), model)
    observed = spark.createDataFrame([(k, int(v)) for k, v in counts.items()], "name string, n long")
    return observed.unionByName(dead.agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead_letters").alias("name"), "n"))


@register("enriched_partitioned", f"""
SELECT split, detected_language, id, code FROM {SPLIT_ROWS_SQL} r
JOIN {TEXT_CUE_TABLE.sql_detect(SAMPLES_SQL, "id", "code", "detected_language")} d USING (id) WHERE split = 'val' AND detected_language IN ('de', 'Unknown')
UNION ALL SELECT split, detected_language, -count(*), NULL FROM {SPLIT_ROWS_SQL} r
JOIN {TEXT_CUE_TABLE.sql_detect(SAMPLES_SQL, "id", "code", "detected_language")} d USING (id) GROUP BY ALL""")
def q_enriched_partitioned(spark, sf_dir):
    """The enriched splits in folders by split and language; some folders read back whole, all of them counted (negative ids)."""
    sp = cut_lineage(sampling.stratified_split(clean.preprocess(samples(spark, sf_dir)), "label", "id", seed=42))
    path = io.save_partitioned(detect.detect_language(sp), io.scratch_path(spark, "enriched"), ["split", "detected_language"], "id")
    t = spark.read.parquet(path)
    some = t.where("split = 'val' and detected_language in ('de', 'Unknown')").select("split", "detected_language", "id", "code")
    n = t.groupBy("split", "detected_language").agg((-F.count(F.lit(1))).alias("id")).withColumn("code", F.lit(None).cast("string"))
    return some.unionByName(n)


# ------------------------------------------------ epoch-wise training, certificate ----

EPOCHS, RATE, L2 = 4, 2.0, 0.01
N_CUES = len(LANGS)


def _cue_features(spark, sf_dir) -> DataFrame:
    """The shares of each language's cue words among a document's cue words, and its labels."""
    s = samples(spark, sf_dir).where("label is not null and code is not null")
    t = s.select("id", "label", *[c.alias(f"s{i}") for i, c in enumerate(TEXT_CUE_TABLE.scores("code"))])
    total = sum((F.col(f"s{i}") for i in range(N_CUES)), F.lit(1))
    return t.select("id", "label", *[(F.col(f"s{i}").cast("double") / total).alias(f"x{i}") for i in range(N_CUES)])


def _epochs_sql() -> str:
    """The same recursion, epoch by epoch, over (row, feature) pairs; feature -1 is the bias."""
    sc = ", ".join(f"{e} AS s{i}" for i, e in enumerate(TEXT_CUE_TABLE.sql_scores("code")))
    total = "(1 + " + " + ".join(f"s{i}" for i in range(N_CUES)) + ")"
    xs = ", ".join(f"s{i}::DOUBLE / {total}" for i in range(N_CUES))
    sql = [f"d AS (SELECT id, label, [{xs}, 1.0::DOUBLE] AS x FROM (SELECT id, label, {sc} FROM {SAMPLES_SQL} WHERE label IS NOT NULL AND code IS NOT NULL))",
           "cw AS (SELECT label, (sum(count(*)) OVER ())::DOUBLE / (count(*) OVER () * count(*)) AS cw FROM d WHERE id % 5 <> 0 GROUP BY label)",
           f"t AS (SELECT id, label, cw, j, x[j + 1] AS x FROM d JOIN cw USING (label), range({N_CUES + 1}) r(j) WHERE id % 5 <> 0)",
           f"v AS (SELECT id, label, j, x[j + 1] AS x FROM d, range({N_CUES + 1}) r(j) WHERE id % 5 = 0)",
           f"w0 AS (SELECT label AS k, j, 0.0::DOUBLE AS w FROM cw, range({N_CUES + 1}) r(j))"]
    for e in range(1, EPOCHS + 1):
        p = e - 1
        sql += [f"z{e} AS (SELECT id, label, cw, k, sum(x * w) AS z FROM t JOIN w{p} USING (j) GROUP BY ALL)",
                f"p{e} AS (SELECT id, label, cw, k, exp(z) / sum(exp(z)) OVER (PARTITION BY id) AS p FROM z{e})",
                f"l{e} AS (SELECT -sum(cw * ln(p)) / sum(cw) AS loss FROM p{e} WHERE k = label)",
                f"g{e} AS (SELECT k, j, sum(t.cw * (p - (k = t.label)::INTEGER) * x) / (SELECT sum(cw) FROM p{e} WHERE k = label) AS g FROM t JOIN p{e} USING (id) GROUP BY k, j)",
                f"w{e} AS (SELECT k, j, w - {RATE} * (g + CASE WHEN j < {N_CUES} THEN {L2} * w ELSE 0 END) AS w FROM w{p} JOIN g{e} USING (k, j))",
                f"y{e} AS (SELECT id, label AS true_label, k AS predicted_label FROM (SELECT id, label, k, sum(x * w) AS z FROM v JOIN w{e} USING (j) GROUP BY ALL) "
                f"QUALIFY row_number() OVER (PARTITION BY id ORDER BY z DESC, k) = 1)",
                f"c{e} AS (SELECT true_label, predicted_label, count(*) AS n FROM y{e} GROUP BY 1, 2)",
                f"m{e} AS (SELECT {e} AS epoch, avg(f1) AS f1, sum(tp)::DOUBLE / sum(support) AS acc FROM {PC_SQL.replace(CONF_SQL, f'(SELECT * FROM c{e})')})"]
    rows = " UNION ALL ".join(f"SELECT epoch, round(loss, 6) AS train_loss, round(f1, 6) AS val_macro_f1, round(acc, 6) AS val_accuracy, "
                              f"(SELECT round(sum(abs(w)), 6) FROM w{e}) AS weight_sum FROM m{e}, l{e}" for e in range(1, EPOCHS + 1))
    return f"WITH {', '.join(sql)}, a AS ({rows}) SELECT *, epoch = (SELECT arg_max(epoch, val_macro_f1 - 1e-9 * epoch) FROM a) AS best FROM a"


@register("train_epochs", _epochs_sql())
def q_train_epochs(spark, sf_dir):
    """Full-batch epochs on four fifths of the documents, validated on the rest after each; the earliest best is the model."""
    f = _cue_features(spark, sf_dir)
    names = [f"x{i}" for i in range(N_CUES)]
    r = softmax.train_softmax(f.where("id % 5 <> 0"), f.where("id % 5 = 0"), names, epochs=EPOCHS, learning_rate=RATE, l2=L2)
    size = r.weights.groupBy("epoch").agg(F.sum(F.abs("weight")).alias("weight_sum"))
    return r.epochs.join(size, "epoch").select("epoch", r6("train_loss").alias("train_loss"), r6("val_macro_f1").alias("val_macro_f1"),
                                               r6("val_accuracy").alias("val_accuracy"), r6("weight_sum").alias("weight_sum"),
                                               (F.col("epoch") == r.best.select("epoch").scalar()).alias("best"))


@register("train_certificate", f"""
SELECT count(*) AS n_rows, count(DISTINCT label) AS n_classes, true AS optimal, false AS optimal_when_moved FROM {SAMPLES_SQL} WHERE label IS NOT NULL AND code IS NOT NULL""")
def q_train_certificate(spark, sf_dir):
    """M4: the fitted Spark ML regression is an optimum of its objective: its gradient, taken in one aggregate, vanishes; that of moved weights does not."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    names = [f"x{i}" for i in range(N_CUES)]
    rows = cut_lineage(_cue_features(spark, sf_dir).select("label", F.lit(1.0).alias("weight"), F.array(*names).alias("features")))
    ml = LogisticRegression(featuresCol="v", family="multinomial", regParam=0.01, maxIter=300, tol=1e-10).fit(rows.withColumn("v", array_to_vector("features")))
    w, b = ml.coefficientMatrix.toArray(), ml.interceptVector.toArray()
    here = softmax.certificate(rows, w, b, list(range(len(b))), 0.01)
    moved = softmax.certificate(rows, w * 1.1, b, list(range(len(b))), 0.01)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("label").alias("n_classes")).select(
        "n_rows", "n_classes", F.lit(here["gradient_norm"] < 1e-4).alias("optimal"), F.lit(moved["gradient_norm"] < 1e-4).alias("optimal_when_moved"))


def _profile_sql() -> str:
    """All tables of the profile, each unfolded to (section, item, field, text, value)."""
    parts = []

    def add(section, sql, item, fields, texts=()):
        for f in fields:
            text, value = (f'"{f}"', "NULL::DOUBLE") if f in texts else ("NULL::VARCHAR", f'"{f}"::DOUBLE')
            parts.append(f"SELECT '{section}' AS section, {item} AS item, '{f}' AS field, {text} AS text, round({value}, 6) AS value FROM ({sql})")
    info = f"""SELECT * FROM (SELECT count(id) AS a, count(code) AS b, count(language) AS c, count(label) AS d, count(*) AS n FROM {NULL_SAMPLES_SQL}),
      LATERAL (VALUES (0, 'id', 'bigint', a, n - a), (1, 'code', 'string', b, n - b), (2, 'language', 'string', c, n - c), (3, 'label', 'int', d, n - d)) v(position, col, type, non_null, n_missing)"""
    add("table_info", info, "col", ("position", "type", "non_null"), ("type",))
    add("missing_values", info, "col", ("position", "n_missing"))
    add("duplicate_count", f"SELECT count(*) - count(DISTINCT code) - (count(*) FILTER (code IS NULL) > 0)::INTEGER AS n_duplicates FROM {NULL_SAMPLES_SQL}", "''", ("n_duplicates",))
    add("short_codes", f"SELECT count(*) AS n_short FROM {NULL_SAMPLES_SQL} WHERE length(code) < 10", "''", ("n_short",))
    add("length_describe", ORACLE["length_describe"].replace(SAMPLES_SQL, NULL_SAMPLES_SQL), "''", ("count", "mean", "std", "min", "q25", "q50", "q75", "max"))
    add("length_histogram", ORACLE["length_histogram"].replace(SAMPLES_SQL, NULL_SAMPLES_SQL), "bin::VARCHAR", ("lo", "hi", "n"))
    add("label_counts", ORACLE["label_counts"], "label::VARCHAR", ("n",))
    add("class_balance", ORACLE["class_balance"], "label::VARCHAR", ("n", "pct"))
    add("length_box", ORACLE["length_box_by_label"].replace(SAMPLES_SQL, f"(SELECT * FROM {NULL_SAMPLES_SQL} WHERE code IS NOT NULL)"), "label::VARCHAR",
        ("q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"))
    add("length_box", f"SELECT label, count(*) AS n FROM {NULL_SAMPLES_SQL} GROUP BY label", "label::VARCHAR", ("n",))
    return " UNION ALL ".join(parts)


@register("profile_job_tables", _profile_sql())
def q_profile_job_tables(spark, sf_dir):
    """Every table of the profile of a sample table with nulls, in one long result."""
    t = jobs.profile_table(jobs.profile_job(samples_with_nulls(spark, sf_dir)))
    return t.select("section", "item", "field", "text", r6("value").alias("value"))
