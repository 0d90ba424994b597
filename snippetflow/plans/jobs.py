"""The train / eval / predict / profile jobs (M10-M14, SURVEY 3).

Each job is a function over DataFrames; a thin ``spark-submit`` script can
call them.  Stage switches are arguments, not config files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from snippetflow.functions.cues import TEXT_CUE_TABLE, CueTable
from snippetflow.operators import classify as C
from snippetflow.operators import clean, detect, labels, metrics, profile, sampling
from snippetflow.schema import ROW_KEY, file_row_ids, id_column, order_key
from snippetflow.session import cut_lineage
from snippetflow.sources import io

STAGES = ("detect", "classify")


def predict_job(df: DataFrame, stages=STAGES, detector=TEXT_CUE_TABLE, classifier=TEXT_CUE_TABLE,
                code: str = "code") -> DataFrame:
    """M10/M12 predict: no preprocessing, one output row per input row.

    Adds ``detected_language`` (stage 1) and ``predicted_label`` (stage 2)
    for the enabled stages; narrow end to end.  Where both stages use the
    same cue table, one tokenization and one scoring serve both.
    """
    if "detect" in stages and "classify" in stages and detector is classifier and isinstance(detector, CueTable):
        return detector.apply_both(df, code, "detected_language", "predicted_label")
    out = df
    if "detect" in stages:
        out = detect.detect_language(out, detector, code)
    if "classify" in stages:
        out = C.classify(out, classifier, code)
    return out


def detect_job(df: DataFrame, path: str, backend=TEXT_CUE_TABLE, code: str = "code", max_failed: float = 1.0,
               out: str = "detected_language", unknown: str = "Unknown") -> tuple[DataFrame, DataFrame, dict]:
    """M1 + M2 as a job that accounts for its failures: the enriched table is written to
    ``path``/enriched, and the same pass counts rows, ``Unknown`` answers and failed rows (``DataFrame.observe``).
    Failed rows (an external model's errors) go to ``path``/dead_letters with the error's text, read from
    the written table by that column.  Returns (enriched, dead letters, counts); raises when more than ``max_failed`` of all rows are unknown."""
    scored = detect.detect_language(df, backend, code, out, error="error")
    if "error" not in scored.columns:
        scored = scored.withColumn("error", F.lit(None).cast("string"))
    seen = Observation("detect")
    lost = F.col(out) == unknown
    watched = scored.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(lost, 1)).alias("unknown"), F.count("error").alias("failed"))
    io.save_parquet(watched, f"{path}/enriched")
    counts = dict(seen.get)
    spark = df.sparkSession
    dead = spark.read.parquet(f"{path}/enriched").where("error is not null")
    io.save_parquet(dead, f"{path}/dead_letters")
    if counts["unknown"] > max_failed * counts["rows"]:
        raise RuntimeError(f"{counts['unknown']} of {counts['rows']} rows have no language; see {path}/dead_letters")
    return spark.read.parquet(f"{path}/enriched").drop("error"), spark.read.parquet(f"{path}/dead_letters"), counts


def with_ids(df: DataFrame) -> tuple[DataFrame, str]:
    """use 'id', else 'ID', else 0-based ids in file order (``df`` is
    the loaded table: file offset + row index, no shuffle of the rows); a
    table that is not read from files is numbered in its present order."""
    col = id_column(df)
    if col is not None:
        return df, col
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return clean.position_ids(df, "id"), "id"
    return file_row_ids(df, "id"), "id"


def submission_job(df: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """predict -> (id, label); written as CSV when a path is given.

    Without an id column the rows are numbered in file order (file offset
    + row index, ``with_ids``); predict keeps every row, so nothing moves."""
    stages = kw.pop("stages", STAGES)
    df, idc = with_ids(df)
    scored = predict_job(df, stages=stages, **kw)
    if path:
        # one part file per task: the table has a row per input row, so it is
        # never funnelled through a single task
        io.write_submission(scored, path, id_col=idc)
    return io.submission(scored, idc)


def metrics_document(mlong: DataFrame, report: DataFrame) -> DataFrame:
    """One row with the flat metrics and the nested report keyed by class
    (both tables hold a few rows per class; a key that comes twice keeps one value)."""
    flat = mlong.groupBy("metric").agg(F.max("value").alias("value")).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    body = F.struct("precision", "recall", "f1", "support")
    nested = report.groupBy("class").agg(F.max(body).alias("body")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("class"), "body"))).alias("classification_report"))
    return flat.select("metrics", nested.scalar().alias("classification_report"))


METRICS_SCHEMA = ("metrics map<string,double>, classification_report "
                  "map<string,struct<precision:double,recall:double,f1:double,support:bigint>>")


def evaluate_job(test: DataFrame, classifier=TEXT_CUE_TABLE, output_dir: str | None = None,
                 prefix: str = "test_", truth: str = "label", order_col: str | None = None,
                 metric_names=None, save_predictions: bool = False, save_errors: bool = True,
                 max_errors: int | None = None, code: str = "code") -> dict:
    """Preprocess -> predict once -> every evaluation table.

    Rows go by ``order_col``, else by ``id``, ``ID`` or their place in the file.
    The text is read and scored once: one written table holds the narrow columns of all rows
    and the text of the misclassified ones only (of all, where the predictions are
    saved), and everything else reads that table.  One aggregate over (truth, language,
    prediction) gives counts and first rows; the confusion table, the label
    map and every metric read it.  The error table holds all misclassified
    rows with their text (the first ``max_errors`` in order where that is set).
    Names that several labels share are told apart by their label.
    Returns the named DataFrames; with ``output_dir`` also writes metrics
    JSON, errors CSV (one part file per task) and (optionally) all predictions.
    """
    if order_col is None:
        test, order_col = order_key(test)
    scored = C.classify(clean.preprocess(test, code=code, order_col=order_col), classifier, code)
    base = output_dir.rstrip("/") if output_dir else None
    wrong = ~F.col(truth).eqNullSafe(F.col("predicted_label"))
    text = F.col(code) if base and save_predictions else F.when(wrong, F.col(code))
    scored = cut_lineage(scored.withColumn(code, text))
    lang = "language" if "language" in scored.columns else None
    cells = cut_lineage(scored.select(
        metrics._non_null(truth, "true").alias("true_label"), metrics._non_null("predicted_label", "predicted").alias("predicted_label"),
        (F.col(lang) if lang else F.lit(None).cast("string")).alias("language"), F.col(order_col).alias("o"))
        .groupBy("true_label", "language", "predicted_label").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first")))
    conf = cells.groupBy("true_label", "predicted_label").agg(F.sum("n").alias("n"))
    if lang:
        lmap = cells.groupBy(F.col("true_label").alias("label"), "language").agg(F.min("first").alias("first")).groupBy("label").agg(
            F.max_by("language", "first").alias("name"))
    else:
        lmap = labels.label_map(conf.select(F.col("true_label").alias("label")))
    lmap = cut_lineage(labels.distinct_names(lmap))
    mlong = metrics.metrics_long(conf, lmap, prefix)
    if metric_names:
        mlong = mlong.filter(F.col("metric").isin([prefix + m for m in metric_names]))
    errors = metrics.misclassified(scored, truth, "predicted_label", lmap)
    if max_errors is not None:
        errors = errors.orderBy(order_col).limit(max_errors)
    keep = [c for c in (order_col, truth, "language", "predicted_label") if c in scored.columns]
    out = {
        "scored": scored.select(*keep),
        "label_map": lmap,
        "confusion": conf,
        "metrics": mlong,
        "report": metrics.classification_report(conf, lmap),
        "per_class": metrics.per_class_long(conf),
        "errors": errors,
    }
    if base:
        io.write_json(metrics_document(out["metrics"], out["report"]), f"{base}/{prefix}metrics.json")
        if save_errors:
            io.write_csv(errors.drop(ROW_KEY), f"{base}/{prefix}misclassifications.csv")
        if save_predictions:
            io.write_csv(scored.drop(ROW_KEY), f"{base}/{prefix}predictions.csv")
    return out


def train_job(train: DataFrame, val: DataFrame, output_dir: str | None = None,
              train_max_rows: int | None = None, val_max_rows: int | None = None,
              seed: int = 42, stages=STAGES, candidates=C.DEFAULT_CANDIDATES,
              detector=TEXT_CUE_TABLE, language_feature: bool = False, class_weighted: bool = True,
              num_features: int = C.DEFAULT_FEATURES) -> dict:
    """M12 train: cap -> preprocess -> stage 1 (saved) -> fit candidates -> best model (saved).

    ``train_max_rows`` bounds the rows that fit the classifier and ``val_max_rows``
    those that choose it; neither is set by default.  Rows go by ``id``, ``ID`` or their place
    in the file, through the cap and the choice among copies alike.  ``language_feature`` adds
    stage 1's language to the features (M9)."""
    def prepared(df: DataFrame, cap: int | None) -> DataFrame:
        df, key = order_key(df)
        return clean.preprocess(sampling.sample_exact(df, cap, seed, key), order_col=key).drop(ROW_KEY)

    tr, va = prepared(train, train_max_rows), prepared(val, val_max_rows)
    res = {}
    if "detect" in stages:
        tr = detect.detect_language(tr, detector)
        va = detect.detect_language(va, detector)
        if output_dir:
            io.save_parquet(tr, f"{output_dir}/train_with_languages.parquet")
            io.save_parquet(va, f"{output_dir}/val_with_languages.parquet")
            spark = train.sparkSession
            tr, va = (spark.read.parquet(f"{output_dir}/{x}_with_languages.parquet") for x in ("train", "val"))
    elif language_feature:
        raise ValueError("language_feature needs the detect stage")
    if "classify" in stages:
        r = C.train_classifier(tr, va, candidates, class_weighted, num_features,
                               language_feature="detected_language" if language_feature else None)
        res.update(model=r.model, candidates=r.candidates, best=r.best)
        if output_dir:
            C.save_model(r.model, f"{output_dir}/classifier_best")
    return res


def train_from_splits(spark, paths: dict, output_dir: str | None = None, train_max_rows: int | None = None,
                      val_max_rows: int | None = None, seed: int = 42, **options) -> dict:
    """S2 + M12: read the train and val tables, cap them, and train."""
    s = sampling.load_splits(spark, {k: paths[k] for k in ("train", "val")}, {"train": train_max_rows, "val": val_max_rows}, seed)
    return train_job(*(s.where(F.col("split") == k).drop("split") for k in ("train", "val")), output_dir, seed=seed, **options)


def profile_job(df: DataFrame, code: str = "code", label: str = "label", order_col: str | None = None) -> dict:
    """The data profile as named DataFrames."""
    if order_col is None:
        keyed, order_col = order_key(df)
    else:
        keyed = df
    out = {
        "preview": sampling.preview(keyed, 5, order_col).drop(ROW_KEY),
        "table_info": profile.table_info(df),
        "missing_values": profile.missing_values(df),
        "duplicate_count": profile.duplicate_count(df, code),
        "short_codes": clean.short_codes(df, code).select(F.count(F.lit(1)).alias("n_short")),
    }
    # one pass over the text serves all length tables
    counts = profile.length_counts(df, code, label if label in df.columns else None)
    total = counts.groupBy("len").agg(F.sum("n").alias("n"))
    out["length_describe"] = profile.length_describe(df, code, total)
    out["length_histogram"] = profile.length_histogram(df, code, counts=total)
    if label in df.columns:
        out.update(label_counts=profile.label_counts(df, label),
                   class_balance=profile.class_balance(df, label),
                   length_box=profile.length_box_by_label(df, code, label, counts=counts))
    return out


def profile_table(profile_tables: dict) -> DataFrame:
    """All tables of ``profile_job`` but the preview in one long table: (section, item, field, value), numbers as doubles, types as text."""
    items = {"table_info": "column", "missing_values": "column", "duplicate_count": None, "short_codes": None, "length_describe": None,
             "length_histogram": "bin", "label_counts": "label", "class_balance": "label", "length_box": "label"}
    out = None
    for section, item in items.items():
        if section not in profile_tables:
            continue
        t = profile_tables[section]
        fields = [c for c in t.columns if c != item]
        name = F.col(item).cast("string") if item else F.lit("")
        values = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string" if dict(t.dtypes)[c] == "string" else "double").cast("string").alias("text"),
                                    (F.lit(None) if dict(t.dtypes)[c] == "string" else F.col(c)).cast("double").alias("value")) for c in fields])
        long = t.select(F.lit(section).alias("section"), name.alias("item"), F.explode(values).alias("f")).select(
            "section", "item", "f.field", F.when(F.col("f.value").isNull(), F.col("f.text")).alias("text"), "f.value")
        out = long if out is None else out.unionByName(long)
    return out
