"""The train, eval and predict jobs for ``spark-submit``.

    spark-submit --py-files snippetflow.zip tools/run_job.py train   --data DIR --out DIR [--max-train N] [--max-val N] [--language-feature] [--no-class-weights] [--features N]
    spark-submit --py-files snippetflow.zip tools/run_job.py eval    --data TABLE --out DIR [--model DIR] [--max-errors N] [--save-predictions]
    spark-submit --py-files snippetflow.zip tools/run_job.py predict --data TABLE --out DIR [--model DIR]

``train`` reads DIR/train.parquet and DIR/val.parquet and writes the enriched
tables and the best model; ``eval`` writes metrics JSON, error CSV and, if
asked, predictions; ``predict`` writes the two-column submission.  Without
``--model`` eval and predict use the cue table.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv=None, spark=None):
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(dest="job", required=True)
    for name in ("train", "eval", "predict"):
        p = sub.add_parser(name)
        p.add_argument("--data", required=True)
        p.add_argument("--out", required=True)
        if name == "train":
            p.add_argument("--max-train", type=int)
            p.add_argument("--max-val", type=int)
            p.add_argument("--language-feature", action="store_true")
            p.add_argument("--no-class-weights", action="store_true")
            p.add_argument("--features", type=int)
        else:
            p.add_argument("--model")
        if name == "eval":
            p.add_argument("--max-errors", type=int)
            p.add_argument("--save-predictions", action="store_true")
    a = ap.parse_args(argv)

    from snippetflow.functions.cues import TEXT_CUE_TABLE
    from snippetflow.operators import classify as C
    from snippetflow.plans import jobs
    from snippetflow.session import drop_tables, get_session
    from snippetflow.sources import io
    own = spark is None
    spark = spark or get_session()
    try:
        return run(a, spark, C, jobs, io, TEXT_CUE_TABLE)
    finally:
        if own:
            drop_tables(spark)       # what the job wrote on its way; its outputs are elsewhere


def run(a, spark, C, jobs, io, TEXT_CUE_TABLE):
    if a.job == "train":
        return jobs.train_from_splits(
            spark, {k: f"{a.data}/{k}.parquet" for k in ("train", "val")}, a.out, a.max_train, a.max_val,
            language_feature=a.language_feature, class_weighted=not a.no_class_weights, num_features=a.features or C.DEFAULT_FEATURES)
    df = io.load_samples(spark, a.data)
    model = C.load_model(a.model) if a.model else TEXT_CUE_TABLE
    if a.job == "eval":
        return jobs.evaluate_job(df, model, a.out, max_errors=a.max_errors, save_predictions=a.save_predictions)
    return jobs.submission_job(df, a.out, classifier=model)


if __name__ == "__main__":
    main()
