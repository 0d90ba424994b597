"""Measure how the work of each stage is spread over tasks when one key holds
a third of all rows.

    python tools/skew_probe.py [--sf DIR] [--out FILE]

The documents and events tables are read and made skewed by rule: every
third document gets the same text and the same class, and every third event
the same user.  Each operator runs under its own job group with Spark's
event log written to a fresh scratch folder; for every stage the largest
task's share of the shuffle records it reads is reported (scan stages are
input splits and are left out; partition coalescing is off in the probe).
With P even partitions a balanced stage shows about 1/P; a hot key that
lands in one task shows at least 1/3.  Stages that read fewer than
``MIN_RECORDS`` records (class tables) are listed apart; one-task stages
over cell tables (offsets by a running sum) are bounded by the cell count.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

MIN_RECORDS = 1000


def build(spark, sf):
    from pyspark.sql import functions as F
    from snippetflow.plans import catalog
    hot = F.col("doc_id") % 3 == 0
    docs = catalog.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.when(hot, F.lit("one text shared by a third of the rows"))
        .otherwise(F.col("text")).alias("code"),
        F.when(hot, F.lit(0)).otherwise(catalog.label_of(F.col("lang"))).alias("label"))
    ev = catalog.table(spark, sf, "events").withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    return docs, ev


def operators(docs, ev):
    from pyspark.sql import functions as F
    from snippetflow.operators import clean, ensemble, metrics, profile, sampling
    from snippetflow.plans import catalog
    stacked = ensemble.stack_predictions(
        {m: t.apply(docs.select("id", "code"), "code", "predicted_label", "index").drop("code")
         for m, t in catalog.MODELS.items()})
    return {
        "dedup_first": lambda: clean.dedup_first(docs),
        "duplicate_count": lambda: profile.duplicate_count(docs),
        "stratified_split": lambda: sampling.stratified_split(docs),
        "sample_exact": lambda: sampling.sample_exact(docs, 3000),
        "confusion_counts": lambda: metrics.confusion_counts(
            docs.withColumn("predicted_label", (F.col("id") % 4).cast("int"))),
        "majority_vote": lambda: ensemble.majority_vote(stacked),
        "running_average": lambda: profile.running_average(
            ev.withColumn("k", F.expr(catalog.EVENT_WEIGHT)), "user_id", ["ts", "event_id"], "value", "k",
            bucket=F.date_trunc("minute", "ts"), bucket_block=lambda b: F.date_trunc("day", b)),
    }


def parse(log_dir):
    groups, stage_group, tasks = {}, {}, {}
    files = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)]
    for path in sorted(files):
        with open(path) as fh:
            for line in fh:
                e = json.loads(line)
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    for s in e.get("Stage IDs", []):
                        stage_group[s] = g
                elif kind == "SparkListenerTaskEnd":
                    m = e.get("Task Metrics") or {}
                    n = m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
                    tasks.setdefault(e["Stage ID"], []).append(n)
    for s, ns in tasks.items():
        g = stage_group.get(s)
        if g is None or not ns or sum(ns) == 0:     # scan stages: input splits, not keys
            continue
        total = sum(ns)
        groups.setdefault(g, []).append({"stage": s, "tasks": len(ns), "records": total,
                                         "max_task_share": round(max(ns) / total, 3) if total else 0.0})
    return groups


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--out", default=None)
    a = ap.parse_args()
    from snippetflow.session import DEFAULT_CONF, get_session
    from pyspark.sql import SparkSession
    # local probe only: the event log goes to a fresh scratch folder
    log_dir = tempfile.mkdtemp(prefix="skew-events-")
    b = SparkSession.builder.master("local[8]")
    for k, v in DEFAULT_CONF.items():        # UI off from the start
        b = b.config(k, v)
    # no partition coalescing: every shuffle shows its real spread over keys
    (b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://" + log_dir)
     .config("spark.eventLog.compress", "false")
     .config("spark.sql.adaptive.coalescePartitions.enabled", "false").getOrCreate())
    spark = get_session("local[8]", 8)     # the package defaults on that session
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs, ev = build(spark, a.sf)
    for name, fn in operators(docs, ev).items():
        spark.sparkContext.setJobGroup(name, name)
        fn().write.format("noop").mode("overwrite").save()
    spark.stop()
    groups = parse(log_dir)
    report = {}
    for name, stages in groups.items():
        big = [s for s in stages if s["records"] >= MIN_RECORDS]
        report[name] = {"worst_max_task_share": max((s["max_task_share"] for s in big), default=None),
                        "stages": big, "small_stages": len(stages) - len(big)}
    text = json.dumps(report, indent=1)
    if a.out:
        with open(a.out, "w") as fh:
            fh.write(text)
    for name, r in report.items():
        print(f"{name:20s} worst max-task share {r['worst_max_task_share']}  "
              f"({len(r['stages'])} stages >= {MIN_RECORDS} records, {r['small_stages']} small)")


if __name__ == "__main__":
    main()
