"""Plan shape checks: the scale properties the operators promise."""

from snippetflow.operators import clean, metrics, sampling
from snippetflow.plans import catalog
from snippetflow.sources import io

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def many_files(spark, n=16):
    """The documents as a table of many files, so a scan needs no spreading and any exchange shows."""
    path = io.scratch_path(spark, "many")
    catalog.samples(spark, SF).repartition(n).write.parquet(path)
    return spark.read.parquet(path)


def test_dedup_leaves_the_text_where_it_was_read(spark):
    out = clean.dedup_first(many_files(spark))
    p = plan(out)
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and "Window" not in p
    assert "Exchange hashpartitioning" not in p     # only the written groups are broadcast
    assert out.count() == catalog.samples(spark, SF).select("code").distinct().count()


def test_sample_and_split_read_the_text_once(spark):
    s = many_files(spark)
    p = plan(sampling.stratified_split(s))
    assert p.count("FileScan parquet") <= 2 and "Window" not in p and "Exchange hashpartitioning" not in p
    p = plan(sampling.sample_exact(s, 50))
    assert "Join" not in p.split("Subquery")[0]


def test_two_views_tokenize_each_view_once(spark):
    from snippetflow.functions.cues import TEXT_CUE_TABLE
    from snippetflow.operators import ensemble
    assert plan(ensemble.two_view_predict(catalog.samples(spark, SF), TEXT_CUE_TABLE)).count("split(lower(") == 2
    from snippetflow.plans import jobs
    assert plan(jobs.predict_job(catalog.samples(spark, SF))).count("split(lower(") == 1


def test_confusion_is_partial_aggregate(spark):
    p = plan(metrics.confusion_counts(catalog.scored(spark, SF)))
    assert "partial_count" in p


def test_cue_scoring_tokenizes_once(spark):
    from snippetflow.functions.cues import TEXT_CUE_TABLE
    df = TEXT_CUE_TABLE.apply(catalog.samples(spark, SF), "code", "p", "index")
    assert plan(df).count("split(lower(") == 1
