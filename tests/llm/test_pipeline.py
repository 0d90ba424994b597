"""The pipeline's stages against brute force, each on its own input."""

import brute
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from snippetflow.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    kept = {r["doc_id"]: r["text"] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = sorted(kept.items())
        out = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        assert out.columns == columns
        kept = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            table = spark.read.parquet(f"{SF}/documents.parquet")
            scored = toxicity.score(table, toxicity.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
            want = {r.doc_id for r in scored if not r.predicted}
        elif name == "exact dedup":
            want = {x[1] for x in brute.exact(before)}
        elif name == "n-gram Jaccard join":
            want = {x[2] for x in brute.near(before)}
        else:
            want = {x[0] for x in brute.hits(before, items) if not x[4]}
        assert set(kept) == want, name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in kept.values())
    assert sum(r.length for r in packed) == total and {r.doc_id for r in packed} == set(kept)
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(packed)
