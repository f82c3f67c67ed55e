"""The pipeline against a plain version of each stage on the rows that the stage before kept."""

import numpy as np
import public_tokenizers
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from contrail.llm import quality, toxicity
from contrail.llm.simhash import shingle_hashes
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.001"


def _least_of_groups(rows):
    """Smallest ids of groups connected by a similarity of 0.8, all pairs compared."""
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] | sets[b])
            if not both or len(sets[a] & sets[b]) >= 0.8 * both:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in ids}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scorer, pack = model.scorer(), zstandard.ZstdCompressor(level=3, write_content_size=False)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality_rules", "simhash_near_dedup", "best_fit_packing"]
    want = {i for i, t in rows if scorer.document(t) < 0.3}
    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns
    got = {r["doc_id"] for r in kept.collect()}
    assert len(got ^ want) <= 1 and len(want) < len(rows)  # training sums in an order of its own
    kept = docs.where(F.col("doc_id").isin(list(want)))
    good = {i for i, t in rows if i in want and quality.measure(t, pack)[-1]}
    kept = stages["quality_rules"](spark, kept, SF)
    assert {r["doc_id"] for r in kept.collect()} == good and kept.columns == docs.columns
    single = stages["simhash_near_dedup"](spark, kept, SF)
    assert single.columns == docs.columns
    assert {r["doc_id"] for r in single.collect()} == _least_of_groups([(i, t) for i, t in rows if i in good])
    packed = stages["best_fit_packing"](spark, single, SF).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    by_doc = {}
    for r in packed:
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["length"]
    assert by_doc == {r["doc_id"]: total[r["doc_id"]] for r in single.collect()}
    assert np.bincount([r["sequence_id"] for r in packed], [r["length"] for r in packed]).max() <= 1024


def test_awkward_rows_pass_all_stages(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # short, empty or repetitive, every one
