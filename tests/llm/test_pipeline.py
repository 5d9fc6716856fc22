"""The pipeline on small tables: each stage against what it must keep."""

import numpy as np
import corpus_pipeline
from pyspark.sql import functions as F

from millrace.llm import decontaminate, packing, quality, secrets, tokens

from ..conftest import SMALL
from .test_exact import brute_components, sets_of


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "secrets", "packing"]
    good = corpus_pipeline.keep_good(spark, docs, SMALL).persist()
    model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert good.columns == docs.columns and good.count() > 0.7 * docs.count()
    apart = corpus_pipeline.drop_near_copies(spark, good, SMALL).persist()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in apart.collect()} == set(brute_components(sets_of(rows)).values())
    clean = corpus_pipeline.drop_benchmark(spark, apart, SMALL).persist()
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.find(apart, bench).filter(F.size("runs") > 0).collect()}
    before, after = {r.doc_id: r.text for r in apart.collect()}, {r.doc_id: r.text for r in clean.collect()}
    assert all(after[i] == t for i, t in before.items() if i not in hit) and hit
    safe = corpus_pipeline.mask_secrets(spark, clean, SMALL).persist()
    assert safe.count() == clean.count() and safe.columns == docs.columns
    assert not any(secrets.scan(r.text or "") for r in safe.collect())
    pieces = corpus_pipeline.pack(spark, safe, SMALL).collect()
    want = tokens.encoder(tokens.default_path())
    whole = {r.doc_id: want.encode([r.text], 1)[0] for r in safe.collect()}
    for r in pieces:
        assert bytes(r.ids) == whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
    assert sum(r.length for r in pieces) == sum(len(x) // 4 for x in whole.values())
    fill = {}
    for r in pieces:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert sum(n < packing.SIZE for n in fill.values()) <= 1 and np.max(list(fill.values())) == packing.SIZE


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
