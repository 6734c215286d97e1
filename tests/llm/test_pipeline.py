"""The pipeline's stages against brute force on the smallest tables."""

import corpus_pipeline
from spanlight.llm.core import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents").cache()
    sizes, at = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF).cache()
        assert at.columns == docs.columns, name
        sizes.append(at.count())
    assert sizes[1] <= sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2]
    items = [" ".join(r.text.lower().split()) for r in table(spark, SF, "benchmark").collect()]
    assert not any(i in " ".join((r.text or "").lower().split()) for r in at.collect() for i in items)
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert len(last) == sizes[4] and sum(r.n_tokens for r in last) == max(r.start + r.n_tokens for r in last)
