"""Documents without a language to learn from."""

import corpus_pipeline
from test_text_ops import EDGE, SF, frame

from textassay.llm import language_id


def test_documents_stay_without_a_language(spark):
    want = sum(bool(t and any(c.isalpha() for c in t)) for _, t in EDGE)
    assert language_id.drop_unknown(frame(spark, EDGE)).count() == want > 0
    long = [(k, "word " * 5_000) for k in range(4)]
    assert corpus_pipeline.recognised_language(spark, frame(spark, long, "en"), SF).count() == len(long)
