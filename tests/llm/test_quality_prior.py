from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import quality


def test_a_bounded_sample_keeps_the_class_ratio(spark, make_docs):
    rows = [(i, "word " * (5 + i % 7)) for i in range(100)]
    labels = spark.createDataFrame([(i, int(i >= 10)) for i in range(100)], "doc_id long, quality int")
    whole, bounded = (quality.fit_on(make_docs(rows), labels, most) for most in (1000, 10))
    assert whole.start == pytest.approx(np.log(9))
    assert bounded.start == pytest.approx(np.log(9))
