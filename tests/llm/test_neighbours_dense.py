"""A dense label whose links the cells miss is compared whole."""

import numpy as np

from stackloom.llm import neighbours


def test_labels_that_the_audit_finds_poor_are_compared_whole(spark):
    rng = np.random.default_rng(1)
    center = rng.normal(size=32)
    center /= np.linalg.norm(center)
    dense = center + 0.2 * rng.normal(size=(1500, 32)) / np.sqrt(32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(dense)]
    rows += [(2000 + i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(30, 32)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = dense / np.linalg.norm(dense, axis=1, keepdims=True)
    true = (x @ x.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r for r in neighbours.near_duplicates(df, cell=10).collect()}
    found = sum(got[i].n_links for i in range(len(dense)))
    assert true.sum() > 0 and all(got[i].n_links <= true[i] for i in range(len(dense)))
    assert found >= 0.95 * true.sum()
    assert all(got[2000 + i].n_links == 0 for i in range(30))
