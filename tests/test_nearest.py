"""The inverted-file index against the exact search."""

import numpy as np
import pytest

from auditspan.operators import nearest, triage
from auditspan.sources import relations

ROW = "vec_id long, embedding array<double>"


def vectors(spark, x, start=0):
    return spark.createDataFrame([(start + i, v) for i, v in enumerate(x.tolist())], ROW)


@pytest.mark.parametrize("block", [4096, 40])
def test_exact_way_equals_the_search_of_all(spark, block):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 8))
    x = middles[rng.integers(0, 12, 400)] + rng.normal(scale=0.2, size=(400, 8))
    x[:200] = x[0] + rng.normal(scale=0.01, size=(200, 8))  # half of all are in one cell
    x[5:9], x[20] = x[4], 0.0
    q = np.concatenate([middles[rng.integers(0, 12, 60)] + rng.normal(scale=0.5, size=(60, 8)), x[:3], -x[:5], np.zeros((2, 8))])
    sections, asked = vectors(spark, x), vectors(spark, q, 1000)
    want = sorted(map(tuple, triage.nearest_sections(asked, sections).collect()))
    assert sorted(map(tuple, nearest.nearest_by_index(asked, sections, cells=10, probes=2, block=block).collect())) == want
    assert sorted(map(tuple, nearest.nearest_by_index(asked, sections, cells=10, probes=1, sample=12).collect())) == want
    assert sorted(map(tuple, nearest.nearest_by_index(asked, sections, cells=1).collect())) == want


def test_recall_of_the_first_cells(spark, sf_dir):
    sections, asked = relations.vectors(spark, sf_dir)
    exact = triage.nearest_sections(asked, sections)
    assert nearest.recall(nearest.nearest_by_index(asked, sections, exact=False, cells=16, probes=8), exact) >= 0.9
    assert nearest.recall(exact, exact) == 1.0


def test_few_or_no_sections(spark):
    one, none = vectors(spark, np.ones((1, 3))), vectors(spark, np.ones((0, 3)))
    asked = vectors(spark, np.eye(3), 5)
    assert {(r.vec_id, r.section_id) for r in nearest.nearest_by_index(asked, one).collect()} == {(5, 0), (6, 0), (7, 0)}
    assert nearest.nearest_by_index(asked, none).count() == 0 == nearest.nearest_by_index(none, one).count()
    zero = vectors(spark, np.zeros((2, 3)))
    assert {(r.vec_id, r.section_id, r.distance) for r in nearest.nearest_by_index(asked, zero).collect()} == {(i, 0, 1.0) for i in (5, 6, 7)}
