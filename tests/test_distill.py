"""Argument checks of the distillation loss."""

import pytest

from vaksetu.operators.vocabulary import distill


@pytest.mark.parametrize(
    "bad",
    [
        {"teacher": "t"},
        {"keep_ids": [2, 0], "teacher": "t"},
        {"keep_ids": [0, 2]},
        {"keep_ids": [0, 2], "topk": "k"},
    ],
)
def test_refused(bad):
    with pytest.raises(ValueError):
        distill(None, True, **bad)


def test_without_kl(spark):
    rows = spark.createDataFrame([([0.0, 0.0], 1), ([5.0, 0.0], -100)], "student array<double>, label int")
    (r,) = distill(rows).collect()
    assert r.kl is None and round(r.loss, 6) == round(r.ce, 6) == 0.693147
