import random

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import stats as s


def test_published_vectors():
    assert s.g2_of(10, 1000, 2, 2000) == pytest.approx(12.8349, abs=1e-4)
    assert s.g2_of(2, 2000, 10, 1000) == pytest.approx(-12.8349, abs=1e-4)
    assert s.log_ratio_of(10, 1000, 2, 2000) == pytest.approx(3.0697, abs=1e-4)
    assert s.log_ratio_interval_of(10, 1000, 2, 2000) == pytest.approx((1.0828, 5.0565), abs=1e-4)
    assert s.log_dice_of(5, 20, 30) == pytest.approx(11.6781, abs=1e-4)
    assert s.pmi_of(4, 10, 20, 1000) == pytest.approx(4.3219, abs=1e-4)
    assert s.t_score_of(4, 10, 20, 1000) == pytest.approx(1.9)
    assert s.dp_of([9, 0, 0], [1, 1, 1]) == pytest.approx(2 / 3)
    assert s.dp_norm_of([9, 0, 0], [1, 1, 1]) == pytest.approx(1)
    assert s.dp_of([3, 3, 3], [1, 1, 1]) == 0
    assert s.rate_contrast_of(0, 21, 8, 1923) == -1
    assert s.rate_contrast_of(1, 21, 0, 1923) == 1
    assert s.rate_contrast_of(0, 21, 0, 1923) is None
    assert s.jsd_of([0.9, 0.1], [0.1, 0.9]) == pytest.approx(0.5310, abs=1e-4)
    assert s.jsd_of([1, 0], [0, 1]) == pytest.approx(1)
    assert s.readability_of(500, 100, 10) == pytest.approx(7.12)
    assert s.coleman_liau_of(500, 100, 10) == pytest.approx(10.64)


def test_diversity():
    assert s.mattr_of(list("abab"), 3) == pytest.approx(2 / 3)
    assert s.mtld_of(list("abcd")) == 4
    assert s.mtld_of(list("aaaa")) == 2
    rng = random.Random(5)
    for _ in range(200):
        x, w = [rng.choice("abcdef") for _ in range(rng.randint(1, 30))], rng.randint(1, 12)
        brute = len(set(x)) / len(x) if len(x) <= w else sum(len(set(x[i : i + w])) / w for i in range(len(x) - w + 1)) / (len(x) - w + 1)
        assert s.mattr_of(x, w) == pytest.approx(brute)


def test_columns_agree_with_scalars(spark):
    row = [F.lit(float(x)) for x in (10, 1000, 2, 2000)]
    got = spark.range(1).select(s.g2(*row).alias("g"), s.log_ratio(*row).alias("r"), s.log_ratio_margin(*row).alias("m")).first()
    low, high = s.log_ratio_interval_of(10, 1000, 2, 2000)
    assert (got.g, got.r, got.m) == pytest.approx((s.g2_of(10, 1000, 2, 2000), s.log_ratio_of(10, 1000, 2, 2000), (high - low) / 2))


@pytest.mark.parametrize("bad", [lambda: s.g2_of(3, 2, 0, 1), lambda: s.dp_of([1], [1]), lambda: s.jsd_of([0.5], [1]), lambda: s.readability_of(1, 2, 1)])
def test_refusals(bad):
    with pytest.raises(ValueError):
        bad()
