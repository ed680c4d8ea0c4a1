"""Golden numbers of the E-step, the M-step and the perplexity bound, and properties of the kernel."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.functions import special
from topicloom.operators import kernel

LAM = np.array([[0.22, 0.7, 0.2, 0.3], [0.14, 0.29, 0.5, 0.2], [0.32, 0.43, 0.2, 0.45]])
COUNTS = np.array([5.0, 2.0, 1.0, 8.0])
GAMMA = np.array([0.11, 0.22, 0.11])
THIRD = 1 / 3

# Expected results for the document above.
E_GAMMA = [0.3731066102557286, 0.9383461525508197, 15.688547237193452]
E_SS = [[0.004337997523699932, 0.024578067243257937, 0.001775775187582318, 0.009064515117168562], [0.0032959055127366158, 0.025017135815613923, 0.5590950723373326, 0.01719131457322387], [4.992366096963564, 1.950404796941128, 0.43912915247508516, 7.973744170309609]]
M_LAM = [[0.3972803623230393, 1.6965800010534808, 0.27327901193597176, 0.6688533802521014], [0.2754473254960829, 1.3070105783689454, 23.229391663361104, 0.8996708276963741], [203.36030412227188, 79.75335256242374, 18.068216670222686, 324.7427271499273]]
BOUND = -238735.18879931796


def step(gamma):
    beta = kernel.exp_expectation(LAM)
    gamma, ss, passes = kernel.vb_document(COUNTS, beta, gamma, THIRD, 100, 0.001)
    return gamma, ss * beta, passes


def test_e_step_golden():
    before = GAMMA.copy()
    gamma, ss, passes = step(GAMMA)
    assert passes == 13
    np.testing.assert_allclose(gamma, E_GAMMA, rtol=1e-7)
    np.testing.assert_allclose(ss, E_SS, rtol=1e-7)
    np.testing.assert_array_equal(GAMMA, before)


def test_m_step_golden_from_the_second_e_step():
    gamma, _, _ = step(GAMMA)
    _, ss, passes = step(gamma)
    assert passes == 1
    lam = kernel.m_step(LAM, ss, 1, eta=THIRD, tau=1024, kappa=0.7, total_docs=5220, updates=4)
    np.testing.assert_allclose(lam, M_LAM, rtol=1e-7)


def test_perplexity_golden_after_two_e_steps():
    gamma, _, _ = step(step(GAMMA)[0])
    got = kernel.perplexity_bound([(np.arange(4), COUNTS)], gamma[None], LAM, alpha=THIRD, eta=THIRD, total_docs=5220)
    assert got == pytest.approx(BOUND, rel=1e-10)


def test_compat_m_step_differs_in_eta_and_rate():
    ss = np.ones_like(LAM)
    one = kernel.m_step(LAM, ss, 10, eta=0.5, tau=2, kappa=0.7, total_docs=100, updates=0)
    two = kernel.m_step(LAM, ss, 10, eta=0.5, tau=2, kappa=0.7, total_docs=100, updates=0, compat="distributed")
    rho, rho_d = 2**-0.7, 3**-0.7
    np.testing.assert_allclose(one, (1 - rho) * LAM + rho * (10 + 0.5))
    np.testing.assert_allclose(two, (1 - rho_d) * LAM + rho_d * 10 + 0.5)


def test_empty_document_has_gamma_alpha():
    gamma, ss, passes = kernel.vb_document(np.zeros(0), np.zeros((3, 0)), GAMMA, 0.25, 100, 0.001)
    assert gamma.tolist() == [0.25] * 3 and ss.shape == (3, 0) and passes == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8), st.integers(1, 5), st.integers(0, 10**6))
def test_properties(counts, k, seed):
    rng = np.random.default_rng(seed)
    n = np.array(counts, float)
    lam = rng.gamma(2.0, 1.0, (k, len(n))) + 0.01
    beta = kernel.exp_expectation(lam)
    gamma, ss, _ = kernel.vb_document(n, beta, kernel.start_gamma(1, seed, k), 0.1, 50, 1e-4)
    assert gamma.sum() == pytest.approx(0.1 * k + n.sum(), rel=1e-6)
    assert (ss * beta).sum() == pytest.approx(n.sum(), rel=1e-6)
    assert (kernel.m_step(lam, ss * beta, 1, eta=0.1, tau=1, kappa=0.7, total_docs=10, updates=3) > 0).all()


@settings(max_examples=100, deadline=None)
@given(st.floats(0.01, 1e4))
def test_special_functions(x):
    assert float(special.lgamma(x)) == pytest.approx(math.lgamma(x), rel=1e-9, abs=1e-9)
    assert float(special.digamma(x + 1)) == pytest.approx(float(special.digamma(x)) + 1 / x, rel=1e-9, abs=1e-9)


def test_columns_equal_numpy(spark):
    from pyspark.sql import functions as F

    xs = [0.05, 0.3, 1.0, 2.5, 40.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.digamma_col(F.col("x")), special.lgamma_col(F.col("x"))).collect()
    for x, p, g in rows:
        assert p == pytest.approx(float(special.digamma(x)), abs=1e-10)
        assert g == pytest.approx(math.lgamma(x), abs=1e-10)


def test_log_sum_exp_of_large_numbers(spark):
    from pyspark.sql import functions as F

    (got,) = spark.range(1).select(special.log_sum_exp_col(F.array(F.lit(1000.0), F.lit(1000.0)))).first()
    assert got == pytest.approx(1000 + math.log(2))
    assert float(special.log_sum_exp(np.array([1000.0, 1000.0]))) == pytest.approx(1000 + math.log(2))


def test_gamma_draws_by_counter():
    """Moments and quantiles of Gamma(100, 1/100); whole arrays equal one by one; ids, places, seeds and streams differ."""
    from topicloom.functions.draws import gamma_draws

    m = gamma_draws(7, 0, np.arange(-20000, 20000), 5)
    assert m.mean() == pytest.approx(1.0, abs=1e-3) and m.var() == pytest.approx(0.01, rel=0.02)
    z = (m - 1) / 0.1
    assert (z**3).mean() == pytest.approx(2 / 100**0.5, abs=0.03) and (z**4).mean() == pytest.approx(3 + 6 / 100, abs=0.1)
    want = np.random.default_rng(0).gamma(100, 0.01, 200_000)
    np.testing.assert_allclose(np.quantile(m, [0.01, 0.25, 0.5, 0.75, 0.99]), np.quantile(want, [0.01, 0.25, 0.5, 0.75, 0.99]), atol=3e-3)
    assert np.abs(np.corrcoef(m.T) - np.eye(5)).max() < 0.03 and abs(np.corrcoef(m[1:, 0], m[:-1, 0])[0, 1]) < 0.03
    order = np.random.default_rng(1).permutation(len(m))
    np.testing.assert_array_equal(gamma_draws(7, 0, np.arange(-20000, 20000)[order], 5), m[order])
    np.testing.assert_array_equal(gamma_draws(7, 0, np.array([3]), 5)[0], m[20003])
    assert len(np.unique(m)) == m.size
    for other in (gamma_draws(8, 0, np.arange(5), 5), gamma_draws(7, 1, np.arange(5), 5)):
        assert not np.isin(other, m).any()
    low = gamma_draws(1, 0, np.arange(50000), 1, 1.0, 2.0)  # rejections are frequent
    assert low.mean() == pytest.approx(2, rel=0.02) and low.var() == pytest.approx(4, rel=0.05)
    assert gamma_draws(1, 0, np.zeros(0, np.int64), 3).shape == (0, 3)
    with pytest.raises(ValueError):
        gamma_draws(1, 0, np.arange(2), 1, 0.5)
