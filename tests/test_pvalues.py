"""Tail probabilities at the sizes that a cluster's tables give."""

import math

import pytest

from vistrata.functions import pvalues


@pytest.mark.parametrize("df", [1e6, 1e9, 1e11, 1e12])
def test_t_tends_to_normal(df):
    assert pvalues.t_two_sided(1.959963984540054, df) == pytest.approx(0.05, rel=1e-5)
    assert pvalues.f_upper(1.959963984540054 ** 2, 1, df) == pytest.approx(0.05, rel=1e-5)


@pytest.mark.parametrize("tail", [pvalues.t_two_sided, pvalues.chi2_upper])
def test_no_step_where_the_form_changes(tail):
    at = [2.0, 2.0] if tail is pvalues.t_two_sided else [200_600.0, 200_604.0]
    assert tail(at[0], 199_998) == pytest.approx(tail(at[1], 200_002), rel=1e-3)


def test_chi_square_of_many_degrees():
    dof = 3.6e9
    z = ((1.0 + 1.6448536 * math.sqrt(2 / dof)) ** (1 / 3) - 1 + 2 / (9 * dof)) / math.sqrt(
        2 / (9 * dof))
    normal = 0.5 * math.erfc(z / math.sqrt(2))
    assert pvalues.chi2_upper(dof + 1.6448536 * math.sqrt(2 * dof), dof) == pytest.approx(
        normal, abs=1e-6)
