"""Good-Turing discounts hold where copies make the counts of counts uneven."""

import numpy as np
import pytest

from gridloom.llm import katz


def absolute(n):
    less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [(r - less) / r for r in range(1, katz.KEEP + 1)]


#: The first two: words and pairs of the training rows of /root/testdata/sf0.1.
@pytest.mark.parametrize("n", [[0, 207344, 59772, 25017, 14274, 13493, 7080], [0, 1579638, 246704, 51653, 21705, 18939, 7580], [0, 900, 200, 0, 90, 0, 30], [0, 1000, 100, 90, 20, 15, 14]])
def test_uneven_counts_keep_good_turing(n):
    d = katz.discounts(n)[1:]
    assert all(0 < x < 1 for x in d) and all(np.diff(d) > 0)
    assert not np.allclose(d, absolute(n))


def test_even_counts_are_taken_as_they_are():
    n = [0, 60000, 20000, 10000, 6000, 4000, 2900]
    whole = 6 * n[6] / n[1]
    assert np.allclose(katz.discounts(n)[1:], [((r + 1) * n[r + 1] / (r * n[r]) - whole) / (1 - whole) for r in range(1, 6)])


@pytest.mark.parametrize("n", [[0] * 7, [0, 5, 0, 0, 0, 0, 0], [0, 0, 3, 1, 0, 0, 0], [0, 2, 2, 2, 2, 2, 2]])
def test_degenerate_tables_fall_back(n):
    assert np.allclose(katz.discounts(n)[1:], absolute(n))
