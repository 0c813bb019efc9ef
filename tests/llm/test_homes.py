import numpy as np
import pytest

from gridloom.llm import jaccard


@pytest.mark.parametrize("ranges", [1, 7, 65_536, 65_537, 1_000_000, 2**31 - 1])
def test_homes_rise_with_the_keys(ranges):
    key = np.linspace(0, 2**jaccard._KEY_BITS - 1, 10_001).astype(np.uint64)
    home = jaccard._homes(key, ranges)
    assert (np.diff(home) >= 0).all() and home[0] == 0 and home[-1] == ranges - 1
