"""What the README says of how often one-deletion neighbourhoods are the cheaper choice."""

import pytest

from skeinlake.llm.ngram_join import allocation, bands


@pytest.mark.parametrize(("percent", "sets", "with_deletions", "of"), [(90, 10**3, 0, 75), (90, 10**6, 0, 75), (90, 10**8, 3, 75), (80, 10**3, 2, 39), (80, 10**5, 4, 39), (80, 10**6, 17, 39)])
def test_bands_with_deletions(percent, sets, with_deletions, of):
    lows = bands(percent, 5000)
    taken = [allocation(percent, int(a), int(b) - 1, sets)[1] for a, b in zip(lows, lows[1:], strict=False)]
    assert (sum(d > 0 for d in taken), len(taken)) == (with_deletions, of)
