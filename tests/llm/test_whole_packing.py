"""Many tiny pieces are packed as any others."""

import pytest

from ledgerlens.llm import packing


@pytest.mark.parametrize("counts", [{2500: 10, 1: 2000}, {2500: 10, 3: 5000, 1: 1}, {2500: 9, 1700: 3, 7: 400, 1: 3000}])
def test_many_tiny_pieces_beside_long_ones(counts):
    plan = packing.complete(counts, 4096)
    used = {}
    for filling, times in plan.bins:
        assert sum(n * k for n, k in filling) <= 4096
        for n, k in filling:
            used[n] = used.get(n, 0) + times * k
    assert used == counts
    assert plan.proven


def bits(*lengths):
    return sum(1 << n for n in lengths)


def test_fillings_of_many_pieces_of_one_length():
    assert next(packing.fillings({1: 2000}, [1], bits(1), 1596, 4096)) == (0, ((1, 1596),))
    assert next(packing.fillings({3: 5000}, [3], bits(3), 4096, 4096)) == (1, ((3, 1365),))


def test_dominated_fillings_are_left_out():
    """Of room 10 by 7, 5, 3, 3, 2: 7 + 3 and 5 + 3 + 2 fill it, but 5 + 2 can give way to 7."""
    left = {7: 1, 5: 1, 3: 2, 2: 1}
    found = list(packing.fillings(left, [2, 3, 5, 7], bits(2, 3, 5, 7), 10, 10))
    assert [f for f in found if f[1] is not None] == [(0, ((7, 1), (3, 1)))]
    assert {f[0] for f in found} >= {0, 1, 2}
