"""Neighbouring strings: all of them, whatever they begin with and however long they are, without pairing up all that begin alike."""

import random

import pytest

from cellsift.operators import distances
from cellsift.operators.distances import neighbours
from cellsift.plans.constraints import STRING
from tests import plain


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string")


@pytest.mark.parametrize("k", [1, 2, 9])
def test_neighbours_are_whole_f6(spark, k):
    r, values = random.Random(k), set()
    for begin, letters, longest in (("", "abé", 9), ("", "ab𝄞cdefgh", 60)):
        for _ in range(25):
            value = [r.choice(letters) for _ in range(r.randrange(longest))]
            values.add("n#" + "".join(value))
            for _ in range(k):
                at = r.randrange(len(value) + 1)
                value[at : at + r.randrange(2)] = r.choice(letters) * r.randrange(2)
            values.add("n#" + begin + "".join(value))
    got = [tuple(x) for x in neighbours(keys(spark, values), STRING, k).collect()]
    order = sorted(values, key=str.encode)
    expected = {(a, b, d) for n, a in enumerate(order) for b in order[n:] if (d := plain.edit(a, b)) <= k}
    assert len(got) == len(set(got)) and set(got) == expected


def test_keys_that_begin_alike_are_not_all_paired_up_f6(spark):
    """1,000 numbered names, as s_name has them; all pairs of them are 500,500."""
    names = keys(spark, [f"Supplier#{n:09}" for n in range(1000)])
    assert distances.candidates(names, 1).count() < 100_000 and neighbours(names, STRING, 1.0).count() == 1000 + 1000 * 27 // 2
