"""The replay in order against a walk over one item after another."""

import pytest

from tidewire.operators import replay

from .test_upkeep import distance, items


def walk(rows, cut, most=None):
    own = sorted((r for r in rows if r[5] is not None), key=lambda r: r[0])
    event = {}
    near = {r[0]: sorted((distance(r[2], o[2]), o[0]) for o in own if o[0] != r[0] and abs((o[1] - r[1]).total_seconds()) <= 72 * 3600) for r in own}
    for r in own[:most]:
        if r[0] in event:
            continue
        hits = [o for d, o in near[r[0]] if d <= cut]
        there, free = [o for o in hits if o in event], [o for o in hits if o not in event]
        if there:
            event[r[0]] = event[there[0]]
        else:
            event[r[0]] = r[0]
            if free:
                event[free[0]] = r[0]
    return sorted(event.items())


@pytest.mark.parametrize(("seed", "cut", "equal", "block"), [(1, 0.2, False, 1024), (2, 0.35, False, 7), (3, 0.1, True, 1024), (4, 0.6, False, 16), (5, 0.05, True, 9)])
def test_one_after_another(spark, seed, cut, equal, block):
    rows, df = items(spark, 110, seed, equal)
    want = walk(rows, cut)
    got = sorted(map(tuple, replay.in_order(df, cut, block=block).collect()))
    assert got == want and len({c for _, c in want}) < len(want)
    for most in (1, 30):
        assert sorted(map(tuple, replay.in_order(df, cut, most=most, block=block).collect())) == walk(rows, cut, most)
    if seed == 1:
        assert replay.in_order(df.limit(0)).count() == 0
