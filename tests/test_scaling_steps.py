"""CLU-9 of many contact sets: rounds that go through each pair of points once, against the plain formula, and what they make again."""

import numpy as np
import pytest

from chainlake.operators import clusters as cl
from chainlake.plans import structures


def sets_of(seed, n=150, cells=24):
    rng = np.random.default_rng(seed)
    made = sorted({tuple(np.flatnonzero(rng.random(cells) < rng.choice([0.3, 0.6]))) for _ in range(n)})
    made = [np.array(c) for c in made if len(c) >= 3]
    return cl.ContactSets(made), rng.integers(1, 6, len(made)).astype(float)


def plain_step(distance, x, w):
    gap = x[:, None] - x[None]
    d = np.sqrt((gap**2).sum(axis=2))
    ratio = np.where(d > 1e-12, distance / np.maximum(d, 1e-12), 0)
    return w @ ((d - distance) ** 2 @ w) / 2, (gap * (ratio * w)[:, :, None]).sum(axis=1) / w.sum()


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("held_mb", [0, 200])
@pytest.mark.parametrize("wide", [7, 2048])
def test_steps_by_blocks(seed, held_mb, wide):
    sets, w = sets_of(seed)
    dense = sets.dense()
    x = np.random.default_rng(seed).random((len(sets), 2)) + 3
    for places in (x, np.where(np.arange(len(x))[:, None] % 5 == 0, x[:1], x)):  # the second has equal ones
        stress, better = plain_step(dense, places, w)
        for made in (sets, dense):
            blocks = cl.PairBlocks(made, w, held_mb=held_mb, high=16, wide=wide)
            assert len(blocks.held) == (0 if held_mb == 0 else -(-len(w) // 16))
            got = blocks.step(places)
            assert abs(got[0] - stress) < 1e-9 * stress and np.allclose(got[1], better, atol=1e-12)
        several = cl.stress_steps(dense, np.stack([places, x]), w)
        assert abs(several[0][0] - stress) < 1e-9 * stress and np.allclose(several[1][0], better, atol=1e-12)


def test_starts_together_or_one_by_one():
    sets, w = sets_of(4, 40)
    one, some, all_ = (cl.smacof_starts(sets, range(4), rounds=60, weights=w, room=room) for room in (0, len(sets) ** 2, 1 << 17))
    for a, b, c in zip(one, some, all_, strict=True):
        assert np.allclose(a[0], b[0], atol=1e-8) and np.allclose(b[0], c[0], atol=1e-8)
        assert np.allclose(a[1:], b[1:]) and np.allclose(b[1:], c[1:])


def test_distances_are_not_made_again_every_round(monkeypatch):
    sets, w = sets_of(6, 520)
    assert len(sets) > 363  # too many for whole matrices of the starts
    made, row = [0], cl.ContactSets.row

    def counted(self, *at):
        made[0] += 1
        return row(self, *at)

    monkeypatch.setattr(cl.ContactSets, "row", counted)
    cl.classical_scaling(sets, 2, w, signed=False)
    first = made[0]
    cl.smacof(sets, starts=1, rounds=20, eps=0, weights=w)
    assert made[0] - 2 * first <= 2 * len(sets)


def test_starts_in_tasks_of_their_own(spark):
    keys = ["a", "b", "matrix_id"]
    one, own = (structures.clu_9(spark, "/root/testdata/sf0.001", large=large).toPandas().sort_values(keys) for large in (10**6, 2))
    assert len(one) > 0 and one[keys].to_numpy().tolist() == own[keys].to_numpy().tolist()
    assert np.allclose(one[["x", "y", "stress"]], own[["x", "y", "stress"]], atol=1e-4)
