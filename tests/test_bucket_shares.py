"""The split of a bootstrap over its buckets is drawn once for all buckets of a task and changes no weight."""
import numpy as np

from tidepanel.operators import inference


def test_shares_are_drawn_once(monkeypatch):
    sizes, draws = np.array([4, 2, 9]), 50
    want = [np.array(list(inference.unit_weights(sizes, b, draws, 3))) for b in range(3)]
    shares = inference.bucket_shares(sizes, draws, 3)
    assert shares.shape == (draws, 3) and (shares.sum(axis=1) == 15).all()
    seeds, make = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda seed: seeds.append(seed) or make(seed))
    got = [np.array(list(inference.unit_weights(sizes, b, draws, 3, shares))) for b in range(3)]
    assert all((a == b).all() for a, b in zip(got, want)) and [3, 0] not in seeds
