"""What one task holds of a model."""
import numpy as np

from tidepanel.operators import boosting as b


def made(n):
    r = np.random.default_rng(1)
    x = r.normal(size=(n, 5))
    return b.order_key(x), x[:, 0] * x[:, 1] + r.normal(size=n)


def test_packed_rows_are_let_go():
    keys, y = made(3000)
    blocks = [b._block(keys[i:i + 1000], np.round(y[i:i + 1000] * b.UNIT), None) for i in range(0, 3000, 1000)]
    assert sum(len(c) for block in blocks for c in block[0]) + sum(len(block[1]) for block in blocks) == 3000 * (5 * 3 + 4)
    assert b.fit_blocks(blocks, b.Boost(rounds=2)) == b.fit_one(keys, y, b.Boost(rounds=2)) and not blocks


def test_rows_of_a_task_are_as_small_as_its_limit_assumes():
    keys, y = made(200_000)
    held, boost = [], b._boost

    def watched(rows, s):
        out = boost(rows, s)
        arrays = {id(a): a.nbytes for a in [rows.fitted, rows.gradient, rows.whole, rows.leaf, *rows.columns, *rows.lists.values(), *(g.codes for g in rows.groups)]}
        held.append(sum(arrays.values()))
        return out

    b._boost = watched
    try:
        b.fit_one(keys, y, b.Boost(rounds=2))
    finally:
        b._boost = boost
    assert held[0] <= 200_000 * (b.ROW_BYTES + b.CELL_BYTES * 5)
    assert b.TASK_BYTES // (b.ROW_BYTES + b.CELL_BYTES * 8) > 45_000_000  # the one model of fit_residual_boosted at 6 GB
