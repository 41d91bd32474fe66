"""What must hold of sizes, weights and shares, whatever way they are found."""

import pytest

def are_capped_shares(values, shares, cap):
    """Shares of one, none above the cap, those below it in proportion to their positive values."""
    positive = [v for v in values if v > 0]
    if not positive:
        assert not any(shares)
        return
    cap = max(cap, 1 / len(positive))
    assert sum(shares) == pytest.approx(1) and max(shares) <= cap + 1e-9
    assert all(s == 0 for v, s in zip(values, shares, strict=True) if v <= 0)
    free = [s / v for v, s in zip(values, shares, strict=True) if v > 0 and s < cap - 1e-9]
    assert free == pytest.approx([free[0]] * len(free) if free else [])
    level = free[0] if free else 0.0
    assert all(v * level >= cap - 1e-9 for v, s in zip(values, shares, strict=True) if v > 0 and s >= cap - 1e-9) or not free


def is_fold(fills, rows):
    """(units, quantity, average) after each (side, qty, price): sells stop at zero and keep the average, buys keep the cost."""
    qty, avg = 0, 0.0
    for (side, n, price), (units, qty_after, avg_after) in zip(fills, rows, strict=True):
        if side == "BUY":
            assert units == n and qty_after == qty + n
            assert avg_after * qty_after == pytest.approx(avg * qty + n * price, rel=1e-9)
        else:
            assert units == min(n, qty) and qty_after == qty - units and avg_after == avg
        qty, avg = qty_after, avg_after
