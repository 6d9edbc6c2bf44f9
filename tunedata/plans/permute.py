"""A keyed permutation of dense positions: order per epoch without a sort per epoch.

Rows are ranked once (:mod:`tunedata.plans.rank`); where a row stands in epoch ``e`` then follows from
its rank alone. The permutation is the swap-or-not shuffle (Hoang, Morris, Rogaway 2012): in a round
with the constant ``k`` the positions ``x`` and ``(k - x) mod n`` are partners, and a pair changes places
if a keyed bit of its larger member says so. A round undoes itself, so the shuffle is a
bijection of ``0 .. n-1`` for any ``n`` (no rounding up of the domain), and the rounds in reverse give
the rank that stands at a position.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 128
PRIME = (1 << 31) - 1


def round_constants(key: str, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """``(k, a, b)`` of each round from the hex digits 1-15, 16-22 and 23-29 of ``md5('{key}|{round}')``."""
    out = []
    for i in range(rounds):
        h = hashlib.md5(f"{key}|{i}".encode()).hexdigest()
        out.append((int(h[:15], 16), int(h[15:22], 16), int(h[22:29], 16)))
    return out


def permuted(pos: Column | str, n: Column | int, key: str, *, inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """The place of the 0-based position ``pos`` among ``n`` under ``key``; with ``inverse`` the position
    that this place came from. NULL for a NULL or a position outside ``0 .. n-1``."""
    x = (F.col(pos) if isinstance(pos, str) else pos).cast("bigint")
    n = (F.lit(n) if isinstance(n, int) else n).cast("bigint")
    constants = round_constants(key, rounds)
    if inverse:
        constants.reverse()
    big = lambda v: F.lit(v).cast("bigint")
    steps = F.array(*[F.struct(big(k).alias("k"), big(a).alias("a"), big(b).alias("b")) for k, a, b in constants])

    def step(x: Column, r: Column) -> Column:
        partner = (r["k"] % n + n - x) % n
        bit = ((F.greatest(x, partner) % PRIME) * (r["a"] + 1) + r["b"]) % PRIME
        return F.when(bit < PRIME // 2, partner).otherwise(x)

    return F.when((x >= 0) & (x < n), F.aggregate(steps, x, step))
