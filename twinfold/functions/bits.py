"""64-bit perceptual hashes as bit patterns of a long: only their bits have meaning, not their order."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex16(x: Column) -> Column:
    """Sixteen lower-case hex digits."""
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def from_bits(n: int, bit) -> Column:
    """A long whose bit i is what ``bit(i)`` says, for i below n (64 at most)."""
    fold = lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", bit(i).cast("bigint"), i))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("bigint"), fold)


def dhash(grid: Column) -> Column:
    """Difference hash of a 9 x 8 luma grid, row by row: bit 8y + x is set where a cell is darker than its right neighbour."""
    at = lambda i: F.floor(i / 8).cast("int") * 9 + i % 8
    return from_bits(64, lambda i: F.get(grid, at(i)) < F.get(grid, at(i) + 1))


def dhash_ring(values: Column, start: int = 0, n: int = 64, ring: int = 64) -> Column:
    """Like ``dhash`` over a ring of ``ring`` values: n bits from ``start`` on."""
    return from_bits(n, lambda i: F.get(values, (i + start) % ring) < F.get(values, (i + start + 1) % ring))


def signed(x: int) -> int:
    """The long with the same 64 bits."""
    return x - (1 << 64) if x >> 63 else x


def ball(mask: int, radius: int) -> list[int]:
    """All patterns of at most ``radius`` bits of the mask, the empty one first."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [sum(c) for r in range(min(len(bits), radius) + 1) for c in combinations(bits, r)]


def chance(agree: list[float], radius: int) -> float:
    """How likely two hashes differ in at most ``radius`` bits, given how likely they agree in each."""
    at = [1.0] + [0.0] * radius
    for q in agree:
        at = [at[k] * q + (at[k - 1] * (1 - q) if k else 0.0) for k in range(radius + 1)]
    return sum(at)


def sliced(agree: dict[int, float], n: int, most: int, probes: int = 2_000) -> tuple[list[int], int]:
    """Masks of the slices to cut ``n`` hashes into, and in how many bits hashes may differ within a slice.

    ``agree`` has, of each bit that varies, how likely two hashes agree in it. Bits are dealt in turns, those that tell most first, and the
    number of slices is that with the fewest probes and candidates together: few wide slices are probed often and
    meet few others by chance, many narrow ones the other way round. Without a bit that varies there is one empty slice.
    """
    order = sorted(agree, key=lambda i: (agree[i], i))
    best = (float("inf"), [0], 0)
    for m in range(1, min(len(order), most + 1) + 1):
        parts, radius = [[] for _ in range(m)], most // m
        for k, i in enumerate(order):
            parts[k % m if k // m % 2 == 0 else m - 1 - k % m].append(i)
        balls = [sum(comb(len(p), k) for k in range(min(len(p), radius) + 1)) for p in parts]
        if max(balls) <= probes:
            cost = n * sum(balls) + n * n / 2 * sum(chance([agree[i] for i in p], radius) for p in parts)
            best = min(best, (cost, [sum(1 << i for i in p) for p in parts], radius))
    return best[1], best[2]
