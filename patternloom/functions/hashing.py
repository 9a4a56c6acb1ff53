"""Counter-based randomness as plain SQL expressions.

Every random decision is a hash of its coordinates (seed, generation, step, rule,
variable, ...), so results depend neither on row order nor on the number of partitions,
and any SQL engine can recompute them. Parts are Python numbers, or SQL text such as a
column name; a constant word is written with quotes inside, ``"'mut'"``.
"""

from __future__ import annotations

RANDOM_BITS = 60


def _key(parts) -> str:
    texts = [p if isinstance(p, str) else f"'{p}'" for p in parts]
    return f"md5(concat_ws('|', {', '.join(f'cast({t} as string)' for t in texts)}))"


def uniform(*parts) -> str:
    """Number in [0, 1) with 32 random bits."""
    return f"(cast(conv(substring({_key(parts)}, 1, 8), 16, 10) as bigint) / 4294967296D)"


def pick(n, *parts) -> str:
    """Integer in 0..n-1, ``n`` a number or SQL text."""
    return f"cast(floor({uniform(*parts)} * {n}) as int)"


def random_bits(*parts) -> str:
    """Bigint holding 60 random bits."""
    return f"cast(conv(substring({_key(parts)}, 1, 15), 16, 10) as bigint)"
