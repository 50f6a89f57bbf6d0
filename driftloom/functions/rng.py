"""Keyed, stateless randomness as plain integer column arithmetic.

A draw is a pure function of ``(seed, field, purpose, ids)``.  Nothing depends on
partitioning, task order or retries, so a lost executor recomputes the same rows
and a streaming replay emits the same batch.  Everything below is 64-bit integer
arithmetic that stays inside whole-stage code generation: no strings, no digests
and no Python per row.

Construction of one 32-bit word::

    x = (low_1 * a_1 & M) + (high_1 * b_1 & M) + (low_2 * a_2 & M) + ... + k   (masked to 32 bits)
    x = mix(x)

``low`` and ``high`` are the two halves of a 64-bit id; ``a_i``, ``b_i`` and ``k`` are derived
on the driver from an md5 of the textual key and differ between the two words of a uniform, so
all 64 bits of an id reach both words.  Two words make the 53 bits of a double in ``[0, 1)``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit mask and the two mixing multipliers (below 2**31, so that a product with
# a 32-bit value fits a long).
MASK = 0xFFFFFFFF
MIX_MULTIPLIERS = (0x7FEB352D, 0x45D9F3B)
TWO_53 = 9007199254740992.0
TWO_32 = 4294967296.0


def word_key(seed: int, field: str, purpose: str, word: int, n_ids: int) -> tuple[int, list[tuple[int, int]]]:
    """Additive constant, and odd multipliers of both halves of every id, for one word of a draw."""
    text = f"{seed}|{field}|{purpose}|{word}"
    digest = hashlib.md5(text.encode()).digest()
    base = int.from_bytes(digest[:4], "big")
    multipliers = []
    for position in range(n_ids):
        part = hashlib.md5(f"{text}|{position}".encode()).digest()
        multipliers.append(tuple((int.from_bytes(part[i : i + 4], "big") >> 1) | 1 for i in (0, 4)))
    return base, multipliers


# --- column form -------------------------------------------------------------
#
# Expressions are built as SQL text: one parse per draw instead of dozens of Column calls.
# An id is a column name, a SQL expression or an integer.


def _mix(x: str) -> str:
    x = f"((({x}) ^ (({x}) >> 16)) * {MIX_MULTIPLIERS[0]}L & {MASK}L)"
    return f"(({x} ^ ({x} >> 15)) * {MIX_MULTIPLIERS[1]}L & {MASK}L)"


def _word(seed: int, field: str, purpose: str, word: int, ids: Sequence[str | int]) -> str:
    base, multipliers = word_key(seed, field, purpose, word, len(ids))
    # A missing id counts as 0; without nulls the generated code is half as long.
    terms = []
    for i, (a, b) in zip(ids, multipliers):
        value = f"coalesce(cast({i} as bigint), 0L)"
        terms.append(f"(({value} & {MASK}L) * {a}L & {MASK}L) + (({value} >>> 32) * {b}L & {MASK}L)")
    return _mix(f"({' + '.join([f'{base}L', *terms])}) & {MASK}L")


def uniform_sql(seed: int, field: str, purpose: str, *ids: str | int) -> str:
    high, low = (_word(seed, field, purpose, word, ids) for word in (0, 1))
    return f"((({high} * 2097152L) + ({low} >> 11)) / {TWO_53!r}D)"


def uniform(seed: int, field: str, purpose: str, *ids: str | int) -> Column:
    """Uniform double in [0, 1), a function of the key and the integer ids."""
    return F.expr(uniform_sql(seed, field, purpose, *ids))


def normal_sql(seed: int, field: str, purpose: str, *ids: str | int) -> str:
    u = uniform_sql(seed, field, purpose, *ids)
    angle = _word(seed, field, purpose + "/angle", 0, ids)
    turn = f"({2.0 * math.pi!r}D * ({angle} / {TWO_32!r}D))"
    return f"(sqrt(-2.0D * ln(1.0D - {u})) * cos({turn}))"


def normal(seed: int, field: str, purpose: str, *ids: str | int) -> Column:
    """Standard normal double by the Box-Muller transform; the angle takes one 32-bit word."""
    return F.expr(normal_sql(seed, field, purpose, *ids))


def indices(seed: int, field: str, purpose: str, sizes: Sequence[int], *ids: str | int) -> list[Column]:
    """Independent uniform integers in [0, n) for every n of ``sizes``, out of one draw.

    The product of the sizes must stay well below 2**53.
    """
    whole = F.expr(f"cast(floor({uniform_sql(seed, field, purpose, *ids)} * {math.prod(sizes)}D) as bigint)")
    parts, step = [], 1
    for n in sizes:
        rest = whole if step == 1 else F.floor(whole / F.lit(float(step))).cast("long")
        parts.append(rest % F.lit(n))
        step *= n
    return parts


def text_id(column: str) -> str:
    """Stable non-negative integer id of a string key, as an id for the draws."""
    return f"cast(conv(substring(md5(cast({column} as string)), 1, 15), 16, 10) as bigint)"


# --- the same draw for driver literals ---------------------------------------


def _mix_value(x: int) -> int:
    x = ((x ^ (x >> 16)) * MIX_MULTIPLIERS[0]) & MASK
    return ((x ^ (x >> 15)) * MIX_MULTIPLIERS[1]) & MASK


def _word_value(seed: int, field: str, purpose: str, word: int, ids: Sequence[int]) -> int:
    x, multipliers = word_key(seed, field, purpose, word, len(ids))
    for value, multiplier in zip(ids, multipliers):
        low, high = int(value) & MASK, (int(value) >> 32) & MASK
        x += ((low * multiplier[0]) & MASK) + ((high * multiplier[1]) & MASK)
    return _mix_value(x & MASK)


def uniform_value(seed: int, field: str, purpose: str, *ids: int) -> float:
    """Driver-side value of :func:`uniform` for literal ids."""
    high, low = (_word_value(seed, field, purpose, word, ids) for word in (0, 1))
    return (high * 2097152 + (low >> 11)) / TWO_53


def normal_value(seed: int, field: str, purpose: str, *ids: int) -> float:
    """Driver-side value of :func:`normal` for literal ids."""
    u = uniform_value(seed, field, purpose, *ids)
    turn = 2.0 * math.pi * (_word_value(seed, field, purpose + "/angle", 0, ids) / TWO_32)
    return math.sqrt(-2.0 * math.log(1.0 - u)) * math.cos(turn)
