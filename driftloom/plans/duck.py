"""DuckDB text of the keyed draws, for the oracles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from driftloom.functions.rng import MASK, MIX_MULTIPLIERS, word_key

PI2 = "6.283185307179586::DOUBLE"


def num(value: float) -> str:
    return f"{float(value)!r}::DOUBLE"


def rounded(value: str, digits: int = 6) -> str:
    """Round without a negative zero (Spark has none)."""
    return f"(round({value}, {digits}) + 0.0::DOUBLE)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values: Sequence[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def _word(seed: int, field: str, purpose: str, word: int, ids: Sequence[str]) -> str:
    base, multipliers = word_key(seed, field, purpose, word, len(ids))
    terms = [str(base)]
    for i, (a, b) in zip(ids, multipliers):
        terms.append(f"((({i})::BIGINT & {MASK}) * {a} & {MASK}) + (((({i})::BIGINT >> 32) & {MASK}) * {b} & {MASK})")
    x = f"(({' + '.join(terms)})::BIGINT & {MASK})"
    x = f"(xor({x}, {x} >> 16) * {MIX_MULTIPLIERS[0]} & {MASK})"
    return f"(xor({x}, {x} >> 15) * {MIX_MULTIPLIERS[1]} & {MASK})"


def uniform(seed: int, field: str, purpose: str, *ids: str) -> str:
    high, low = (_word(seed, field, purpose, w, ids) for w in (0, 1))
    return f"(({high} * 2097152 + ({low} >> 11))::DOUBLE / 9007199254740992.0::DOUBLE)"


def normal(seed: int, field: str, purpose: str, *ids: str) -> str:
    u, angle = uniform(seed, field, purpose, *ids), _word(seed, field, purpose + "/angle", 0, ids)
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u})) * cos({PI2} * ({angle}::DOUBLE / 4294967296.0::DOUBLE)))"


def integer(seed: int, field: str, low: int, high: int, *ids: str, purpose: str = "value") -> str:
    return f"({low} + floor({uniform(seed, field, purpose, *ids)} * {high - low + 1})::BIGINT)"


def indices(seed: int, field: str, purpose: str, sizes: Sequence[int], *ids: str) -> list[str]:
    """Zero-based positions that share one draw."""
    whole = f"floor({uniform(seed, field, purpose, *ids)} * {math.prod(sizes)}::DOUBLE)::BIGINT"
    return [f"(({whole}) // {math.prod(sizes[:k])} % {n})" for k, n in enumerate(sizes)]


def pick(pool: Sequence[str], position: str) -> str:
    return f"({texts(pool)})[1 + {position}]"


def clipped(value: str, low: float | None, high: float | None) -> str:
    """CASE form of a clip; ``value`` should be a plain column name."""
    branches = []
    if low is not None:
        branches.append(f"WHEN {value} < {num(low)} THEN {num(low)}")
    if high is not None:
        branches.append(f"WHEN {value} > {num(high)} THEN {num(high)}")
    return f"CASE {' '.join(branches)} ELSE {value} END" if branches else value


def weighted(u: str, values: Sequence[str], edges: Sequence[str]) -> str:
    """CASE form of a weighted choice; ``u`` should be a plain column name."""
    if not edges:
        return values[-1]
    branches = " ".join(f"WHEN {u} < {edge} THEN {value}" for value, edge in zip(values, edges))
    return f"CASE {branches} ELSE {values[-1]} END"


def text_id(value: str) -> str:
    return f"(('0x' || substr(md5({value}), 1, 15))::BIGINT)"
