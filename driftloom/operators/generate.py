"""Generation: a table specification becomes one projection over row ids.

Every field is an expression of ``(seed, field, row id)``; a batch is a range of row
ids.  Catalyst prunes fields nobody reads and the whole projection is one codegen stage
with no shuffle, so the throughput scales with the number of cores.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import pools, rng
from driftloom.functions.scalars import MICROS_PER_SECOND, clip, micros_value, ntz_of
from driftloom.schema import FieldSpec, SpecError, TableSpec
from driftloom.session import small_methods

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Draws:
    """Keyed draws of one field; custom field types get one of these."""

    seed: int
    field: str
    row_id: str

    def uniform(self, purpose: str = "value") -> Column:
        return rng.uniform(self.seed, self.field, purpose, self.row_id)

    def normal(self, purpose: str = "value") -> Column:
        return rng.normal(self.seed, self.field, purpose, self.row_id)

    def integer(self, low: int, high: int, purpose: str = "value") -> Column:
        """Uniform integer in [low, high], both ends included."""
        return F.lit(low) + F.floor(self.uniform(purpose) * F.lit(float(high - low + 1))).cast("long")

    def indices(self, *sizes: int, purpose: str = "value") -> list[Column]:
        """Independent positions in pools of these sizes, out of one draw."""
        return rng.indices(self.seed, self.field, purpose, sizes, self.row_id)


def literal_array(values: Sequence[Any]) -> Column:
    """Constant array; text goes through one parsed expression (cheaper to build than many columns)."""
    if all(isinstance(v, str) for v in values):
        quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
        return F.expr(f"array({quoted})")
    return F.array(*[F.lit(v) for v in values])


def element(values: Sequence[Any], position: Column) -> Column:
    """Zero-based pick from a literal array."""
    return F.element_at(literal_array(values), (position + 1).cast("int"))


def cumulative(probabilities: list[float]) -> list[float]:
    """Upper edges of the inverse distribution function, without the last (always 1)."""
    total = sum(probabilities)
    return [edge / total for edge in accumulate(probabilities)][:-1]


def choose(values: list[Any], edges: Iterable[float | Column], u: Column) -> Column:
    """Weighted choice without branches: the position is the number of edges at or below ``u``."""
    position = F.lit(0)
    for edge in edges:
        position = position + (u >= edge).cast("int")
    return element(values, position)


# --- field types -------------------------------------------------------------

FieldType = Callable[[FieldSpec, Draws], Column]


def _float(spec: FieldSpec, draws: Draws) -> Column:
    value = F.lit(spec.mean) + F.lit(spec.std) * draws.normal()
    return clip(value, *(None if b is None else float(b) for b in (spec.low, spec.high)))


def _int(spec: FieldSpec, draws: Draws) -> Column:
    return draws.integer(*spec.int_range)


def _category(spec: FieldSpec, draws: Draws) -> Column:
    return choose(spec.categories, cumulative(spec.probabilities), draws.uniform())


def _datetime(spec: FieldSpec, draws: Draws) -> Column:
    start, end = (micros_value(value) for value in spec.dates)
    return ntz_of(F.lit(start) + F.floor(draws.uniform() * F.lit(end - start)).cast("long"))


def _name(spec: FieldSpec, draws: Draws) -> Column:
    first, last = draws.indices(len(pools.FIRST_NAMES), len(pools.LAST_NAMES))
    return F.concat_ws(" ", element(pools.FIRST_NAMES, first), element(pools.LAST_NAMES, last))


def _email(spec: FieldSpec, draws: Draws) -> Column:
    sizes = (len(pools.FIRST_NAMES), len(pools.LAST_NAMES), 9999, len(pools.MAIL_DOMAINS))
    first, last, number, domain = draws.indices(*sizes)
    return F.concat(
        element([n.lower() for n in pools.FIRST_NAMES], first),
        F.lit("."),
        element([n.lower() for n in pools.LAST_NAMES], last),
        (number + 1).cast("string"),
        F.lit("@"),
        element(pools.MAIL_DOMAINS, domain),
    )


def _address(spec: FieldSpec, draws: Draws) -> Column:
    sizes = (9999, len(pools.STREETS), len(pools.CITIES), len(pools.STATES), 99999)
    number, street, city, state, code = draws.indices(*sizes)
    return F.concat(
        (number + 1).cast("string"),
        F.lit(" "),
        element(pools.STREETS, street),
        F.lit(", "),
        element(pools.CITIES, city),
        F.lit(", "),
        element(pools.STATES, state),
        F.lit(" "),
        F.lpad((code + 1).cast("string"), 5, "0"),
    )


FIELD_TYPES: dict[str, FieldType] = {
    "float": _float,
    "int": _int,
    "category": _category,
    "datetime": _datetime,
    "name": _name,
    "email": _email,
    "address": _address,
}


def register_field_type(kind: str, build: FieldType) -> None:
    """Add a field type: ``build(spec, draws)`` returns the column expression."""
    FIELD_TYPES[kind] = build


def field_column(spec: FieldSpec, seed: int, row_id: str) -> Column:
    build = FIELD_TYPES.get(spec.kind)
    if build is None:
        log.warning("unknown field type %r of field %r: column of nulls", spec.kind, spec.name)
        return F.lit(None).cast("string")
    return build(spec, Draws(seed, spec.name, row_id))


# --- tables and series -------------------------------------------------------


def row_ids(spark: SparkSession, size: int, start: int = 0, partitions: int | None = None) -> DataFrame:
    """Row ids ``start .. start + size - 1``."""
    return spark.range(start, start + size, 1, partitions).withColumnRenamed("id", "row_id")


def generate(ids: DataFrame, spec: TableSpec, row_id: str = "row_id", keep: Iterable[str] = ()) -> DataFrame:
    """One generated row per input row, fields in the order of the specification."""
    small_methods(ids.sparkSession)
    return ids.select(*keep, *[field_column(f, spec.seed, row_id).alias(f.name) for f in spec.fields])


def generate_series(
    ids: DataFrame,
    spec: TableSpec,
    start: Any,
    batch_size: int,
    row_id: str = "row_id",
    keep: Iterable[str] = (),
    continuous: bool = False,
) -> DataFrame:
    """Generated rows on a time grid, with trend and seasonality on the numeric fields.

    A trend runs from 0 to its strength inside each batch of ``batch_size`` rows and starts
    over with the next one; ``continuous=True`` lets it run on.  The time of a row follows
    from its id, so batches join seamlessly without any state.
    """
    small_methods(ids.sparkSession)
    rid = F.col(row_id)
    micros = F.lit(micros_value(start)) + rid * F.lit(spec.interval_us)
    columns = {}
    for f in spec.fields:
        value = field_column(f, spec.seed, row_id)
        if f.kind in ("float", "int") and f.name != spec.time_field:
            if f.name in spec.trends:
                value = with_trend(value, spec.trends[f.name], rid, batch_size, continuous)
            if f.name in spec.seasonality:
                value = with_season(value, spec.seasonality[f.name], micros)
        columns[f.name] = value
    columns[spec.time_field or "timestamp"] = ntz_of(micros)
    return ids.select(*keep, *[value.alias(name) for name, value in columns.items()])


def with_trend(
    value: Column, trend: Mapping[str, Any], row_id: Column, batch_size: int, continuous: bool = False
) -> Column:
    """Linear (added) or exponential (multiplied) trend along the position in the batch."""
    strength = float(trend.get("strength", 0.1))
    position = row_id if continuous else row_id % F.lit(batch_size)
    progress = F.lit(strength) * position / F.lit(float(batch_size - 1)) if batch_size > 1 else F.lit(0.0)
    kind = trend.get("type", "linear")
    if kind == "linear":
        return value + progress
    if kind == "exponential":
        return value * F.exp(progress)
    return value


def with_season(value: Column, season: Mapping[str, Any], micros: Column) -> Column:
    """Sine of the absolute time with a period in hours."""
    period = float(season.get("period", 24)) * 3600.0
    amplitude = float(season.get("amplitude", 0.1))
    seconds = micros / F.lit(float(MICROS_PER_SECOND))
    return value + F.lit(amplitude) * F.sin(F.lit(2.0 * 3.141592653589793) * seconds / F.lit(period))


# --- several generators ------------------------------------------------------


@dataclass
class GeneratorSet:
    """Named specifications that produce batches together."""

    specs: dict[str, TableSpec] = field(default_factory=dict)
    start: Any = "2024-01-01"

    def add(self, spec: TableSpec) -> None:
        self.specs[spec.name] = spec

    def remove(self, name: str) -> None:
        self.specs.pop(name, None)

    def set_seed(self, seed: int) -> None:
        self.specs = {name: replace(spec, seed=seed) for name, spec in self.specs.items()}

    def batch(self, ids: DataFrame, batch_size: int, name: str | None = None, row_id: str = "row_id",
              keep: Iterable[str] = ()) -> dict[str, DataFrame]:
        """One DataFrame per generator; an unknown name gives none, a broken one is skipped."""
        if name is not None and name not in self.specs:
            log.error("no generator named %r", name)
            return {}
        chosen = self.specs if name is None else {name: self.specs[name]}
        frames = {}
        for key, spec in chosen.items():
            try:
                if spec.time_field is None:
                    frames[key] = generate(ids, spec, row_id, keep)
                else:
                    frames[key] = generate_series(ids, spec, self.start, batch_size, row_id, keep)
            except (SpecError, ValueError, TypeError) as error:
                log.error("generator %r skipped: %s", key, error)
        return frames


def stamp(df: DataFrame, generator: str, emitted_at: Column | None = None) -> DataFrame:
    """Provenance: the generator name and the emit time, next to (never over) the event time."""
    emitted = F.current_timestamp() if emitted_at is None else emitted_at
    return df.withColumns({"generator": F.lit(generator), "emitted_at": emitted})


def union_batches(frames: Mapping[str, DataFrame]) -> DataFrame:
    """All batches in one frame; columns a generator lacks are null."""
    merged = None
    for name, frame in frames.items():
        tagged = frame.withColumn("generator", F.lit(name))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    if merged is None:
        raise SpecError("no batches to unite")
    return merged
