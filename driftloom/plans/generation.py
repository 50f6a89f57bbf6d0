"""Queries: generated tables and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import pools
from driftloom.functions.scalars import micros_of, micros_value
from driftloom.operators import generate as g
from driftloom.plans import duck
from driftloom.plans.tables import query, table
from driftloom.schema import (
    CUSTOMER_SCHEMA,
    PRESET_SERIES,
    PRESET_TABULAR,
    TRANSACTION_SCHEMA,
    TableSpec,
)

SEED = 42
PRESET = TableSpec.of("preset", PRESET_TABULAR)
SERIES = TableSpec.of("series", PRESET_SERIES)
CUSTOMERS = TableSpec.of("customer_profiles", CUSTOMER_SCHEMA)
TRANSACTIONS = TableSpec.of("transactions", TRANSACTION_SCHEMA)
START, BATCH = "2024-01-01", 1000
START_US = micros_value(START)


# --- oracle fragments --------------------------------------------------------


def duck_float(f, rid, seed=SEED):
    """(inner column, outer expression) of a float field."""
    inner = f"{duck.num(f.mean)} + {duck.num(f.std)} * {duck.normal(seed, f.name, 'value', rid)}"
    return inner, duck.clipped(f"_{f.name}", f.low, f.high)


def duck_category(f, rid, seed=SEED):
    values = [duck.text(c) if isinstance(c, str) else str(c).lower() for c in f.categories]
    edges = [duck.num(e) for e in g.cumulative(f.probabilities)]
    return duck.uniform(seed, f.name, "value", rid), duck.weighted(f"_{f.name}", values, edges)


def duck_field(f, rid, seed=SEED):
    if f.kind == "float":
        return duck_float(f, rid, seed)
    if f.kind == "category":
        return duck_category(f, rid, seed)
    if f.kind == "int":
        return duck.integer(seed, f.name, *f.int_range, rid), f"_{f.name}"
    if f.kind == "datetime":
        lo, hi = (micros_value(v) for v in f.dates)
        u = duck.uniform(seed, f.name, "value", rid)
        return f"make_timestamp({lo} + floor({u} * {hi - lo})::BIGINT)", f"_{f.name}"

    first, last = pools.FIRST_NAMES, pools.LAST_NAMES
    if f.kind == "name":
        i, j = duck.indices(seed, f.name, "value", (len(first), len(last)), rid)
        return f"{duck.pick(first, i)} || ' ' || {duck.pick(last, j)}", f"_{f.name}"
    if f.kind == "email":
        i, j, k, m = duck.indices(
            seed, f.name, "value", (len(first), len(last), 9999, len(pools.MAIL_DOMAINS)), rid
        )
        return (
            f"lower({duck.pick(first, i)}) || '.' || lower({duck.pick(last, j)}) || (1 + {k}) || '@' || "
            f"{duck.pick(pools.MAIL_DOMAINS, m)}",
            f"_{f.name}",
        )
    if f.kind == "address":
        i, j, k, m, n = duck.indices(
            seed, f.name, "value",
            (9999, len(pools.STREETS), len(pools.CITIES), len(pools.STATES), 99999), rid,
        )
        return (
            f"(1 + {i}) || ' ' || {duck.pick(pools.STREETS, j)} || ', ' || {duck.pick(pools.CITIES, k)} || ', ' || "
            f"{duck.pick(pools.STATES, m)} || ' ' || lpad((1 + {n})::VARCHAR, 5, '0')",
            f"_{f.name}",
        )
    return "NULL::VARCHAR", f"_{f.name}"


def duck_table(spec, source, rid, keep=(), outer=None):
    """SELECT of a whole specification; floats are rounded to 6 digits like in the query."""
    inner, outside = [f"{k} AS {k}" for k in keep], list(keep)
    for f in spec.fields:
        first, second = duck_field(f, rid, spec.seed)
        inner.append(f"{first} AS _{f.name}")
        second = (outer or {}).get(f.name, second)
        outside.append(f"{duck.rounded(second)} AS {f.name}" if f.kind == "float" else f"{second} AS {f.name}")
    return f"SELECT {', '.join(outside)} FROM (SELECT {', '.join(inner)} FROM {source})"


def rounded(df, spec):
    """Round generated floats: logarithm and cosine may differ in the last digit between engines."""
    return df.withColumns({f.name: F.round(f.name, 6) for f in spec.fields if f.kind == "float"})


def spec_of(name, **fields):
    return TableSpec.of(name, fields)


# --- tabular -----------------------------------------------------------------


@query("gen_tabular", duck_table(PRESET, "orders", "o_orderkey", ["o_orderkey"]))
def gen_tabular(spark, folder):
    ids = table(spark, folder, "orders").select("o_orderkey")
    return rounded(g.generate(ids, PRESET, "o_orderkey", ["o_orderkey"]), PRESET)


FLOATS = spec_of(
    "floats",
    plain={"type": "float"},
    untyped={},
    floor={"type": "float", "mean": 100, "std": 15, "min": 0},
    band={"type": "float", "mean": 50, "std": 30, "min": 5, "max": 80},
)


@query("gen_float", duck_table(FLOATS, "orders", "o_orderkey", ["o_orderkey"]))
def gen_float(spark, folder):
    ids = table(spark, folder, "orders").select("o_orderkey")
    out = g.generate(ids, FLOATS, "o_orderkey", ["o_orderkey"])
    return out.withColumns({f.name: F.round(f.name, 6) for f in FLOATS.fields})


INTS = spec_of("ints", age={"type": "int", "min": 18, "max": 90}, plain={"type": "int"},
               signed={"type": "int", "min": -5, "max": 5}, single={"type": "int", "min": 7, "max": 7})


@query("gen_int", duck_table(INTS, "orders", "o_orderkey", ["o_orderkey"]))
def gen_int(spark, folder):
    ids = table(spark, folder, "orders").select("o_orderkey")
    return g.generate(ids, INTS, "o_orderkey", ["o_orderkey"])


CATEGORIES = spec_of(
    "categories",
    plain={"type": "category"},
    weighted={"type": "category", "categories": ["A", "B", "C"], "probabilities": [0.5, 0.3, 0.2]},
    flag={"type": "category", "categories": [True, False], "probabilities": [0.25, 0.75]},
    single={"type": "category", "categories": ["only"]},
)


@query("gen_category", duck_table(CATEGORIES, "orders", "o_orderkey", ["o_orderkey"]))
def gen_category(spark, folder):
    ids = table(spark, folder, "orders").select("o_orderkey")
    return g.generate(ids, CATEGORIES, "o_orderkey", ["o_orderkey"])


DATES = spec_of("dates", plain={"type": "datetime"},
                year={"type": "datetime", "start_date": "2022-03-01", "end_date": "2022-12-31T12:30:00"})


@query("gen_datetime", duck_table(DATES, "orders", "o_orderkey", ["o_orderkey"]))
def gen_datetime(spark, folder):
    ids = table(spark, folder, "orders").select("o_orderkey")
    return g.generate(ids, DATES, "o_orderkey", ["o_orderkey"])


IDENTITY = spec_of("identity", person={"type": "name"}, mail={"type": "email"}, home={"type": "address"})


@query("gen_identity", duck_table(IDENTITY, "customer", "c_custkey", ["c_custkey"]))
def gen_identity(spark, folder):
    ids = table(spark, folder, "customer").select("c_custkey")
    return g.generate(ids, IDENTITY, "c_custkey", ["c_custkey"])


UNKNOWN = spec_of("unknown", shape={"type": "polygon"}, size={"type": "int"})


@query("gen_unknown", duck_table(UNKNOWN, "customer", "c_custkey", ["c_custkey"]))
def gen_unknown(spark, folder):
    ids = table(spark, folder, "customer").select("c_custkey")
    return g.generate(ids, UNKNOWN, "c_custkey", ["c_custkey"])


# --- series ------------------------------------------------------------------


@query(
    "ts_grid",
    f"SELECT event_id, make_timestamp({START_US} + event_id * 300000000) AS timestamp FROM events",
)
def ts_grid(spark, folder):
    ids = table(spark, folder, "events").select("event_id")
    grid = TableSpec.of("grid", {"time_field": "timestamp", "time_interval_seconds": 300})
    return g.generate_series(ids, grid, START, BATCH, "event_id", ["event_id"])


@query(
    "ts_linear_trend",
    f"""SELECT event_id,
        round(value + 0.5::DOUBLE * (event_id % {BATCH}) / {BATCH - 1}.0::DOUBLE, 6) AS restarting,
        round(value + 0.5::DOUBLE * event_id / {BATCH - 1}.0::DOUBLE, 6) AS continuous,
        round(value, 6) AS single
    FROM events""",
)
def ts_linear_trend(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    value, rid, trend = F.col("value"), F.col("event_id"), {"type": "linear", "strength": 0.5}
    return events.select(
        "event_id",
        F.round(g.with_trend(value, trend, rid, BATCH), 6).alias("restarting"),
        F.round(g.with_trend(value, trend, rid, BATCH, continuous=True), 6).alias("continuous"),
        F.round(g.with_trend(value, trend, rid, 1), 6).alias("single"),
    )


@query(
    "ts_exp_trend",
    f"""SELECT event_id,
        round(value * exp(0.1::DOUBLE * (event_id % {BATCH}) / {BATCH - 1}.0::DOUBLE), 6) AS trended
    FROM events""",
)
def ts_exp_trend(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    trended = g.with_trend(F.col("value"), {"type": "exponential"}, F.col("event_id"), BATCH)
    return events.select("event_id", F.round(trended, 6).alias("trended"))


@query(
    "ts_season",
    f"""SELECT event_id,
        round(value + 0.2::DOUBLE * sin({duck.PI2} * (epoch_us(ts) / 1000000.0::DOUBLE)
              / 86400.0::DOUBLE), 6) AS daily,
        round(value + 0.1::DOUBLE * sin({duck.PI2} * (epoch_us(ts) / 1000000.0::DOUBLE)
              / 604800.0::DOUBLE), 6) AS weekly
    FROM events""",
)
def ts_season(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "value")
    micros = micros_of(F.col("ts"))
    daily = g.with_season(F.col("value"), {"amplitude": 0.2}, micros)
    weekly = g.with_season(F.col("value"), {"period": 168}, micros)
    return events.select("event_id", F.round(daily, 6).alias("daily"), F.round(weekly, 6).alias("weekly"))


def duck_series(spec, source, rid, keep=()):
    """SELECT of a series specification with trend and season."""
    patterns = {}
    micros = f"({START_US} + {rid} * {spec.interval_us})"
    names = {}
    for f in spec.fields:
        value = duck_field(f, rid, spec.seed)[1]
        if f.name in spec.trends:
            strength = duck.num(spec.trends[f.name]["strength"])
            value = f"{value} + {strength} * ({rid} % {BATCH}) / {BATCH - 1}.0::DOUBLE"
        if f.name in spec.seasonality:
            s = spec.seasonality[f.name]
            value = (
                f"{value} + {duck.num(s['amplitude'])} * sin({duck.PI2} * "
                f"({micros} / 1000000.0::DOUBLE) / {duck.num(s['period'] * 3600)})"
            )
            if f.kind == "int":
                value = duck.rounded(value)
        patterns[f.name] = value
        names[f.name] = value
    base = duck_table(spec, source, rid, list(dict.fromkeys([*keep, rid])), patterns)
    kept = ", ".join([*keep, *names])
    return f"SELECT {kept}, make_timestamp({micros}) AS {spec.time_field} FROM ({base})"


def rounded_series(df, spec):
    shaped = [f.name for f in spec.fields if f.kind == "float" or f.name in spec.seasonality]
    return df.withColumns({name: F.round(name, 6) for name in shaped})


@query(
    "ts_batches",
    f"SELECT event_id // {BATCH} AS batch, * FROM ({duck_series(SERIES, 'events', 'event_id', ['event_id'])})",
)
def ts_batches(spark, folder):
    ids = table(spark, folder, "events").select("event_id")
    out = g.generate_series(ids, SERIES, START, BATCH, "event_id", ["event_id"])
    batch = F.floor(F.col("event_id") / BATCH).cast("long")
    return rounded_series(out, SERIES).select(batch.alias("batch"), "*")


# --- several generators ------------------------------------------------------

MULTI_COLUMNS = ["o_orderkey", "age", "income", "status", "value", "count", "category", "timestamp"]


@query(
    "gen_multi",
    f"""SELECT o_orderkey, age, income, status, NULL::DOUBLE AS value, NULL::BIGINT AS count,
               NULL::VARCHAR AS category, NULL::TIMESTAMP AS timestamp, 'preset' AS generator
        FROM ({duck_table(PRESET, 'orders', 'o_orderkey', ['o_orderkey'])})
        UNION ALL
        SELECT o_orderkey, NULL, NULL, NULL, value, count, category, timestamp, 'series' AS generator
        FROM ({duck_series(SERIES, 'orders', 'o_orderkey', ['o_orderkey'])})""",
)
def gen_multi(spark, folder):
    generators = g.GeneratorSet(start=START)
    generators.add(PRESET)
    generators.add(SERIES)
    ids = table(spark, folder, "orders").select("o_orderkey")
    frames = generators.batch(ids, BATCH, row_id="o_orderkey", keep=["o_orderkey"])
    merged = g.union_batches(frames).select(*MULTI_COLUMNS, "generator")
    return merged.withColumns({"income": F.round("income", 6), "value": F.round("value", 6)})


# A transaction draws the position of its customer, and customer ids follow from positions, so
# the two generated tables share their key domain exactly.
FIRST_CUSTOMER = CUSTOMERS["customer_id"].int_range[0]


@query(
    "gen_customers_transactions",
    f"""WITH c AS (SELECT * REPLACE ({FIRST_CUSTOMER} + c_custkey AS customer_id)
                   FROM ({duck_table(CUSTOMERS, 'customer', 'c_custkey', ['c_custkey'])})),
        t AS (SELECT * REPLACE ({FIRST_CUSTOMER} + floor({duck.uniform(SEED, 'customer_id', 'customer',
                                                                      'o_orderkey')}
                                 * (SELECT count(*) FROM customer))::BIGINT AS customer_id)
              FROM ({duck_series(TRANSACTIONS, 'orders', 'o_orderkey', ['o_orderkey'])}))
        SELECT o_orderkey, transaction_id, t.customer_id, product_id, quantity, price, discount,
               payment_method, timestamp, 'transactions' AS generator, gender, location, is_premium,
               lifetime_value
        FROM t JOIN c ON t.customer_id = c.customer_id""",
)
def gen_customers_transactions(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey")
    profiles = g.generate(customers, CUSTOMERS, "c_custkey", ["c_custkey"]).withColumn(
        "customer_id", F.lit(FIRST_CUSTOMER) + F.col("c_custkey")
    )
    population = customers.agg(F.count("*")).scalar()
    orders = table(spark, folder, "orders").select("o_orderkey")
    draws = g.Draws(TRANSACTIONS.seed, "customer_id", "o_orderkey")
    position = F.floor(draws.uniform("customer") * population).cast("long")
    sales = g.generate_series(orders, TRANSACTIONS, START, BATCH, "o_orderkey", ["o_orderkey"])
    sales = sales.withColumn("customer_id", F.lit(FIRST_CUSTOMER) + position)
    traits = rounded(profiles, CUSTOMERS).select(
        "customer_id", "gender", "location", "is_premium", "lifetime_value"
    )
    return (
        g.stamp(rounded_series(sales, TRANSACTIONS), "transactions")
        .drop("emitted_at")
        .join(traits, "customer_id")
    )


def _coin(spec, draws):
    return F.when(draws.uniform() < 0.5, "heads").otherwise("tails")


@query(
    "gen_custom_field",
    f"""SELECT o_orderkey, CASE WHEN {duck.uniform(42, 'side', 'value', 'o_orderkey')} < 0.5 THEN 'heads' ELSE 'tails' END AS side
        FROM orders""",
)
def gen_custom_field(spark, folder):
    """A field of a user's own type over the order ids."""
    g.register_field_type("coin", _coin)
    spec = TableSpec.of("coins", {"side": {"type": "coin"}}, 42)
    return g.generate(table(spark, folder, "orders"), spec, "o_orderkey", ["o_orderkey"])


WIDE = "(SELECT o_orderkey, o_orderkey * 4000000007 AS wide FROM orders)"


@query("gen_wide_ids", duck_table(PRESET, WIDE, "wide", ["wide"]))
def gen_wide_ids(spark, folder):
    """The preset over ids far above 32 bits."""
    ids = table(spark, folder, "orders").select((F.col("o_orderkey") * F.lit(4000000007)).alias("wide"))
    return rounded(g.generate(ids, PRESET, "wide", ["wide"]), PRESET)
