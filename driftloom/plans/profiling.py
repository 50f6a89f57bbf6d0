"""Queries: profiles, histograms and conformance."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import profile as p
from driftloom.operators import sketches
from driftloom.operators.conformance import conformance
from driftloom.operators.series import SeriesKey, ordered
from driftloom.plans import duck
from driftloom.plans.tables import query, table
from driftloom.schema import TableSpec
from driftloom.session import fresh_path

NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"]
OTHER = ["l_returnflag", "l_linestatus", "l_shipdate"]


def _profile_sql(left_out: tuple[str, ...] = (), shown=duck.rounded) -> str:
    parts = []
    for c in NUMERIC + OTHER:
        metrics = {"null_count": f"count(*) - count({c})", "unique_count": f"count(DISTINCT {c})"}
        if c in NUMERIC:
            metrics |= {"min": f"min({c})", "max": f"max({c})", "mean": f"avg({c})",
                        "std": f"stddev_samp({c})", "median": f"median({c})"}
        parts += [
            f"SELECT '{c}' AS column, '{m}' AS metric, {shown(f'({e})::DOUBLE')} AS value FROM lineitem"
            for m, e in metrics.items() if m not in left_out
        ]
    return " UNION ALL ".join(parts)


@query("profile", _profile_sql())
def profile(spark, folder):
    return p.profile(table(spark, folder, "lineitem")).withColumn("value", F.round("value", 6))


def _digits(value: str) -> str:
    """Merged sums add in another order: four digits, and eight of what is below 1 (six would meet exact halves)."""
    return f"CASE WHEN abs({value}) < 1 THEN {duck.rounded(value, 8)} ELSE {duck.rounded(value, 4)} END"


@query("profile_merged", _profile_sql(("unique_count", "median"), _digits))
def profile_merged(spark, folder):
    """Profiles of three batches, stored as they come and merged without the rows; the metrics that merge exactly."""
    items, path = table(spark, folder, "lineitem"), fresh_path(spark, "profiles")
    for version in range(3):
        batch = items.where(F.year("l_shipdate") % 3 == version)
        sketches.save_state(sketches.profile_state(batch), path, version)
    out = sketches.report(sketches.merge_states(sketches.load_states(spark, path)))
    shown = F.when(F.abs("value") < 1, F.round("value", 8)).otherwise(F.round("value", 4))
    return out.where(~F.col("metric").isin("unique_count", "median")).withColumn("value", shown)


@query("table_shape", "SELECT count(*) AS record_count, 11::BIGINT AS column_count FROM lineitem")
def table_shape(spark, folder):
    return p.shape(table(spark, folder, "lineitem"))


def _counts_sql() -> str:
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
             "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column, '{t}' AS dtype, count(*) - count({c}) AS null_count, "
        f"count(DISTINCT {c}) AS unique_count FROM orders" for c, t in types.items()
    )


@query("column_counts", _counts_sql())
def column_counts(spark, folder):
    return p.column_counts(table(spark, folder, "orders"))


@query(
    "column_moments",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean,
            round(stddev_samp({c}), 4) AS std, round(median({c}), 4) AS median FROM orders"""
        for c in ["o_orderkey", "o_custkey", "o_totalprice"]
    ),
)
def column_moments(spark, folder):
    orders = table(spark, folder, "orders")
    out = p.moments(orders).join(p.medians(orders), "column")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median")})


def _value_counts_sql() -> str:
    parts = [
        f"""SELECT '{c}' AS column, {c} AS value, count(*) AS n FROM {t}
            WHERE (SELECT count(DISTINCT {c}) FROM {t}) <= 10 AND {c} IS NOT NULL GROUP BY 2"""
        for t, c in [("customer", "c_name"), ("customer", "c_mktsegment")]
    ]
    return " UNION ALL ".join(parts)


@query("value_counts", _value_counts_sql())
def value_counts(spark, folder):
    return p.value_counts(table(spark, folder, "customer"))


@query(
    "histogram",
    """WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders),
       c AS (SELECT least(20, floor((o_totalprice - lo) / w)::INTEGER + 1) AS bin, count(*) AS n
             FROM orders, e GROUP BY 1),
       g AS (SELECT unnest(range(1, 21))::INTEGER AS bin)
       SELECT g.bin, round(lo + w * (g.bin - 1), 4) AS left_edge, round(lo + w * g.bin, 4) AS right_edge,
           coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.bin = c.bin, e""",
)
def histogram(spark, folder):
    out = p.histogram(table(spark, folder, "orders"), "o_totalprice")
    return out.withColumns({c: F.round(c, 4) for c in ("left_edge", "right_edge")})


@query(
    "category_frequency",
    "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value",
)
def category_frequency(spark, folder):
    return p.category_frequency(table(spark, folder, "orders"), "o_orderpriority")


@query("series_extract", "SELECT ts, event_id, value FROM events ORDER BY ts, event_id")
def series_extract(spark, folder):
    key = SeriesKey((), "ts", ("event_id",))
    return ordered(table(spark, folder, "events"), key, ["ts", "event_id", "value"])


CHECKED = TableSpec.of(
    "orders",
    {
        "o_totalprice": {"type": "float", "min": 5000, "max": 400000},
        "o_custkey": {"type": "int", "min": 0, "max": 500},
        "o_orderstatus": {"type": "category", "categories": ["F", "O"], "probabilities": [0.5, 0.5]},
        "o_orderpriority": {
            "type": "category",
            "categories": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
        },
        "o_orderdate": {"type": "datetime", "start_date": "1996-01-01", "end_date": "2000-12-31"},
        "price_text": {"type": "float", "max": 300000},
        "o_comment": {"type": "name"},
    },
)


def _conformance_sql() -> str:
    def row(field, rule, condition):
        return (
            f"SELECT '{field}' AS field, '{rule}' AS rule, count(*) AS checked, "
            f"count(*) FILTER ({condition}) AS violations FROM t"
        )

    def share(field):
        off = " + ".join(
            f"(abs(count(*) FILTER ({field} = {duck.text(c)}) / count({field})::DOUBLE - {duck.num(q)}) "
            f"> 0.05::DOUBLE)::BIGINT"
            for c, q in zip(CHECKED[field].categories, CHECKED[field].probabilities)
        )
        return f"SELECT '{field}', 'category_share', count(*), {off} FROM t"

    known = ", ".join(duck.text(c) for c in CHECKED["o_orderpriority"].categories)
    parts = [
        row("o_totalprice", "not_null", "o_totalprice IS NULL"),
        row("o_totalprice", "type", "false"),
        row("o_totalprice", "min", "o_totalprice < 5000"),
        row("o_totalprice", "max", "o_totalprice > 400000"),
        row("o_custkey", "not_null", "o_custkey IS NULL"),
        row("o_custkey", "type", "false"),
        row("o_custkey", "min", "o_custkey < 0"),
        row("o_custkey", "max", "o_custkey > 500"),
        row("o_orderstatus", "not_null", "o_orderstatus IS NULL"),
        row("o_orderstatus", "known_category", "o_orderstatus NOT IN ('F', 'O')"),
        share("o_orderstatus"),
        row("o_orderpriority", "not_null", "o_orderpriority IS NULL"),
        row("o_orderpriority", "known_category", f"o_orderpriority NOT IN ({known})"),
        share("o_orderpriority"),
        row("o_orderdate", "not_null", "o_orderdate IS NULL"),
        row("o_orderdate", "type", "false"),
        row("o_orderdate", "date_range", "o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '2000-12-31'"),
        row("price_text", "not_null", "price_text IS NULL"),
        row("price_text", "type", "price_text IS NOT NULL AND TRY_CAST(price_text AS DOUBLE) IS NULL"),
        row("price_text", "max", "TRY_CAST(price_text AS DOUBLE) > 300000"),
        "SELECT 'o_comment', 'present', count(*), 1 FROM t",
    ]
    source = "SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE o_totalprice::VARCHAR END AS price_text FROM orders"
    return f"WITH t AS ({source}) " + " UNION ALL ".join(parts)


@query("conformance", _conformance_sql())
def conformance_report(spark, folder):
    orders = table(spark, folder, "orders")
    broken = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    return conformance(orders.withColumn("price_text", broken), CHECKED)
