"""Canonical views over the driver's tables, as expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..lineage import dealt
from ..operators.ranks import numbered
from ..schemas import GRID, POSITIONS, RUNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(column: str, values, first: int = 0) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {quote(v)}" for k, v in enumerate(values, first)) + " END"


#: Result rows on lineitem: the line number is the position, the supplier the run.
RESULT_COLUMNS = {
    "run_name": case("(l_suppkey % 7)", RUNS),
    "evaluation_mode": "CASE WHEN l_partkey % 5 = 0 THEN 'locate_only' ELSE 'free' END",
    "group_id": "CAST(l_orderkey AS BIGINT)",
    "task": "l_returnflag",
    "filler_type": "l_linestatus",
    "target_tokens": "CASE WHEN l_quantity < 25 THEN 8192 ELSE 32768 END",
    "position_label": case("l_linenumber", GRID, 1),
    "target_position": case("l_linenumber", POSITIONS, 1),
    "valid_json": "l_tax <= 0.07",
    "answer_correct": "l_tax <= 0.07 AND l_discount >= 0.03",
    "answer_score": "CASE WHEN l_tax <= 0.07 THEN CASE WHEN l_discount >= 0.03 THEN 1.0 ELSE l_discount * 10 END ELSE CAST(0.0 AS DOUBLE) END",
    "answer": "CASE WHEN l_tax <= 0.07 THEN CASE WHEN l_discount >= 0.02 THEN 'right' ELSE 'wrong' END END",
    "evidence_ids_applicable": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 4 <> 1 END",
    "evidence_ids_correct": "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_tax <= 0.06 END",
    "evidence_quotes_applicable": "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_orderkey % 9 <> 1 END",
    "evidence_quotes_correct": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_discount >= 0.05 END",
    "all_predicted_quotes_supported_applicable": "l_orderkey % 9 <> 1",
    "all_predicted_quotes_supported": "l_tax <= 0.05",
    "finish_reason": "CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_quantity > 45 THEN 'length' ELSE 'stop' END",
    "output_tokens": "CAST(l_quantity * 3 AS INT)",
    "batch_wall_seconds": "l_extendedprice / 1000",
    "line_id": "l_orderkey * 1000 + l_partkey % 1000",
}


def results(spark: SparkSession, sf_dir: str, by_group: bool = False) -> DataFrame:
    """by_group: dealt out by order, so that groups need no other shuffle."""
    rows = table(spark, sf_dir, "lineitem")
    if by_group:
        rows = dealt(rows, 200_000, "l_orderkey")
    return rows.selectExpr(*(f"{v} AS {k}" for k, v in RESULT_COLUMNS.items()))


RESULTS_SQL = "results AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in RESULT_COLUMNS.items()) + " FROM lineitem)"

#: A complete aligned grid: part x 7 positions x 7 runs, its outcome from a hash.
GRID_COLUMNS = {
    "unit": "p_partkey",
    "task": "CASE WHEN p_partkey % 3 = 0 THEN 'two_hop' ELSE 'kv' END",
    "filler_type": case("(p_size % 3)", ("neutral", "same_format", "answer_bearing")),
    "target_tokens": "CASE WHEN p_retailprice < 1400 THEN 8192 ELSE 32768 END",
    "cluster": "CAST(p_size AS BIGINT) % 10 + 10 * (p_partkey % 3)",
    "run_name": case("run_no", RUNS),
    "position_label": case("pos_no", GRID),
    "target_position": case("pos_no", POSITIONS),
}


#: Parts in a partition of the grid, with 49 rows each.
PARTS = 4_000


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by unit before rows multiply, so a task has about PARTS units, and whole ones."""
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand"), PARTS, "p_partkey")
    wide = part.selectExpr("*", "explode(sequence(0, 6)) AS run_no").selectExpr("*", "explode(sequence(0, 6)) AS pos_no")
    roll = "conv(substring(sha2(concat_ws(':', run_no, p_partkey, pos_no), 256), 1, 8), 16, 10)"
    return wide.selectExpr(*(f"{v} AS {k}" for k, v in GRID_COLUMNS.items()), f"CAST({roll} AS BIGINT) % 100 < 55 + 5 * run_no - CASE WHEN pos_no IN (2, 3, 4) THEN 12 ELSE 0 END AS correct", f"CAST({roll} AS BIGINT) % 1000 / 1000 AS score", "p_brand AS subject")


GRID_SQL = (
    "grid AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in GRID_COLUMNS.items()) + ", roll % 100 < 55 + 5 * run_no - CASE WHEN pos_no IN (2, 3, 4) THEN 12 ELSE 0 END AS correct, (roll % 1000) / 1000 AS score, p_brand AS subject FROM "
    "(SELECT p.*, r.run_no, s.pos_no, CAST('0x' || substr(sha256(r.run_no || ':' || p.p_partkey || ':' || s.pos_no), 1, 8) AS BIGINT) AS roll FROM part p, (SELECT unnest(range(7)) AS run_no) r, (SELECT unnest(range(7)) AS pos_no) s))"
)

#: Metric histories on events: the type is the variant, the order of time the step.
HISTORY_COLUMNS = {
    "variant": "event_type",
    "seed": "CAST(user_id % 3 AS INT)",
    "step": "CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INT)",
    "seq": "event_id",
    "loss": "CASE WHEN event_id % 37 = 0 THEN NULL ELSE value END",
    "eval_loss": "CASE WHEN event_id % 50 = 0 THEN value * 1.1 END",
    "learning_rate": "CASE WHEN event_id % 37 = 0 AND event_id % 2 = 0 THEN NULL ELSE CAST(0.001 AS DOUBLE) / (1 + event_id % 10) END",
    "grad_norm": "value / 3",
    "mean_token_accuracy": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1 / (1 + abs(value)) END",
}


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of time is a rank over ranges: no event type is sorted in one task."""
    ranked = numbered(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "_step")
    return ranked.selectExpr(*(f"{'CAST(_step AS INT)' if k == 'step' else v} AS {k}" for k, v in HISTORY_COLUMNS.items()))


HISTORY_SQL = "history AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in HISTORY_COLUMNS.items()) + " FROM events)"
