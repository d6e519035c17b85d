"""Plans over streams: operators that need neither the order of rows nor a look at the data run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import Context, get
from ..plans.execute import SKIPPED, PlanError, run_step
from ..plans.model import Plan


def transform(stream: DataFrame, plan: Plan | dict | str) -> DataFrame:
    """The stream through the plan's steps, in strict mode; ordered and data-dependent operators are refused."""
    plan = plan if isinstance(plan, Plan) else Plan.of(plan)
    for step in plan.steps:
        if step.op in SKIPPED:
            continue
        op = get(step.op)
        params = step.params
        looks = op is not None and op.kind == "eager" and not (
            (op.name == "extract_regex" and params.get("mode") != "best") or (op.name == "bin_numeric" and not isinstance(params.get("bins"), int)) or (op.name == "parse_date_text" and not params.get("infer_year"))
        )
        if op is None or op.kind == "ordered" or looks:
            raise PlanError(f"{step.op} does not run over a stream")
        stream = run_step(stream, step, plan, Context())
    return stream


def windowed(stream: DataFrame, time: str, size: str, late: str, keys: list[str], **sums: str) -> DataFrame:
    """Counts and sums by window of event time; rows later than ``late`` behind are dropped with their windows closed."""
    out = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = out.groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *sums)


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """All that is there now to parquet files, exactly once."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
