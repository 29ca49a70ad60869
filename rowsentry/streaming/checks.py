"""Row-local checks on streams, and grouping checks on the batches of a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.executors import is_row_local, row_finding, run_row_local, run_rules
from ..plans.model import CompiledRule
from ..sources.dataset import Dataset


def stream_findings(ds: Dataset, rules: Sequence[CompiledRule]) -> DataFrame:
    """Findings of row-local rules over a streaming dataset; they need no state."""
    require_row_local(rules)
    return run_row_local(ds, rules)


def require_row_local(rules: Sequence[CompiledRule]) -> None:
    other = [r.id for r in rules if not is_row_local(r.plan)]
    if other:
        raise ValueError(f"These rules compare rows and need a batch: {', '.join(other)}.")


def windowed_counts(ds: Dataset, rules: Sequence[CompiledRule], time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings per rule and event-time window; a window closes ``late`` after its end."""
    require_row_local(rules)
    hits = F.explode(F.filter(F.array(*[F.when(row_finding(ds, r).isNotNull(), F.lit(r.id)) for r in rules]), lambda x: x.isNotNull()))
    return ds.df.withWatermark(time, late).select(time, hits.alias("rule_id")).groupBy(F.window(time, window), "rule_id").agg(F.count(F.lit(1)).alias("findings"))


def each_batch(ds: Dataset, rules: Sequence[CompiledRule], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All rules on each micro-batch; ``sink`` gets the findings and the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        sink(run_rules(Dataset(batch, ds.headers, ds.name), rules), number)

    return ds.df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
