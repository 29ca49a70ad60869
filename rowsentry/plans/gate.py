"""Admission: a second opinion on each interpretation before anything runs."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .model import Interpretation

CONFIDENCE = 0.8


@dataclass(frozen=True)
class Decision:
    approved: bool
    confidence: float
    reason: str = ""


class IntentGate(Protocol):
    def review(self, it: Interpretation) -> Decision: ...


class DeterministicGate:
    """Approves what the parser is sure of, without a model."""

    def review(self, it: Interpretation) -> Decision:
        ok = it.status == "valid"
        return Decision(ok, 1.0 if ok else 0.0, "" if ok else " ".join(it.warnings))


class PredictorGate:
    """Asks a predictor whether a rule's text means its check: ``(answer matches, confidence, truncated)``."""

    def __init__(self, predict: Callable[[str, str], tuple[bool, float, bool]]):
        self.predict = predict

    def review(self, it: Interpretation) -> Decision:
        if it.status == "unsupported":
            return Decision(False, 0.0, "The rule is not supported.")
        match, confidence, truncated = self.predict(it.text, question(it))
        return decided(it, match, confidence, truncated)


def decided(it: Interpretation, match: bool, confidence: float, truncated: bool) -> Decision:
    """A predictor's answer as a decision: it counts from the floor on, and never for a text that was cut."""
    sure = isinstance(confidence, (int, float)) and not isinstance(confidence, bool) and CONFIDENCE <= confidence <= 1
    said = "" if match else "The answer differs from the check."
    said = "The text was too long to be read whole." if truncated else said if match is False or sure else f"The answer is sure to {confidence:.2f} only."
    return Decision(bool(match) and sure and not truncated, confidence, said)


def within(seconds: float, f, *args):
    """The result of a call, or a TimeoutError; a call that hangs is left to a thread that ends with the process."""
    found: queue.Queue = queue.Queue()

    def call():
        try:
            found.put((f(*args), None))
        except BaseException as e:  # handed to the caller
            found.put((None, e))

    threading.Thread(target=call, daemon=True).start()
    try:
        result, error = found.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError from None
    if error is not None:
        raise error
    return result


class ClusterGate:
    """Asks a predictor on the executors: each distinct rule once, one prediction at a time for each model, each within a deadline.

    ``load`` makes the predictor in a worker, once for each of ``models`` partitions. A prediction that
    takes longer than ``seconds``, fails or can't be loaded approves nothing. A prediction that hangs
    occupies its model: what waits behind it in the partition gets a model of its own.
    """

    def __init__(self, spark: SparkSession, load: Callable[[], Callable[[str, str], tuple[bool, float, bool]]], seconds: float = 60, models: int = 1):
        self.spark, self.load, self.seconds, self.models = spark, load, seconds, models

    def review(self, it: Interpretation) -> Decision:
        return self.review_all([it])[0]

    def review_all(self, its: Sequence[Interpretation]) -> list[Decision]:
        """Decisions in the order of the interpretations."""
        asked = list(dict.fromkeys((it.text, question(it)) for it in its if it.status != "unsupported"))
        answers = {}
        if asked:
            table = self.spark.createDataFrame([(k, *x) for k, x in enumerate(asked)], "place long, text string, question string")
            answers = {asked[r.place]: r for r in self.predictions(table).collect()}
        out = []
        for it in its:
            if it.status == "unsupported":
                out.append(Decision(False, 0.0, "The rule is not supported."))
                continue
            r = answers[it.text, question(it)]
            out.append(Decision(False, 0.0, r.error) if r.error else decided(it, r.match, r.confidence, r.truncated))
        return out

    def predictions(self, table: DataFrame) -> DataFrame:
        """``place, match, confidence, truncated, error`` for a table of ``place, text, question`` of any size."""
        load, seconds = self.load, self.seconds

        def run(batches):
            predict = None
            for batch in batches:
                out = []
                for place, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    try:
                        if predict is None:
                            predict = load()
                        match, confidence, truncated = within(seconds, predict, text, asked)
                        out.append((place, bool(match), float(confidence), bool(truncated), None))
                    except TimeoutError:
                        predict = None
                        out.append((place, False, 0.0, False, f"The prediction took longer than {seconds:g} seconds."))
                    except Exception as e:  # a model that fails approves nothing
                        out.append((place, False, 0.0, False, f"The model is not available. {e}".strip()))
                kinds = [("place", pa.int64()), ("match", pa.bool_()), ("confidence", pa.float64()), ("truncated", pa.bool_()), ("error", pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

        dealt = table.select("place", "text", "question").repartition(self.models, "place")
        return dealt.mapInArrow(run, "place long, match boolean, confidence double, truncated boolean, error string")


def question(it: Interpretation) -> str:
    """What the predictor is asked to confirm."""
    names = ", ".join(b.token for b in it.fields)
    kind = it.check.kind if it.check else it.category
    return f"Does this rule ask for a {kind.replace('_', ' ')} check of {names or 'the dataset'}?"


def admit(interpretations: list[Interpretation], gate: IntentGate) -> list[Interpretation]:
    """One review for each rule; a rejected one becomes unsupported."""
    together = getattr(gate, "review_all", None)
    decisions = together(interpretations) if together else [gate.review(it) for it in interpretations]
    for it, decision in zip(interpretations, decisions, strict=True):
        it.gate = decision
        if it.status == "valid" and not it.gate.approved:
            it.status = "unsupported"
            it.warnings.append(it.gate.reason or "The rule was not approved.")
    return interpretations


def self_test(gate: IntentGate) -> tuple[Decision, float]:
    """A gate's answer to a plain rule, and how many seconds it took."""
    import time

    from .language import SourceRule, interpret

    began = time.monotonic()
    decision = gate.review(interpret(SourceRule("self-test", "Email is required"), {"email": "Email"}))
    return decision, time.monotonic() - began
