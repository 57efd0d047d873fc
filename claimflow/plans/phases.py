"""The phases as functions from DataFrame to DataFrame, and a batch run over them.

Records only widen. A phase works on rows that are still in flight and leaves the others as they
are; because every phase is a projection, closed rows ride along in the same frame and no branch
or union is needed. The whole run up to the records table is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..fixed import MAX_PROMPT_CHARS, MODEL_EXCERPT
from ..functions.fence import settle
from ..operators.classify import cascade, close_out
from ..operators.decide import dispatch
from ..operators.evaluate import run_eval
from ..operators.govern import fallback_chain, guardrail_flags
from ..operators.infer import extract, result_json
from ..operators.inference import CallLimits
from ..operators.lookup import BROADCAST_ROWS
from ..operators.meter import call_records
from ..operators.normalize import normalize
from ..operators.report import build_report
from ..operators.validate import validate
from ..schemas import PHASES
from ..sources.landing import source_union
from .observed import WHOLE, RunMeter
from .resume import PhaseStore, phase_fingerprints


@dataclass
class Services:
    """What the phases draw on besides the documents. All optional."""

    model: object | None = None
    call: Callable[[str, str], str] | None = None
    classify_call: Callable[[str, str], str] | None = None
    registry: DataFrame | None = None
    icd10: DataFrame | None = None
    cpt: DataFrame | None = None
    providers: DataFrame | None = None
    prefer_local: bool = False
    #: Characters of a document that a type prompt and an extraction prompt carry to a model.
    excerpt_chars: int = MODEL_EXCERPT
    prompt_chars: int = MAX_PROMPT_CHARS
    #: A registry up to this many rows is broadcast, a larger one becomes a membership test.
    broadcast_rows: int = BROADCAST_ROWS
    #: Calls at once, time a call may take and attempts, for both kinds of model calls.
    limits: CallLimits = CallLimits()


def ingest(raw: DataFrame, run_ts: Column | None = None) -> DataFrame:
    return validate(normalize(raw, run_ts)).withColumn("stages_completed", F.array(F.lit("ingestion")))


def only_open(df: DataFrame, phase: Callable[[DataFrame], DataFrame], name: str,
              changes: list[str]) -> DataFrame:
    """Run a phase for rows in flight and keep the others.

    Closed rows show the phase a NULL text, so its costly expressions (and any model call) skip
    them. Afterwards they get back the columns in ``changes`` and NULL in every added column.
    """
    before = df.columns
    kept = [*changes, "full_text"]
    flight = F.col("_open")
    df = df.withColumns({"_open": F.col("disposition").isNull(),
                         **{f"_old_{c}": F.col(c) for c in kept}})
    out = phase(df.withColumn("full_text", F.when(flight, F.col("full_text"))))

    def restored(c: str) -> Column:
        if c == "full_text":
            return F.col("_old_full_text")
        if c == "stages_completed":
            return F.when(flight, F.concat(F.col(c), F.array(F.lit(name)))).otherwise(F.col(c))
        if c in changes:
            return F.when(flight, F.col(c)).otherwise(F.col(f"_old_{c}"))
        return F.col(c) if c in before else F.when(flight, F.col(c))

    hidden = {"_open", *(f"_old_{c}" for c in kept)}
    return settle(out.select(*[restored(c).alias(c) for c in out.columns if c not in hidden]))


def classification(df: DataFrame, s: Services) -> DataFrame:
    return only_open(df, lambda d: close_out(cascade(d, s.model, s.classify_call, excerpt_chars=s.excerpt_chars, limits=s.limits)),
                     "classification", ["document_type", "errors", "disposition"])


def extraction(df: DataFrame, s: Services) -> DataFrame:
    return only_open(df, lambda d: extract(
        d, s.call, s.registry, s.icd10, s.cpt, s.prefer_local, s.prompt_chars, s.broadcast_rows, s.limits),
                     "extraction", [])


def orchestration(df: DataFrame, s: Services) -> DataFrame:
    def phase(d: DataFrame) -> DataFrame:
        return fallback_chain(guardrail_flags(result_json(d))).drop("result_json")

    return only_open(df, phase, "orchestration", [
        "fields", "mean_confidence", "extraction_warnings", "errors", "disposition"])


def agents(df: DataFrame, s: Services) -> DataFrame:
    return only_open(df, lambda d: dispatch(d, s.providers).drop("x"), "agents", ["disposition"])


STEPS = [
    ("classification", classification), ("extraction", extraction),
    ("orchestration", orchestration), ("agents", agents),
]


def run_phases(raw: DataFrame, services: Services | None = None, until: str = "agents",
               run_ts: Column | None = None,
               on_phase: Callable[[str, DataFrame], DataFrame] | None = None,
               start: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Records after the phase ``until``. ``on_phase`` may write a phase and hand back the table.

    ``start`` names a phase and its records; the run goes on after it and does not read ``raw``.
    """
    if until not in PHASES:
        raise ValueError(f"unknown phase: {until}")
    services = services or Services()
    keep = on_phase or (lambda name, df: df)
    done, df = start or ("ingestion", None)
    if df is None:
        df = keep("ingestion", ingest(raw, run_ts))
    for name, step in STEPS:
        if PHASES.index(done) < PHASES.index(name) <= PHASES.index(until):
            df = keep(name, step(df, services))
    return df


def run_batch(spark: SparkSession, raw: DataFrame, out: str, run_id: str,
              services: Services | None = None, until: str = "observability",
              gold: DataFrame | None = None, timings: DataFrame | None = None,
              phase_files: bool = False, run_ts: Column | None = None, resume: bool = False) -> DataFrame | None:
    """Run, write the records once, derive every other output from that table.

    Returns the one-row report, or None when the run stops before it. The records table is the
    point a lost executor falls back to: reports and result tables read it and never recompute
    the phases. Means, calls and times come from figures taken during the writes; times are per phase
    with ``phase_files`` and for the whole run without. ``timings`` takes their place where given.
    With ``resume`` phases are kept by fingerprint under ``out`` for all its runs, and this run starts
    from the newest that fits its inputs, services and code; phases taken over have no time.
    """
    meter = RunMeter()
    store = PhaseStore(spark, f"{out}/phases", phase_fingerprints(raw, services or Services(), run_ts)) if resume else None
    start = store.newest(until) if store else None
    if start:
        start = (start[0], meter.watched(*start))

    def on_phase(name: str, df: DataFrame) -> DataFrame:
        df = meter.watched(name, df)
        if store:
            return store.keep(name, df, lambda write: meter.timed(name, write))
        if not phase_files:
            return df
        folder = f"{out}/phases/run_id={run_id}"
        meter.timed(name, lambda: sinks.write_phase(df, folder, PHASES.index(name) + 1, name))
        return spark.read.parquet(sinks.phase_path(folder, PHASES.index(name) + 1, name))

    records = run_phases(raw, services, until, run_ts, on_phase, start)
    path = f"{out}/records/run_id={run_id}"
    meter.timed(WHOLE, lambda: records.write.mode("overwrite").parquet(path))
    if phase_files or resume:
        meter.rows.pop(WHOLE)  # only a copy of the last phase's table
    sinks.write_stages(meter.table(spark), f"{out}/run_id={run_id}")
    records = spark.read.parquet(path)
    if PHASES.index(until) < PHASES.index("agents"):
        return None
    sinks.write_tables(records, f"{out}/tables", run_id)
    if until != "observability":
        return None
    evaluation = run_eval(gold, model=(services or Services()).model) if gold is not None else None
    report = build_report(records, call_records(records), timings if timings is not None else meter.timings(spark),
                          evaluation, meter.means(spark))
    sinks.write_report(report, f"{out}/run_id={run_id}")
    return spark.read.json(f"{out}/run_id={run_id}/report")


def run_landing(spark: SparkSession, folder: str, out: str, run_id: str,
                sources: list[str] | None = None, **options) -> DataFrame | None:
    return run_batch(spark, source_union(spark, folder, sources), out, run_id, **options)
