"""The pluggable model call: ``call(system, user) -> str`` over Arrow batches.

The call returns a struct column, so the document's other columns never leave the JVM. A failing
call is a row with an error, not a failed task. The UDF is marked nondeterministic: the optimizer
then neither duplicates nor reorders it, and each row is called once per task attempt.

Model calls wait on a service, so a task keeps several in the air (``CallLimits.lanes``) and hands their
rows on in input order. A call has a limit of time; when it passes, the attempt is an error and its lane
goes to the next row, while the thread that hangs is left behind (it ends with the worker). Failed attempts
are repeated after waits that double and hold no chance. Every attempt is one record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

ATTEMPTS = "array<struct<attempt:int,latency_ms:double,success:boolean,error:string>>"
REPLY = f"reply string, error string, latency_ms double, success boolean, attempts {ATTEMPTS}"


@dataclass(frozen=True)
class CallLimits:
    """How a task calls: ``lanes`` calls at once (more than one needs a thread-safe callable), seconds a call
    may take (None: any), further attempts after a failed one, and seconds before the first of them."""

    lanes: int = 1
    timeout_s: float | None = None
    retries: int = 0
    wait_s: float = 0.5


def call_model(call: Callable[[str, str], str], limits: CallLimits = CallLimits()):
    """Column function ``(system, user) -> struct<reply, error, latency_ms, success, attempts>``.

    ``latency_ms`` is the sum over the attempts, reply and error are the last one's. A NULL ``user`` is
    not sent and gives NULLs: that is how callers skip rows.
    """
    lanes, timeout, retries, wait = max(1, limits.lanes), limits.timeout_s, max(0, limits.retries), limits.wait_s

    # Everything the task needs is a local name, so workers need not have this package.
    def attempt(system: str, user: str) -> tuple[str | None, str | None]:
        import threading

        if timeout is None:
            try:
                return str(call(system, user)), None
            except Exception as exc:
                return None, str(exc)
        done: list = []

        def work() -> None:
            try:
                done.append((str(call(system, user)), None))
            except Exception as exc:
                done.append((None, str(exc)))

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        thread.join(timeout)
        return done[0] if done else (None, f"no reply within {timeout:g} s")

    def one(system: str, user: str | None) -> tuple:
        import time

        if user is None:
            return None, None, None, None, None
        records, reply, error = [], None, None
        for n in range(retries + 1):
            if n and wait:
                time.sleep(wait * 2 ** (n - 1))
            started = time.perf_counter()
            reply, error = attempt(system, user)
            records.append({"attempt": n, "latency_ms": round((time.perf_counter() - started) * 1000, 2),
                            "success": error is None, "error": error})
            if error is None:
                break
        return reply, error, round(sum(r["latency_ms"] for r in records), 2), error is None, records

    def answered(pairs: Iterator[tuple]) -> list[tuple]:
        """The rows' answers in input order, at most ``lanes`` calls at a time."""
        from concurrent.futures import ThreadPoolExecutor

        if lanes == 1:
            return [one(s, u) for s, u in pairs]
        with ThreadPoolExecutor(lanes) as pool:
            return list(pool.map(lambda p: one(*p), pairs))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import pandas

        for systems, users in batches:
            out = pandas.DataFrame(answered(zip(systems, users)), columns=["reply", "error", "latency_ms", "success", "attempts"])
            yield out.astype({"reply": "object", "error": "object", "latency_ms": "float64",
                              "success": "boolean", "attempts": "object"})

    return F.pandas_udf(run, REPLY).asNondeterministic()
