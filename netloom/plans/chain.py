"""Chains of long jobs: retries with growing waits, polling to an end, and a state that a later run resumes."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path


def retried(job: Callable[[], object], tries: int = 5, wait: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The job's result; after an error it is tried again, each time after twice the wait, and the last error is raised."""
    for turn in range(tries):
        try:
            return job()
        except Exception:
            if turn == tries - 1:
                raise
            sleep(wait * 2**turn)
    raise ValueError("tries must be 1 at least")


def polled(status: Callable[[], str], ends: set[str], deadline: float, every: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> str:
    """The first status that is one of ends; `timeout` after deadline seconds."""
    began = clock()
    while (now := status()) not in ends:
        if clock() - began >= deadline:
            return "timeout"
        sleep(every)
    return now


def resumed(path: str, segments: list[str], run: Callable[[str, list[dict]], dict], enough: Callable[[list[dict]], bool] = lambda _: False) -> list[dict]:
    """The records of all segments; those that the state file has aren't run again, and an error is recorded as INFRA_FAIL and the chain goes on."""
    file = Path(path)
    done: list[dict] = json.loads(file.read_text())["iters"] if file.exists() else []
    finished = {x["seg"] for x in done if x.get("status") != "INFRA_FAIL"}
    for seg in segments:
        if seg in finished:
            continue
        if enough(done):
            break
        try:
            record = {"seg": seg} | run(seg, done)
        except Exception as error:  # noqa: BLE001  a segment that fails leaves the others to run
            record = {"seg": seg, "status": "INFRA_FAIL", "reason": str(error)}
        done.append(record)
        part = file.with_suffix(".part")
        part.write_text(json.dumps({"iters": done}))
        part.replace(file)
    return done
