"""Parses in the background, and what became of them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark import InheritableThread

from querylens.ingest import ParseResult
from querylens.sources.state import utc_now


@dataclass
class Job:
    id: str
    status: str = "pending"  # pending, running, completed or failed
    started_at: str = ""
    finished_at: str = ""
    result: dict | None = None
    error: str = ""


class Jobs:
    """One parse at a time; jobs are kept by id."""

    def __init__(self):
        self._jobs: dict[str, Job] = {}
        self._turn = threading.Lock()

    def start(self, parse: Callable[[], ParseResult]) -> Job:
        job = Job(uuid.uuid4().hex)
        self._jobs[job.id] = job

        def work() -> None:
            with self._turn:
                job.status, job.started_at = "running", utc_now().isoformat()
                try:
                    job.result, job.status = asdict(parse()), "completed"
                except Exception as error:
                    job.error, job.status = str(error), "failed"
                job.finished_at = utc_now().isoformat()

        InheritableThread(target=work, daemon=True).start()
        return job

    def get(self, key: str) -> Job | None:
        return self._jobs.get(key)

    def all(self) -> list[Job]:
        return list(self._jobs.values())
