"""Background jobs of one driver: start, progress, result; and what their messages show."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Job:
    id: str
    kind: str
    status: str = "running"
    progress: dict = field(default_factory=dict)
    result: object = None
    error: str | None = None
    start: float = field(default_factory=time.time)
    end: float | None = None


class Jobs:
    """The jobs of a process; of those that have ended, the last `keep` stay."""

    def __init__(self, keep: int = 10):
        self.keep, self._jobs, self._lock = keep, {}, threading.Lock()

    def start(self, kind: str, work: Callable[[Callable], object]) -> str:
        """Run work(report) in a thread; report(phase, current, total) updates the progress."""
        job = Job(uuid.uuid4().hex, kind)
        with self._lock:
            self._jobs[job.id] = job
        threading.Thread(target=self._run, args=(job, work), daemon=True).start()
        return job.id

    def _run(self, job: Job, work: Callable) -> None:
        try:
            job.result = work(lambda phase, current, total: job.progress.update(progress(phase, current, total, time.time() - job.start)))
            job.status = "completed"
        except Exception as e:
            job.error, job.status = str(e), "failed"
        job.end = time.time()
        with self._lock:
            ended = sorted((j for j in self._jobs.values() if j.end is not None), key=lambda j: j.start, reverse=True)
            for old in ended[self.keep :]:
                del self._jobs[old.id]

    def get(self, id_: str) -> Job | None:
        return self._jobs.get(id_)

    def running(self, kind: str | None = None) -> list[Job]:
        return [j for j in self._jobs.values() if j.end is None and kind in (None, j.kind)]

    def all(self) -> list[Job]:
        return sorted(self._jobs.values(), key=lambda j: j.start, reverse=True)


def progress(phase: str, current: int, total: int, seconds: float) -> dict:
    """Percentage, speed and remaining seconds of a phase."""
    speed = current / seconds if seconds > 0 else 0.0
    return {
        "phase": phase, "current": current, "total": total, "percentage": 100 * current / total if total else 0.0, "speed": speed,
        "eta": (total - current) / speed if speed else None
    }


def bar(current: int, total: int, width: int = 40) -> str:
    share = current / total if total else 0.0
    full = int(share * width)
    return "█" * full + "░" * (width - full) + f" {share * 100:.1f}%"


def format_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB"):
        if n < 1024:
            return f"{n:.0f}{unit}" if unit == "B" else f"{n:.1f}{unit}"
        n /= 1024
    return f"{n:.1f}GB"


def tier(done: int, total: int) -> str:
    """How a finished run is reported: partial successes from 95 % on count as success with warnings."""
    share = done / total if total else 0.0
    return "success" if done == total and total else "warning" if share >= 0.95 else "partial" if done else "failed"
