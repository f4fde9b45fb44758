"""Jobs: a pipeline run in the background, with a state that can be asked for."""

from __future__ import annotations

import datetime
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..plans.pipeline import PARSERS, Pipeline
from ..sources.documents import Decoder, read_output
from ..sources.shared import remove

#: Formats that a job can write.
FORMATS = ("csv", "json")
#: Of the way that a running job's progress has left, each finished stage takes this share, as nobody knows how many follow.
STEP = 0.06


class UnknownJob(KeyError):
    """There is no job of that id."""


class NoOutput(ValueError):
    """The job has no output, or not yet."""


@dataclass(frozen=True)
class Job:
    id: str
    path: str
    status: str = "pending"
    progress: int = 0
    created_at: datetime.datetime = field(default_factory=datetime.datetime.now)
    kind: str = "csv"
    output: str | None = None
    rows: int = 0
    error: str | None = None


class JobManager:
    """Runs jobs on one session; each has its own name for its output, and a tag by which it can be interrupted and followed."""

    def __init__(self, spark: SparkSession, folder: str, workers: int = 2):
        self.spark, self.folder = spark, folder
        self.pool, self.lock, self.jobs = ThreadPoolExecutor(workers), threading.Lock(), {}

    def _set(self, key: str, **to: object) -> None:
        with self.lock:
            if key in self.jobs:
                self.jobs[key] = replace(self.jobs[key], **to)

    def submit(self, path: str, parser: str | None = None, kind: str = "csv", decode: Decoder | None = None) -> str:
        job = Job(uuid.uuid4().hex[:8], path, kind=kind if kind in FORMATS else "csv")
        with self.lock:
            self.jobs[job.id] = job
        self.pool.submit(self._run, job.id, path, parser, job.kind, decode)
        return job.id

    def _run(self, key: str, path: str, parser: str | None, kind: str, decode: Decoder | None) -> None:
        self._set(key, status="processing", progress=10)
        try:
            self.spark.addTag(key)
            self.spark.sparkContext.addJobTag(key)
            result = Pipeline(parser=parser).process_file(self.spark, path, f"{self.folder}/{key}", kind, decode)
            row = result.stats.first()
            self._set(key, status="completed", progress=100, output=result.output, rows=row["rows_output"])
        except Exception as e:  # noqa: BLE001  the job's result is its error
            self._set(key, status="failed", error=str(e)[:1000])
        finally:
            self.spark.removeTag(key)
            self.spark.sparkContext.removeJobTag(key)

    def _stages_done(self, key: str) -> float:
        """Stages of the job's Spark jobs that have ended, and the share of those that run; Spark's status tracker is asked."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = list(self.spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(key))
        stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        told = [x for s in stages if (x := tracker.getStageInfo(s)) and x.numTasks]
        return sum(x.numCompletedTasks / x.numTasks for x in told)

    def get(self, key: str) -> Job:
        """A job as it is now. Between 10 and 90 its progress rises with the stages that end."""
        with self.lock:
            job = self.jobs.get(key)
        if job is None:
            raise UnknownJob(key)
        if job.status != "processing":
            return job
        reached = max(job.progress, 10 + int(80 * (1 - (1 - STEP) ** self._stages_done(key))))  # the tracker forgets old stages
        with self.lock:
            now = self.jobs.get(key, job)
            if now.status == "processing" and now.progress < reached:
                now = self.jobs[key] = replace(now, progress=reached)
        return now

    def list(self) -> list[Job]:
        """All jobs, the latest first."""
        with self.lock:
            keys = [j.id for j in sorted(self.jobs.values(), key=lambda j: j.created_at, reverse=True)]
        return [self.get(k) for k in keys if k in self.jobs]

    def cancel(self, key: str) -> None:
        self.spark.interruptTag(key)

    def delete(self, key: str) -> None:
        """Forget a job and remove its output."""
        with self.lock:
            job = self.jobs.pop(key, None)
        if job is None:
            raise UnknownJob(key)
        if job.output:
            remove(self.spark, job.output)

    def download(self, key: str) -> str:
        """Path of a completed job's output; an unknown job, and one without output, are errors of their own."""
        job = self.get(key)
        if job.status != "completed" or not job.output:
            raise NoOutput(f"job {key} has no output; it is {job.status}")
        return job.output

    def preview(self, key: str, limit: int = 20) -> DataFrame:
        """The first rows of a completed job's output, without internal columns."""
        return read_output(self.spark, self.download(key), self.get(key).kind, limit)


def catalog() -> dict[str, list[str]]:
    return {"parsers": ["auto", *PARSERS], "formats": list(FORMATS)}
