"""Memory of a run: a trace of the driver's processes, peaks, and the executors' storage."""

from __future__ import annotations

import os
import resource
import threading
import time
from pathlib import Path
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession


def _processes(root: int) -> list[int]:
    """A process and all below it."""
    children: dict[int, list[int]] = {}
    for p in Path("/proc").iterdir():
        if p.name.isdigit():
            try:
                parent = int((p / "stat").read_text().rpartition(")")[2].split()[1])
            except (OSError, IndexError, ValueError):
                continue
            children.setdefault(parent, []).append(int(p.name))
    todo, out = [root], []
    while todo:
        out.append(todo.pop())
        todo += children.get(out[-1], [])
    return out


def rss_bytes(root: int | None = None) -> int:
    """Resident memory of a process and all below it; 0 where the system doesn't tell."""
    total = 0
    for pid in _processes(root or os.getpid()) if Path("/proc").is_dir() else []:
        try:
            total += int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")
        except (OSError, IndexError, ValueError):
            continue
    return total


def peak_mb() -> dict[str, float]:
    """Greatest resident memory so far, of this process and of the largest one it has waited for."""
    return {"self": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, "children": resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss / 1024}


class RssTrace:
    """While entered, writes ``seconds,rss_gib`` lines of this process and those below it (in local mode all of Spark)."""

    def __init__(self, path: str, interval: float = 0.1):
        self.path, self.interval, self.peak = path, interval, 0
        self._stop = threading.Event()

    def _run(self) -> None:
        began = time.perf_counter()
        with open(self.path, "w") as f:
            f.write("seconds,rss_gib\n")
            while True:
                now = rss_bytes()
                self.peak = max(self.peak, now)
                f.write(f"{time.perf_counter() - began:.3f},{now / 2**30:.4f}\n")
                f.flush()
                if self._stop.wait(self.interval):
                    return

    def __enter__(self) -> RssTrace:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self._stop.set()
        self._thread.join()


def memory_report(spark: SparkSession) -> DataFrame:
    """``executor``, ``max_mb``, ``free_mb`` of storage memory."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    it, rows = status.iterator(), []
    while it.hasNext():
        e = it.next()
        rows.append((e._1(), e._2()._1() / 2**20, e._2()._2() / 2**20))
    return spark.createDataFrame(rows, "executor string, max_mb double, free_mb double")
