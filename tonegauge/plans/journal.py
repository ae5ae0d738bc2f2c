"""What a run has finished, so that any later run can go on from there.

    <path>/run=<number>/<step>      one small file per finished step, with a mark of its input

A step is entered after its output is committed, in one atomic creation. A run without its last step is
unfinished; runs are numbered one up and only the newest one can be. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Run:
    number: int
    done: dict[str, str]  # finished steps and their marks


class RunJournal:
    def __init__(self, spark: SparkSession, path: str, steps: tuple[str, ...]):
        self.spark, self.path, self.steps = spark, path.rstrip("/"), steps

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        folder, fs = self._hadoop(path)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def _mark(self, number: int, step: str) -> str:
        file, fs = self._hadoop(f"{self.path}/run={number}/{step}")
        with_text = fs.open(file)
        try:
            return with_text.readUTF()
        finally:
            with_text.close()

    def newest(self) -> Run | None:
        numbers = [int(n.removeprefix("run=")) for n in self._names(self.path) if n.startswith("run=")]
        if not numbers:
            return None
        number = max(numbers)
        entered = set(self._names(f"{self.path}/run={number}"))
        return Run(number, {step: self._mark(number, step) for step in self.steps if step in entered})

    def current(self) -> Run:
        """The unfinished run, or a new one."""
        run = self.newest()
        if run is None or self.steps[-1] in run.done:
            return Run(0 if run is None else run.number + 1, {})
        return run

    def enter(self, run: Run, step: str, mark: str = "") -> Run:
        """Note a finished step; entering it twice is an error of the caller."""
        # Written aside and renamed: a file that is there is whole.
        aside, fs = self._hadoop(f"{self.path}/run={run.number}/.{step}")
        out = fs.create(aside, True)
        out.writeUTF(mark)
        out.close()
        if not fs.rename(aside, self._hadoop(f"{self.path}/run={run.number}/{step}")[0]):
            raise FileExistsError(f"step {step} of run {run.number} is already entered")
        return Run(run.number, {**run.done, step: mark})

    def step(self, run: Run, name: str, work: Callable[[], str | None]) -> Run:
        """Do a step unless it is done."""
        return run if name in run.done else self.enter(run, name, work() or "")
