"""Text recognition by an external program: one long-lived process for each task, fed in batches over a pipe.

The program reads a path a line and answers `path<TAB>text` in the order asked, a batch being sent only when the one
before has been answered, so neither side's pipe fills up. A path that it leaves out, answers without a tab, or doesn't
answer in time has the text ''. If the program ends, the path that it was at has '', and a new process goes on with the
next one; so does a task that is run again elsewhere, from its beginning.
"""

from __future__ import annotations

import queue
import subprocess
import threading
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


class Program:
    """A recogniser process that is started when needed, and again if it ends."""

    def __init__(self, command: Sequence[str], timeout_s: float) -> None:
        self.command, self.timeout = list(command), timeout_s
        self.process: subprocess.Popen | None = None
        self.starts = 0

    def _start(self) -> subprocess.Popen:
        if self.process is None:
            self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, encoding="utf-8", errors="replace")
            self.lines: queue.Queue[str | None] = queue.Queue()
            threading.Thread(target=self._listen, args=(self.process, self.lines), daemon=True).start()
            self.starts += 1
        return self.process

    @staticmethod
    def _listen(process: subprocess.Popen, lines: queue.Queue) -> None:
        for line in process.stdout:
            lines.put(line.rstrip("\r\n"))
        lines.put(None)

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.wait()
            self.process = None

    def read(self, paths: list[str]) -> list[str]:
        """The texts of paths."""
        found: dict[int, str] = {}
        at = 0
        while at < len(paths):
            process = self._start()
            try:
                process.stdin.write("".join(f"{p}\n" for p in paths[at:]))
                process.stdin.flush()
            except OSError:  # it has ended; what it still said is read below
                pass
            while at < len(paths):
                try:
                    line = self.lines.get(timeout=self.timeout)
                except queue.Empty:
                    line = None
                if line is None:
                    self.close()
                    at += 1
                    break
                path, tab, text = line.partition("\t")
                if tab and path in paths[at:]:
                    at = paths.index(path, at)
                    found[at] = text
                    at += 1
                elif not tab and path == paths[at]:
                    at += 1
        return [found.get(k, "") for k in range(len(paths))]


def recognised(frames: DataFrame, command: Sequence[str], path_col: str = "path", batch: int = 64, timeout_s: float = 60.0) -> DataFrame:
    """frames with raw, the text that the program reads at each path; rows keep their order. A null path has ''."""
    names = frames.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program(command, timeout_s)
        try:
            for b in batches:
                for low in range(0, b.num_rows, batch):
                    part = b.slice(low, batch)
                    paths = part.column(names.index(path_col)).to_pylist()
                    texts = iter(program.read([p for p in paths if p is not None]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(["" if p is None else next(texts) for p in paths], pa.string())], names=[*names, "raw"])
        finally:
            program.close()

    return frames.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in frames.dtypes), "raw string"]))
