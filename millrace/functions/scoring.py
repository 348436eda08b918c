"""Scores of one model response: Column in, Column out."""

from __future__ import annotations

import json
import subprocess
import sys
import tempfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from queue import SimpleQueue

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import has_keyword, let, strip, text_of


def matched(response: Column | str, concepts: Column) -> Column:
    """The concepts that the response holds as plain substrings, without case."""
    asked = F.coalesce(concepts, F.array().cast("array<string>"))
    return let(F.lower(text_of(response)), lambda t: F.filter(asked, lambda c: F.contains(t, F.lower(c))))


def concept_score(response: Column | str, required: Column, forbidden: Column) -> Column:
    """Share of required concepts (1 if none are asked for) less a half for each forbidden one, within 0 and 1, to four
    digits."""
    n = F.size(F.coalesce(required, F.array().cast("array<string>")))
    share = F.when(n > 0, F.size(matched(response, required)) / n).otherwise(F.lit(1.0))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share - 0.5 * F.size(matched(response, forbidden)))), 4)


def last_number(col: Column | str) -> Column:
    """The last whole number, trailing dots left off; null without one."""
    t = F.regexp_replace(strip(col), r"\.+$", "")
    return F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?U)\b\d+\b"), 0), F.lit(-1))


def number_correct(col: Column | str, expected: Column) -> Column:
    e = expected.cast("string")
    return F.coalesce(has_keyword(col, F.array(e)) | (last_number(col) == e) | F.contains(text_of(col), e), F.lit(False))


# Words taken for a direction.
EAST, WEST = ("east", "rise", "coming up", "sunrise"), ("west", "set", "going down", "sunset")


def direction_correct(col: Column | str, expected: Column) -> Column:
    said = lambda ks: has_keyword(col, F.array(*[F.lit(k) for k in ks]))
    return F.when(expected == "east", said(EAST)).when(expected == "west", said(WEST)).otherwise(F.lit(False))


def runs_while_asleep(col: Column | str) -> Column:
    """The flag for a continuation that has the sleeper running."""
    t = F.lower(text_of(col))
    return F.contains(t, F.lit("running")) & ~F.contains(t, F.lit("sleep"))


def first_word_matches(col: Column | str, expected: Column) -> Column:
    first = F.get(F.split(strip(col), r"\s+"), F.lit(0))
    return F.contains(F.lower(F.coalesce(first, F.lit(""))), F.lower(expected))


def code_of(completion: Column | str, entry_point: Column) -> Column:
    """The code in a completion: the fenced block that defines ``entry_point``, else the first fenced block; without a
    fence the lines from the definition on up to a heading or an explanation; else all of it."""
    t = text_of(completion)
    start = F.concat(F.lit("def "), entry_point)
    blocks = F.regexp_extract_all(t, F.lit(r"(?si)```(?:python)?\s*(.*?)\s*```"), 1)
    best = F.coalesce(F.get(F.filter(blocks, lambda b: F.contains(b, start)), F.lit(0)), F.get(blocks, F.lit(0)))
    lines = F.split(t, "\n")
    holds = F.transform(lines, lambda x: F.contains(x, start))
    at = F.array_position(holds, F.lit(True)).cast("int")
    tail = F.slice(lines, F.greatest(at, F.lit(1)), F.greatest(F.size(lines), F.lit(1)))
    ends = F.transform(tail, lambda x: F.startswith(x, F.lit("# ")) | F.startswith(x, F.lit("## ")) | F.startswith(x, F.lit("Explanation:")))
    stop = F.array_position(ends, F.lit(True)).cast("int")
    body = F.array_join(F.when(stop > 0, F.slice(tail, F.lit(1), stop - 1)).otherwise(tail), "\n")
    return F.when(F.size(blocks) > 0, best).when((at > 0) & (stop != 1), body).otherwise(strip(t))


#: Reads paths of scripts and time limits, a line each, and answers with the exit code (null if time ran out) and the last
#: line of the script's errors. Each script runs in a fork of this process, which ends as an interpreter of its own does.
_RUNNER = """
import gc, json, os, select, signal, sys
gc.freeze()
for line in sys.stdin:
    path, limit = json.loads(line)
    folder = os.path.dirname(path)
    pid = os.fork()
    if not pid:
        os.setsid()
        os.chdir(folder)
        null, err = os.open(os.devnull, os.O_RDWR), os.open(path + '.err', os.O_WRONLY | os.O_CREAT)
        os.dup2(null, 0), os.dup2(null, 1), os.dup2(err, 2)
        os.close(null), os.close(err)
        sys.stdin, sys.argv = open(0, closefd=False), [path]
        break
    fd = os.pidfd_open(pid)
    ended = select.select([fd], [], [], limit)[0]
    if not ended:
        os.kill(pid, signal.SIGKILL)
    os.close(fd)
    code = os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1])
    with open(path + '.err', errors='replace') if os.path.exists(path + '.err') else open(os.devnull) as f:
        said = f.read().strip().splitlines()
    print(json.dumps([code if ended else None, said[-1] if said else '']), flush=True)
else:
    os._exit(0)
with open(path, encoding='utf-8') as f:
    source = f.read()
for name in [n for n in globals() if n[:2] != '__' and n not in ('path', 'source')]:
    del globals()[name]
del name
__file__ = path
exec(compile(source, globals().pop('path'), 'exec', dont_inherit=True), (globals().pop('source'), globals())[1])
"""


class _Runner:
    """An interpreter that is started once and forks for each script; starting one takes longer than most scripts run."""

    def __init__(self) -> None:
        self.process = subprocess.Popen([sys.executable, "-I", "-c", _RUNNER], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)

    def run(self, path: Path, timeout: float) -> tuple[int | None, str]:
        self.process.stdin.write(json.dumps([str(path), timeout]) + "\n")
        self.process.stdin.flush()
        answer = self.process.stdout.readline()
        if not answer:
            raise RuntimeError("the interpreter that runs the scripts has ended")
        return tuple(json.loads(answer))

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait()
        self.process.stdout.close()


def run_code(df: DataFrame, code: str, tests: str, *, trusted: bool = False, timeout: float = 3.0, at_once: int = 2) -> DataFrame:
    """``df`` with passed and message: each row's code and tests run in a process of their own, ``at_once`` of them a task.

    The code runs with the rights of the executor. It is refused unless the caller says that it is ``trusted``.
    """
    if not trusted:
        raise PermissionError("code is run only with trusted=True")

    def one(runners: SimpleQueue, source: str, checks: str) -> tuple[bool, str]:
        runner = runners.get()
        try:
            with tempfile.TemporaryDirectory() as d:
                script = Path(d, "candidate.py")
                script.write_text(f"{source or ''}\n\n{checks or ''}\n", encoding="utf-8")
                status, said = runner.run(script, timeout)
        finally:
            runners.put(runner)
        if status is None:
            return False, f"Timeout after {timeout}s"
        return status == 0, "OK" if status == 0 else said or "failed"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started = [_Runner() for _ in range(at_once)]
        runners: SimpleQueue = SimpleQueue()
        for runner in started:
            runners.put(runner)
        try:
            for pdf in batches:
                with ThreadPoolExecutor(at_once) as pool:
                    results = list(pool.map(lambda c, t: one(runners, c, t), pdf[code], pdf[tests]))
                yield pdf.assign(passed=[r[0] for r in results], message=[r[1] for r in results])
        finally:
            for runner in started:
                runner.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, fields + ", passed boolean, message string")
