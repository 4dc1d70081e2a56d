"""Calling a converter in a child process with a deadline for each part.

Parts that take next to no time are given in groups, which grow while they do, as most of the time would
go into calls otherwise. A group shares one deadline, and after a fault in it each of its parts is called
alone, so it may run a second time, and results are those of calls part by part.

A converter that hangs, ends its process or eats memory then costs the one part it was given, not the
Spark task: the child is killed or found dead, the part is timed out or lost, and another child goes on
with the part after it. X4 decides what becomes of the part.
"""

from __future__ import annotations

import ctypes
import multiprocessing
import os
import resource
import signal
import time
from collections.abc import Callable

import pandas as pd

Result = tuple[str | None, str, list[str]]

#: A group takes no longer than this, if its parts take as long as those before, and has no more parts.
GROUP_SECONDS, GROUP_PARTS = 0.05, 1024


def call(converter: Callable, part: pd.DataFrame) -> Result:
    """The converter's result for one part; what it raises is a failure."""
    try:
        found = list(converter(part))
        if len(found) != 1:
            raise ValueError(f"converter returned {len(found)} results for 1 part")
        markdown, status, errors = found[0]
        return markdown, status, list(errors)
    except Exception as error:  # noqa: BLE001  a converter's fault is a result, not the job's end
        return None, "failure", [f"{type(error).__name__}: {error}"]


def _call_group(converter: Callable, parts: pd.DataFrame) -> list[Result] | None:
    """The converter's results for several parts; None if it raises or returns another number of them."""
    try:
        found = [(markdown, status, list(errors)) for markdown, status, errors in converter(parts)]
    except Exception:  # noqa: BLE001  found out part by part
        return None
    return found if len(found) == len(parts) else None


def _serve(converter: Callable, batch: pd.DataFrame, told, memory: int | None, alone: int) -> None:
    """In the child: how many parts a group has, then their results, one group after another; the first alone parts are each called alone."""
    os.setsid()  # what the converter starts dies with it
    ctypes.CDLL(None).prctl(1, signal.SIGKILL)  # PR_SET_PDEATHSIG: nor does it outlive the worker
    if memory is not None:
        with open("/proc/self/statm") as f:
            used = int(f.read().split()[0]) * resource.getpagesize()
        resource.setrlimit(resource.RLIMIT_AS, (used + memory, used + memory))
    n, size = 0, 1
    while n < len(batch):
        parts = batch.iloc[n : n + (1 if n < alone else size)]
        told.send(len(parts))
        start = time.monotonic()
        results = [call(converter, parts)] if len(parts) == 1 else _call_group(converter, parts)
        took = time.monotonic() - start
        if results is None:
            alone = n + len(parts)
            told.send([])
            continue
        told.send(results)
        n += len(parts)
        size = min(2 * len(parts), GROUP_PARTS) if 2 * took < GROUP_SECONDS else max(1, int(len(parts) * GROUP_SECONDS / (2 * took)))


def convert_isolated(converter: Callable, batch: pd.DataFrame, deadline: float, memory: int | None = None) -> list[Result]:
    """Results of the parts of batch in order; deadline is in seconds for each part, memory in bytes that a converter may take beyond the worker's."""
    context = multiprocessing.get_context("fork")  # a converter need not be importable where it runs
    out: list[Result] = []
    alone = 0  # parts before this one are called alone
    while len(out) < len(batch):
        hears, tells = context.Pipe(duplex=False)
        child = context.Process(target=_serve, args=(converter, batch.iloc[len(out) :], tells, memory, max(0, alone - len(out))), daemon=False)
        child.start()
        tells.close()
        group = 1
        try:
            while len(out) < len(batch):
                group = hears.recv()
                if not hears.poll(deadline):
                    fault = (None, "timed_out", [f"no result within {deadline:g} seconds"])
                    break
                out += hears.recv()
                group = 1
        except (EOFError, OSError):
            child.join()
            fault = (None, "lost", [f"the converter's process ended with {child.exitcode}"])
        finally:
            if child.is_alive():
                try:
                    os.killpg(child.pid, signal.SIGKILL)
                except ProcessLookupError:
                    child.kill()
            child.join()
            hears.close()
        if group > 1:
            alone = len(out) + group
        elif len(out) < len(batch):
            out.append(fault)
    return out
