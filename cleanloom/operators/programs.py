"""Pandas programs of a plan: guarded, then run over Arrow batches of rows, in a process with limits.

A program is one function transform(df).  It sees a batch at a time, in no given order, so it must be a
function of each row alone; what needs the whole column is an action or an expression.  Each task
runs it in a child process of its own, which can open no file for writing, no socket and no process, and
is ended when a batch takes too much time or memory.
"""

from __future__ import annotations

import builtins
import multiprocessing
import resource
import socket
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.connection import Connection

from pyspark.sql import DataFrame

from cleanloom.operators import guard

#: What a program may call besides pandas and numpy.
BUILTINS = ("len", "str", "int", "float", "bool", "range", "min", "max", "abs", "round", "list", "dict", "set", "tuple", "sorted", "enumerate", "zip", "any", "all", "sum", "isinstance", "True", "False", "None")


@dataclass(frozen=True)
class Limits:
    """Seconds that a batch may take, and bytes that the program may take beyond what the process has."""

    seconds: float = 30.0
    memory: int = 1 << 30


class ProgramError(RuntimeError):
    """A program failed or went beyond its limits."""


def _no_network(*_args, **_kwargs):
    raise PermissionError("a program has no network")


class _NoSocket(socket.socket):
    __init__ = _no_network


def _confine(limits: Limits) -> None:
    with open("/proc/self/statm") as f:
        held = int(f.read().split()[0]) * resource.getpagesize()
    for what, most in ((resource.RLIMIT_AS, held + limits.memory), (resource.RLIMIT_FSIZE, 0), (resource.RLIMIT_CORE, 0)):
        resource.setrlimit(what, (most, most))
    socket.socket, socket.create_connection, socket.getaddrinfo = _NoSocket, _no_network, _no_network


def _serve(calls: Connection, code: str, limits: Limits) -> None:
    """The child: confines itself, then answers a batch with the batch after the program, or with what went wrong."""
    import numpy as np
    import pandas as pd

    _confine(limits)
    scope = {"__builtins__": {n: getattr(builtins, n) for n in BUILTINS if hasattr(builtins, n)}, "pd": pd, "np": np}
    exec(compile(code, "<program>", "exec"), scope)  # noqa: S102
    while (batch := calls.recv()) is not None:
        try:
            calls.send((scope["transform"](batch), None))
        except BaseException as e:  # the parent says it
            calls.send((None, f"{type(e).__name__}: {e}"))


class Confined:
    """A program in its child process."""

    def __init__(self, code: str, limits: Limits):
        self.limits = limits
        fork = multiprocessing.get_context("fork")
        self.calls, theirs = fork.Pipe()
        self.child = fork.Process(target=_serve, args=(theirs, code, limits), daemon=True)
        self.child.start()
        theirs.close()

    def __call__(self, batch):
        try:
            self.calls.send(batch)
            if not self.calls.poll(self.limits.seconds):
                raise ProgramError(f"the program took more than {self.limits.seconds:g} seconds for a batch")
            out, wrong = self.calls.recv()
        except (EOFError, BrokenPipeError, ConnectionResetError) as e:
            raise ProgramError("the program's process ended; it may have taken too much memory") from e
        if wrong:
            raise ProgramError(wrong)
        return out

    def close(self) -> None:
        self.child.kill()
        self.child.join()
        self.calls.close()


def transformed(df: DataFrame, code: str, types: dict[str, str] | None = None, limits: Limits | None = None) -> DataFrame:
    """df after the program, same columns; types names those of another type than before.

    A program that adds or drops rows of a batch fails the run, as plans keep every row.
    """
    report = guard.check_program(code)
    if not report.ok:
        raise PermissionError("; ".join(report.violations))
    names, limits = df.columns, limits or Limits()
    schema = ", ".join(f"`{f.name}` {(types or {}).get(f.name, f.dataType.simpleString())}" for f in df.schema)

    def run(batches: Iterator) -> Iterator:
        program = Confined(code, limits)
        try:
            for b in batches:
                out = program(b)
                if len(out) != len(b):
                    raise ProgramError(f"the program made {len(out)} rows of {len(b)}")
                yield out[names]
        finally:
            program.close()

    return df.mapInPandas(run, schema)
