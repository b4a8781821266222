"""Approved plans, kept by source and schema fingerprint as small JSON files."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
from pathlib import Path
from typing import Any
from urllib.parse import quote

from cleanloom.functions.text import snake

KEPT = 5


def signature(profile: dict[str, dict]) -> list[str]:
    """name:family of each column, sorted; stable while names and families are."""
    return sorted(f"{snake(c)}:{p.get('dominant_family', 'null')}" for c, p in profile.items() if c != "_id")


def fingerprint(profile: dict[str, dict]) -> str:
    return hashlib.sha256(json.dumps(signature(profile)).encode()).hexdigest()[:16]


def overlap(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def similarity(a: list[str], b: list[str]) -> float:
    """0.7 of the shared columns with their families, 0.3 of the shared names."""
    names = [{x.split(":")[0] for x in s} for s in (a, b)]
    return round(0.7 * overlap(set(a), set(b)) + 0.3 * overlap(*names), 4)


def slim(profile: dict[str, dict]) -> dict[str, dict]:
    return {c: {k: p.get(k) for k in ("dominant_family", "null_ratio", "distinct", "top_values", "categories", "families")} for c, p in profile.items()}


class Memory:
    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _path(self, kind: str, source: str, key: str) -> Path:
        return self.folder / kind / quote(source, safe="") / f"{key}.json"

    @staticmethod
    def _read(path: Path) -> dict[str, Any] | None:
        return json.loads(path.read_text()) if path.exists() else None

    @staticmethod
    def _write(path: Path, value: dict[str, Any]) -> None:
        """Whole or not at all."""
        path.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=path.parent)
        with os.fdopen(handle, "w") as f:
            json.dump(value, f, default=str)
        os.replace(name, path)

    def get(self, source: str, key: str) -> dict[str, Any] | None:
        found = self._read(self._path("plans", source, key))
        return found if found and found["status"] == "active" else None

    def all(self) -> list[dict[str, Any]]:
        return [x for p in sorted((self.folder / "plans").glob("*/*.json")) if (x := self._read(p))]

    def similar(self, profile: dict[str, dict], least: float, but: tuple[str, str] | None = None) -> tuple[dict | None, float]:
        """The active entry whose signature is most alike, if it is at least `least`."""
        own, best, score = signature(profile), None, 0.0
        for x in self.all():
            if x["status"] == "active" and (x["source"], x["fingerprint"]) != but:
                s = similarity(own, x["signature"])
                if s > score:
                    best, score = x, s
        return (best if score >= least else None), score

    def baseline(self, source: str) -> dict[str, dict] | None:
        found = self._read(self._path("baselines", source, "latest"))
        return found["profile"] if found else None

    def save(self, source: str, profile: dict, plan: dict, program: str, approved_by: str, run_id: str, artifacts: dict | None = None) -> dict[str, Any]:
        key = fingerprint(profile)
        path = self._path("plans", source, key)
        old = self._read(path)
        past = [*old["history"], {k: old[k] for k in ("version", "plan", "program", "approved_by", "saved_at", "run_id")}][-KEPT:] if old else []
        value = {
            "source": source, "fingerprint": key, "signature": signature(profile), "plan": plan, "program": program, "program_sha256": hashlib.sha256(program.encode()).hexdigest(),
            "artifacts": artifacts or {}, "approved_by": approved_by, "run_id": run_id, "version": old["version"] + 1 if old else 1, "saved_at": time.strftime("%Y-%m-%dT%H:%M:%S"),
            "status": "active", "uses": 0, "failures": 0, "history": past,
        }
        self._write(path, value)
        self.rebase(source, profile)
        return value

    def rebase(self, source: str, profile: dict) -> None:
        self._write(self._path("baselines", source, "latest"), {"profile": slim(profile), "fingerprint": fingerprint(profile)})

    def _change(self, source: str, key: str, **new: Any) -> None:
        path = self._path("plans", source, key)
        old = self._read(path)
        if old:
            self._write(path, old | {k: v(old) if callable(v) else v for k, v in new.items()})

    def record_use(self, source: str, key: str, profile: dict | None = None) -> None:
        self._change(source, key, uses=lambda x: x["uses"] + 1, last_used_at=time.strftime("%Y-%m-%dT%H:%M:%S"))
        if profile is not None:
            self.rebase(source, profile)

    def demote(self, source: str, key: str, reason: str) -> None:
        self._change(source, key, status="demoted", failures=lambda x: x["failures"] + 1, demoted_reason=reason[:300])
