"""python -m cleanloom run SOURCE | profile SOURCE | resume RUN ACTION | memory | guard FILE | trial"""

from __future__ import annotations

import argparse
import json
import sys

from cleanloom.operators import datagen, guard, issues
from cleanloom.operators.profile import compact, profile
from cleanloom.plans import trial
from cleanloom.plans.engine import Engine, Result
from cleanloom.plans.memory import Memory
from cleanloom.plans.model import Settings
from cleanloom.sources import spec, tables


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("cleanloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def told(result: Result) -> int:
    for e in result.state["events"]:
        print(f"{e['node']}: {e['msg']}")
    print(f"{result.run_id}: {result.status}" + (f", {result.state['output']}" if result.state.get("output") else ""))
    if result.review:
        print(json.dumps(result.review, indent=2, default=str))
    return 0 if result.status == "succeeded" else 1


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cleanloom", description=__doc__)
    parser.add_argument("--folder", default=Settings.folder)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "profile"):
        c = commands.add_parser(name)
        c.add_argument("source")
        c.add_argument("--target", help="a JSON file with the target schema")
    c = commands.add_parser("resume")
    c.add_argument("run_id")
    c.add_argument("action", choices=("approve", "reject", "edit"))
    c.add_argument("--plan", help="a JSON file with the edited plan")
    commands.add_parser("memory")
    c = commands.add_parser("trial", help="clean generated messy tables of all domains and report")
    c.add_argument("--rows", type=int, default=2000)
    c.add_argument("--domain", action="append", choices=tuple(datagen.DOMAINS))
    commands.add_parser("guard").add_argument("file")
    a = parser.parse_args(args)
    read = lambda path: json.load(open(path)) if path else None  # noqa: E731, SIM115
    if a.command == "memory":
        for x in Memory(f"{a.folder}/memory").all():
            print(f"{x['source']} {x['fingerprint']} version {x['version']} {x['status']}, used {x['uses']} times")
        return 0
    if a.command == "guard":
        with open(a.file) as f:
            report = guard.check_pipeline(json.load(f)) if a.file.endswith(".json") else guard.check_program(f.read())
        print("\n".join(report.violations) or "allowed")
        return int(not report.ok)
    spark = session()
    if a.command == "profile":
        p = profile(tables.ingest(spark, spec.parse(a.source)).sample)
        print(json.dumps({"columns": compact(p), "issues": issues.detect(p, read(a.target))}, indent=2, default=str))
        return 0
    if a.command == "trial":
        records, cells = trial.trial(spark, tables.scratch(spark, "trial"), a.rows, domains=tuple(a.domain or datagen.DOMAINS))
        print(trial.rendered(trial.summary(records, cells)))
        for r in [*trial.by_kind(cells).orderBy("kind", "pass").collect(), *trial.reasons(records).collect()]:
            print(" ".join(map(str, r)))
        return 0
    engine = Engine(spark, Settings(folder=a.folder))
    return told(engine.run(a.source, read(a.target)) if a.command == "run" else engine.resume(a.run_id, {"action": a.action, "plan": read(a.plan)}))


if __name__ == "__main__":
    sys.exit(main())
