"""Command line: scan, context, layer, expand, start, report, gate (init, check, diff), watch, serve, language server."""

from __future__ import annotations

import argparse
import json
import sys

from cairn import ci
from cairn.engine import Engine
from cairn.functions.text import PROFILES
from cairn.service import Service
from cairn.session import local_session
from cairn.sources import scan

def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cairn", description=__doc__)
    p.add_argument("command", choices=["scan", "context", "layer", "focus", "expand", "start", "advise", "view", "init", "check", "diff", "report", "watch", "serve", "lsp"])
    p.add_argument("root")
    p.add_argument("--task", default="")
    p.add_argument("--symbol", default="")
    p.add_argument("--budget", type=int, default=4096)
    p.add_argument("--profile", default="custom", choices=[*PROFILES, "custom"])
    p.add_argument("--tier", default="all", choices=["all", "critical", "workflow", "support"])
    p.add_argument("--staged", nargs="*", default=[])
    p.add_argument("--form", default="compact", choices=["compact", "json", "xml", "markdown"])
    p.add_argument("--out", default="")
    p.add_argument("--baseline", default=".cairn-baseline")
    a = p.parse_args(argv)
    spark = local_session()
    engine = Engine.from_path(spark, a.root)
    budget = PROFILES.get(a.profile, a.budget)
    say = lambda text: scan.write_text(spark, text, a.out) if a.out else print(text)
    if a.command == "scan":
        if a.out:
            scan.write_graph(engine.tables(), a.out)
        print(engine.statistics().toJSON().first())
    elif a.command == "context":
        say(engine.context(a.task, budget, a.form))
    elif a.command == "layer":
        say(json.dumps(engine.context_layer(a.task, a.tier, budget)))
    elif a.command == "focus":
        say(engine.focused_context(a.task, budget))
    elif a.command == "expand":
        print("\n".join(engine.symbol_context(a.symbol).toJSON().collect()))
    elif a.command == "start":
        print(engine.smart_start(a.task).toJSON().first())
    elif a.command == "advise":
        print("\n".join(r.id for r in engine.not_staged(a.task, a.staged, budget).collect()))
    elif a.command == "view":
        say(scan.render_html(engine.bundle()))
    elif a.command == "init":
        ci.take_snapshot(engine, a.baseline)
    elif a.command in ("check", "diff", "report"):
        old = spark.read.parquet(a.baseline)
        ci.take_snapshot(engine, f"{a.baseline}-now")
        new = spark.read.parquet(f"{a.baseline}-now")
        changes = ci.compare_snapshots(old, new)
        if a.command == "diff":
            print("\n".join(changes.orderBy("kind", "key").limit(1000).toJSON().collect()))
            return 0
        row = ci.verdict(old, new, changes).first()
        say(ci.report(row, changes))
        return int(bool(row.failed)) if a.command == "check" else 0
    elif a.command == "watch":
        from cairn.streaming.watch import file_stream, watch

        held = [engine]

        def tell(batch, no: int) -> None:
            paths = [r.path for r in batch.select("path").limit(20).collect()]
            held[0] = held[0].rescanned(a.root)  # files with the same digest are not parsed again
            print(json.dumps({"batch": no, "paths": paths, "statistics": json.loads(held[0].statistics().toJSON().first())}), flush=True)

        watch(file_stream(spark, a.root), tell, f"{a.baseline}-watch").awaitTermination()
    elif a.command == "lsp":
        Service(engine, a.root).serve_language(sys.stdin.buffer, sys.stdout.buffer)
    else:
        service = Service(engine, a.root)
        for line in sys.stdin:
            if line.strip():
                print(json.dumps(service.answer(json.loads(line))), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
