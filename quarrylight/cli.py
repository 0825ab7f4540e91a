"""The command line: python -m quarrylight.cli COMMAND ...

init ROOT, index SOURCE [--root ROOT], status ROOT, health ROOT, query TOOL ROOT [name=value ...], and serve, which answers lines of JSON
{"tool": ..., "arguments": {...}} on standard input with lines of JSON.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from quarrylight.operators import embed
from quarrylight.plans import health, index
from quarrylight.plans.service import QueryService, RepositoryNotIndexedError, to_json
from quarrylight.plans.store import Store
from quarrylight.plans.tools import Tools
from quarrylight.sources import config, inputs

TOOLS = ("repository_summary", "search_code", "hybrid_search", "find_symbols", "find_routes", "get_related_code", "analyze_change_impact", "find_existing_implementation", "find_symbol", "get_file_context", "find_related_files", "find_related_tests", "explain_change_impact", "check_existing_implementation")


def session() -> SparkSession:
    return SparkSession.builder.appName("quarrylight").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def answer(tools: Tools, tool: str, arguments: dict) -> str:
    """What a tool says; unknown tools and arguments are errors like any other."""
    if tool not in TOOLS:
        return json.dumps({"error": f"no such tool: {tool}", "code": "UnknownTool"})
    try:
        return getattr(tools, tool)(**arguments)
    except TypeError as e:
        return json.dumps({"error": str(e), "code": "BadArguments"})


def value(text: str):
    """A value of name=value: JSON where it is, else the text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(argv: list[str] | None = None, *, make_session: Callable[[], SparkSession] = session, stdin=None, out=print) -> int:
    parser = argparse.ArgumentParser(prog="quarrylight", description=__doc__.split("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init").add_argument("root")
    build = commands.add_parser("index")
    build.add_argument("source")
    build.add_argument("--ref")
    build.add_argument("--root", help="the folder whose index this becomes; archives and GitHub sources need one")
    for name in ("status", "health"):
        commands.add_parser(name).add_argument("root")
    ask = commands.add_parser("query")
    ask.add_argument("tool", choices=TOOLS)
    ask.add_argument("root")
    ask.add_argument("arguments", nargs="*")
    commands.add_parser("serve")
    args = parser.parse_args(argv)
    try:
        if args.command == "init":
            out(config.create_default(args.root))
            return 0
        spark = make_session()
        if args.command == "index":
            if args.root is None and inputs.classify(args.source) is not inputs.InputKind.LOCAL:
                raise inputs.InputError("root_needed", "The workspace of this source is temporary: name a folder for its index with --root.")
            with inputs.prepare(args.source, ref=args.ref) as prepared:
                store = None if args.root is None else Store(spark, Path(args.root).resolve() / config.FOLDER)
                out(json.dumps(index.build(spark, str(prepared.root), store=store).counts))
        elif args.command == "status":
            out(to_json(QueryService(spark, args.root).status()))
        elif args.command == "health":
            out(to_json(health.health(spark, args.root)))
        else:
            tools = Tools(spark, embed.HashingEncoder())
            if args.command == "query":
                out(answer(tools, args.tool, {"repository_root": args.root} | {k: value(v) for k, _, v in (x.partition("=") for x in args.arguments)}))
            else:
                for line in stdin or sys.stdin:
                    if line.strip():
                        try:
                            asked = json.loads(line)
                            out(answer(tools, asked["tool"], asked.get("arguments", {})))
                        except (ValueError, KeyError, TypeError) as e:
                            out(json.dumps({"error": f"not a request: {e}", "code": "BadRequest"}))
        return 0
    except (config.ConfigError, inputs.InputError, index.BuildError, RepositoryNotIndexedError) as e:
        print(f"{getattr(e, 'code', type(e).__name__)}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
