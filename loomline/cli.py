"""``index build``, ``search`` and ``context`` over a folder of notes."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from pathlib import Path

from loomline.functions.text import parse_days
from loomline.operators.chunking import build_index, read_index, write_index
from loomline.operators.log_store import hydrate, replay
from loomline.operators.search import SearchOptions, context_pack, result_lines, search
from loomline.session import local_session
from loomline.sources.records import read_log, read_sidecars


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomline")
    parser.add_argument("--save-folder", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("index").add_argument("action", choices=["build"])
    for name in ("search", "context"):
        sub = commands.add_parser(name)
        sub.add_argument("query", nargs="?" if name == "context" else None)
        if name == "context":
            sub.add_argument("--query", dest="named")
            sub.add_argument("--out", required=True)
        sub.add_argument("--limit", type=int, default=20)
        sub.add_argument("--since", type=parse_days)
        sub.add_argument("--tag")
    args = parser.parse_args(argv)
    spark = local_session()
    folder = str(Path(args.save_folder).resolve())
    target = f"file://{folder}/.index"
    if args.command == "index":
        log, _ = read_log(spark, f"{folder}/history.jsonl")
        bodies, meta = read_sidecars(spark, folder)
        write_index(build_index(hydrate(replay(log), meta, bodies), meta), target)
        return 0
    query = args.query or getattr(args, "named", None)
    if not query or not query.strip():
        parser.error("a query is needed")
    options = SearchOptions(query, args.limit, args.since, args.tag)
    now = datetime.now(UTC).isoformat()
    results = search(read_index(spark, target), options, now)
    if args.command == "search":
        for row in result_lines(results).collect():
            print(row.line)
        return 0
    out = Path(args.out)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(context_pack(results, options, now), encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
