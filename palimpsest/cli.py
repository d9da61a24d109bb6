"""Command line over the library: ``python -m palimpsest.cli search|ask ...``."""

from __future__ import annotations

import argparse
import json
import textwrap
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import functions as F

from palimpsest.operators.embedding import hashing_embedder
from palimpsest.operators.search import K, MAX_DISTANCE, MIN_GAP, search
from palimpsest.plans.ask import MODEL, SCHEME


def snippet(text: str, width: int = 88, lines: int = 4) -> str:
    """Wrapped text of at most ``lines`` lines, cut with `` ...``."""
    wrapped = textwrap.wrap(" ".join((text or "").split()), width)
    if len(wrapped) <= lines:
        return "\n".join(wrapped)
    last = textwrap.shorten(wrapped[lines - 1] + " x", width - 4, placeholder="")
    return "\n".join([*wrapped[: lines - 1], f"{last} ..."])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("search", "ask"):
        one = commands.add_parser(name)
        one.add_argument("question")
        one.add_argument("--data", required=True, help="folder that the pipeline wrote")
        one.add_argument("--json", action="store_true")
        one.add_argument("--model", default=MODEL, help="embedding model of the vectors to search")
        one.add_argument("--scheme", default=SCHEME, help="chunk scheme of the vectors to search")
        if name == "search":
            one.add_argument("-k", type=int, default=K)
            one.add_argument("--max-distance", type=float, default=MAX_DISTANCE)
            one.add_argument("--min-gap", type=float, default=MIN_GAP)
            one.add_argument("--protocol")
            one.add_argument("--source", choices=("proposal", "forum"))
            one.add_argument("--as-of", type=datetime.fromisoformat, help="search what was valid at an ISO time, in UTC if it has no zone")
            one.add_argument("--no-threshold", action="store_true", help="neither the gate nor the ceiling")
    return top


def main(argv: list[str] | None = None) -> int:
    from palimpsest.operators.upsert import VersionedTable
    from palimpsest.plans.ask import Assistant
    from palimpsest.plans.templates import Templates
    from palimpsest.session import session
    from palimpsest.sources.objects import protocols

    args = parser().parse_args(argv)
    spark = session()
    vectors = VersionedTable(spark, f"{args.data}/vectors").read()
    if args.command == "search":
        ceiling, gap = (None, None) if args.no_threshold else (args.max_distance, args.min_gap)
        at = args.as_of and F.lit(args.as_of if args.as_of.tzinfo else args.as_of.replace(tzinfo=UTC))
        filters = {"model": args.model, "scheme": args.scheme, "protocol": args.protocol, "source": args.source, "as_of": at}
        hits = search(vectors, hashing_embedder([args.question])[0], args.k, ceiling, gap, tie="chunk_id", **filters)
        shown = ("source", "document_id", "protocol_name", "chunk_index", "heading", "title", "chunk", "document_date")
        found: Any = [r.asDict() for r in hits.select(*shown, F.round("distance", 4).alias("distance")).orderBy("distance").collect()]
    else:
        tables = (VersionedTable(spark, f"{args.data}/{n}").read() for n in ("proposal_versions", "forum_posts"))
        found = vars(Assistant(spark, vectors, Templates(*tables), protocols(spark), model=args.model, scheme=args.scheme).ask(args.question))
    if args.json:
        print(json.dumps(found, default=str, ensure_ascii=False))
    elif args.command == "search":
        if not found:
            print("no chunk is near enough; --no-threshold shows the nearest")
        for r in found:
            print(f"{r['distance']:.4f}  {r['source']}:{r['document_id']}#{r['chunk_index']}  {r['title'] or ''}\n{textwrap.indent(snippet(r['chunk']), '    ')}")
    else:
        print(found["text"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
