"""Command line: python -m notemill [--config FILE] --index DIR COMMAND ...; prints JSON. Exit codes: 0, 1 (error), 2 (settings)."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notemill", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--vault")
    p.add_argument("--index", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("status")
    sub.add_parser("index").add_argument("--rebuild", action="store_true")
    for name in ("ingest", "dedup", "redundant", "classify", "tags"):
        c = sub.add_parser(name, help="about the files of folders of the vault" + (", or without any the whole index" if name == "dedup" else ""))
        c.add_argument("folders", nargs="*" if name == "dedup" else "+")
        c.add_argument("--k", type=int, default=5)
    sub.add_parser("suggest-tags").add_argument("--k", type=int)
    c = sub.add_parser("similar")
    c.add_argument("folders", nargs="*")
    c.add_argument("--text")
    c.add_argument("--image", help="a file; goes before --text, which goes before folders")
    c.add_argument("--k", type=int, default=10)
    c = sub.add_parser("extract")
    c.add_argument("folders", nargs="+")
    c.add_argument("--max-chars", type=int)
    return p


def plain(value: Any) -> Any:
    """DataFrames as lists of rows: a report is for reading, and comes to the driver."""
    if isinstance(value, DataFrame):
        from notemill.sources.vault import json_lines

        return [json.loads(r["value"]) for r in json_lines(value).collect()]
    return {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def run(spark: SparkSession, a: argparse.Namespace) -> Any:
    from notemill.api import Engine
    from notemill.config import Config
    from notemill.sources.vault import documents, extract, scan_vault

    config = Config(a.config, {"vault": a.vault} if a.vault else None)
    engine = Engine(spark, config, a.index)
    if a.command == "status":
        return engine.status()
    if a.command == "index":
        return engine.refresh(a.rebuild)
    if a.command == "suggest-tags":
        return engine.propose_tags(a.k)
    if a.command == "dedup" and not a.folders:
        return engine.dedup_all()
    if a.command == "similar" and a.image is not None:
        with open(a.image, "rb") as f:
            return engine.similar(image=spark.createDataFrame([(a.image, bytearray(f.read()))], "query string, content binary"), k=a.k)
    if a.command == "similar" and a.text is not None:
        return engine.similar(text=a.text, k=a.k)
    # folders named on the command line are read whatever their names
    docs = documents(scan_vault(spark, config.vault, {**config.data, "exclude": [], "inbox": ""}, a.folders))
    if a.command == "extract":
        return extract(docs, a.max_chars).drop("file_hash")
    if a.command == "ingest":
        return engine.ingest(docs, k=a.k)
    queries, chunks = engine.queries(docs)
    if a.command == "dedup":
        return engine.dedup(queries, chunks)
    if a.command == "redundant":
        return engine.redundant(queries, chunks)
    if a.command == "classify":
        return engine.classify(queries)
    return engine.tags(queries, k=a.k) if a.command == "tags" else engine.similar(queries, k=a.k)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from notemill.api import EngineError
    from notemill.session import release

    spark = SparkSession.builder.appName("notemill").getOrCreate()
    try:
        out, code = {"ok": True, "result": plain(run(spark, a))}, 0
    except EngineError as e:
        out, code = {"ok": False, "error": {"code": e.code, "message": str(e)}}, 1
    except (ValueError, FileNotFoundError) as e:
        out, code = {"ok": False, "error": {"code": "config", "message": str(e)}}, 2
    finally:
        release(spark)
    print(json.dumps(out, ensure_ascii=False, indent=2))
    return code


if __name__ == "__main__":
    sys.exit(main())
