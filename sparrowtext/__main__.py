"""Commands: build an index of text files, query it, list its terms, sum it up.

    python -m sparrowtext index FILES INDEX [--segment NAME] [--update]
    python -m sparrowtext query INDEX [-n 10] QUERY...      (or JSON lines on standard input)
    python -m sparrowtext terms INDEX [--field contents] [--prefix P] [--segment NAME]
    python -m sparrowtext summary INDEX
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import fields as fd
from .operators import terms as tm
from .operators.search import Searcher
from .plans import parser
from .sources import corpora
from .sources.store import Store

FIELDS = [fd.keyword("path", stored=True), fd.string("title", stored=True), fd.text("contents"), fd.long_field("modified"), fd.long_field("size", stored=True)]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = argparse.ArgumentParser(prog="sparrowtext", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("files")
    index.add_argument("index")
    index.add_argument("--segment")
    index.add_argument("--update", action="store_true")
    query = sub.add_parser("query")
    query.add_argument("index")
    query.add_argument("queries", nargs="*")
    query.add_argument("-n", type=int, default=10)
    terms = sub.add_parser("terms")
    terms.add_argument("index")
    terms.add_argument("--field", default="contents")
    terms.add_argument("--prefix", default="")
    terms.add_argument("--segment", default="")
    sub.add_parser("summary").add_argument("index")
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparrowtext").getOrCreate()
    store = Store(spark, args.index)
    if args.command == "index":
        mode = "update" if args.update else "append" if store.versions() else "overwrite"
        store.write(corpora.text_files(spark, args.files), "path", FIELDS, mode, args.segment)
    elif args.command == "query":
        x = Searcher(store.open())
        asked = [parser.parse(q, "contents") for q in args.queries] or parser.read_batch(sys.stdin, "contents")
        hits = x.search_batch(asked, args.n)
        for r in x.fetch(hits, "path").orderBy("query_id", "rank").toLocalIterator():
            print(json.dumps({"query": r.query_id, "rank": r["rank"], "score": round(r.score, 5), "path": r.path, "hits": r.total_hits}))
    elif args.command == "terms":
        for r in tm.terms(store.open(only=args.segment), args.field, args.prefix).toLocalIterator():
            print(f"{r.term}\t{r.df}\t{r.ttf}")
    else:
        for r in store.summary().toLocalIterator():
            print(r.segment, r.json)


if __name__ == "__main__":
    main()
