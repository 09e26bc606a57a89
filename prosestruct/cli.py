"""Command line: analyze, summarize, keyphrases. Exit codes: 0 found, 1 nothing found, 2 an error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.metrics import document_metrics, section_breakdown
from .plans.engine import Engine
from .sources.ingest import path_source, raise_error


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="prosestruct", description="Structure of texts.")
    out.add_argument("--model-dir", help="folder with the English model of the statistical parser; without it the built-in rules parse")
    commands = out.add_subparsers(dest="command", required=True)
    for name, methods, n in (("analyze", None, 0), ("summarize", ("tfidf", "textrank"), 3), ("keyphrases", ("rake", "yake"), 10)):
        command = commands.add_parser(name)
        command.add_argument("input")
        command.add_argument("--json", action="store_true")
        if methods:
            command.add_argument("-n", type=int, default=n)
            command.add_argument("--method", choices=methods, default=methods[0])
        else:
            command.add_argument("-s", "--sections", action="store_true")
    return out


def shown(value: float | None) -> str:
    return "-" if value is None else f"{value:.3f}"


def raise_first(errors: DataFrame) -> None:
    """The exception of the first error row, by path."""
    rows = errors.orderBy("path").limit(1).collect()
    if rows:
        raise_error(rows[0].error.asDict())


def show_document(d: dict, totals: dict) -> None:
    print(d["path"])
    for name, value in (("sentences", totals["total_sentences"]), ("words", totals["total_words"])):
        print(f"  {name}: {value}")
    print(f"  mean_sentence_length: {totals['mean_sentence_length']:.1f}")
    print(f"  sentence_length_std: {totals['sentence_length_std']:.1f}")
    for name in ("vocabulary_ttr", "nominalization_ratio"):
        print(f"  {name}: {shown(d[name])}")
    print(f"  passive_ratio: {totals['passive_share']:.3f}")


def run(arguments: argparse.Namespace, spark: SparkSession) -> int:
    engine = Engine.english(arguments.model_dir) if arguments.model_dir else Engine()
    raw, failures = path_source(spark, arguments.input)
    raise_first(failures)
    if arguments.command != "analyze":
        found, errors = engine.extract(raw, arguments.method, arguments.n)
        raise_first(errors)
        rows = [r.asDict() for r in found.drop("doc_id").collect()]
        rows.sort(key=lambda r: r["position"] if arguments.command == "summarize" else (-r["score"], r["phrase"]))
        if arguments.json:
            print(json.dumps(rows, indent=2, ensure_ascii=False))
        else:
            for r in rows:
                print(f"[{r['score']:.3f}] {r.get('text', r.get('phrase'))}")
        return 0 if rows else 1
    documents, errors = engine.analyze(raw)
    raise_first(errors)
    found = sorted((r.asDict(recursive=True) for r in documents.collect()), key=lambda d: d["path"])
    a = engine.annotate(raw)
    totals = {r.doc_id: r.asDict() for r in document_metrics(a.raw, a.paragraphs, a.sentences).collect()}
    if arguments.json:
        print(json.dumps(found, indent=2, ensure_ascii=False))
    else:
        for d in found:
            show_document(d, totals[d["doc_id"]])
        if arguments.sections:
            for r in section_breakdown(a.paragraphs, a.sentences).orderBy("doc_id", "section_idx").collect():
                print(f"  {'#' * r.level} {r.heading}: {r.paragraphs} paragraphs, {r.sentences} sentences, {r.words} words")
    return 0 if any(t["total_sentences"] for t in totals.values()) else 1


def main(argv: list[str] | None = None) -> int:
    arguments = parser().parse_args(argv)
    if not os.path.exists(arguments.input):  # before a session is started
        print(f"io error: {arguments.input}: no such file", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("prosestruct").getOrCreate()
    try:
        return run(arguments, spark)
    except BrokenPipeError:
        return 0
    except (OSError, ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
