"""python -m ragloom.cli build | retrieve | ask | benchmark | compare | fetch."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AGENT = "ragloom/1.0"
SYSTEM = "Answer from the context alone, in the language of the question, and cite the source of every statement as [source/section/chunk]. If the context lacks the answer, say so."


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ragloom")
    commands = out.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="make an index of one document")
    build.add_argument("--source", required=True)
    build.add_argument("--boundaries", required=True)
    build.add_argument("--strategy", default="high_accuracy", choices=["baseline", "high_accuracy"])
    build.add_argument("--embedding-model", default="mock")
    build.add_argument("--reranker", action="store_true")
    build.add_argument("--index-path", required=True)
    for name, help_ in (("retrieve", "chunks for a query"), ("ask", "an answer to a query")):
        c = commands.add_parser(name, help=help_)
        c.add_argument("--query", required=True)
        c.add_argument("--top-k", type=int, default=5)
        c.add_argument("--index-path", required=True)
    bench = commands.add_parser("benchmark", help="gold and diagnostic queries through one preset or both")
    bench.add_argument("--source", required=True)
    bench.add_argument("--boundaries", required=True)
    bench.add_argument("--gold", required=True)
    bench.add_argument("--diagnostic", required=True)
    which = bench.add_mutually_exclusive_group()
    which.add_argument("--compare-strategies", action="store_true")
    which.add_argument("--strategy", choices=["baseline", "high_accuracy"])
    bench.add_argument("--embedding-model", default="mock")
    bench.add_argument("--reranker", action="store_true")
    bench.add_argument("--skip-generation", action="store_true")
    bench.add_argument("--llm-judge", action="store_true")
    bench.add_argument("--output", required=True)
    compare = commands.add_parser("compare", help="report of both strategies over a folder of tables")
    compare.add_argument("--tables", required=True)
    compare.add_argument("--output", required=True)
    fetch = commands.add_parser("fetch", help="pages of a URL list as Markdown, with a manifest")
    fetch.add_argument("input_csv")
    fetch.add_argument("--output-dir", required=True)
    fetch.add_argument("--delay", type=float, default=1.0, help="seconds between requests")
    fetch.add_argument("--timeout", type=float, default=20.0)
    fetch.add_argument("--user-agent", default=AGENT)
    fetch.add_argument("--overwrite", action="store_true")
    return out


def _query(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("q", text)], "query_id string, query string")


def fetch(spark: SparkSession, given: argparse.Namespace, get=None) -> int:
    """Documents below output-dir/documents, the manifest below output-dir/sources. 1 if a page was left out."""
    from ragloom.session import checkpointed
    from ragloom.sources import documents as D
    from ragloom.sources import pages as P

    rows = P.read_url_list(spark, given.input_csv).coalesce(1)  # one task, so that the delay holds between all requests
    sources, folder = f"{given.output_dir}/sources", f"{given.output_dir}/documents"
    exists = spark._jvm.org.apache.hadoop.fs.Path(sources)
    old = P.read_manifest(spark, sources) if exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists) else spark.createDataFrame([], ", ".join(f"{c} string" for c in P.schema.MANIFEST))
    old = checkpointed(old)
    got = checkpointed(P.crawl(rows, get or P.http_fetch(given.user_agent, given.timeout, given.delay), given.user_agent, date.today().isoformat(), None if given.overwrite else old))
    D.write_markdown(got.where("document is not null"), folder, mode="append" if not given.overwrite else "overwrite")
    P.write_manifest(P.upsert_manifest(old, P.manifest_rows(got, folder)), sources)
    failed = got.where("document is null").select("url", "error").collect()
    for url, why in failed:
        print(f"left out {url}: {why}", file=sys.stderr)
    return 1 if failed else 0


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    if given.command == "fetch" and given.delay < 1:
        print("the delay must be at least a second, for the sake of the sites", file=sys.stderr)
        return 2
    if given.command == "benchmark" and given.llm_judge and given.skip_generation:
        print("a judge needs answers", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    from ragloom.functions import providers
    from ragloom.plans import benchmark, evaluation, report
    from ragloom.plans.pipeline import RagPipeline
    from ragloom.sources import documents as D

    if given.command == "build":
        p = RagPipeline.for_strategy(spark, given.strategy, given.embedding_model, given.reranker)
        p.build_index(given.source, given.boundaries)
        p.save_index(given.index_path)
    elif given.command == "retrieve":
        p = RagPipeline.load_index(spark, given.index_path)
        p.retrieve(_query(spark, given.query), given.top_k).orderBy("rank").select("rank", "source", "score", "chunk_id", "raw_text").show(truncate=100)
    elif given.command == "ask":
        p = RagPipeline.load_index(spark, given.index_path)
        said = p.answer(_query(spark, given.query), providers.ChatModel.from_environment(SYSTEM), given.top_k).first()
        if said.error:
            print(said.error, file=sys.stderr)
            return 1
        print(said.answer)
        print("\n".join(f"- {c.slug}/{c.chunk_id}" for c in said.citations))
    elif given.command == "benchmark":
        gold, probes = D.load_gold_queries(spark, given.gold), D.load_diagnostic_queries(spark, given.diagnostic)
        model = None if given.skip_generation else providers.ChatModel.from_environment(SYSTEM)
        names = (given.strategy,) if given.strategy else ("baseline", "high_accuracy")
        runs = benchmark.compare(
            spark, given.source, given.boundaries, gold, probes, names, given.embedding_model, given.reranker, model, model if given.llm_judge else None
        )
        report.write_benchmark(runs, given.output, {"source": given.source, "judge": given.llm_judge})
    elif given.command == "fetch":
        return fetch(spark, given)
    else:
        report.write_report(evaluation.strategy_comparison(spark, given.tables), given.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
