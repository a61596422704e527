"""Command line: ``eval``, ``demo`` and ``ablation`` over Parquet tables.

    python -m gleanframe.cli demo --corpus corpus.parquet --query "sort a list"
    python -m gleanframe.cli eval --corpus c --queries q --qrels r --config my.json --output out.json
    python -m gleanframe.cli ablation --corpus c --queries q --qrels r --md table.md --json table.json

The tables are ``corpus(doc_id, doc_pos, text)``, ``queries(query_id, text)`` and
``qrels(query_id, doc_id, relevance)``.
"""

from __future__ import annotations

import argparse
import sys

from gleanframe.config import load_config, sweep
from gleanframe.operators.ablation import ablation_table, as_markdown, measured, write_report
from gleanframe.operators.evolution import stable_core_and_delta
from gleanframe.operators.metrics import evaluate_retrieval
from gleanframe.operators.versions import VersionedIndex
from gleanframe.retriever import CodeRetriever, Encoder
from gleanframe.session import cut, local_session, shared_dir, ship
from gleanframe.sources.tables import distinct_items, queries_from, write_result_files


def _parser(command: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=f"gleanframe {command}")
    p.add_argument("--corpus", required=True)
    p.add_argument("--cpus", type=int, default=8)
    p.add_argument("--backend", choices=["hashing", "sentence_transformer"], default="hashing")
    p.add_argument("--model")
    p.add_argument("--hashing-dim", type=int, default=2048)
    p.add_argument("--trust-remote-code", action="store_true")
    p.add_argument("--config", help="a file that takes the place of all other settings")
    p.add_argument("--hyde", action="store_true")
    p.add_argument("--multiview", action="store_true")
    p.add_argument("--hybrid", action="store_true")
    return p


def _backend(args) -> dict:
    own = {"kind": args.backend, "hashing_dim": args.hashing_dim, "trust_remote_code": args.trust_remote_code}
    return own | ({"model_name": args.model} if args.model else {})


def _config(args):
    if args.config:
        return load_config(args.config)
    return load_config({"name": "cli", "backend": _backend(args), "query": {"hyde_enabled": args.hyde}, "snippet": {"multiview_enabled": args.multiview}, "scoring": {"hybrid_enabled": args.hybrid}})


def _tables(args, *names):
    spark = ship(local_session(args.cpus))
    keys = {"corpus": "doc_id", "queries": "query_id"}
    return [distinct_items(spark.read.parquet(getattr(args, n)), keys[n]) if n in keys else spark.read.parquet(getattr(args, n)) for n in names]


def run_eval(argv: list[str]) -> int:
    p = _parser("eval")
    p.add_argument("--queries", required=True)
    p.add_argument("--qrels", required=True)
    p.add_argument("--output")
    args = p.parse_args(argv)
    config = _config(args)
    corpus, queries, qrels = _tables(args, "corpus", "queries", "qrels")
    found = CodeRetriever(config).index(corpus)
    scores = evaluate_retrieval(qrels, found.batch_search(queries, 100)).first().asDict()
    for name, value in scores.items():
        print(f"{name}: {value:.4f}")
    if args.output:
        write_result_files({"result": {"scores": {"test": [scores]}}, "scores": scores}, config, args.output)
    return 0


def run_demo(argv: list[str]) -> int:
    p = _parser("demo")
    p.add_argument("--query", action="append", default=[])
    p.add_argument("--top-k", type=int, default=3)
    p.add_argument("--versioned", action="store_true", help="index the corpus twice, once with a changed item")
    args = p.parse_args(argv)
    config = _config(args)
    (corpus,) = _tables(args, "corpus")
    spark = corpus.sparkSession
    if args.versioned:
        encoder = Encoder(config)
        index = VersionedIndex(spark, f"{shared_dir(spark)}/demo", encoder.encode_documents, encoder.dim)
        first = corpus.agg({"doc_id": "min"}).first()[0]
        changed = corpus.selectExpr("doc_id", f"CASE WHEN doc_id = '{first}' THEN concat(coalesce(text, ''), '\\nchanged = True') ELSE text END AS text")
        for name, rows in (("v1", corpus), ("v2", changed)):
            seconds = index.add_version(name, rows)
            print(f"{name}: {index.encoded_counts[name]} of {index.sizes[name]} encoded in {seconds:.1f} s, {index.cache_hit_rate(name):.0%} from the cache")
        pair = corpus.where(f"doc_id = '{first}'").selectExpr("doc_id AS group_id", "0 AS version_no", "text").unionByName(changed.where(f"doc_id = '{first}'").selectExpr("doc_id AS group_id", "1 AS version_no", "text"))
        stable_core_and_delta(pair).show(truncate=60)
    found = CodeRetriever(config).index(corpus)
    asked = queries_from(spark, {q: q for q in args.query or ["sort a list"]})
    found.batch_search(asked, args.top_k).orderBy("query_id", "pos").show(100, truncate=60)
    print(f"mean latency {found.telemetry.mean_query_latency_ms:.1f} ms")
    return 0


def run_sweep(argv: list[str]) -> int:
    p = _parser("ablation")
    p.add_argument("--queries", required=True)
    p.add_argument("--qrels", required=True)
    p.add_argument("--md")
    p.add_argument("--json")
    args = p.parse_args(argv)
    corpus, queries, qrels = _tables(args, "corpus", "queries", "qrels")
    found = cut(ablation_table(corpus.sparkSession, sweep(_backend(args)), measured(cut(corpus), cut(queries), qrels)))
    print(as_markdown(found))
    write_report(found, args.md, args.json)
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    commands = {"eval": run_eval, "demo": run_demo, "ablation": run_sweep}
    if not argv or argv[0] not in commands:
        print(__doc__)
        return 2
    return commands[argv[0]](argv[1:])


if __name__ == "__main__":
    sys.exit(main())
