"""Reports of a benchmark, as JSON and Markdown. They hold metrics and gold queries, which people read, so they are made on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

_RETRIEVAL = {
    "hit_at_1": ("Hit@1", "share"), "recall_at_3": ("Recall@3", "share"), "recall_at_5": ("Recall@5", "share"), "mrr_at_5": ("MRR@5", "plain"),
    "procedure_accuracy": ("Procedure accuracy", "share"), "mean_retrieval_latency_ms": ("Mean retrieval latency", "ms"), "p95_retrieval_latency_ms": ("P95 retrieval latency", "ms"),
}
_ANSWERS = {
    "mean_gold_keyword_coverage": ("Mean keyword coverage", "share"), "citation_present_rate": ("Answers with citations", "share"),
    "total_unsupported_citations": ("Unsupported citations", "count"), "mean_generation_latency_ms": ("Mean generation latency", "ms"),
    "diagnostic_refusal_correct_rate": ("Correct refusals", "share"), "mean_judge_score": ("Mean judge score", "plain"),
}


def cell(value, kind: str) -> str:
    if value is None:
        return "n/a"
    return {"share": lambda: f"{value * 100:.1f}%", "plain": lambda: f"{value:.3f}", "ms": lambda: f"{value:.1f} ms", "count": lambda: str(value)}[kind]()


def table(names: list[str], rows: list[dict], what: dict) -> list[str]:
    lines = ["| Metric | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|"]
    for column, (title, kind) in what.items():
        if any(column in r for r in rows):
            lines.append(f"| {title} | " + " | ".join(cell(r.get(column), kind) for r in rows) + " |")
    return [*lines, ""]


def verdict(names: list[str], rows: list[dict]) -> str:
    """The best by Recall@5, then MRR@5; equals are said to be equal."""
    if len(rows) < 2:
        return "One strategy was run, so nothing was compared." if rows else "Nothing was compared."
    score = [(r.get("recall_at_5") or 0.0, r.get("mrr_at_5") or 0.0) for r in rows]
    best = [n for n, s in zip(names, score, strict=True) if s == max(score)]
    if len(best) > 1:
        return f"No difference in Recall@5 and MRR@5 between {', '.join(best)}."
    top = max(score)
    return f"Best by Recall@5, then MRR@5: {best[0]} ({cell(top[0], 'share')}, {top[1]:.3f})."


def markdown(rows: list[dict], key: str = "strategy") -> str:
    names = [r[key] for r in rows]
    return "\n".join(["# Retrieval report", "", *table(names, rows, _RETRIEVAL), verdict(names, rows), ""])


def write_report(metrics: DataFrame, folder: str, key: str = "strategy") -> list[dict]:
    """latest.json and latest.md in folder."""
    rows = [r.asDict() for r in metrics.orderBy(key).collect()]
    _write(folder, rows, markdown(rows, key))
    return rows


def _write(folder: str, data, text: str) -> None:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "latest.json").write_text(json.dumps(data, ensure_ascii=False, indent=1, default=str), encoding="utf-8")
    (out / "latest.md").write_text(text, encoding="utf-8")


def failure_cause(row: dict) -> str:
    """Why no relevant chunk was found for a query."""
    if row["filter_applied"] and row["predicted"] != row["expected_procedure"]:
        return "the filter kept another procedure"
    return "no chunk with enough of the keywords was ranked high enough"


def benchmark_data(runs: list, about: dict | None = None) -> dict:
    """Runs (``benchmark.Run``) as plain data."""
    out = []
    for r in runs:
        hits: dict[str, list[dict]] = {}
        for h in sorted((h.asDict() for h in r.hits.collect()), key=lambda h: (h["query_id"], h["rank"])):
            hits.setdefault(h.pop("query_id"), []).append(h)
        queries = [{**q.asDict(), "hits": hits.get(q.query_id, [])} for q in sorted(r.queries.collect(), key=lambda q: q.query_id)]
        probes = [q.asDict() for q in sorted(r.diagnostics.collect(), key=lambda q: q.query_id)]
        out.append({
            "strategy": r.strategy, "config": r.config, "index_build_ms": r.build_ms, "chunks": r.chunks, "generation_skipped": r.skipped,
            "retrieval_metrics": r.retrieval, "answer_metrics": r.answers, "queries": queries, "diagnostics": probes,
        })
    return {**(about or {}), "strategies": out}


def benchmark_markdown(data: dict) -> str:
    runs = data["strategies"]
    names = [r["strategy"] for r in runs]
    lines = ["# Benchmark report", "", *(f"- {k}: {v}" for k, v in data.items() if k != "strategies"), "", "## Retrieval", "", *table(names, [r["retrieval_metrics"] for r in runs], _RETRIEVAL)]
    lines += ["## Answers", ""]
    lines += table(names, [r["answer_metrics"] for r in runs], _ANSWERS) if any(r["answer_metrics"] for r in runs) else ["No answers were made.", ""]
    lines += ["## Strategies", ""]
    for r in runs:
        c = r["config"]
        lines += [
            f"### {r['strategy']}", f"- Embedding: {c['embedding']}, chunker: {c['chunker']}, chunks: {r['chunks']}, built in {cell(r['index_build_ms'], 'ms')}",
            f"- BM25: {c['use_bm25']}, filter: {c['use_metadata_filter']}, reranker: {c['use_reranker']}, neighbours: {c['use_adjacent_expansion']}",
            *([f"- No answers: {r['generation_skipped']}"] if r["generation_skipped"] else []), "",
        ]
    lines += ["## Queries", ""]
    for i, q in enumerate(runs[0]["queries"] if runs else []):
        lines += [f"### {q['query_id']}: {q['question']}", f"- Expected: {q['expected_procedure']}"]
        for r in runs:
            own = r["queries"][i]
            top = own["hits"][0] if own["hits"] else {"chunk_id": "none", "relevant": False}
            lines.append(f"- **{r['strategy']}**: predicted {own['predicted']} ({own['confidence']:.2f}, filter {own['filter_applied']}), first {top['chunk_id']} (relevant {top['relevant']})")
            if own.get("answer") is not None:
                lines.append(f"  - keyword coverage {cell(own['coverage'], 'share')}, citations {own['citations']}, unsupported {own['unsupported']}")
        lines.append("")
    lines += ["## Diagnostic queries", ""]
    for r in runs:
        for q in r["diagnostics"]:
            lines.append(f"- **{r['strategy']}**, {q['question']}: predicted {q['predicted']} ({q['confidence']:.2f}), scores {q['top_scores']}" + (f", refusal correct {q['refusal_correct']}" if q.get("refusal_correct") is not None else ""))
    failures = [
        f"- **{r['strategy']}**, {q['query_id']}: nothing relevant among the first; {failure_cause(q)}." for r in runs for q in r["queries"] if not any(q["flags"])
    ]
    lines += ["", "## Failures", "", *(failures or ["None."]), "", "## Metadata filter", ""]
    for r in runs:
        applied = [q for q in r["queries"] if q["filter_applied"]]
        helped = sum(any(q["flags"]) for q in applied)
        lines.append(f"- {r['strategy']}: applied to {len(applied)} of {len(r['queries'])}; with a relevant chunk {helped}, without {len(applied) - helped}")
    return "\n".join([*lines, "", "## Verdict", "", verdict(names, [r["retrieval_metrics"] for r in runs]), ""])


def write_benchmark(runs: list, folder: str, about: dict | None = None) -> dict:
    """latest.json and latest.md in folder, with tables, failures and a verdict."""
    data = benchmark_data(runs, about)
    _write(folder, data, benchmark_markdown(data))
    return data
