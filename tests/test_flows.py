"""Loaders and sinks, the larger paths of operators, providers, the benchmark and the commands."""

import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from ragloom import cli
from ragloom.functions import providers
from ragloom.functions import text as T
from ragloom.operators import chunking as C
from ragloom.operators import evaluate as E
from ragloom.operators import ranking as R
from ragloom.operators.bm25 import BM25Index
from ragloom.operators.dense import dense_topk
from ragloom.plans import benchmark, report
from ragloom.session import shared_folder
from ragloom.sources import documents as D
from ragloom.sources import pages as P

MANIFEST = ", ".join(f"{c} string" for c in P.schema.MANIFEST)


def test_more_queries_than_go_to_every_task(spark):
    """BM25 by join of postings and dense search by blocks give what the ways for few queries give."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(300)], "chunk_id int, raw_text string")
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=4))) for i in range(150)], "query_id string, query string")
    index = BM25Index.build(docs)
    few, many = ({(r.query_id, r.id, r.rank): r.score for r in index.search(queries, 7, 9, at_once=n).collect()} for n in (10_000, 5))
    assert few == pytest.approx(many) and len(few) > 900
    assert BM25Index.build(docs.limit(0)).search(queries).count() == 0 and index.search(queries.limit(0)).count() == 0
    e = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(5)], i % 4) for i in range(500)], "id int, embedding array<double>, scope int").repartition(3)
    q = e.where("id < 60").select(F.col("id").alias("query_id"), "embedding", F.when(F.col("id") % 2 == 0, F.col("scope")).alias("scope"))
    few, many = ({(r.query_id, r.id, r.rank): r.score for r in dense_topk(q, e, 4, "id", "id", scope="scope", at_once=n).collect()} for n in (1000, 3))
    assert few == pytest.approx(many) and len(few) == 240
    assert dense_topk(q.limit(0), e, 3, "id", "id", scope="scope").count() == 0


def test_more_keywords_than_go_to_every_task(spark):
    rng = random.Random(5)
    kw = spark.createDataFrame([(rng.choice("abc"), "".join(rng.choices("xyzXß", k=rng.randint(0, 5)))) for _ in range(60)], "slug string, keyword string")
    q = spark.createDataFrame([(i, "".join(rng.choices("xyzß ", k=rng.randint(0, 30)))) for i in range(80)] + [(99, None)], "query_id int, query string")
    few, many = (sorted(map(tuple, R.classify_keywords(q, kw, small=n).collect())) for n in (1000, 5))
    assert few == many and len(few) == 81


def test_nearest_rank_by_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for _ in range(700)] + [("c", 5), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    for by, groups in ((["g"], ["a", "b", None, "c"]), ([], ["all"])):
        got = {(r.g if by else "all"): r.p95 for r in E.nearest_rank(df, "v", by).collect()}
        want = {}
        for g in groups:
            values = sorted(v for k, v in rows if v is not None and (not by or k == g))
            want[g] = values[round(0.95 * (len(values) - 1))]
        assert got == want


def test_gold_and_diagnostic_queries(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({"queries": [{"id": "g1", "question": "Q?", "expected_procedure": "s", "gold_keywords": ["k", "Ký"]}]}))
    (tmp_path / "diag.json").write_text(json.dumps({"queries": [
        {"id": "d1", "question": "X?", "in_corpus": False, "expected_behavior": {"retrieval_confidence": "low", "must_not_hallucinate": True, "expected_answer_contains": "no"}, "note": "n"},
        {"id": "d2", "question": "Y?", "in_corpus": True}, {"id": "d3", "question": "Z?"},
    ]}))
    g = D.load_gold_queries(spark, str(tmp_path / "gold.json")).first()
    assert (g.id, g.expected_procedure, g.gold_keywords) == ("g1", "s", ["k", "Ký"])
    d = D.load_diagnostic_queries(spark, str(tmp_path / "diag.json"))
    assert d.where("id = 'd1'").first().expected_behavior.must_not_hallucinate is True
    assert [r.id for r in benchmark.outside(d).collect()] == ["d1"]
    with pytest.raises(FileNotFoundError):
        D.load_gold_queries(spark, str(tmp_path / "none.json"))


def test_lists_and_manifests_as_files(spark, tmp_path):
    (tmp_path / "urls.csv").write_text(" url ,title,audience\n https://a.org/x , T ,all\n,no url,\nhttps://b.org/,,\n")
    rows = {r.url: r.row for r in P.read_url_list(spark, str(tmp_path / "urls.csv")).collect()}
    assert set(rows) == {"https://a.org/x", "https://b.org/"} and rows["https://a.org/x"]["title"] == "T" and rows["https://b.org/"]["audience"] == ""
    (tmp_path / "bad.csv").write_text("link\nx\n")
    with pytest.raises(ValueError):
        P.read_url_list(spark, str(tmp_path / "bad.csv"))
    new = spark.createDataFrame([("b", "1", None, "u", "d", "v", "x"), ("a", "1", "t, with comma", "u", "d", "v", "x"), ("b", "2", 'quote "q"', "u", "d", "v", "x")], MANIFEST).coalesce(1)
    path = str(tmp_path / "manifest")
    P.write_manifest(P.upsert_manifest(spark.createDataFrame([], MANIFEST), new), path)
    again = P.read_manifest(spark, path)
    assert sorted((r.doc_id, r.file_path, r.title) for r in again.collect()) == [("a", "1", "t, with comma"), ("b", "2", 'quote "q"')]
    by_order = P.upsert_manifest(again, new, F.col("file_path").cast("int") * -1)
    assert {r.doc_id: r.file_path for r in by_order.collect()} == {"a": "1", "b": "1"}


def test_markdown_is_read_as_it_was_written(spark, tmp_path):
    docs = spark.createDataFrame([("one", {"doc_id": "one", "title": 'A "b"'}, "Text\nmore"), ("two", {"doc_id": "two", "title": "T"}, "x")], "doc_id string, m map<string,string>, c string")
    D.write_markdown(docs.select("doc_id", D.markdown_document(F.col("m"), F.col("m")["title"], F.col("c")).alias("document")), str(tmp_path / "md"))
    files = spark.read.text(str(tmp_path / "md"), wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    got = {r.id: r for r in D.with_front_matter(files).collect()}
    assert set(got) == {"one", "two"} and got["one"].content.strip() == '# A "b"\n\nText\nmore' and got["two"].metadata["title"] == "T"


def test_only_composed_characters_skip_normalisation(spark):
    import re
    import unicodedata

    class_ = re.compile(f"[{T.COMPOSED}]")
    inside = [chr(c) for c in range(0x10000) if class_.match(chr(c))]
    seconds = {d[-1] for d in (unicodedata.normalize("NFD", chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000) if len(d) > 1}
    assert len(inside) > 30_000
    assert all(unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and c not in seconds for c in inside)
    texts = ["e\u0301 caf\u00e9", "plain", "\u0110\u1eb7ng", "D\u0103\u0323ng", "\u1100\u1161\u11a8", "\u212b\u2000x", "\U0001f600 a\u0308", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.n for r in df.select("i", T.nfc(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [unicodedata.normalize("NFC", t) if t is not None else None for t in texts]


def test_embedders_have_a_time_limit(spark):
    import time

    providers.register_embedder("slow", lambda: time.sleep(30))
    began = time.time()
    assert providers.embedder("slow", timeout=0.2)[0] == "mock" and time.time() - began < 10
    with pytest.raises(providers.ProviderError):
        providers.embedder("slow", None, timeout=0.1)


def test_chunks_by_another_token_counter(spark):
    c = C.StructureChunker(15, 25, 5, count=lambda text: len(text))
    (units,) = spark.createDataFrame([("aaaa bbbb cccc dddd eeee ffff gggg hhhh\n\nxx yy\n\nzz",)], "t string").select(c.units(F.col("t"), overlap=False)).first()
    assert units == [["aaaa bbbb cccc dddd eeee"], ["ffff gggg hhhh"], ["xx yy", "zz"]]


@pytest.fixture
def model(monkeypatch):
    """A chat model on this machine; it answers by what it is asked."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], asked))
            prompt = asked["messages"][-1]["content"]
            if "broken" in prompt:
                self.send_response(500)
                self.end_headers()
                return
            said = "I give it 4." if prompt.startswith("Rate the answer") else "See [documents/withdraw/guide::withdraw::chunk_000]: form 1."
            said = "I cannot find that in the documents." if "weather" in prompt else said
            body = json.dumps({"choices": [{"message": {"content": said}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    for name, value in (("LLM_BASE_URL", f"http://127.0.0.1:{server.server_port}/v1/"), ("LLM_MODEL", "m"), ("LLM_API_KEY", "secret")):
        monkeypatch.setenv(name, value)
    yield seen
    server.shutdown()


def test_chat_models(model, monkeypatch):
    chat = providers.ChatModel.from_environment("be brief")
    assert chat("hello").startswith("See [documents") and chat.address.endswith("/v1/chat/completions")
    key, asked = model[0]
    assert key == "Bearer secret" and asked["model"] == "m" and asked["messages"][0] == {"role": "system", "content": "be brief"} and asked["temperature"] == 0.0
    with pytest.raises(providers.ProviderError, match="did not answer") as problem:
        chat("broken")
    assert "secret" not in str(problem.value) and "secret" not in repr(chat)
    monkeypatch.delenv("LLM_API_KEY")
    with pytest.raises(providers.ProviderError, match="LLM_API_KEY"):
        providers.ChatModel.from_environment()


def files(folder):
    names = ("register", "withdraw", "appeal")
    (folder / "guide.md").write_text("intro\n\n" + "\n\n".join(f"## {s}\n\nTo {s} a course, fill in form {i}. " + f"More about {s}. " * 30 for i, s in enumerate(names)))
    (folder / "b.json").write_text(json.dumps({"source_document": {"source_id": "guide", "source_title": "Guide"}, "procedures": [{"slug": s, "title": s.title(), "anchor": f"## {s}", "query_keywords": [s, "course"]} for s in names]}))
    gold = [{"id": "g1", "question": "How to withdraw a course?", "expected_procedure": "withdraw", "gold_keywords": ["form", "withdraw"]}, {"id": "g2", "question": "register course", "expected_procedure": "register", "gold_keywords": ["nowhere", "to be found"]}]
    (folder / "gold.json").write_text(json.dumps({"queries": gold}))
    (folder / "diag.json").write_text(json.dumps({"queries": [{"id": "d1", "question": "What is the weather?", "in_corpus": False}, {"id": "d2", "question": "appeal form", "in_corpus": True}]}))
    return [str(folder / n) for n in ("guide.md", "b.json", "gold.json", "diag.json")]


def test_benchmark_of_both_presets(spark, tmp_path, model):
    source, boundaries, gold, diag = files(tmp_path)
    generate = providers.ChatModel.from_environment()
    runs = benchmark.compare(spark, source, boundaries, D.load_gold_queries(spark, gold), D.load_diagnostic_queries(spark, diag), generate=generate, judge=generate)
    assert [r.strategy for r in runs] == ["baseline", "high_accuracy"] and [r.config["chunker"] for r in runs] == ["fixed_size", "structure"]
    best = runs[1]
    q = {r.query_id: r for r in best.queries.collect()}
    assert q["g1"].predicted == "withdraw" and any(q["g1"].flags) and not any(q["g2"].flags) and q["g1"].judge_score == 4 and q["g1"].citations == 1
    assert best.answers["diagnostic_refusal_correct_rate"] == 1.0 and best.answers["citation_present_rate"] == 1.0 and best.answers["mean_judge_score"] == 4.0
    probes = {r.query_id: r for r in best.diagnostics.collect()}
    assert probes["d1"].refusal_correct is True and probes["d2"].refusal_correct is None and len(probes["d2"].top_scores) >= 1
    assert best.retrieval["recall_at_5"] == 0.5 and best.retrieval["p95_retrieval_latency_ms"] > 0
    data = report.write_benchmark(runs, str(tmp_path / "out"), {"source": source})
    text = (tmp_path / "out" / "latest.md").read_text()
    assert "## Failures" in text and "**high_accuracy**, g2: nothing relevant" in text and "## Verdict" in text and "| Recall@5 |" in text and "| Correct refusals |" in text
    assert json.loads((tmp_path / "out" / "latest.json").read_text())["strategies"][1]["queries"][0]["hits"][0]["chunk_id"] == data["strategies"][1]["queries"][0]["hits"][0]["chunk_id"]
    with pytest.raises(ValueError):
        benchmark.compare(spark, source, boundaries, None, None, judge=generate)


def test_verdicts():
    rows = [{"recall_at_5": 0.5, "mrr_at_5": 0.2}, {"recall_at_5": 0.5, "mrr_at_5": 0.4}]
    assert "b (50.0%, 0.400)" in report.verdict(["a", "b"], rows) and "No difference" in report.verdict(["a", "b"], [rows[0], rows[0]])
    assert "One strategy" in report.verdict(["a"], rows[:1])
    assert report.failure_cause({"filter_applied": True, "predicted": "x", "expected_procedure": "y"}) != report.failure_cause({"filter_applied": False, "predicted": "x", "expected_procedure": "y"})


def test_commands(spark, tmp_path, model, capsys, monkeypatch):
    source, boundaries, gold, diag = files(tmp_path)
    index = str(tmp_path / "index")
    assert cli.main(["build", "--source", source, "--boundaries", boundaries, "--index-path", index]) == 0
    assert cli.main(["ask", "--query", "How to withdraw?", "--index-path", index]) == 0
    assert "form 1" in capsys.readouterr().out
    assert cli.main(["benchmark", "--source", source, "--boundaries", boundaries, "--gold", gold, "--diagnostic", diag, "--strategy", "baseline", "--skip-generation", "--output", str(tmp_path / "out")]) == 0
    data = json.loads((tmp_path / "out" / "latest.json").read_text())
    assert [r["strategy"] for r in data["strategies"]] == ["baseline"] and data["strategies"][0]["generation_skipped"] and not data["strategies"][0]["answer_metrics"]
    assert cli.main(["benchmark", "--source", "x", "--boundaries", "x", "--gold", "x", "--diagnostic", "x", "--skip-generation", "--llm-judge", "--output", "x"]) == 2
    assert cli.main(["fetch", "x.csv", "--output-dir", "x", "--delay", "0.1"]) == 2


def test_fetch_command(spark, tmp_path):
    (tmp_path / "urls.csv").write_text("url,doc_id,license_or_permission\nhttps://a.org/good,one,cc\nhttps://a.org/x/no,two,\nhttps://a.org/short,three,\nhttps://b.org/down,four,\n")

    def get(url):
        if url == "https://a.org/robots.txt":
            return url, "<pre>User-agent: *\nDisallow: /x</pre>"
        if "b.org" in url and not url.endswith("robots.txt"):
            raise OSError("down")
        if url.endswith("robots.txt"):
            return url, "<pre></pre>"
        return url + "/final", "<title>T</title><p>" + ("too short" if "short" in url else "long text " * 20)

    given = cli.parser().parse_args(["fetch", str(tmp_path / "urls.csv"), "--output-dir", str(tmp_path / "out")])
    assert cli.fetch(spark, given, get) == 1
    manifest = {r.doc_id: r for r in P.read_manifest(spark, str(tmp_path / "out" / "sources")).collect()}
    assert set(manifest) == {"one"} and manifest["one"].license_or_permission == "cc" and manifest["one"].source_url == "https://a.org/good/final"
    documents = spark.read.text(str(tmp_path / "out" / "documents"), wholetext=True, recursiveFileLookup=True).collect()
    assert len(documents) == 1 and documents[0][0].startswith('---\ndoc_id: "one"') and "# T" in documents[0][0]
    assert cli.fetch(spark, given, get) == 1  # what is there already stays
    crawled = P.crawl(P.read_url_list(spark, str(tmp_path / "urls.csv")), get, "me", "2024-01-01", P.read_manifest(spark, str(tmp_path / "out" / "sources")))
    why = {r.url.rsplit("/", 1)[1]: r.error for r in crawled.collect()}
    assert why == {"good": "the document is there already", "no": "not allowed by the site", "short": "the text is too short", "down": "down"}


def test_pages_over_http(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            kind, body = {"/h": ("text/html; charset=latin-1", "<p>é</p>".encode("latin-1")), "/t": ("text/plain", b"a < b")}.get(self.path, ("image/png", b""))
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get, base = P.http_fetch("me", 5, 0), f"http://127.0.0.1:{server.server_port}"
    assert get(base + "/h") == (base + "/h", "<p>é</p>") and P.extract(get(base + "/t")[1])[1] == "a < b"
    with pytest.raises(ValueError, match="image/png"):
        get(base + "/i")
    server.shutdown()


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"
        _jsc = property(lambda self: self)
        sc = getCheckpointDir = lambda self: self
        isDefined = lambda self: False

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared_folder(Session())
    assert math.isfinite(len(shared_folder(spark)))
