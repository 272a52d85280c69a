"""Operators on small inputs with results worked out by hand or by brute force."""

import itertools
import json
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragloom.functions import providers
from ragloom.functions import text as T
from ragloom.functions import vectors as V
from ragloom.operators import chunking as C
from ragloom.operators import evaluate as E
from ragloom.operators import hybrid as H
from ragloom.operators import ranking as R
from ragloom.operators.bm25 import BM25Index
from ragloom.operators.dense import dense_topk
from ragloom.operators.sections import SectionBoundaryError, detect_sections
from ragloom.operators.store import EmbeddingStore, cache_misses
from ragloom.plans.pipeline import KnowledgeBaseAgent, NotBuilt, RagPipeline, build_knowledge_base
from ragloom.plans.report import markdown
from ragloom.sources import documents as D
from ragloom.sources import pages as P
from ragloom.sources.index import IndexMissing
from ragloom.streaming.ingest import arrivals_by_window, ingest, read_arrivals


def values(spark, texts, *columns):
    """Columns worked out for each text, in order."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def one(spark, texts, column):
    return [r[0] for r in values(spark, texts, column.alias("c"))]


TEXTS = ["", "a" * 100, "word " * 60, "One. Two! Three? Four.  Five\nSix. 7", "x" * 45 + ". " + "y z " * 30, "é\n\nß\n\n\n" * 12, "Đăng ký học phần. " * 9, "😀" * 47, " . ! ", None]


def test_fixed_chunks(spark):
    for size, overlap in ((20, 5), (45, 0), (500, 50)):
        want = []
        for t in TEXTS:
            cut = []
            for at in itertools.count(0, size - overlap):
                if t:
                    cut.append(t[at : at + size])
                if not t or at + size >= len(t):
                    break
            want.append(cut)
        assert one(spark, TEXTS, C.FixedSizeChunker(size, overlap).chunk(F.col("t"))) == want
    with pytest.raises(ValueError):
        C.FixedSizeChunker(10, 10)


def test_sentence_chunks(spark):
    got = one(spark, TEXTS, C.SentenceChunker(2).chunk(F.col("t")))
    for t, chunks in zip(TEXTS, got, strict=True):
        s = [x.strip() for x in re.split(r"(?<=[.!?])\s+", (t or "").strip()) if x.strip()]
        assert chunks == [" ".join(s[i : i + 2]) for i in range(0, len(s), 2)]


def recursively(t, separators, size):
    """The definition, by recursion."""
    if len(t) <= size:
        return [t] if t else []
    if not separators or separators[0] == "":
        return [t[i : i + size] for i in range(0, len(t), size)]
    out, held = [], ""
    for part in t.split(separators[0]):
        longer = f"{held}{separators[0]}{part}" if held else part
        if len(longer) <= size:
            held = longer
            continue
        out += [held] if held else []
        if len(part) > size:
            out += recursively(part, separators[1:], size)
            held = ""
        else:
            held = part
    return out + ([held] if held else [])


def test_recursive_chunks(spark):
    for size in (7, 20, 500):
        got = one(spark, TEXTS, C.RecursiveChunker(chunk_size=size).chunk(F.col("t")))
        assert got == [recursively(t or "", C.SEPARATORS, size) for t in TEXTS]
        assert all(len(c) <= size for chunks in got for c in chunks)


def test_token_estimate_rounds_halves_to_even(spark):
    assert one(spark, ["", "a b c", "a b c d e", "a b c d e f g"], T.token_estimate(F.col("t"))) == [1, 4, 8, 10]


def test_structure_chunks(spark):
    text = "\n\n".join(" ".join(f"w{i}.{j}" for j in range(n)) for i, n in enumerate((3, 4, 40, 2, 6, 1)))
    c = C.StructureChunker(15, 25, 5)
    assert one(spark, ["", " \n\n "], c.chunk(F.col("t"))) == [[], []]
    units = one(spark, [text], c.units(F.col("t"), overlap=False))[0]
    assert [w for chunk in units for u in chunk for w in u.split()] == text.split()
    assert all(sum(C.tokens_of(u) for u in chunk) <= 25 or len(chunk) == 1 for chunk in units)
    with_overlap = one(spark, [text], c.units(F.col("t")))[0]
    for before, own, whole in zip(units[:-1], units[1:], with_overlap[1:], strict=True):
        added = whole[: len(whole) - len(own)]
        assert whole[len(added) :] == own and added and before[-len(added) :] == added
    for bad in ((0, 5), (10, 5)):
        with pytest.raises(ValueError):
            C.StructureChunker(*bad)


def test_chunk_links_and_ids(spark):
    s = spark.createDataFrame([("src", "slug", "Title", 0, "one two three.\n\n" * 40), ("src", "other", "T2", 1, " \n ")], "source_id string, procedure_slug string, procedure_title string, section_index int, text string")
    rows = C.chunk_sections(s, C.StructureChunker(15, 25, 0), "label").orderBy("chunk_index").collect()
    assert rows[0].chunk_id == "src::slug::chunk_000" and rows[0].previous_chunk_id is None and rows[-1].next_chunk_id is None
    assert all(a.next_chunk_id == b.chunk_id and b.previous_chunk_id == a.chunk_id for a, b in itertools.pairwise(rows))
    assert rows[0].text == f"Tài liệu: label\nQuy trình: Title\n\n{rows[0].raw_text}" and len(rows[0].content_hash) == 16
    assert {r.procedure_slug for r in rows} == {"slug"}


def test_normal_forms(spark):
    raw = ["A\r\nB\rC D﻿E", "a\n\n\n\n\nb", "• x\n  ◦  y \t\n", "https://x.y/Mẫu 07 8,0", "", None, unicodedata.normalize("NFD", "Đăng ký")]
    assert one(spark, raw, T.normalize_text(F.col("t"))) == ["A\nB\nC DE", "a\n\nb", "- x\n  - y", "https://x.y/Mẫu 07 8,0", "", "", "Đăng ký"]
    assert one(spark, ["  Đăng   ký học   phần?  "], T.normalize_query(F.col("t"))) == ["Đăng ký học phần?"]
    assert one(spark, ["Đăng_ký 8,0!"], T.tokenize(F.col("t"))) == [["đăng_ký", "8", "0"]]
    assert one(spark, ["A b--C!", "日本", None], T.slugify(F.col("t"))) == ["a-b-c", "document", "document"]


def test_vectors(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0, 0.0], [-3.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([3.0, 4.0], [3.0], 9 / 15)]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>, want double")
    for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), "want").collect():
        assert r.c == pytest.approx(r.want)
    (v,) = one(spark, ["some text"], V.mock_embedding(F.col("t")))
    import hashlib

    seed, want = int(hashlib.md5(b"some text").hexdigest(), 16), []
    for _ in range(64):
        seed = (seed * 1664525 + 1013904223) & 0xFFFFFFFF
        want.append(seed / 0xFFFFFFFF * 2 - 1)
    size = math.sqrt(sum(x * x for x in want))
    assert v == pytest.approx([x / size for x in want])


def test_front_matter(spark):
    files = [("a/b/one.md", "---\ntitle: \"T: x\" # c\n# no\nk: v\nk: w\nplain\n---\n\n\nBody\n"), ("two.TXT", "--- not closed\nx: y"), ("three.md", "no\n---\n")]
    df = spark.createDataFrame(files, "path string, text string")
    rows = {r.id: r for r in D.with_front_matter(df).collect()}
    assert rows["one"].content == "Body\n" and rows["one"].metadata == {"title": "T: x", "k": "w", "doc_id": "one", "source": "a/b/one.md"}
    assert rows["two"].content == files[1][1] and rows["three"].metadata == {"doc_id": "three", "source": "three.md"}


def test_sections_need_their_anchors_in_order(spark):
    df = spark.createDataFrame([(1, "pre A one B two A end")], "id int, text string")
    rows = detect_sections(df, [{"slug": "a", "anchor": "A"}, {"slug": "b", "title": "Bee", "anchor": "B"}, {"slug": "c", "anchor": "A"}]).orderBy("section_index").collect()
    assert [(r.procedure_slug, r.text) for r in rows] == [("a", "A one"), ("b", "B two"), ("c", "A end")]
    with pytest.raises(Exception, match="anchor not found"):
        detect_sections(df, [{"slug": "b", "anchor": "B"}, {"slug": "x", "anchor": "pre"}]).collect()
    with pytest.raises(SectionBoundaryError):
        detect_sections(df, [])


def test_pages(spark):
    html = "<title> A &amp; B </title><nav>skip</nav><p>One<br>two</p><script>var x='</p>'</script><!-- no --><div>three"
    assert P.extract(html) == ("A & B", "A & B \nOne\ntwo\n\nthree")
    u = spark.createDataFrame([("https://a.org/x/Page.html?q", "T"), ("https://a.org/", "Some Title"), ("http://b.org/", "")], "url string, title string")
    assert [r[0] for r in u.select(P.document_id(F.col("url"), F.col("title"))).collect()] == ["page", "some-title", "document"]
    robots = spark.createDataFrame([("https://a.org", "User-agent: *\nDisallow: /x")], "site string, body string")
    assert [r.allowed for r in P.robots_allowed(u, robots, "me").orderBy("url").collect()] == [False, True, False]
    old = spark.createDataFrame([("a", "old", "t", "u", "d", "1", "x"), ("b", "old", "t", "u", "d", "1", "x")], P.schema.MANIFEST)
    new = spark.createDataFrame([("b", "new", "t", "u", "d", "2", None)], "doc_id string, file_path string, title string, source_url string, retrieved_at string, document_version string, license_or_permission string")
    assert sorted((r.doc_id, r.file_path, r.license_or_permission) for r in P.upsert_manifest(old, new).collect()) == [("a", "old", "x"), ("b", "new", "")]

    def fetch(url):
        if "b.org" in url:
            raise OSError("down")
        return url + "#final", html

    got = {r.url: r for r in P.fetch_pages(u, fetch).collect()}
    assert got["http://b.org/"].error == "down" and got["https://a.org/"].final_url == "https://a.org/#final"


def test_bm25_by_hand(spark):
    texts = {"c1": "red apple apple", "c2": "green pear", "c3": "blue sky over sea", "c4": "green grass", "c5": ""}
    docs = spark.createDataFrame(list(texts.items()), "chunk_id string, raw_text string")
    queries = spark.createDataFrame([("q", "apple green apple"), ("none", "zebra")], "query_id string, query string")
    got = {r.id: r.score for r in BM25Index.build(docs).search(queries).collect()}
    n, avg = 5, 11 / 5
    idf = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    part = lambda df, tf, dl: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({"c1": 2 * part(1, 2, 3), "c2": part(2, 1, 2), "c4": part(2, 1, 2)})


def test_dense_ties_go_by_insertion_and_scope(spark):
    e = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], i % 3) for i in range(12)], "id int, embedding array<double>, scope int")
    q = spark.createDataFrame([("a", [1.0, 0.0], None), ("b", [1.0, 0.0], 2)], "query_id string, embedding array<double>, scope int")
    for parts in (1, 7):
        rows = dense_topk(q, e.repartition(parts), 3, "id", "id", scope="scope", at_once=1).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.id) for r in rows] == [("a", 1), ("a", 3), ("a", 5), ("b", 5), ("b", 11), ("b", 2)]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int, procedure_slug string")


def test_fusion_and_dedup(spark):
    a = ranked(spark, [("q", c, 1.0, i + 1, "s") for i, c in enumerate("abc")])
    b = ranked(spark, [("q", c, 1.0, i + 1, "s") for i, c in enumerate("bde")])
    fused = R.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()
    assert fused[0].chunk_id == "b" and fused[0].score == pytest.approx(1 / 62 + 1 / 61)
    tie = R.reciprocal_rank_fusion([ranked(spark, [("q", "z", 1.0, 1, "s")]), ranked(spark, [("q", "a", 1.0, 1, "s")])])
    assert [r.chunk_id for r in tie.orderBy("rank").collect()] == ["a", "z"]
    dup = a.withColumn("content_hash", F.when(F.col("chunk_id") == "c", "h2").otherwise("h1"))
    assert [(r.chunk_id, r.rank) for r in R.deduplicate(dup).orderBy("rank").collect()] == [("a", 1), ("c", 2)]
    assert R.deduplicate(a.withColumn("content_hash", F.lit(""))).count() == 3


def diversified(items, k, epsilon=0.02):
    left, out = list(items), []
    while left and len(out) < k:
        band = [x for x in left if left[0][1] - x[1] <= epsilon]
        pick = next((x for x in band if x[2] not in {o[2] for o in out}), band[0]) if out else left[0]
        out.append(pick)
        left.remove(pick)
    return [x[0] for x in out]


def test_diversify_against_brute_force(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for q in range(30):
        scores = sorted((round(rng.uniform(0, 0.08), 3) for _ in range(rng.randint(1, 9))), reverse=True)
        items = [(f"c{i}", s, rng.choice("xyz")) for i, s in enumerate(scores)]
        rows += [(f"q{q}", c, s, i + 1, slug) for i, (c, s, slug) in enumerate(items)]
        want[f"q{q}"] = diversified(items, 4)
    got = {}
    for r in R.diversify(ranked(spark, rows), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == want


def test_expand_adjacent_against_brute_force(spark):
    rng = random.Random(6)
    chunks = [(f"c{i}", "w " * rng.randint(1, 12), f"s{i // 7}", f"c{i - 1}" if i else None, f"c{i + 1}") for i in range(30)]
    table = {c[0]: c for c in chunks}
    size = lambda c: max(1, round(len(table[c][1].split()) * 1.5))
    rows, want = [], {}
    for q in range(20):
        own = rng.sample(sorted(table), 4)
        rows += [(f"q{q}", c, 1.0 - i / 10, i + 1, table[c][2]) for i, c in enumerate(own)]
        used, total, out = set(own), sum(map(size, own)), []
        for c in own:
            out.append((c, "primary"))
            for near in table[c][3:]:
                if near and near in table and near not in used and table[near][2] == table[c][2] and total + size(near) <= 70:
                    used.add(near)
                    total += size(near)
                    out.append((near, "adjacent"))
        want[f"q{q}"] = out
    df = spark.createDataFrame(chunks, "chunk_id string, raw_text string, procedure_slug string, previous_chunk_id string, next_chunk_id string")
    got = {}
    for r in R.expand_adjacent(ranked(spark, rows), df, 70).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.source))
    assert got == want


def test_classification(spark):
    kw = spark.createDataFrame([("a", "Apple"), ("b", "bee"), ("b", "buzz")], "slug string, keyword string")
    q = spark.createDataFrame([("1", "An APPLE"), ("2", "apple bee"), ("3", "bee buzz"), ("4", "none")], "query_id string, query string")
    got = {r.query_id: tuple(r)[1:] for r in R.classify_keywords(q, kw).collect()}
    assert got == {"1": ("a", 0.75, True), "2": ("b", 0.5, False), "3": ("b", 1.0, True), "4": (None, 0.0, False)}


def test_metrics(spark):
    rows = [([True, False, False], "a", "a", 10.0), ([False, True], None, "a", 20.0)]
    df = spark.createDataFrame(rows, "flags array<boolean>, predicted string, expected string, latency_ms double")
    m = E.retrieval_metrics(df).first()
    assert tuple(m) == (0.5, 1.0, 1.0, 0.75, 0.5, 15.0, 20.0)
    assert set(E.retrieval_metrics(df.limit(0)).first()) == {0.0}
    assert "| Hit@1 | 50.0% |" in markdown([{"strategy": "x", **m.asDict()}])


def test_store(spark):
    docs = spark.createDataFrame([(f"doc{i}", f"This is document number {i}.", {"lang": "en" if i % 2 else "vi"}) for i in range(10)], "id string, content string, metadata map<string,string>")
    store = EmbeddingStore(spark)
    assert store.get_collection_size() == 0
    store.add_documents(docs)
    store.add_documents(docs.limit(1))
    assert store.get_collection_size() == 11 and store.records.select("seq").distinct().count() == 11
    q = spark.createDataFrame([("q", "This is document number 3.")], "query_id string, query string")
    first = store.search(q, 4).orderBy("rank").collect()
    assert len(first) == 4 and first[0].id == "doc3" and first[0].score == pytest.approx(1.0)
    assert {r.metadata["lang"] for r in store.search_with_filter(q, 3, {"lang": "vi", "none": None}).collect()} == {"vi"}
    assert store.delete_document("doc3") and not store.delete_document("doc3") and store.get_collection_size() == 10
    cache = spark.createDataFrame([], "model string, text_hash string, embedding array<double>")
    assert cache_misses(docs, cache).count() == 10


BOUNDARIES = {
    "source_document": {"source_id": "guide", "source_title": "Guide"},
    "procedures": [{"slug": s, "title": s.title(), "anchor": f"## {s}", "query_keywords": [s]} for s in ("register", "withdraw", "appeal")],
}


def test_pipeline_from_file_to_answers(spark, tmp_path):
    text = "intro\n\n" + "\n\n".join(f"## {s}\n\nTo {s} a course, fill in form {i}. " + f"More about {s}. " * 30 for i, s in enumerate(("register", "withdraw", "appeal")))
    (tmp_path / "guide.md").write_text(text)
    (tmp_path / "b.json").write_text(json.dumps(BOUNDARIES))
    p = RagPipeline.for_strategy(spark, "high_accuracy")
    with pytest.raises(NotBuilt):
        p.built()
    p.build_index(str(tmp_path / "guide.md"), str(tmp_path / "b.json"))
    q = spark.createDataFrame([("1", "How do I  withdraw?"), ("2", "appeal form")], "query_id string, query string")
    hits = p.retrieve(q, 2).orderBy("query_id", "rank").collect()
    assert {(r.query_id, r.procedure_slug) for r in hits} == {("1", "withdraw"), ("2", "appeal")}
    p.save_index(str(tmp_path / "index"))
    again = RagPipeline.load_index(spark, str(tmp_path / "index")).retrieve(q, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in again] == [(r.query_id, r.chunk_id, r.score) for r in hits]
    with pytest.raises(IndexMissing):
        RagPipeline.load_index(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        RagPipeline.for_strategy(spark, "other")

    def generate(prompt):
        if "appeal form" in prompt:
            raise RuntimeError("no answer")
        return "See [documents/withdraw/guide::withdraw::chunk_000] and [documents/x/y]."

    said = {r.query_id: r for r in p.answer(q, generate).collect()}
    assert [c.chunk_id for c in said["1"].citations] == ["guide::withdraw::chunk_000", "y"] and [c.chunk_id for c in said["1"].unsupported] == ["y"]
    assert said["2"].answer is None and said["2"].error == "no answer"
    plain = RagPipeline.for_strategy(spark, "baseline")
    plain.build_index(str(tmp_path / "guide.md"), str(tmp_path / "b.json"))
    assert plain.retrieve(q, 3).count() == 6


def test_knowledge_base_and_agent(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\nlang: en\n---\n" + "All about apples. " * 3)
    (tmp_path / "sub" / "b.TXT").write_text("All about bees.")
    (tmp_path / "c.pdf").write_text("no")
    store = build_knowledge_base(spark, str(tmp_path), C.FixedSizeChunker(30, 5))
    rows = {r.id: r for r in store.records.collect()}
    assert set(rows) == {"a::chunk_0", "a::chunk_1", "b::chunk_0"} and rows["a::chunk_0"].metadata["lang"] == "en"
    agent = KnowledgeBaseAgent(store, lambda prompt: f"{prompt.count('All about')}|{prompt[-27:]}")
    q = spark.createDataFrame([("q", "What is it?")], "query_id string, query string")
    assert agent.answer(q, 2).first().answer.endswith("Question: What is it?\nAnswer:"[-27:])


def test_embedders_fall_back(spark):
    def broken():
        raise OSError("no model")

    providers.register_embedder("broken", broken)
    assert providers.embedder("broken")[0] == "mock"
    with pytest.raises(providers.ProviderError):
        providers.embedder("broken", None)
    lengths = providers.model_embedder(lambda: lambda texts: [[float(len(t))] for t in texts])
    assert one(spark, ["ab", None, "abc"], lengths(F.col("t"))) == [[2.0], None, [3.0]]


def test_streaming_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def arrive(name, *rows):
        (source / name).write_text("\n".join(json.dumps({"id": i, "content": c, "arrived": t}) for i, c, t in rows))

    def run():
        ingest(read_arrivals(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state"), C.FixedSizeChunker(10, 0)).awaitTermination()
        return sorted((r.chunk_id, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive("1.json", ("a", "x" * 15, "2024-01-01T00:00:00"), ("a", "x" * 15, "2024-01-01T00:00:01"))
    assert run() == [("a::chunk_0", "x" * 10), ("a::chunk_1", "x" * 5)]
    arrive("2.json", ("a", "x" * 15, "2024-01-01T01:00:00"), ("b", "new", "2024-01-01T02:00:00"))
    assert run()[2:] == [("b::chunk_0", "new")]
    counted = arrivals_by_window(read_arrivals(spark, str(source)))
    assert counted.isStreaming and counted.columns == ["start", "documents", "characters"]


def test_hybrid_without_lexical_hits_keeps_dense_scores(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"alpha{i}", "s", f"h{i}", None, None) for i in range(4)], "chunk_id string, raw_text string, procedure_slug string, content_hash string, previous_chunk_id string, next_chunk_id string")
    r = H.HybridRetriever(chunks.withColumn("embedding", V.mock_embedding(F.col("raw_text"))))
    q = spark.createDataFrame([("q", "zzz")], "query_id string, query string")
    got = r.retrieve(q, 4).primary.collect()
    assert len(got) == 4 and max(x.score for x in got) > 0.04


ODD_TEXTS = ["", " ", "--", "a", "-a-", "İstanbul ǅ ß naïve é x_y ½ ² Ⅷ ٣ 漢字かな ａｂ — don't 𝒳 😀", "क्षि ñ̃ q̃ Σίσυφος ΣΑΣ", "one  two\nthree four", None, "the the The", "_", "﻿x​y"]


def test_tokens_are_counted_a_few_texts_at_a_time(spark, monkeypatch):
    """The arrays that are worked out have a bound however many rows a batch has, and the counts are those of tokenize."""
    from ragloom.operators import bm25

    sizes, inner = [], bm25.words_of
    monkeypatch.setattr(bm25, "BYTES_OF_A_PIECE", 300)
    texts = ["many words of a text " * 4] * 200 + ["long " * 200] + [t for t in ODD_TEXTS if t is not None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    pieces = list(bm25._pieces(batch, pa.array([len(t.encode()) for t in texts]), 300))
    for piece in pieces:
        row, _ = inner(piece.column(1))
        sizes.append(len(row))
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch])) and max(sizes) == 200 and sorted(sizes)[-2] <= 75
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "id long, text string").repartition(2)
    want = {r.id: Counter(r.t) for r in docs.where("text is not null").select("id", T.tokenize(F.col("text")).alias("t")).collect()}
    got = {r.id: r for r in bm25.counted_tokens(docs, "id", "text").collect()}
    assert {i: Counter(dict(zip(r.tokens, r.tf, strict=True))) for i, r in got.items()} == want
    assert all(r.dl == sum(want[i].values()) for i, r in got.items())


@pytest.mark.parametrize("at_once", [64, 130, 1_000_000])
def test_scores_are_added_up_some_rows_at_a_time(spark, monkeypatch, at_once):
    from ragloom.operators import bm25

    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(0, 20)))) for i in range(150)], "id long, text string")
    queries = spark.createDataFrame([(str(i), " ".join(rng.choices(words, k=4))) for i in range(70)], "query_id string, query string")
    index = bm25.BM25Index.build(docs, "id", "text")
    monkeypatch.setattr(bm25, "SCORES_AT_ONCE", at_once)
    monkeypatch.setattr(bm25, "TOKENS_AT_A_TIME", at_once)
    few = {(r.query_id, r.rank): (r.id, r.score) for r in index.search(queries, 5, 6).collect()}
    joined = {(r.query_id, r.rank): (r.id, r.score) for r in index.search(queries, 5, 6, at_once=0).collect()}
    assert len(few) > 200 and few == joined


@pytest.mark.parametrize("at_once", [1000, 3])
def test_scoped_vectors_meet_those_of_their_scope_only(spark, monkeypatch, at_once):
    from ragloom.operators import dense

    pairs, inner = [], dense.best_of_batch
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.choice(["a", "b", "c", None])) for i in range(60)]
    e = spark.createDataFrame(rows, "id long, embedding array<double>, scope string").repartition(3)
    queries = e.select((F.col("id") + 100).alias("query_id"), "embedding", "scope")
    got = dense_topk(queries, e, 3, "id", scope="scope", digits=9, at_once=at_once).collect()
    want = {}
    for q, v, s in rows:
        score = sorted((-round(sum(x * y for x, y in zip(v, w, strict=True)), 9), i) for i, w, t in rows if s is None or s == t)
        want |= {(q + 100, n + 1): i for n, (_, i) in enumerate(score[:3])}
    assert {(r.query_id, r.rank): r.id for r in got} == want
    monkeypatch.setattr(dense, "best_of_batch", lambda score, k: pairs.append(score.size) or inner(score, k))
    ask = pa.table({"query_id": range(60), "scope": pa.array([r[2] for r in rows])}).to_batches()[0]
    batch = pa.record_batch([pa.array(range(60)), pa.array(range(60)), pa.array([r[2] for r in rows]), pa.array([r[1] for r in rows])], ["id", "tie", "scope", "embedding"])
    list(dense._scores(ask, batch, np.array([r[1] for r in rows]), 3, 9))
    n = Counter(r[2] for r in rows)
    assert sum(pairs) == n[None] * 60 + sum(m * m for s, m in n.items() if s is not None)


def test_few_hits_meet_the_chunks_where_they_are(spark):
    """No join of the hits shuffles or sorts the chunks, and tokens are counted of the texts asked for only."""
    chunks = spark.createDataFrame(
        [(f"c{i}", f"word{i} text", "s", f"h{i}", f"c{i - 1}" if i else None, f"c{i + 1}") for i in range(50)],
        "chunk_id string, raw_text string, procedure_slug string, content_hash string, previous_chunk_id string, next_chunk_id string",
    ).withColumn("embedding", V.mock_embedding(F.col("raw_text"))).cache()
    queries = spark.createDataFrame([("q", "word7 text")], "query_id string, query string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        primary = spark.createDataFrame([("q", "c7", 1.0, 1), ("q", "c8", 0.5, 2)], "query_id string, chunk_id string, score double, rank int")
        grown = R.expand_adjacent(primary, chunks)
        plan = grown._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan
        assert [(r.chunk_id, r.source) for r in grown.orderBy("rank").collect()] == [("c7", "primary"), ("c6", "adjacent"), ("c8", "primary"), ("c9", "adjacent")]
        r = H.HybridRetriever(chunks, None, H.Strategy(use_adjacent_expansion=False, enable_diversity=False))
        fused = r.fused(queries, r.classify(queries))
        assert "strategy=broadcast" in fused._jdf.queryExecution().optimizedPlan().toString()
        assert fused.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (10, 5), (10, 8), (10, 0), (1, 0), (500, 50)])
def test_fixed_chunks_are_cut_in_one_pass(spark, size, overlap):
    """Lengths about every border, newlines and characters of four bytes; where the overlap is no more than a step no substring is counted from the begin of the text."""
    texts = ["a😀\né"[: n % 5] + "xy\n😀é" * (n // 5) for n in [*range(0, 40), 449, 450, 451, 499, 500, 501, 949, 950, 951, 1400, 3000]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    cut = docs.select("i", C.FixedSizeChunker(size, overlap).chunk(F.col("t")).alias("c"))
    step = size - overlap
    for i, c in cut.collect():
        t = texts[i] if i < len(texts) else ""
        assert c == [t[k : k + size] for k in range(0, max(1, math.ceil((len(t) - size) / step) * step + 1), step) if t]
    assert ("regexp_extract_all" in cut._jdf.queryExecution().optimizedPlan().toString()) == (overlap <= step)
