"""Operators against brute force, and their results on null, empty, long, tied, repeated and clashing rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ragloom.llm import decontam, gru, langid, mixing, passages, quality, simhash, tokens, toxicity, urlfilter
from ragloom.llm import kernel as K

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside.
CLASHING = ["key", "th", "row", "n", "slot", "place", "block", "epoch", "carried", "starts", "ends", "node", "keep", "language", "a.b"]


def prose(rng, n, language="en"):
    syllables = {"en": ["th", "er", "on", "an", "ing", "and", "wh", "ou"], "de": ["sch", "ein", "ung", "ch", "der", "ich", "zu", "ge"]}[language]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 9 == 8 else w for i, w in enumerate(words))


def documents(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, lang, s, len(t) if t else None) for i, t, lang, s in rows], DOCUMENT)
    for c in CLASHING if extra else []:
        df = df.withColumn(c, F.lit("x"))
    return df


def corpus(rng):
    """Prose of two languages, exact and near copies, shared passages, and awkward rows."""
    rows = [(i, prose(rng, rng.randint(60, 200), "en" if i % 3 else "de"), "en" if i % 3 else "de", f"s{i % 4}") for i in range(60)]
    words = rows[5][1].split()
    near = " ".join([*words[:-4], "one", "two", "three", "four"])
    passage = prose(rng, 80)
    rows += [(60, rows[4][1], "en", "s0"), (61, rows[4][1], "en", "s1"), (62, near, "en", "s0")]
    rows += [(63, prose(rng, 70) + " " + passage + " " + prose(rng, 70), "en", "s2"), (64, prose(rng, 90) + "\n" + passage.upper(), "en", "s2")]
    rows += [(65, None, None, None), (66, "", "en", ""), (None, "!!! ...", "de", "s1"), (None, None, None, "s3"), (67, prose(rng, 30_000), "en", "s1")]
    return rows + [(68, "same row " * 5, "en", "s0")] * 3


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(3))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def test_token_counts_by_encoding_each(spark, rows, docs, none):
    encode = tokens.encoder(tokens.VOCABULARY, tokens.PATTERN).encode_ordinary
    sizes = [len(encode(t or "")) for _, t, _, _ in rows]
    limits = tokens.context_limits(tokens.length_histogram(docs)).cache()
    got = {r.n_tokens: r for r in limits.collect()}
    assert {n: r.docs for n, r in got.items()} == dict(Counter(sizes))
    for n, r in got.items():
        assert r.docs_at_least == sum(s >= n for s in sizes) and r.docs_up_to == sum(s <= n for s in sizes)
        assert r.tokens_at_least == sum(s for s in sizes if s >= n) and r.truncated_tokens == sum(min(s, n) for s in sizes)
    asked = tokens.at_limits(limits, [0, 7, 100, 10**6]).collect()
    assert {r.limit_tokens: (r.docs_fit, r.truncated_tokens) for r in asked} == {
        x: (sum(s <= x for s in sizes), sum(min(s, x) for s in sizes)) for x in (0, 7, 100, 10**6)
    }
    quantiles = {r.quantile: r.n_tokens for r in tokens.quantiles(limits, [0.5, 0.9]).collect()}
    assert quantiles == {q: sorted(sizes)[math.ceil(q * len(sizes)) - 1] for q in (0.5, 0.9)}
    assert tokens.context_limits(tokens.length_histogram(none)).count() == 0


def repeated(rows, size):
    """By document the words that are in a window of size words that an earlier document has, by brute force."""
    texts = sorted({(i if i is not None else K.NO_ID, t or "") for i, t, _, _ in rows})
    first = {}
    out = {}
    for at, (i, t) in enumerate(texts):
        w = re.findall(r"[^\W_]+", t.lower())
        for k in range(len(w) - size + 1):
            if first.setdefault(tuple(w[k : k + size]), at) < at:
                out.setdefault((i, t), set()).update(range(k, k + size))
    return out


def test_passages_are_those_of_brute_force(spark, rows, docs, none):
    want = repeated(rows, passages.WORDS)
    got = defaultdict(set)
    for r in passages.removed_passages(docs).collect():
        got[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    assert got == {i: s for (i, _), s in want.items()} and {61, 60, 62, 64} <= set(got)
    left = passages.drop_passages(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    by_id = {r.doc_id: r for r in left.collect() if r.doc_id is not None}
    assert by_id[60].text == "" and by_id[60].n_chars == 0 and by_id[65].text is None
    assert by_id[3].text == rows[3][1]
    assert passages.removed_passages(none).count() == passages.drop_passages(none).count() == 0


@pytest.mark.parametrize(("bodies", "batch"), [(2000, 10_000), (1, 7), (2000, 7), (0, 60)])
def test_passages_of_a_small_alphabet(spark, bodies, batch):
    """By suffix arrays and by window hashes, in large batches of documents and in small ones."""
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 60))), "en", "s") for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = defaultdict(set)
        for r in passages.removed_passages(documents(spark, rows), words=8, gram=4, shard_words=50, gram_bodies=bodies).collect():
            got[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: s for (i, _), s in repeated(rows, 8).items()}


def test_a_passage_in_very_many_documents(spark):
    """One passage whole in a third of all documents, and one shorter than a window, so every document has other words around it."""
    rng = random.Random(2)
    whole, line = prose(rng, 60), prose(rng, 45)
    own = [prose(rng, 30) for _ in range(50)]
    n = 30_000
    base = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit(whole + " "), "id")).when(F.col("id") % 3 == 1, F.concat(F.lit("x"), "id", F.lit(" "), F.lit(line), F.lit(" y"), F.col("id") % 7, F.lit(" "), F.lit(own[0])))
        .otherwise(F.concat(F.lit("z"), F.col("id").cast("string"))).alias("text"),
    )
    got = passages.removed_passages(base, gram_bodies=100).groupBy("doc_id").agg(F.sum("n_words").alias("n"))
    by = {r.kind: (r.docs, r.low, r.high) for r in got.groupBy((F.col("doc_id") % 3).alias("kind")).agg(F.count("*").alias("docs"), F.min("n").alias("low"), F.max("n").alias("high")).collect()}
    assert by == {0: (n // 3 - 1, 60, 60), 1: (n // 3 - 7, 76, 76)}  # every window of the line holds one of seven words


@pytest.mark.parametrize("script", ["мама мыла раму и пела", "đăng ký học phần ở trường", "人人生而自由在尊严和权利上一律平等"])
def test_passages_of_other_scripts(spark, script):
    passage = (script + " ") * 13 if " " in script else script * 5
    rows = [(0, "erste " + passage, "x", "s"), (1, passage.upper() + " zweite", "x", "s")]
    got = passages.removed_passages(documents(spark, rows), words=20, gram=10).collect()
    n = len(passage.split()) if " " in script else len(passage)
    assert [(r.doc_id, r.first_word, r.n_words) for r in got] == [(1, 0, n)]
    bench = documents(spark, [(9, passage[: len(passage) // 2], "x", "s")], extra=False)
    assert {r.doc_id for r in decontam.contaminated_spans(documents(spark, rows), bench).collect()} == {0, 1}


def test_mixture_keeps_weights_and_every_document(spark, rows, docs, none):
    mixed = [r.asDict() for r in mixing.mix(docs, block_docs=4, resolution=100).collect()]
    counts = Counter(s or "" for *_, s in rows)
    parts = mixing.whole_weights(mixing.tempered(counts), 100)
    by_slot = {}
    for r in mixed:
        assert by_slot.setdefault(r["slot"], r["source"]) == r["source"]
    assert sorted(by_slot) == list(range(len(by_slot)))
    done = Counter()
    for slot in range(len(by_slot)):
        done[by_slot[slot]] += 1
        assert all(abs(done[s] - (slot + 1) * p / 100) < 1 for s, p in parts.items())
    assert Counter((r["source"], r["doc_id"]) for r in mixed if r["epoch"] == 0) == Counter((s or "", i) for i, _, _, s in rows)
    many = mixing.mix(docs, block_docs=4, resolution=100, rows_per_task=3)
    assert many.where("epoch = 0").count() == len(rows) and many.select("slot").distinct().count() == len(by_slot)
    texts = mixing.mix_texts(docs)
    given = {n if n not in ("slot", "place", "block", "epoch") else f"given_{n}" for n in docs.columns}
    assert texts.columns[:4] == ["slot", "place", "block", "epoch"] and set(texts.columns[4:]) == given and texts.where("text is not null").count() > 0
    assert mixing.mix(none).count() == mixing.mix_texts(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 1.0})


def test_mixture_of_very_many_sources(spark):
    rows = [(i, "x", "en", f"s{i % 1500}") for i in range(3000)]
    mixed = mixing.mix(documents(spark, rows), block_docs=1).collect()
    assert {(r.source, r.doc_id) for r in mixed} == {(s, i) for i, _, _, s in rows} and len({r.slot for r in mixed}) == len(mixed)


def test_mixture_orders_rows_of_equal_id_by_their_content(spark):
    rows = [(None, f"text {i}", "en", "s") for i in range(40)] + [(7, f"other {i}", "en", "s") for i in range(40)]
    orders = []
    for seed in (0, 1):
        random.Random(seed).shuffle(rows)
        mixed = mixing.mix_texts(documents(spark, rows).repartition(3 + seed), block_docs=4)
        orders.append(sorted((r.slot, r.place, r.text) for r in mixed.collect()))
    assert orders[0] == orders[1] and len(orders[0]) == 80


def near_pairs(docs, distance):
    signed = simhash.signatures(docs).collect()
    sig = np.array([[r.s0, r.s1, r.s2, r.s3] for r in signed], np.int64).view(np.uint64)
    d = np.bitwise_count(sig[:, None] ^ sig[None]).sum(2)
    return [r.key for r in signed], d <= distance


def groups_of(keys, near):
    """Connected components of all pairs within distance, by brute force."""
    own = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if near[i, j] and own[i] != own[j]:
                a, b = own[i], own[j]
                own = [b if x == a else x for x in own]
    return own


def test_near_duplicates_have_the_recall_of_all_pairs(spark):
    rng = random.Random(1)
    base = [prose(rng, 150).split() for _ in range(60)]
    rows = []
    for i in range(400):
        w = list(base[i % 60])
        for _ in range(rng.randint(0, 30)):
            w[rng.randrange(len(w))] = "".join(rng.choices("abcdefg", k=6))
        rows.append((i, " ".join(w), "en", "s"))
    docs = documents(spark, rows, extra=False)
    keys, near = near_pairs(docs, simhash.DISTANCE)
    own = groups_of(keys, near)
    got = {r.key: r.group_id for r in simhash.near_duplicates(docs).collect()}
    pairs = [(i, j) for i in range(len(keys)) for j in range(i) if near[i, j]]
    assert len(pairs) > 300
    found = sum(got.get(keys[i], -1) == got.get(keys[j], -2) for i, j in pairs)
    assert found >= 0.9 * len(pairs)
    by_key = dict(zip(keys, own, strict=True))
    for group in set(got.values()):  # nothing is joined that all pairs would not join
        assert len({by_key[k] for k, g in got.items() if g == group}) == 1


@pytest.mark.parametrize("nodes", [1000, 200_000, 15_000_000])
def test_recall_at_the_distance_holds_at_every_size(spark, nodes):
    rng = np.random.default_rng(7)
    sig = rng.integers(0, 1 << 64, (600, 4), dtype=np.uint64)
    for i in range(0, len(sig), 2):  # pairs exactly at the distance, nothing else near
        bits = np.unpackbits(sig[i].view(np.uint8))
        bits[rng.choice(256, simhash.DISTANCE, replace=False)] ^= 1
        sig[i + 1] = np.packbits(bits).view(np.uint64)
    rows = [(i, *s) for i, s in enumerate(sig.view(np.int64).tolist())]
    table = spark.createDataFrame(rows, "node long, s0 long, s1 long, s2 long, s3 long")
    got = {(r.a, r.b) for r in simhash.links(table, nodes).collect()}
    assert got <= {(i, i + 1) for i in range(0, len(sig), 2)}
    assert len(got) >= 0.86 * len(sig) / 2  # 0.9 less some two deviations


@pytest.mark.parametrize(("block", "tile", "held"), [(400_000, 1024, 1_000_000), (97, 16, 5)])
def test_no_pair_within_the_distance_is_left_out(spark, monkeypatch, block, tile, held):
    """Pairs at the very distance and one bit beyond it, and a chain of near nodes: links and their numbers are those of all pairs."""
    for name, value in (("BLOCK", block), ("TILE", tile), ("HELD", held)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(12)
    sig = rng.integers(0, 1 << 64, (900, 4), dtype=np.uint64)
    for i in range(1, len(sig)):
        if i % 2 or i > 860:
            bits = np.unpackbits(sig[i - 1].view(np.uint8))
            bits[rng.choice(256, simhash.DISTANCE + (i % 20 == 1), replace=False)] ^= 1
            sig[i] = np.packbits(bits).view(np.uint64)
    near = np.bitwise_count(sig[:, None] ^ sig[None]).sum(2) <= simhash.DISTANCE
    near[np.arange(900), np.arange(900)] = False
    assert near.sum() > 800
    for key in (np.zeros(900, np.int64), np.arange(900) // 450):  # in this process, which has the sizes of tiles
        a, b, degree = simhash._links(key, np.arange(900), sig, simhash.DISTANCE)
        shown = near & ((key[:, None] != key) | (key[-1] == 0))
        assert degree.tolist() == shown.sum(1).tolist() and shown[a, b].all() and groups_of(range(900), shown) == groups_of(range(900), np.isin(np.arange(900)[:, None] * 900 + np.arange(900), [*(a * 900 + b), *(b * 900 + a)]))
    for n, count in ((900, 900), (20, 12 * 97)):  # a table of 20 nodes leaves some blocks empty
        rows = [(i, *s) for i, s in enumerate(sig[-n:].view(np.int64).tolist())]
        got = simhash.compared(spark.createDataFrame(rows, "node long, s0 long, s1 long, s2 long, s3 long"), count).collect()
        links = {(r.a, r.b) for r in got if r.a != r.b}
        assert all(a < b and near[-n:, -n:][a, b] for a, b in links)
        want = groups_of(range(n), near[-n:, -n:])
        own = simhash._joined(n, *np.array(sorted(links)).T)
        assert len({*zip(own.tolist(), want, strict=True)}) == len(set(want)) == len(set(own.tolist()))
        degree = Counter()
        for r in got:
            degree[r.a] += r.links
        assert [degree[i] for i in range(n)] == near[-n:, -n:].sum(1).tolist()


@pytest.mark.parametrize("flips", [20, 35, 60])
def test_links_of_many_near_copies(flips):
    """Tiles in which many pairs are within the distance, or just beyond it."""
    rng = np.random.default_rng(2)
    bits = np.repeat(rng.integers(0, 2, (1, 256), dtype=np.uint8), 1500, 0)
    for row in bits[:1300]:
        row[rng.choice(256, flips, replace=False)] ^= 1
    sig = np.packbits(bits, axis=1).view(np.uint64)
    near = np.bitwise_count(sig[:, None] ^ sig[None]).sum(2) <= simhash.DISTANCE
    near[np.arange(1500), np.arange(1500)] = False
    a, b, degree = simhash._links(np.zeros(1500, np.int64), np.arange(1500), sig, simhash.DISTANCE)
    assert degree.tolist() == near.sum(1).tolist() and near[a, b].all() and len(a) < 3000
    assert len(set(simhash._joined(1500, a, b).tolist())) == len(set(simhash._joined(1500, *np.nonzero(near)).tolist()))


def distant_pairs(rng, rows):
    """Signatures of which every second one is near the one before, at the very distance or a bit beyond it, the bits of some in a few segments only."""
    sig = rng.integers(0, 1 << 64, (rows, 4), dtype=np.uint64)
    for i in range(1, rows, 2):
        bits = np.unpackbits(sig[i - 1].view(np.uint8))
        many = simhash.DISTANCE + (i % 20 == 1) if i < rows * 2 // 3 else int(rng.integers(0, 60))
        bits[rng.choice(256 if i % 3 else 70, many, replace=False)] ^= 1
        sig[i] = np.packbits(bits).view(np.uint64)
    sig[: rows // 10] ^= sig[: rows // 10] & sig[0] ^ sig[0]  # a group that shares many bits
    return sig


@pytest.mark.parametrize(("distance", "cells", "held"), [(simhash.DISTANCE, simhash.CELLS, simhash.HELD), (simhash.DISTANCE, 7, 40), (20, 500, 100), (5, 500, 100)])
def test_a_search_by_segments_finds_every_pair_once(monkeypatch, distance, cells, held):
    monkeypatch.setattr(simhash, "CELLS", cells)
    monkeypatch.setattr(simhash, "HELD", held)
    sig = distant_pairs(np.random.default_rng(9), 900)
    near = np.bitwise_count(sig[:, None] ^ sig[None]).sum(2) <= distance
    assert near.sum() > 910
    for shares in (1, 5):
        got = Counter((min(p), max(p)) for share in range(shares) for i, j in simhash._searched(sig, sig, True, distance, share, shares) for p in zip(i.tolist(), j.tolist(), strict=True))
        assert set(got.values()) <= {1} and set(got) == {*zip(*np.nonzero(np.triu(near, 1)), strict=True)}
        x, y = sig[:450], sig[450:]
        got = Counter(p for share in range(shares) for i, j in simhash._searched(x, y, False, distance, share, shares) for p in zip(i.tolist(), j.tolist(), strict=True))
        assert set(got.values()) <= {1} and set(got) == {*zip(*np.nonzero(near[:450, 450:]), strict=True)}


@pytest.mark.parametrize("block", [400_000, 97])
def test_links_of_a_search_by_segments_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    sig = distant_pairs(np.random.default_rng(10), 300)
    rows = [(i, *s) for i, s in enumerate(sig.view(np.int64).tolist())]
    nodes = spark.createDataFrame(rows, "node long, s0 long, s1 long, s2 long, s3 long").repartition(1)
    by_search, by_products = (simhash.compared(nodes, 300, dense=dense).collect() for dense in (0, 300))
    degree, groups = [], []
    for got in (by_search, by_products):
        n = Counter()
        for r in got:
            n[r.a] += r.links
        degree.append(+n)
        own = simhash._joined(300, *np.array([(r.a, r.b) for r in got if r.a != r.b]).T)
        groups.append({frozenset(np.flatnonzero(own == k).tolist()) for k in set(own.tolist())})
    assert degree[0] == degree[1] and sum(degree[0].values()) > 100 and groups[0] == groups[1]
    assert simhash.looked_at(simhash.DISTANCE) < 0.15  # of all pairs, where products look at each


def test_near_copies_are_found_whatever_their_share_of_the_table(spark):
    rng = random.Random(3)
    base = prose(rng, 350).split()
    rows = [(i, prose(rng, 150), "en", "s") for i in range(120)]
    for i in range(120, 160):  # each with 2 % of its words edited
        w = list(base)
        for at in rng.sample(range(len(w)), 7):
            w[at] = "".join(rng.choices("abcdefg", k=6))
        rows.append((i, " ".join(w), "en", "s"))
    got = {r.key: r.group_id for r in simhash.near_duplicates(documents(spark, rows, extra=False)).collect()}
    assert got == dict.fromkeys(range(120, 160), 120)


def test_documents_of_common_words_are_no_duplicates(spark):
    """Texts of few words in all, two of which share the only rare one."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(400)]
    texts[10] += " zebra"
    texts[300] += " zebra"
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    assert simhash.drop_near_duplicates(documents(spark, rows)).count() == 400


def test_a_bucket_falls_apart_only_where_no_two_are_near():
    """Chains in which followers of leaders, not the leaders, are near each other; in any order of rows, all pairs being the truth."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.integers(0, 1 << 64, 4, dtype=np.uint64)
        bits = np.unpackbits(base.view(np.uint8))
        flips = rng.permutation(256)
        sig = []
        for k in range(8):
            own = bits.copy()
            own[flips[: k * 30]] ^= 1
            sig.append(np.packbits(own).view(np.uint64))
        sig = np.array(sig)[rng.permutation(8)]
        a, b, _ = simhash._links(np.zeros(8, np.int64), np.arange(8), sig, 52)
        own = simhash._joined(8, a, b)
        near = np.bitwise_count(sig[:, None] ^ sig[None]).sum(2) <= 52
        want = groups_of(range(8), near)
        assert len(set(own.tolist())) == len(set(want)) == 1 and all(near[i, j] for i, j in zip(a, b, strict=True))


def test_buckets_larger_than_a_block(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = np.unpackbits(rng.integers(0, 1 << 64, 4, dtype=np.uint64).view(np.uint8))
    sig = []
    for _ in range(300):
        own = base.copy()
        own[rng.choice(256, 12, replace=False)] ^= 1
        sig.append(np.packbits(own).view(np.int64))
    table = spark.createDataFrame([(i, *s.tolist()) for i, s in enumerate(sig)], "node long, s0 long, s1 long, s2 long, s3 long").repartition(2)
    monkeypatch.setattr(simhash, "BLOCK", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        got = simhash.components(simhash.links(table, 300)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 300 and {r.component for r in got} == {0}


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in simhash.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.components(chain, rounds=1)


def test_pigeonring_never_drops_a_pair_within_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, (4000, 4)).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(256, rng.integers(0, 90), replace=False):
            b[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    d = np.bitwise_count(a ^ b).sum(1).astype(np.int64)
    assert (simhash.hamming_within(a, b, 52) == np.where(d <= 52, d, -1)).all()


def test_one_of_each_group_stays(spark, rows, docs, none):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[4] == 1 and 60 not in ids and 61 not in ids and ids[68] == 1
    assert ids[65] == ids[66] == ids[67] == 1 and ids[None] == 2
    groups = simhash.near_duplicates(docs).collect()
    assert sum(r.keep for r in groups) == len({r.group_id for r in groups})
    assert all((r.links > 0) == (r.key in (5, 62)) for r in groups)  # copies are no links
    assert simhash.drop_near_duplicates(none).count() == 0


def test_language_model_learns_and_scores_whole_texts(spark, rows, docs, none):
    train = documents(spark, [(i, prose(random.Random(i), 300), "en", "s") for i in range(30)], extra=False)
    model = gru.train(train, 400, learned=40)
    assert len(model.v.words) > 300 and model.v.size == 40 + gru.BANDS + 1
    held = documents(spark, [(i, prose(random.Random(100 + i), 300), "en", "s") for i in range(5)], extra=False)
    mean = held.sparkSession.createDataFrame([r.asDict() for r in gru.score(held, model).collect()]).agg(F.avg("mean_log_likelihood")).first()[0]
    untrained = gru.Model(model.v, model.h)
    before = [r.mean_log_likelihood for r in gru.score(held, untrained).collect()]
    assert mean > sum(before) / len(before) + 0.3
    scored = {r.doc_id: r for r in gru.score(docs, model).collect()}
    assert scored[65].n_words == 0 and scored[65].log_likelihood == 0 and scored[65].mean_log_likelihood is None
    assert scored[67].n_words == 30_000 and scored[60].log_likelihood == pytest.approx(scored[61].log_likelihood, abs=1e-2)
    assert gru.score(docs, model).count() == len(rows)
    assert gru.score(none, gru.train(none)).count() == 0


def test_words_outside_the_vocabulary_are_scored_by_their_letters(spark):
    train = documents(spark, [(i, prose(random.Random(i), 300), "en", "s") for i in range(30)], extra=False)
    model = gru.train(train, 40)
    rng = random.Random(9)
    unseen = [w for w in prose(rng, 4000).lower().replace(".", "").split() if len(w) > 6][:200]
    gibberish = ["".join(rng.choices("bcdfjklmpqvxyz", k=len(w))) for w in unseen]
    pairs = documents(spark, [(0, " ".join(unseen), "en", "s"), (1, " ".join(gibberish), "en", "s"), (2, "Hxqz", "en", "s"), (3, "hXQZ\n", "en", "s")], extra=False)
    got = {r.doc_id: r.mean_log_likelihood for r in gru.score(pairs, model).collect()}
    assert got[0] > got[1] + 5
    assert got[2] == pytest.approx(got[3])
    p = np.exp(model.spelled.reshape(257, 257).astype(float))
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    word = b"hxqz"
    spelled = sum(float(model.spelled[a * 257 + b]) for a, b in zip([256, *word], [*word, 256], strict=True))
    bare = gru.Model(model.v, model.h, model.flat, np.zeros(257 * 257))

    # A document's score by a plain loop over its words.
    e, u, wc, bc, ww, bw = (x.astype(float) for x in model.parts)
    text, state, last, total = unseen[:20] + train.first().text.split()[:300], np.zeros(model.h), model.v.size, 0.0
    k = K.words(K.strings(pa.array([" ".join(text)])))
    for h, word in zip(k.hash, re.findall(r"[^\W_]+", " ".join(text).lower()), strict=True):
        z, r = (1 / (1 + np.exp(-(e[last] + state @ u)[i * model.h : (i + 1) * model.h])) for i in (0, 1))
        new = np.tanh(e[last][2 * model.h :] + (r * state) @ u[:, 2 * model.h :])
        state = state + z * (new - state)
        known = np.flatnonzero(model.v.words == h)
        last = int(model.v.symbols[known[0]]) if len(known) else model.v.unknown
        of = model.v.class_of[last]
        inside = np.flatnonzero(model.v.class_of == of)
        top, low = state @ wc + bc, (state @ ww + bw)[inside]
        total += top[of] - np.log(np.exp(top).sum()) + low[last - inside[0]] - np.log(np.exp(low).sum())
        if len(known):
            total += float(model.v.extra[known[0]])
        else:
            w = word.encode()
            total += sum(float(model.spelled[a * 257 + b]) for a, b in zip([256, *w], [*w, 256], strict=True))
    plain = gru.score(documents(spark, [(0, " ".join(text), "en", "s")]), model).first()
    assert plain.n_words == len(k.hash) and plain.log_likelihood == pytest.approx(total, rel=1e-4)
    assert got[2] - gru.score(pairs.where("doc_id = 2"), bare).first().log_likelihood == pytest.approx(spelled, abs=1e-3)


def test_quality_thresholds_are_exact_binomial_bounds(spark, docs, none):
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.02), (7, 20, 0.4), (20, 20, 0.5)):
        exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(exact)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)] + [(None, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    judged = quality.judge(docs, labels, risk=0.3).collect()
    assert len(judged) == docs.count() and {r.doc_id: r.keep for r in judged}[65]
    assert all(r.keep for r in quality.judge(docs, labels.limit(0)).collect())
    assert quality.judge(none, labels).count() == 0


def test_copies_count_once_for_the_thresholds(spark):
    good = [(i, prose(random.Random(i), 40), "en", "s") for i in range(40)]
    copies = [(1000 + i, good[0][1], "en", "s") for i in range(3000)]
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good + copies], "doc_id long, quality int, toxic int")
    few, many = (quality.cutoffs(quality.scores(documents(spark, r)), labels, 0.3) for r in (good, good + copies))
    assert few == many


def test_quality_cutoffs_hold_their_risk():
    rng = np.random.default_rng(5)
    bad = 0
    for _ in range(200):
        scores = rng.beta(1, 20, 1500)
        classes = np.bincount(np.ceil(scores * quality.STEPS).astype(int), minlength=quality.STEPS + 1).tolist()
        cut = quality.select_cutoffs({("en", "r"): classes}, 0.02, 0.05).get(("en", "r"))
        # Chance that a score of this distribution is above the cutoff.
        bad += cut is not None and (1 - cut / quality.STEPS) ** 20 > 0.02
    assert bad <= 0.05 * 200 + 3 * math.sqrt(200 * 0.05)


def test_languages_of_held_out_texts(spark, docs, none):
    def some(base, label):
        return [(i, prose(random.Random(base + i), 120, lang), lang if label else None, "s") for i in range(60) for lang in ("en", "de")]

    model = langid.train(documents(spark, some(0, True), extra=False))
    held = some(1000, False)
    got = langid.identify(documents(spark, held, extra=False), model).collect()
    want = Counter(["en", "de"] * 60)
    assert Counter(r.language for r in got) == want and sum(r.accepted for r in got) >= 0.97 * len(got)
    foreign = documents(spark, [(1, "мама мыла раму и пела песни каждый вечер у окна " * 5, None, "s"), (2, "zzqx qqxj vvkw xxzq jjqv " * 20, None, "s")], extra=False)
    assert not any(r.accepted for r in langid.identify(foreign, model).collect())
    kept = langid.keep_identified(docs, model)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and not ids & {65, 66} and 67 in ids
    assert langid.keep_identified(none).count() == 0 and langid.identify(none, model).count() == 0


def test_languages_by_plain_arithmetic(spark, rows):
    """Document frequencies, cosines, answers and rejections of every text, worked out gram by gram."""
    table = documents(spark, rows, extra=False)
    model = langid.train(table)

    def grams(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        data = (" " + " ".join(words) + " ").encode()
        out = Counter()
        for i in range(len(data) - 2):
            if data[i + 1] != 32:
                code = data[i] | data[i + 1] << 8 | data[i + 2] << 16
                out[(code * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 52] += 1
        return out

    counted = [grams(t) for _, t, _, _ in rows]
    df = Counter(f for c in counted for f in c)
    got_df, n = langid.gram_document_frequency(table)
    assert n == len(rows) and {f: int(x) for f, x in enumerate(got_df) if x} == dict(df)
    idf = {f: math.log((1 + n) / (1 + df[f])) + 1e-3 for f in range(langid.SIZE)}
    which, cosine, accepted = langid.classify(K.strings(pa.array([t for _, t, _, _ in rows])), model)
    for i, c in enumerate(counted):
        v = {f: k * idf[f] for f, k in c.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        near = [sum(x * float(m[f]) for f, x in v.items()) / length if length else 0.0 for m in model.centroids]
        best = max(range(len(near)), key=lambda j: near[j])
        assert cosine[i] == pytest.approx(near[best], abs=1e-5) and (which[i] == model.language_of[best] if c else which[i] == -1)
        least = model.least[int(math.log2(max(1, c.total())))]
        if abs(near[best] - least) > 1e-5:
            assert accepted[i] == (bool(c) and near[best] >= least)


def test_foreign_texts_are_rejected_by_a_model_of_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(table)
    rng = random.Random(5)
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
        " ".join("".join(rng.choices("bcdfjklmpqvwxyz", k=6)) for _ in range(50)),
    ]
    texts = pa.array([t for f in foreign for t in (f, f"{f} {f}")])
    assert not langid.classify(K.strings(texts), model)[2].any()
    assert langid.identify(table, model).agg(F.avg(F.col("accepted").cast("int"))).first()[0] >= 0.98


def test_sample_of_languages_is_full_however_many_rows(spark):
    many = spark.range(3_000_000, numPartitions=8).select(F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    few = spark.range(50).select(F.concat(F.lit("wort "), F.col("id") % 40).alias("text"), F.lit("de").alias("lang"))
    got = langid.sample_labelled(many.union(few), 600)
    assert Counter(name for name, _ in got) == {"en": 600, "de": 40} and len(set(got)) == 640
    least = many.orderBy(F.xxhash64("text")).limit(600).collect()
    assert {t for name, t in got if name == "en"} == {r.text for r in least}


def test_urls_by_looking_at_every_entry(spark):
    day = "2024-01-{:02d} 00:00:00"
    entries = [("evil.com", "spam", "add", day.format(5)), ("evil.com", "spam", "remove", day.format(10)), ("evil.com", "spam", "add", day.format(10)), ("a.org/x", "adult", "add", day.format(3))]
    entries += [("evil.com", "spam", "add", day.format(20)), (None, "spam", "add", day.format(1)), ("b.net", "spam", "add", None)] + entries[:1]
    entries += [("C.org/Foo/", "adult", "add", day.format(4)), ("D.com.", "spam", "add", day.format(4))]
    urls = ["http://evil.com/", "https://sub.EVIL.com:80/a?b", "http://notevil.com", "http://a.org/x/y", "http://a.org/xy", "nonsense", None, "http://b.net/", "", "http://c.ORG/Foo/x", "http://c.org/foo/x", "http://c.org/Foo", "http://d.com/A"]
    captures = [(i, u, day.format(d) if d else None) for i, (u, d) in enumerate((u, d) for u in urls for d in (2, 5, 9, 10, 15, 20, None))] * 2
    cast = "to_timestamp({})"
    e = spark.createDataFrame(entries, "pattern string, category string, action string, d string").withColumn("dated", F.expr(cast.format("d"))).withColumn("id", F.lit(1))
    c = spark.createDataFrame(captures, "page_id long, url string, d string").withColumn("fetched_at", F.expr(cast.format("d"))).withColumn("pattern", F.lit("x"))

    def active(url, at):
        if url is None or at is None or "://" not in url:
            return []
        host, _, path = url.split("://")[1].partition("/")
        host, path = host.split(":")[0].lower(), "/" + path.partition("?")[0]
        found = []
        for pattern, category in {(p, k) for p, k, _, _ in entries if p}:
            h, _, below = pattern.partition("/")
            h, below = h.lower().rstrip("."), below.rstrip("/")
            covers = (host == h and (path + "/").startswith(f"/{below}/")) if below else host == h or host.endswith("." + h)
            log = sorted((d, a) for p, k, a, d in entries if (p, k) == (pattern, category) and d and d <= at)
            if covers and log and log[-1][1] == "add":
                found.append(category)
        return sorted(found)

    got = urlfilter.evaluate(c, e).collect()
    assert len(got) == len(captures)
    for r in got:
        at = r.fetched_at.strftime("%Y-%m-%d %H:%M:%S") if r.fetched_at else None
        want = active(r.url, at)
        assert r.entries == len(want) and r.categories == ",".join(sorted(set(want))) and r.blocked == bool(want)
    assert urlfilter.evaluate(c.limit(0), e).count() == 0 and not any(r.blocked for r in urlfilter.evaluate(c, e.limit(0)).collect())


def test_toxic_passages_are_found_and_clean_texts_left(spark, docs, none):
    slurs = ["vexor", "grumbat", "skarn", "pluvix", "dorgle"]
    rng = random.Random(4)

    def text(toxic):
        w = prose(rng, 250).split()
        if toxic:
            at = rng.randrange(50, 200)
            w[at:at] = rng.choices(slurs, k=8)
        return " ".join(w)

    table = [(i, text(i % 4 == 0), "en", "s") for i in range(240)]
    d = documents(spark, table)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)] + [(None, 1, 1), (5, 1, None), (120_000, 1, 1)], "doc_id long, quality int, toxic int")
    scores = toxicity.train(d, labels)
    got = toxicity.toxic_passages(d, scores).collect()
    found = {r.doc_id for r in got}
    assert {i for i in range(120, 240) if i % 4 == 0} <= found
    assert len([i for i in found if i % 4]) <= 3
    for r in got:
        if r.doc_id % 4 == 0 and r.score == r.doc_score:
            w = re.findall(r"[^\W_]+", table[r.doc_id][1].lower())
            assert sum(x in slurs for x in w[r.first_word : r.first_word + r.n_words]) >= 6
    assert toxicity.toxic_passages(docs, scores).where("doc_id in (65, 66)").count() == 0
    assert toxicity.toxic_passages(d, toxicity.train(d, labels.limit(0))).count() == 0
    assert toxicity.toxic_passages(none, scores).count() == toxicity.toxic_passages(none, toxicity.train(none, labels)).count() == 0


def test_toxic_words_that_stand_apart(spark):
    """Words that only toxic texts have, one in fifty of all words there; texts without labels are judged too."""
    rng = random.Random(6)
    slurs = ["vexor" + x for x in ("a", "ba", "da", "fa", "ga", "ka", "la", "ma", "na", "pa", "ra", "sa")]

    def text(toxic):
        w = prose(rng, 300).split()
        for _ in range(6 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(slurs))
        return " ".join(w)

    table = [(i, text(i % 8 == 0), "en", "s") for i in range(1600)]
    d = documents(spark, table, extra=False)
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    got = toxicity.toxic_passages(d, toxicity.train(d, labels)).collect()
    found = {r.doc_id for r in got}
    assert len([i for i in found if i % 8 == 0 and i >= 800]) >= 95 and len([i for i in found if i % 8]) <= 3
    assert all(r.p_value <= toxicity.SIGNIFICANT and r.doc_p_value <= r.p_value and r.doc_score >= r.score for r in got)
    for r in got:
        if r.doc_id % 8 == 0 and r.score == r.doc_score:  # the best passage is of such words
            w = re.findall(r"[^\W_]+", table[r.doc_id][1].lower())[r.first_word : r.first_word + r.n_words]
            assert sum(x in slurs for x in w) >= 2


def test_word_odds_by_plain_counting(spark):
    texts = [(i, prose(random.Random(i), 12) + (" vexor grumbat" if i % 3 == 0 else " plain words"), "en", "s") for i in range(240)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    scores = toxicity.train(documents(spark, texts), labels)
    counts = {True: Counter(), False: Counter()}
    for i, t, _, _ in texts[:160]:
        counts[i % 3 == 0].update(set(re.findall(r"[^\W_]+", t.lower())))
    df = Counter(w for _, t, _, _ in texts for w in set(re.findall(r"[^\W_]+", t.lower())))
    n = {c: x.total() for c, x in counts.items()}
    words = sorted({*counts[True], *counts[False]})
    want = {}
    for w in words:
        share = min(df[w] / df.total(), (counts[True][w] + counts[False][w]) / (n[True] + n[False]))
        up, down = ((counts[c][w] + toxicity.PRIOR) / (n[c] * share + toxicity.PRIOR) for c in (True, False))
        want[int(K.words(K.strings(pa.array([w]))).hash[0] >> np.uint64(20))] = math.copysign(max(0.0, abs(math.log(up / down)) - toxicity.DEVIATIONS * math.sqrt(sum(1 / (counts[c][w] + toxicity.PRIOR) for c in (True, False)))), up - down)
    got = dict(zip(scores.words.tolist(), scores.odds.tolist(), strict=True))
    assert set(got) == set(want) and all(got[k] == pytest.approx(x) for k, x in want.items())
    assert min(got.values()) < -0.5 and max(got.values()) > 0.5


def test_decontamination_by_looking_for_every_phrase(spark, rows, docs, none):
    items = [" ".join(rows[7][1].split()[10:40]), "Prefix words here, " + rows[8][1][30:300].upper(), "too short", None, "", " ".join(rows[9][1].split()[5:14])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    phrases = set()
    for t in items:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if decontam.LEAST <= len(w) < decontam.PHRASE:
            phrases.add(tuple(w))
        phrases |= {tuple(w[k : k + decontam.PHRASE]) for k in range(len(w) - decontam.PHRASE + 1)}
    want = {}
    for i, t, _, _ in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        spans = sorted((k, k + len(p)) for p in phrases for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1] + decontam.GAP:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        if merged:
            want[i] = sorted((a, b - a) for a, b in merged)
    for at_once in (10**6, 7):
        got = defaultdict(list)
        for r in decontam.contaminated_spans(docs, bench, at_once).collect():
            got[r.doc_id].append((r.first_word, r.n_words))
        assert {i: sorted(x) for i, x in got.items()} == want and {7, 8, 9} <= set(want)
    left = decontam.decontaminate(docs, bench)
    by_id = {r.doc_id: r for r in left.collect() if r.doc_id is not None}
    assert left.columns == docs.columns and by_id[65].text is None and by_id[10].text == rows[10][1]
    assert decontam.contaminated_spans(left, bench).count() == 0
    assert decontam.contaminated_spans(none, bench).count() == decontam.contaminated_spans(docs, bench.limit(0)).count() == 0


def test_spans_are_cut_without_harm_to_the_rest():
    text = K.strings(pa.array(["", "Ä b, c. D e f", "x y"]))
    w = K.words(text)
    out = {}
    decontam.cut_spans(text, 0, w, np.array([1]), np.array([3]), out)
    assert out == {1: "Ä D e f"}


def staged(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        yield name, docs, (after := stage(spark, docs, sf_dir))
        docs = after


def test_pipeline_stages_keep_columns_and_clean_documents(spark, rows, docs, none, tmp_path):
    bench = [(0, " ".join(rows[7][1].split()[10:40])), (1, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, before, after in staged(spark, docs, str(tmp_path)):
        if name != "mixture":
            assert after.columns == before.columns
        seen[name] = (Counter(r[0] for r in before.select("doc_id").collect()), Counter(r[0] for r in after.select("doc_id").collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen)
    before, after = seen["language_id"]
    assert not set(after) & {65, 66} and len(set(before) - set(after)) <= 6
    before, after = seen["near_dedup"]
    assert {60, 61} <= set(before) - set(after) and set(range(60)) & set(before) <= set(after)
    for name in ("passage_dedup", "decontamination"):
        assert seen[name][0] == seen[name][1]
    assert set(seen["mixture"][0]) == set(seen["mixture"][1])
    for _, _, after in staged(spark, none, str(tmp_path)):
        assert after.count() == 0


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def without(text, gone):
    return [w for k, w in enumerate(words_of(text)) if k not in gone]


def contaminated(texts, items):
    """By text the places of words in merged spans of benchmark phrases."""
    phrases = set()
    for t in items:
        w = words_of(t)
        phrases |= {tuple(w[k : k + decontam.PHRASE]) for k in range(max(1, len(w) - decontam.PHRASE + 1)) if len(w) >= decontam.LEAST}
    out = {}
    for t in texts:
        w, gone = words_of(t), []
        for k in range(len(w)):
            for n in {len(p) for p in phrases}:
                if tuple(w[k : k + n]) in phrases:
                    if gone and k <= gone[-1][1] + decontam.GAP:
                        gone[-1][1] = max(gone[-1][1], k + n)
                    else:
                        gone.append([k, k + n])
        out[t] = {k for a, b in gone for k in range(a, b)}
    return out


def test_pipeline_against_brute_force(spark, rows, docs, tmp_path):
    """What each stage should make of its input, worked out on the driver."""
    shown = [r for r in rows if r[0] != 67]  # a long text makes brute force slow
    items = [" ".join(rows[7][1].split()[10:40]), rows[11][1], None, "too short"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, before, after in staged(spark, docs.where("doc_id is null or doc_id <> 67"), str(tmp_path)):
        seen[name] = (before.cache(), after.cache())
    plain = {name: tuple(Counter((r.doc_id, r.text) for r in x.select("doc_id", "text").collect()) for x in both) for name, both in seen.items()}
    assert plain["language_id"][0] == Counter((i, t) for i, t, _, _ in shown)

    before, after = plain["language_id"]
    model = langid.train(seen["language_id"][0])
    which, _, accepted = langid.classify(K.strings(pa.array([t for _, t in before])), model)
    assert after == Counter({k: n for ok, (k, n) in zip(accepted, before.items(), strict=True) if ok}) and after != before
    named = {t: model.languages[j] for j, (_, t) in zip(which, before, strict=True)}
    assert all(r.lang == named[r.text] for r in seen["language_id"][1].select("lang", "text").collect())

    before, after = plain["near_dedup"]
    rows_of = seen["near_dedup"][0].select("doc_id", "text", F.coalesce("doc_id", F.lit(K.NO_ID)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).distinct().collect()
    sig = {(r.key, r.th): (r.s0, r.s1, r.s2, r.s3) for r in simhash.signatures(seen["near_dedup"][0]).collect()}
    known = sorted((r.key, r.th, r.doc_id, r.text) for r in rows_of if (r.key, r.th) in sig)
    bits = np.array([sig[r[:2]] for r in known], np.int64).view(np.uint64)
    group = groups_of(range(len(known)), np.bitwise_count(bits[:, None] ^ bits[None]).sum(2) <= simhash.DISTANCE)
    first = {}
    for r, g in zip(known, group, strict=True):
        first.setdefault(g, r)
    want = Counter((r[2], r[3]) for r in first.values()) + Counter({k: n for k, n in before.items() if not words_of(k[1])})
    assert after == want and len(after) < len(before)

    before, after = plain["passage_dedup"]
    gone = repeated([(i, t, None, None) for i, t in before.elements()], passages.WORDS)
    want = Counter((i, tuple(without(t, gone.get((i if i is not None else K.NO_ID, t or ""), ())))) for i, t in before.elements())
    assert Counter((i, tuple(words_of(t))) for i, t in after.elements()) == want and gone

    before, after = plain["decontamination"]
    gone = contaminated([t for _, t in before], items)
    want = Counter((i, tuple(without(t, gone[t]))) for i, t in before.elements())
    assert Counter((i, tuple(words_of(t))) for i, t in after.elements()) == want and any(gone.values())

    before, mixed = seen["mixture"]
    assert Counter((r.doc_id, r.text) for r in mixed.where("epoch = 0").collect()) == plain["mixture"][0]
    by_slot = {}
    for r in mixed.select("slot", F.coalesce("source", F.lit("")).alias("s")).collect():
        assert by_slot.setdefault(r.slot, r.s) == r.s
    counts = Counter(r.source or "" for r in before.collect())
    parts = mixing.whole_weights(mixing.tempered(counts))
    done = Counter()
    for slot in range(len(by_slot)):
        done[by_slot[slot]] += 1
        assert all(abs(done[s] - (slot + 1) * p / sum(parts.values())) < 1 for s, p in parts.items())


def test_near_dedup_stage_passes_over_no_pair(spark):
    """Pairs of texts of which many are just within the distance: the rows that stay are those of all pairs."""
    rng = random.Random(5)
    rows = []
    for i in range(0, 800, 2):
        w = prose(rng, 150).split()
        rows.append((i, " ".join(w), "en", "s"))
        for at in rng.sample(range(150), 25):
            w[at] = "".join(rng.choices("abcdefg", k=6))
        rows.append((i + 1, " ".join(w), "en", "s"))
    docs = documents(spark, rows)
    keys, near = near_pairs(docs, simhash.DISTANCE)
    first = {}
    for k, g in zip(keys, groups_of(keys, near), strict=True):
        first[g] = min(k, first.get(g, k))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert kept == set(first.values()) and 450 < len(kept) < 750


def test_pipeline_rereads_each_stage_from_parquet(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    inputs = []

    def stage(spark, docs, sf_dir):
        inputs.append(docs.inputFiles())
        return docs.where("doc_id < 10")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == docs.columns and out.count() == 10
    assert all("/one/" in f for f in inputs[1]) and all("/two/" in f for f in out.inputFiles())
