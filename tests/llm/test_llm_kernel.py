import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.llm import decontam, gru, suffix, toxicity
from ragloom.llm import kernel as K

LETTERS = st.text(alphabet="aBé Ñ.,\n“x1日МмĐđẾếΣσの，𠀀𝒳ก", max_size=60)
ALONE = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"


def norm(text):
    return re.findall(rf"{ALONE}|(?:(?!{ALONE})[^\W_])+", "".join(c.lower() for c in text))


@settings(max_examples=200, deadline=None)
@given(st.lists(LETTERS, max_size=6))
def test_words_are_runs_of_letters_and_digits(texts):
    w = K.words(K.strings(pa.array(texts, pa.string())))
    seen = {}
    for i, text in enumerate(texts):
        want = norm(text)
        lo, hi = w.offsets[i], w.offsets[i + 1]
        assert hi - lo == len(want)
        data = b"".join(t.encode() for t in texts)
        got = ["".join(c.lower() for c in data[a:b].decode()) for a, b in zip(w.start[lo:hi], w.end[lo:hi], strict=True)]
        assert got == want
        for word, h in zip(want, w.hash[lo:hi].tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_case_is_folded_in_every_script():
    pairs = ["МАМА мама", "ĐĂNG KÝ HỌC đăng ký học", "ΣΟΦΟΣ σοφος", "ÉCOLE école", "ŁÓDŹ łódź", "ԱԲԳ աբգ"]
    for text in pairs:
        w = K.words(K.strings(pa.array([text])))
        half = len(w.hash) // 2
        assert half and w.hash[:half].tolist() == w.hash[half:].tolist(), text
    assert len(K.words(K.strings(pa.array(["人人生而自由，在尊严。"]))).hash) == 9
    assert len(K.words(K.strings(pa.array(["ภาษา ok"]))).hash) == 5


def test_chunks_cover_every_row_once(monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 10)
    arr = K.strings(pa.array(["a" * 50, "", "bb", None, "c" * 9, "d" * 30]))
    parts = list(K.chunks(arr))
    assert [at for at, _ in parts] == [sum(len(p) for _, p in parts[:i]) for i in range(len(parts))]
    assert [x for _, p in parts for x in p.to_pylist()] == ["a" * 50, "", "bb", "", "c" * 9, "d" * 30]


def test_grams_depend_on_their_words_alone():
    w = K.words(K.strings(pa.array(["a b c d", "x a b c d"])))
    g = K.grams(w.hash, 3)
    assert g[0] == g[5] and g[1] == g[6] and g[0] != g[1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40))
def test_suffix_array_and_common_prefixes(symbols):
    t = np.array([*symbols, 0])
    sa = suffix.suffix_array(t)
    tails = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert sa.tolist() == tails == decontam.suffix_array(t).tolist()
    plcp = suffix.permuted_common_prefixes(t, sa, 100)
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        same = 0
        while t[a + same] == t[b + same]:
            same += 1
        assert plcp[b] == same


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc ", max_size=50), min_size=1, max_size=5), st.lists(st.text("abc ", max_size=30), max_size=4))
def test_fm_index_finds_every_occurrence(docs, items):
    p = decontam.phrases(items, size=4, least=2)
    w = K.words(K.strings(pa.array(docs)))
    start, size = decontam.occurrences(w, p)
    got = sorted((int(w.doc[s]), int(s - w.offsets[w.doc[s]]), int(n)) for s, n in zip(start, size, strict=True))
    want = set()
    for item in items:
        t = norm(item)
        for q in [t] if 2 <= len(t) < 4 else [t[i : i + 4] for i in range(len(t) - 3)]:
            for d, text in enumerate(docs):
                x = norm(text)
                want |= {(d, i, len(q)) for i in range(len(x) - len(q) + 1) if x[i : i + len(q)] == q}
    assert got == sorted(want)


def test_merged_spans_stay_in_their_texts():
    w = K.words(K.strings(pa.array(["a b c d", "e f g h"])))
    s, e = decontam.merged(w, np.array([2, 4, 0]), np.array([2, 2, 1]), gap=1)
    assert list(zip(s, e, strict=True)) == [(0, 4), (4, 6)]


def maximal(scores):
    """Maximal scoring segments by definition: the best, and those left and right of it."""

    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 1e-9 and (found is None or total > found[2] + 1e-9 or (abs(total - found[2]) < 1e-9 and j + 1 - i < found[1] - found[0])):
                    found = (i, j + 1, total)
        return [] if found is None else best(lo, found[0]) + [found] + best(found[1], hi)

    return best(0, len(scores))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([-0.5, -0.5, -0.75, -2.0, 1.25, 3.0]), max_size=24))
def test_maximal_scoring_segments(scores):
    got = toxicity.segments(np.array(scores))
    want = maximal(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([-0.5, -0.75, -2.0, 1.25, 3.0]), max_size=12), max_size=6))
def test_best_segment_of_each_text(texts):
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(int)
    got = toxicity.best_of_each(np.array([x for t in texts for x in t]), offsets)
    assert np.allclose(got, [max((s for *_, s in maximal(t)), default=0.0) for t in texts])


def test_calibration_gives_the_chances_of_random_texts():
    rng = np.random.default_rng(1)
    odds = np.concatenate([rng.normal(0, 0.2, 500), rng.uniform(1, 4, 40)])
    share = np.concatenate([np.full(500, 0.9 / 500), np.full(40, 0.02 / 40)])
    rate, k = toxicity.calibrate(odds - 0.5, share)
    scores = toxicity.Scores(np.zeros(1), np.zeros(1), rate, k)
    value = np.append(odds, 0.0) - 0.5
    drawn = value[rng.choice(541, (4000, 300), p=np.append(share, 0.08))]
    best = toxicity.best_of_each(drawn.reshape(-1), np.arange(4001) * 300)
    for p in (0.3, 0.05, 0.01):
        x = -np.log(-np.log1p(-p) / (k * 300)) / rate
        assert 0.4 * p <= (best >= x).mean() <= 1.6 * p and abs(toxicity.chance(x, 300, scores) - p) < 1e-9


def small_vocabulary(words, classes, **how):
    return gru.make_vocabulary(np.arange(words) * 7919, 100 - np.arange(words), 3000, classes, **how)


def test_gru_gradient_and_lanes():
    rng = np.random.default_rng(0)
    v = small_vocabulary(20, 4)
    m = gru.Model(v, 5)
    docs = [rng.integers(0, v.size, n) for n in (7, 3, 9, 0, 4)]
    ids, off = np.concatenate(docs).astype(np.int16), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    lanes = gru.pack(ids, off, v.size, lanes=2)
    m = gru.Model(v, 5, m.flat.astype(np.float64))
    g = gru.Model(v, 5, np.zeros_like(m.flat))
    x, y, fresh, _ = lanes.window(0, int(lanes.length[0]), 2)
    seen = m.forward(x, fresh, np.zeros((2, 5), np.float32))
    real = y >= 0
    assert real.sum() == len(ids)
    _, back = m.output(seen[3][real], y[real].astype(np.int64), g)
    d = np.zeros_like(seen[3])
    d[real] = back
    m.backward(x, fresh, seen, d, g)
    for k in rng.choice(len(m.flat), 40, replace=False):
        old = m.flat[k]
        m.flat[k] = old + 1e-2
        up = gru.score_lanes(m, lanes, 5).sum()
        m.flat[k] = old - 1e-2
        down = gru.score_lanes(m, lanes, 5).sum()
        m.flat[k] = old
        assert abs((up - down) / 2e-2 - g.flat[k]) < 1e-3
    # The state goes across windows and starts anew with a document: packing and window do not matter.
    whole = gru.score_lanes(m, lanes, 5)
    other = gru.score_lanes(m, gru.pack(ids, off, v.size, lanes=5), 5)
    alone = [gru.score_lanes(m, gru.pack(x.astype(np.int16), np.array([0, len(x)]), v.size), 1)[0] for x in docs]
    assert np.allclose(whole, other, atol=1e-4) and np.allclose(whole, alone, atol=1e-4)


def test_sums_of_runs():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(400, 3))
    start = np.unique(np.concatenate([[0], rng.integers(0, 400, 60), [30, 31, 32, 100]]))
    start = start[(start < 150) | (start > 220)]  # a long run
    assert np.allclose(gru._run_sums(rows, start), np.add.reduceat(rows, start, axis=0))
    assert np.allclose(gru._run_sums(rows[:1], np.array([0])), rows[:1])


def test_lanes_take_no_more_than_their_words():
    size = np.array([2_000_000, *[50] * 2000, 0])
    offsets = np.concatenate([[0], np.cumsum(size)])
    ids = (np.arange(offsets[-1]) % 1000).astype(np.int16)
    lanes = gru.pack(ids, offsets, 1000)
    assert sum(a.nbytes for a in lanes[:5]) < 8 * len(ids)
    assert int(lanes.length.sum()) == len(ids) and lanes.length[0] == 2_000_000
    x, y, fresh, doc = lanes.window(0, 40, 256)
    assert fresh[0].all() and (x[0] == 1000).all() and (y[0] == ids[offsets[doc[0]]]).all() and (x[1:] == y[:-1]).all()


def test_probabilities_of_all_words_sum_to_one():
    v = small_vocabulary(90, 5, learned=30, bands=4)
    m = gru.Model(v, 4)
    h = np.tile(np.linspace(-1, 1, 4, dtype=np.float32), (v.size, 1))
    log_p, _ = m.output(h, np.arange(v.size))
    assert v.size == 35 and abs(np.exp(log_p).sum() - 1) < 1e-5
    ids, extra = gru.symbols_of((np.arange(91) * 7919).astype(np.uint64), v)
    assert ids[90] == v.unknown and v.unknown not in ids[:90] and (extra[:30] == 0).all() and (extra[30:90] < 0).all()
    assert abs(np.exp(log_p[ids] + extra).sum() - 1) < 1e-5


def test_batches_hold_every_document_once():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 40, 100)
    sizes[50] = 500
    ids = rng.integers(0, 9, sizes.sum()).astype(np.int16)
    whole = pa.RecordBatch.from_arrays([pa.array(np.arange(100)), gru._binary(ids, 2 * sizes)], ["doc_id", "ids"])
    seen, words = [], []
    for rows, got, offsets in gru._batched(iter([whole.slice(0, 30), whole.slice(30, 0), whole.slice(30)]), 200):
        seen += rows.column("doc_id").to_pylist()
        words.append(got)
        assert offsets[-1] == len(got) <= 200 or len(rows) == 1
    assert seen == list(range(100)) and np.concatenate(words).tolist() == ids.tolist()
