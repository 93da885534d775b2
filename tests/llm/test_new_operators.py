"""Importance resampling, periodic runs, language model and the ring's growth against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_documents import collected, frame, prose
from twinloom.llm import importance, language_model, periodic, sharding, suffix_dedup


@pytest.fixture(scope="module")
def rows():
    repeated = " ".join(f"w{k % 7}" for k in range(90))
    cases = [
        (0, None, None),
        (1, "", "en"),
        (2, " \t\n\x0b", "en"),
        (3, "!!! ... ---", "de"),
        (4, "one two", "en"),
        (5, "One, TWO", "en"),
        (None, prose(5, 60), "en"),
        (None, prose(5, 60), "en"),
        (7, prose(7, 9000), "en"),
        (8, prose(8, 40), None),
        (8, prose(8, 40), None),
        (9, prose(9, 30) + " " + repeated + " " + prose(10, 30), "en"),
        (10, "so " * 50, "fr"),
        (11, "日本語 Ärger naïve x " * 30, "ja"),
    ]
    return cases + [(20 + k, prose(30 + k, 15 + 9 * k), "en") for k in range(30)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def grams(text, low, high):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize(("low", "high", "percent"), [(1, 1, 10), (1, 3, 50)])
def test_importance_resampling(spark, rows, docs, none, low, high, percent):
    goal = [prose(31, 200), None, "", prose(500, 80)]
    target = spark.createDataFrame([(t, 1) for t in goal], "text string, id int")
    got = collected(importance.resample(docs, target, percent, 20, low, high, buckets=97))
    bucket = lambda g: zlib.crc32(g.encode()) % 97
    raw, wanted = collections.Counter(), collections.Counter()
    for _, text, _ in rows:
        raw.update(map(bucket, grams(text, low, high)))
    for text in goal:
        wanted.update(map(bucket, grams(text, low, high)))
    s, t = sum(raw.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 97) / ((raw[b] + 1) * (t + 97)))) for b in range(97)}
    expected = []
    for i, text, _ in rows:
        own = grams(text, low, high)
        weight = sum(gain[bucket(g)] for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        expected.append((i, len(own), weight, score, len(words_of(text)) >= 20))
    assert collections.Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == collections.Counter(e[:4] for e in expected)
    eligible = sorted((e for e in expected if e[4]), key=lambda e: (-e[3], -1 if e[0] is None else e[0]))
    drawn = eligible[: percent * len(eligible) // 100]
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(r["doc_id"], r["score"], r["rank"]) for r in ranked] == [(e[0], e[3], k + 1) for k, e in enumerate(drawn)]
    assert importance.resample(none, target).count() == 0
    alone = collected(importance.resample(docs, target.limit(0)))
    assert len(alone) == len(rows)


def test_spans_are_cut_at_word_boundaries():
    one, two = importance.spans(1, 2)
    flat = importance.collapsed("--Ab  c,De-é ".encode())
    assert flat.decode() == "ab c de é"
    assert [flat[a:b].decode() for a, b in (m.span() for m in two.finditer(flat, overlapped=True))] == ["ab c", "c de", "de é"]
    assert [m.group().decode() for m in one.finditer(flat, overlapped=True)] == ["ab", "c", "de", "é"]


def brute_runs(symbols, least, exponent):
    found = {}
    for q in range(1, len(symbols) // exponent + 1):
        i = 0
        while i + q < len(symbols):
            j = i
            while j + q < len(symbols) and symbols[j] == symbols[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in found.items())


def test_runs_of_random_symbols():
    draw = random.Random(8)
    for _ in range(400):
        size = draw.randrange(70)
        symbols = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(size)]
        if size > 8 and draw.random() < 0.6:
            p, a = draw.randrange(1, size // 4), draw.randrange(size // 2)
            symbols = [symbols[i] if i < a else symbols[a + (i - a) % p] for i in range(size)]
        least, exponent = draw.choice([(6, 4), (2, 2), (6, 3)])
        want = brute_runs(symbols, least, exponent)
        got = periodic.find_runs([[s + 1 for s in symbols]], least, exponent)[0]
        assert sorted(map(tuple, got.tolist())) == want
        n, own, _ = periodic.runs_of([" ".join(f"w{s}" for s in symbols)], least, exponent)[0]
        assert n == size and sorted(map(tuple, own.tolist())) == want


def test_suffix_tree_orders_suffixes():
    text = [int(c) + 1 for c in "0102010201022"]
    turns, place, first, last = periodic.SuffixTree(text).tour()
    suffixes = [[*text[i:], 0] for i in range(len(text) + 1)]
    assert first == sorted(range(len(suffixes)), key=lambda i: suffixes[i])
    assert last == sorted(range(len(suffixes)), key=lambda i: [s or 99 for s in suffixes[i]])
    common = lambda a, b: next(k for k in range(99) if a[k] != b[k])
    assert turns == [common(suffixes[a], suffixes[b]) for a, b in zip(first, first[1:])]
    assert all(first[place[i]] == i for i in range(len(suffixes)))


def test_range_minima():
    random_ = np.random.default_rng(3)
    values = random_.integers(0, 50, 700).astype(np.int32)
    low = random_.integers(0, 700, 3000)
    high = np.minimum(low + random_.integers(0, 700, 3000), 699)
    assert periodic.RangeMinima(values)(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]


def run_truth(text, id_=None, planted=False):
    words = (text or "").encode().split()
    h = zlib.crc32(str(id_).encode())
    if planted and id_ is not None and h % 10 == 0 and words:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    names = {}
    own = brute_runs([names.setdefault(w, len(names)) for w in words], 6, 4)
    own.sort(key=lambda r: (r[0], r[2]))
    gone = {i for start, length, period in own for i in range(start + period, start + length)}
    return words, own, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def test_repeated_runs(docs, rows, none):
    got = collected(periodic.repeated_runs(docs))
    key = lambda i, n, own, text: (str(i), n, tuple(own), text)
    found = collections.Counter(key(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got)
    truth = [(i, *run_truth(t)) for i, t, _ in rows if len(t or "") < 20000]
    assert collections.Counter(key(i, len(w), own, text) for i, w, own, text in truth) - found == collections.Counter()
    assert len(got) == len(rows) and any(own for _, _, own, _ in truth)
    assert periodic.repeated_runs(none).count() == 0


def test_digests_of_planted_runs(docs, rows):
    got = {(r["doc_id"], r["collapsed_sha256"]): r for r in collected(periodic.digests(periodic.repeated_runs(periodic.plant(docs))))}
    for i, text, _ in rows:
        if len(text or "") > 20000:
            continue
        _, own, rest = run_truth(text, i, planted=True)
        r = got[i, hashlib.sha256(rest.encode()).hexdigest()]
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in own)
        assert (r["n_runs"], r["runs_sha256"]) == (len(own), hashlib.sha256(lines.encode()).hexdigest())
        best = min(own, key=lambda x: (-x[1], x[0], x[2])) if own else (None, None, None)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (best[1] * 1000 // best[2] if own else None)


def small(monkeypatch):
    for name, value in {"OWN": 6, "CLASSES": 4, "UNITS": 10, "FREQUENT": 200, "HELD": 50, "POOL": 300, "BATCH": 64}.items():
        monkeypatch.setattr(language_model, name, value)
    shapes = ((10, 32), (10, 32), (2, 32, 32), (10,))
    monkeypatch.setattr(language_model.Model, "SHAPES", shapes)
    monkeypatch.setattr(language_model.Model, "SIZE", -(-sum(int(np.prod(s)) for s in shapes) // 16) * 16)


def test_base_scores_and_counts(docs, rows, none):
    got = collected(language_model.score_documents(docs))
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    learned = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    counts = collections.Counter(w for i, t, _ in rows if learned(i) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    expected = collections.Counter()
    for i, t, _ in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        expected[i, not learned(i), len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)] += 1
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert collections.Counter((*(r[c] for c in columns), round(r["base_score"], 6)) for r in got) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert language_model.score_documents(none).count() == 0


def test_normalisers_are_sums_over_all_units(monkeypatch):
    small(monkeypatch)
    model = language_model.Model(np.random.default_rng(1).normal(0, 0.5, language_model.Model.SIZE).astype(np.float32))
    near, far, norm = model.scores()
    for one in range(10):
        for two in range(10):
            mean = model.context[one] @ model.places[0] + model.context[two] @ model.places[1]
            score = model.output @ mean + model.bias
            assert norm[one, two] == pytest.approx(np.log(np.exp(score.astype(float)).sum()), rel=1e-4)
            assert np.allclose(near[one] + far[two], score, atol=1e-4)
    score = language_model.scorer(model)([np.array([3, 2, 0], np.uint16).tobytes(), np.array([0], np.uint16).tobytes()])
    steps = [(0, 0, 3), (3, 0, 2), (2, 3, 0)]
    want = sum(near[a, w] + far[b, w] - norm[a, b] for a, b, w in steps) / math.log(10)
    assert score == pytest.approx([want, (near[0, 0] + far[0, 0] - norm[0, 0]) / math.log(10)], rel=1e-4)


def test_probabilities_of_one_word_texts_add_up(spark):
    """Over all words seen, one unseen word per class and the end, the first token's probabilities sum to one."""
    draw = random.Random(4)
    vocabulary = [a + b + c for a in "abcdefghijkl" for b in "uvwxyz" for c in "mnopqrstuvwx"]
    texts = [" ".join(draw.choice(vocabulary[: draw.choice([9, 120, 864])]) for _ in range(60)) for _ in range(200)]
    seen = sorted({w for t in texts for w in t.split()})
    unseen = {language_model.class_of(f"?{k:x}".encode()): f"?{k:x}" for k in range(1 << 13)}
    assert len(seen) > language_model.OWN and len(unseen) == language_model.CLASSES
    probes = [*seen, *unseen.values()]
    docs = spark.createDataFrame(list(enumerate([*texts, *probes])), "doc_id long, text string").repartition(2)
    read, counts, known, model = language_model.learn(docs, "doc_id", "text", lambda i: i < len(texts))
    got = {r["id"]: r["score"] for r in collected(language_model.judged(read, counts, known, model))}
    near, far, norm = model.scores()
    units = dict(zip(known.words, known.units().tolist()))
    total = math.exp(near[0, 0] + far[0, 0] - norm[0, 0])
    for k, probe in enumerate(probes):
        u = units.get(probe.encode(), language_model.class_of(probe.encode()))
        end = (near[u, 0] + far[0, 0] - norm[u, 0]) / math.log(10)  # the end follows the word
        total += 10 ** (got[len(texts) + k] - end)
    assert total == pytest.approx(1.0, abs=1e-3)


def test_model_learns_order(spark):
    """Texts walk around a ring of words: the next word follows from the last, which frequencies miss."""
    draw = random.Random(6)
    ring = [f"v{k}" for k in range(40)]
    rows = []
    for k in range(600):
        at = draw.randrange(40)
        rows.append((k, " ".join(ring[(at + s) % 40] for s in range(draw.randrange(20, 60)))))
    got = collected(language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)))
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


def test_a_longer_ring_keeps_points_and_moves_little(spark):
    few, more = sharding.ring(spark, 8, 64), dict(sharding.ring(spark, 9, 64))
    assert all(more[at] == shard for at, shard in few)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    before = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 8, 64).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 9, 64).collect()}
    moved = sum(before[i] != after[i] for i in before) / len(before)
    assert 1 / 9 - 0.01 <= moved < 2.2 / 9


def test_kept_text_of_suffix_dedup(spark):
    passage = prose(77, 120)
    docs = spark.createDataFrame([(k, f"{prose(80 + k, 30)} {passage} {prose(90 + k, 30)}") for k in range(3)], "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(docs).collect():
        assert r["kept_text"].encode() == bytes(r["kept"]) and passage[50:500] not in r["kept_text"]
