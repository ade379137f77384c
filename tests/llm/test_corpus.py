"""Mixing, sharding, near-duplicates, top-k, languages and quality against
brute force."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phenoscope.llm import langid, mixing, neardup, quality, rules, sharding, topk

from .fixtures import documents, labels, prose, rows, with_clashes


def n_words(text):
    return len((text or "").encode().split())


# mixing


def test_targets_are_shared_and_capped():
    aims = mixing.targets_for([100, 100, 100, 0], [3, 1, 2, 3])
    assert sum(aims) == pytest.approx(450) and aims == pytest.approx([200, 250 / 3, 500 / 3, 0])
    aims = mixing.targets_for([10, 1000], [3, 1])
    assert aims[0] == 20 and sum(aims) == pytest.approx(1515)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 1 << 40))
def test_permutation_is_one(n, key):
    at = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
    assert sorted(at) == list(range(n))
    assert mixing.permute(at, np.full(n, n), np.full(n, key), back=True).tolist() == list(range(n))


def test_mixture(spark):
    got = mixing.mix_documents(with_clashes(documents(spark)), block=16, shards=7).collect()
    again = mixing.mix_documents(documents(spark).repartition(5), block=16, shards=7).collect()
    pick = lambda rs: sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rs)
    assert pick(got) == pick(again)
    assert sorted((r.doc_id, r.size) for r in got) == sorted((d[0], n_words(d[1])) for d in rows())
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for source, rs in by.items():
        assert rs[0].source_size == sum(r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 1
    assert by[None][0].target == pytest.approx(2 * by[None][0].source_size)


def test_mixed_texts(spark):
    data = [d for d in rows() if d[0] != 7]
    docs = with_clashes(documents(spark, data))
    out = mixing.mixed_texts(docs, block=16, shards=7)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(docs, block=16, shards=7).collect()}
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += n_words(r.text)
        assert r.n_chars == len(r.text) and r.kept == "own kept"
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_mixed_texts_of_null_and_repeated_ids(spark):
    ids = [None, None, None, 1, 1, 1, 2, 2, 3, 4, 5, 5]
    data = [(i, " ".join(f"r{k}w{j}" for j in range(20 + 7 * k)), "xx", ("s0", "s1", None)[k % 3], k) for k, i in enumerate(ids)]
    docs = with_clashes(documents(spark, data)).withColumn("tag", F.col("n_chars"))
    out = mixing.mixed_texts(docs, block=16, shards=7).collect()
    again = mixing.mixed_texts(docs.repartition(5), block=16, shards=7).collect()
    assert sorted((r.tag, r.text) for r in out) == sorted((r.tag, r.text) for r in again)
    words = Counter()
    for r in out:
        assert r.doc_id == ids[r.tag] and set(r.text.split()) <= set(data[r.tag][1].split())
        words[r.tag] += n_words(r.text)
    sizes = {k: n_words(d[1]) for k, d in enumerate(data)}
    assert all(n <= 2 * sizes[k] for k, n in words.items())
    mix = mixing.mix_documents(docs, block=16, shards=7).collect()
    assert {r.size: r.taken for r in mix if r.taken} == {sizes[k]: n for k, n in words.items()}
    by = Counter()
    for k, n in words.items():
        by[data[k][3]] += n
    assert all(abs(by[r.source] - r.target) <= 1 for r in mix)


def test_mixture_of_nothing_and_of_many_sources(spark):
    assert mixing.mix_documents(documents(spark, [])).collect() == []
    data = [(i, "word " * 40, "xx", f"s{i:05d}", 1) for i in range(2000)]
    got = mixing.mix_documents(documents(spark, data), block=16, shards=3).collect()
    assert len(got) == 2000 and sum(r.taken for r in got) == pytest.approx(1.5 * 80_000, rel=0.02)
    assert all(r.taken <= 80 for r in got)


# sharding


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, shards):
    got = sharding.shard_documents(with_clashes(documents(spark)), shards).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in rows())
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    text = {d[0]: d[1] or "" for d in rows()}
    places = defaultdict(set)
    for r in got:
        places[text[r.doc_id]].add(r.shard)
    assert all(len(p) == 1 for p in places.values())  # equal texts stay together


def test_even_shards_and_heavy_groups(spark):
    data = [(i, "same text " * 20 if i % 3 == 0 else f"text {i} " * 25, "xx", f"s{i % 4}", 1) for i in range(3000)]
    got = sharding.shard_documents(documents(spark, data), 10).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 10 and max(sizes.values()) < 1.1 * min(sizes.values())


def test_repeated_rows_are_dealt_and_sources_may_share_a_prefix(spark):
    data = [(7, "again and again " * 4, "xx", "source_01", 1)] * 400 + [(i, f"text {i:05d} of its own " * 3, "xx", f"source_{i % 9}", 1) for i in range(100, 500)]
    got = sharding.shard_documents(documents(spark, data), 8).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == 800 and len(sizes) == 8 and max(sizes.values()) < 1.1 * min(sizes.values())
    assert sharding.shard_documents(documents(spark, []), 8).collect() == []


# near-duplicates


def sets_of(docs, width):
    out = {}
    for i, t, *_ in docs:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def components_of(sets, percent):
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width,percent,blocks,node_rows", [(3, 85, 2000, 16), (5, 80, 600_000, 4), (3, 70, 500, 1024)])
def test_near_duplicates(spark, width, percent, blocks, node_rows, monkeypatch):
    import random

    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", blocks)  # small: pivots and blocks
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8 if blocks < 600_000 else 1024)
    rng, data = random.Random(5), rows(40)
    for g in range(6):
        base = prose(rng, 120).split()
        for c in range(12):
            w = list(base)
            for _ in range(c % 5):
                w[rng.randrange(len(w))] = "changed"
            data.append((1000 + g * 100 + c, " ".join(w).upper() if c == 3 else " ".join(w), "xx", "s0", 1))
    got = neardup.group_near_duplicates(with_clashes(documents(spark, data)), width, percent, node_rows=node_rows).collect()
    sets = sets_of(data, width)
    want = components_of(sets, percent)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(got) == len(data)


def test_near_duplicate_edges(spark):
    data = [(None, "a b c d", "xx", "s", 1), (1, "a b c d", "xx", "s", 1), (2, "A B C D", "xx", "s", 1), (3, None, "xx", "s", 1), (4, "", "xx", "s", 1), (2, "A B C D", "xx", "s", 1)]
    docs = documents(spark, data)
    judged = neardup.group_near_duplicates(docs, 3, 85)
    got = {(r.doc_id, r.component_id, r.kept) for r in judged.collect()}
    assert got == {(None, None, False), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)}
    assert sorted(r.doc_id or 0 for r in neardup.keep_one(docs, judged).collect()) == [0, 1, 3, 4]


def test_texts_that_share_an_id_are_one_document(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    data = [(1, a, "xx", "s", 1), (2, a, "xx", "s", 1), (2, b, "xx", "s", 1), (3, b, "xx", "s", 1), (4, "", "xx", "s", 1), (4, None, "xx", "s", 1)]
    got = neardup.group_near_duplicates(documents(spark, data), 3, 85)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got.collect()) == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)]
    assert neardup.group_near_duplicates(documents(spark, []), 3, 85).collect() == []


def test_many_near_equal_short_texts(spark):
    words = "this page was made from a template by the same people as ever before and after".split()
    data = [(i, " ".join([*words[: i % 7], f"n{i}", *words]), "xx", "s", 1) for i in range(3000)]
    got = neardup.group_near_duplicates(documents(spark, data), 3, 60).collect()
    sets = sets_of(data[:120], 3)
    want = components_of(sets, 60)
    assert len(got) == 3000
    by = {r.doc_id: r.component_id for r in got}
    assert all((by[i] == by[j]) for i in sets for j in sets if want[i] == want[j])


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (60, 100)]
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 100: 50}


# top-k


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    rng = np.random.default_rng(3)
    data = [(i, [float(v) for v in rng.normal(0, 0.3, 6)], 0) for i in range(400)]
    data += [(1000 + i, data[0][1], 0) for i in range(9)]  # ties
    data += [(50, None, 0), (100_000, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (150_000, [float("nan")] * 6, 0), (None, [1.0] * 6, 0), (7, [float("inf")] * 6, 0), (200_000, [1.0, 2.0], 0), data[3]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = topk.exact_top_k(df.withColumn("id", F.lit("own")).withColumn("v", F.lit("own")), "vec_id", "embedding", F.col("id") % 50 == 0, 5, 256).collect()
    clean = {i: [int(np.floor(256 * v)) for v in e] for i, e, _ in data if i is not None and e and all(v is not None and np.isfinite(v) for v in e)}
    want = set()
    for q in [i for i in clean if i % 50 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(clean[q], clean[c])), c) for c in clean if c != q and len(clean[c]) == len(clean[q]))
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:5])}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want
    assert topk.exact_top_k(df.limit(0), "vec_id", "embedding", F.col("id") % 50 == 0, 5, 256).collect() == []


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(v) for v in rng.integers(-5, 5, 4) * 10.0**12], 0) for i in range(60)] + [(60, [1e300, 0.0, 0.0, 0.0], 0), (61, [1e300, 1.0, 0.0, 0.0], 0)]
    data += [(100 + i, [float(v) for v in rng.integers(-9, 9, 4) * 2.0**25 + 1], 0) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = topk.exact_top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0, 5, 256).collect()
    top = (1 << 63) - 1
    cut = lambda v: max(-top - 1, min(top, v))
    ints = {i: [cut(int(np.floor(256 * v)) if abs(v) < 1e17 else int(256 * v)) for v in e] for i, e, _ in data}
    want = set()
    for q in (0, 50, 100, 150):
        scored = sorted((-cut(sum(a * b for a, b in zip(ints[q], ints[c]))), c) for c in ints if c != q)
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:5])}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want


# languages


def test_more_languages_than_one_block(spark):
    import random

    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = ["".join(rng.sample(letters, 4)) for _ in range(300)]
    data = [(n * 3 + k, " ".join("".join(rng.choice(kind) for _ in range(5)) for _ in range(40)), f"l{n:03d}", "s", 1) for n, kind in enumerate(kinds) for k in range(3)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(documents(spark, data)).collect()}
    learned = {d[2] for d in data if zlib.crc32(str(d[0]).encode()) % 5}
    assert np.mean([got[d[0]] == d[2] for d in data if d[2] in learned]) > 0.9


def test_languages(spark):
    got = {r.doc_id: r for r in langid.identify(with_clashes(documents(spark))).collect()}
    truth = {d[0]: d[2] for d in rows()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(got[i].lang_pred == truth[i] for i in range(60))
    for i in (62, 63, 64, 66):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(documents(spark, [])).collect() == []


def test_mixture_proportions():
    rng = np.random.default_rng(0)
    probs = rng.dirichlet(np.full(langid.BUCKETS, 0.05), 3) + 1e-9
    probs /= probs.sum(1, keepdims=True)
    one = rng.multinomial(3000, probs[1])
    two = rng.multinomial(2100, probs[0]) + rng.multinomial(900, probs[2])
    w = langid.fit(np.stack([one, two]), probs)
    assert w[0].tolist() == [0, 1, 0]
    assert w[1] == pytest.approx([0.7, 0, 0.3], abs=0.05)


# quality


def base_counts(text):
    words = [w.decode() for w in (text or "").encode().split()]
    five = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often, hit = Counter(five), set()
    for k, w in enumerate(five):
        if often[w] > 1:
            hit |= set(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def brute_rules(docs, trusted):
    """Scores by dictionaries over the same buckets, hashed by the library."""
    import xxhash

    def word(w):
        return xxhash.xxh64_intdigest(w, seed=42)

    def pair(a, b):
        first = xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42)
        return xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=first)

    raw, good, grams = Counter(), Counter(), {}
    for k, (i, t, *_) in enumerate(docs):
        h = [word(w) for w in (t or "").encode().split()]
        grams[k] = [g % rules.BUCKETS for g in h + [pair(a, b) for a, b in zip(h, h[1:])]]
        raw.update(grams[k])
        if i in trusted:
            good.update(grams[k])
    n, m = sum(raw.values()), sum(good.values())
    prior = rules.PRIOR * m / n
    scale = (n + rules.PRIOR * rules.BUCKETS) / (m + prior * rules.BUCKETS)
    ratio = {g: np.log((good[g] + prior) / (raw[g] + rules.PRIOR) * scale) for g in raw}
    return {k: (np.mean([ratio[g] for g in gs]) if gs else 0.0) for k, gs in grams.items()}


def test_quality_rules(spark):
    import random

    rng = random.Random(2)
    data = rows(60)
    junk = [(500 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "xx", "s0", 1) for i in range(20)]
    rep = prose(rng, 12)
    data = [d for d in data if d[0] != 67] + junk + [(600, f"{rep} {rep} {prose(rng, 4)}", "xx", "s0", 1)]
    trusted = {i for i in range(40) if i % 7 != 0}
    got = rules.judge_documents(with_clashes(documents(spark, data)), labels(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(data)
    for i, t, *_ in data:
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t)
        assert r.kept == (not r.base_failed and r.llr >= rules.THRESHOLD)
    want = brute_rules(data, trusted)
    assert all(by[d[0]].llr == pytest.approx(want[k], abs=1e-9) for k, d in enumerate(data))
    assert by[600].base_failed
    none = rules.judge_documents(documents(spark), labels(spark, [])).collect()
    assert {r.llr for r in none} == {0.0}
    assert rules.judge_documents(documents(spark, []), labels(spark)).collect() == []


def test_classifier(spark):
    import random

    rng, data, known = random.Random(9), [], []
    for i in range(400):
        text = prose(rng, rng.randint(30, 80))
        if i % 4 == 0:
            text = " | ".join(w.upper() for w in text.split())
        data.append((i, text, "xx", f"s{i % 3}", 1))
        if i % 2 == 0 or i % 8 == 4:
            known.append((i, int(i % 4 != 0), 0))
    data += [(900, None, None, None, None), (901, "", "xx", "s0", 0), data[3]]
    docs = with_clashes(documents(spark, data))
    got = quality.score_documents(docs, labels(spark, known)).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id < 400 and r.doc_id % 2 == 1]
    assert sum(r.kept for r in held) >= 0.98 * len(held)
    bad = [r for r in got if r.doc_id < 400 and r.doc_id % 4 == 0]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)
    model = quality.learn(docs, labels(spark, known))
    left = quality.kept_documents(docs, model)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in got if r.kept)
    clash = docs.withColumns({"score": F.lit("own"), "_c_x": F.lit("own"), "text_score": F.lit("own")})
    scored = quality.with_scores(clash, model)
    assert scored.where("_c_x = 'own' and score between 0 and 1").count() == len(data)
    long = documents(spark, [(1, "word " * 200_000, "xx", "s", 1), (None, "x" * 200_000, None, None, None)])
    assert quality.score_documents(long, labels(spark, known)).count() == 2
    plain = quality.score_documents(documents(spark), labels(spark, []))
    assert {(r.score, r.kept) for r in plain.collect()} == {(0.5, True)}
    assert quality.score_documents(documents(spark, []), labels(spark)).collect() == []
