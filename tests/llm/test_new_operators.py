"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phenoscope.llm import alignment, anchors, importance
from phenoscope.llm.tokens import byte_symbols, public_path

from . import fixtures

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def awkward():
    """The fixture with copies, shared passages, null ids and repeated ids."""
    rng = random.Random(5)
    data = fixtures.rows()
    passage = fixtures.prose(rng, 40)
    for i in range(100, 130):
        data.append((i, f"{fixtures.prose(rng, rng.randint(0, 30))} {passage} {fixtures.prose(rng, rng.randint(0, 20))}", "xx", "s1", 1))
    short = passage.split()[:13]
    data += [
        (130, " ".join(short), "xx", "s0", 1),
        (131, " ".join(short[:12]), "xx", "s0", 1),
        (132, " ".join(["x", *short, *short, "y"]), "xx", "s0", 1),
        (133, "▁ odd " + passage, "xx", "s0", 1),
        (134, " lead  two   three ", None, None, None),
        (135, "a\n\n  b\t c <s> <|endoftext|> don't 's", None, None, None),
        (136, "nospace" * 3000, None, None, None),
        (None, passage, "xx", "s0", 1),
        (None, passage, "xx", "s0", 1),
        (105, passage, "xx", "s0", 1),  # an id again, with another text
        (99, passage, "xx", "s0", 1),
        (99, passage, "xx", "s0", 1),
    ]
    rng.shuffle(data)
    return data


def removed_by_hand(data, window):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    docs = [(d[0], word.findall((d[1] or "").encode())) for d in data]
    least = {}
    for doc, w in docs:
        for i in range(len(w) - window + 1):
            if doc is not None:
                s = tuple(w[i : i + window])
                least[s] = min(least.get(s, doc), doc)
    out = []
    for doc, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and least[tuple(w[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append((doc, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def test_the_cover_brings_every_two_places_onto_it():
    for i in range(anchors.PERIOD):
        for j in range(anchors.PERIOD):
            assert any((i + k) % anchors.PERIOD in anchors.COVER and (j + k) % anchors.PERIOD in anchors.COVER for k in range(anchors.PERIOD))


@pytest.mark.parametrize(("window", "chunk"), [(13, 1 << 20), (13, 50), (7, 200), (20, 1000)])
def test_repeats_equal_plain_search(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(anchors, "CHUNK_WORDS", chunk)
    data = awkward()
    docs = fixtures.with_clashes(fixtures.documents(spark, data)).repartition(3)
    rows = anchors.remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((tuple(r) for r in rows), key=str) == removed_by_hand(data, window)


def test_repeats_of_an_empty_table(spark):
    assert anchors.remove_repeats(fixtures.documents(spark, [])).count() == 0
    assert anchors.remove_repeats(fixtures.documents(spark, [(1, None, None, None, None)])).collect()[0].n_words == 0


def test_a_hot_passage_is_few_rows_before_the_shuffle():
    import numpy as np

    ids = np.arange(1000, dtype=np.int64)
    keep, salt = anchors._salted((np.full(1000, 7, np.uint64),), ids, True)
    assert len(keep) == 1000 and (salt == 0).sum() == 2 and {int(ids[k]) for k in keep[salt == 0]} == {0, 999}


def resampled_by_hand(data, target, percent, min_words, buckets, low, high):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall

    def features(text):
        w = find((text or "").translate(lower))
        return len(w), [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for d in data:
        s.update(map(bucket, features(d[1])[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for d in data:
        words, f = features(d[1])
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        out.append([d[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    enough = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = enough[: len(enough) * percent // 100]
    ranks = Counter()
    for k, r in enumerate(drawn, 1):
        ranks[(k, *r[:4])] += 1
    return sorted((tuple(r[:4]) for r in out), key=str), sorted(ranks)


@pytest.mark.parametrize(("low", "high", "frequent", "percent"), [(1, 1, 1 << 18, 10), (1, 2, 20, 50), (2, 3, 0, 10)])
def test_resampling_equals_plain_version(spark, monkeypatch, low, high, frequent, percent):
    monkeypatch.setattr(importance, "FREQUENT", frequent)
    monkeypatch.setattr(importance, "HELD", 500)
    data = awkward()
    target = [data[3][1], None, "", "kalo TREMI son été"]
    docs = fixtures.with_clashes(fixtures.documents(spark, data)).repartition(3)
    targets = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    rows = importance.resample(docs, targets, percent, 20, 2024, 997, low, high).collect()
    every, drawn = resampled_by_hand(data, target, percent, 20, 997, low, high)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in rows), key=str) == every
    assert sorted((r["rank"], r.doc_id, r.n_features, r.weight, r.score) for r in rows if r["rank"]) == drawn


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(fixtures.documents(spark, []), none).count() == 0
    assert {r.weight for r in importance.resample(fixtures.documents(spark, [(1, None, None, None, None), (2, "", None, None, None)]), none).collect()} == {0}


def aligned_by_hand(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_path(B))
    back = {s: n for n, s in byte_symbols().items()}
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [of_b(i) for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        sides = []
        for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
            end, out = 0, {}
            for i, p in zip(ids, parts, strict=True):
                end += len(p)
                out[end] = i
            sides.append(out)
        cuts = [e for e in sides[0] if e in sides[1]]
        groups, last = [], 0
        for e in cuts:
            groups.append("|".join(",".join(str(i) for x, i in s.items() if last < x <= e) for s in sides))
            last = e
        links = [(sides[0][e], sides[1][e]) for e in cuts]
        counts.update(links)
        docs.append((ids_a, ids_b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(len(x), len(y), len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), ";".join(g)) for x, y, g, k in docs]


@pytest.mark.parametrize("frequent", [1 << 17, 30, 0])
def test_alignment_equals_plain_version(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    data = [d for d in awkward() if d[0] != 67]  # the plain version is quadratic in one very long text
    docs = fixtures.with_clashes(fixtures.documents(spark, data)).repartition(3)
    rows = alignment.align_documents(docs, public_path(A), public_path(B)).select("doc_id", *alignment.SUMS, "groups").collect()
    expected = [(d[0], *x) for d, x in zip(data, aligned_by_hand([d[1] for d in data]), strict=True)]
    assert sorted((tuple(r) for r in rows), key=str) == sorted(expected, key=str)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align_documents(fixtures.documents(spark, []), public_path(A), public_path(B)).count() == 0


def test_texts_fall_apart_at_spaces(spark):
    """Ids of the segments, end to end, are those of the text."""
    rng = random.Random(3)
    pieces = ["a", "kalo", " ", "  ", "\n", "\t", "\xa0", "é", "'s", "12", "你好", ".", "​", "　", "x" * 30, "🙂", "́"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", alignment._segments(F.col("t")).alias("s")).collect()
    pair = alignment.Pair(public_path(A), public_path(B))
    for r in rows:
        assert "".join(r.s) == " " + r.t
        whole = next(pair.encode([" " + r.t]))
        parts = [*pair.encode(r.s)]
        assert [i for p in parts for i in p[0]] == whole[0], r.t
        assert [i for p in parts for i in p[1]] == whole[1], r.t


def test_repeated_rows_with_a_near_copy(spark):
    """3,000 repeats of a row are one text wherever texts are compared."""
    from phenoscope.llm import neardup

    rng = random.Random(8)
    text = fixtures.prose(rng, 60)
    data = [(7, text, "xx", "s", 1)] * 3000 + [(8, text + " more", "xx", "s", 1), (9, fixtures.prose(rng, 60), "xx", "s", 1), (None, text, "xx", "s", 1)]
    docs = fixtures.documents(spark, data)
    told = neardup._describe(docs, 3).where("n_shingles > 0 and doc_id is not null")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    assert sorted(r.id for r in neardup._once(texts, told).collect()) == [7, 8, 9]
    rows = neardup.group_near_duplicates(docs, 3, 85).collect()
    assert len(rows) == 3003 and {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}


def test_one_row_of_an_id_is_kept_whatever_its_columns(spark):
    from phenoscope.llm import neardup

    docs = fixtures.documents(spark, [(1, "b x", "xx", "s", 1), (1, "a x", "xx", "s", 2), (2, "c y", None, None, None)])
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.col("n_chars")))
    kept = neardup.keep_one(docs, neardup.group_near_duplicates(docs, 5, 80)).collect()
    assert sorted((r.doc_id, r.text, r.m["k"]) for r in kept) == [(1, "a x", 2), (2, "c y", None)]


def test_null_metadata_is_not_the_text_none():
    from phenoscope.llm import quality

    of = lambda s, lang: set(quality.features(["a b"], [s], [lang], [3])[0].tolist())
    assert of(None, "en") != of("None", "en") and of("s", None) != of("s", "None")


def test_ranks_of_many_sources(spark):
    from phenoscope.llm import sharding

    names = [f"https://h{i % 50021}/{i}" for i in range(20_000)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "source string")
    got = {r.source: r.at for r in sharding.with_rank(df, "source", "at").collect()}
    assert got == {n: float(k) for k, n in enumerate(sorted(names), 1)} | {None: -1.0}
