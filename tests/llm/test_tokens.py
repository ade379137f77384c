"""Encoding, packing, files and counts against the library itself."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phenoscope.llm import arrowfile, packing, tokencount
from phenoscope.llm.tokens import TextEncoder, byte_symbols, public_path

from .fixtures import documents, rows, with_clashes

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoders():
    return TextEncoder(BYTE), TextEncoder(WORD), tokencount.TokenCounter(WORD)


TEXTS = st.text(alphabet=st.sampled_from(list("\x01\x02\x03\x85\x1cab'sDé Ω\n\t  　!?#1 2<|>ïß你́İΣ")), max_size=60)


def test_both_vocabularies_take_the_fast_way(encoders):
    assert encoders[0].fast is not None and encoders[1].fast is not None


def test_vocabularies_that_merge_otherwise_are_left_to_the_library():
    from phenoscope.llm.tokens import _ranked

    model = {"vocab": {s: k for k, s in enumerate([*map(chr, range(33, 127)), "ab", "bc", "abc"])}, "merges": ["a b", "b c", "a bc"]}
    assert _ranked(model) is None  # "abc" never comes from its own letters
    rest = [c for c in byte_symbols().values() if c not in model["vocab"]]
    model = {"vocab": {s: k for k, s in enumerate([*byte_symbols().values(), "ab", "bc", "abc"])}, "merges": ["a b", "b c", "a bc"]}
    assert rest and _ranked(model) is None
    model["merges"][2] = "ab c"
    assert _ranked(model) is not None


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_batches_of_texts(encoders, texts):
    for code in encoders[:2]:
        ids, counts = code.many([*texts, None], 2)
        want = [[*(code.whole(t).tolist() if t else []), 2] for t in [*texts, None]]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_awkward_texts(encoders):
    for code in encoders[:2]:
        for text in ("x" * 2500, "<|EndOfText|> a", "it's  a\n\n b", "ab\ncd", "ab \ncd", "\nab", "İstanbul Σας ’“— 你好 한국", "é ̀a", "½ ² ① ٣", "\u200d\xad\ufeff", "'S 'Re I'M", "a" * 120):
            assert code.of(text).tolist() == code.whole(text).tolist()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_the_librarys(encoders, text):
    byte, word, counter = encoders
    assert byte.of(text).tolist() == byte.whole(text).tolist()
    assert word.of(text).tolist() == word.whole(text).tolist()
    assert counter.counts([text]) == [len(word.whole(text))]


def test_special_strings(encoders):
    byte, word, counter = encoders
    for text in ("a <|endoftext|>b", "  <|endoftext|>  ", "x<|startoftext|>y z", "aaaaaaa aaaa", "<|endoftext"):
        assert byte.of(text).tolist() == byte.whole(text).tolist()
        assert word.of(text).tolist() == word.whole(text).tolist()
        assert counter.counts([text]) == [len(word.whole(text))]


def test_counts_of_documents(spark, encoders):
    got = tokencount.count_documents(with_clashes(documents(spark)), WORD, 2048).collect()
    want = sorted((i, len((t or "").encode()), len(encoders[1].whole(t or ""))) for i, t, *_ in rows())
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)


def test_files_round_trip(spark, encoders):
    got = sorted(arrowfile.round_trip(with_clashes(documents(spark)), WORD, 2, 64).collect(), key=lambda r: r.start)
    docs, start = sorted(rows(), key=lambda r: r[0]), 0
    assert [r.doc_id for r in got] == [d[0] for d in docs]
    for r, d in zip(got, docs):
        ids = encoders[1].whole(d[1] or "").tobytes() + (2).to_bytes(4, "little")
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids) // 4, ids)
        start += r.n_tokens


def test_files_of_null_and_repeated_ids_and_long_documents(spark, encoders):
    # the third document spans several batches of 1,024 sequences of 16
    data = [(None, "no id", "xx", "s", 1), (None, "no id either", "xx", "s", 1), (3, "word " * 40_000, "xx", "s", 1), (3, "again", "xx", "s", 1), (4, None, "xx", "s", 1), (3, "again", "xx", "s", 1)]
    got = sorted(arrowfile.round_trip(documents(spark, data), WORD, 2, 16).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 3, 3, 3, 4]
    assert sum(r.n_tokens for r in got) == got[-1].start + 1
    want = sorted(encoders[1].whole(d[1] or "").tobytes() + (2).to_bytes(4, "little") for d in data)
    assert sorted(bytes(r.ids) for r in got) == want


def test_random_access(tmp_path):
    path = str(tmp_path / "x.arrow")
    writer = arrowfile.SequenceWriter(path, 8, wide=False)
    data = np.arange(8 * 1030 + 5) % 60_000
    for part in np.array_split(data, 7):
        writer.add(part)
    writer.close()
    file = arrowfile.SequenceFile("file://" + path)
    for n in (0, 1, 1023, 1024, 1029):
        assert file.sequence(n)[0].tolist() == data[n * 8 : n * 8 + 8].tolist()
    ids, mask = file.sequence(1030)
    assert mask.tolist() == [True] * 5 + [False] * 3 and ids[:5].tolist() == data[-5:].tolist()


def test_packing(spark, encoders):
    got = packing.pack_digests(with_clashes(documents(spark)), BYTE, 2, 128).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in {d[0]: d[1] for d in rows()}.items():
        ids = encoders[0].whole(t or "").tobytes() + (2).to_bytes(4, "little")
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]})
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert sum(p[2] for p in pieces) * 4 == len(ids)
        assert all(p[2] == 128 for p in pieces[1:])
        assert all(p[3] == zlib.crc32(ids[4 * p[1] : 4 * (p[1] + p[2])]) for p in pieces)
    assert len(by_doc[7]) == 2 * len({r.piece for r in by_doc[7]})  # the repeated row
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        at = 0
        for r in seq:
            assert r.offset == at
            at += r.length
        assert at <= 128
    total = sum(r.length for r in got)
    assert len(by_seq) <= math.ceil(total / 128) * 1.05 + 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50)))
def test_plan_uses_every_piece_once(counts):
    used = {}
    for pattern, times in packing.plan(counts, 32):
        assert sum(pattern) <= 32 and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=8))
def test_plan_is_near_the_optimum(lengths):
    def fewest(rest, bins):
        if not rest:
            return len(bins)
        best = fewest(rest[1:], [*bins, 16 - rest[0]])
        for k, room in enumerate(bins):
            if room >= rest[0] and room not in bins[:k]:
                best = min(best, fewest(rest[1:], [*bins[:k], room - rest[0], *bins[k + 1 :]]))
        return best

    from collections import Counter

    got = sum(times for _, times in packing.plan(Counter(lengths), 16))
    assert got <= fewest(sorted(lengths, reverse=True), []) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 3), max_size=8), st.integers(1, 24))
def test_the_index_finds_what_fills_a_gap(counts, total):
    from itertools import combinations_with_replacement

    array = np.zeros(25, np.int64)
    for x, n in counts.items():
        array[x] = n
    ways = [c for k in (1, 2, 3) for c in combinations_with_replacement(sorted(counts), k) if sum(c) == total and all(c.count(x) <= counts[x] for x in c)]
    found = packing.ComplementIndex(array).exact(total)
    assert (found is None) == (not ways)
    assert found is None or (tuple(sorted(found)) in ways and len(found) == min(map(len, ways)))


def test_exact_complements_are_found():
    patterns = dict(packing.plan({20: 3, 12: 1, 7: 1, 5: 1, 6: 1, 4: 1, 2: 1}, 32))
    assert sorted(map(sum, patterns)) == [32, 32, 32]


def test_empty(spark):
    none = documents(spark, [])
    assert packing.pack_digests(none, BYTE, 2, 128).collect() == []
    assert arrowfile.round_trip(none, WORD, 2).collect() == []
    assert tokencount.count_documents(none, WORD, 10).collect() == []
