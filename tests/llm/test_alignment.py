"""Segments as arrays, and texts told from the entries of their segments."""

import random
from types import SimpleNamespace

import pyarrow as pa
import regex

from phenoscope.llm import alignment
from phenoscope.llm.tokens import public_path

from . import fixtures
from .test_new_operators import A, B, aligned_by_hand, awkward

PIECES = ["a", "kalo", " ", "  ", "\n", "\t", "\xa0", "é", "'s", "12", "你好", ".", "​", "　", "🙂", "́", "<s>", "<|endoftext|>", ""]


def mixed(n):
    rng = random.Random(4)
    return [None if rng.random() < 0.05 else " " + "".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)]


def test_segments_equal_a_plain_split():
    texts = mixed(5000)
    cut = regex.compile(r"(?V1)(?= +[^ ])(?<=[^\p{Z}\p{C}\s])")
    expected = [[] if t is None else cut.split(t) for t in texts]
    for low, high in ((0, 5000), (3, 4000), (7, 8), (5, 5)):
        assert alignment._divided(pa.array(texts, pa.string()).slice(low, high - low)).to_pylist() == expected[low:high]
    assert alignment._divided(pa.array(["", None, ""], pa.string())).to_pylist() == [[], [], []]


def test_segments_encoded_together_have_their_own_ids():
    segments = sorted({s for t in mixed(3000) if t for s in alignment._divided(pa.array([t])).to_pylist()[0]} - {" "}) + [" " + "nospace" * 400]
    pair = alignment.Pair(public_path(A), public_path(B))
    plain = [*pair.encode(segments)]
    order, (a, at_a), (b, at_b) = pair.encode_segments(segments)
    assert sorted(order) == [*range(len(segments))]
    for k, i in enumerate(order):
        assert (a[at_a[k] : at_a[k + 1]].tolist(), b[at_b[k] : at_b[k + 1]].tolist(), True) == plain[i]
    assert not len(pair.encode_segments([])[0])


def test_long_texts_are_handed_over_in_parts(monkeypatch):
    monkeypatch.setattr(alignment, "OUT_BYTES", 20)
    entry = lambda k, g: {**{c: k for c in alignment.SUMS}, "groups": g}
    known = pa.RecordBatch.from_pylist([entry(1, "1|1"), entry(10, "22|2;3|3")])
    rest = [[], [entry(100, "4|4")], None, [entry(1000, "5|5"), entry(5000, "6|6")]]
    ids = [[0, 1] * 5, [0, -1, 1], [], [-1, 0, -1]]
    kind = pa.list_(pa.struct(known.schema))
    batch = pa.RecordBatch.from_arrays([pa.array([7, None, 8, 9]), pa.array(ids, pa.list_(pa.int32())), pa.array(rest, kind)], ["doc_id", "ids", "rest"])
    out = [*alignment._told(SimpleNamespace(value=known))([batch])]
    rows = [r for b in out for r in b.to_pylist()]
    assert len(out) > 1
    assert [(r["doc_id"], r["count_sum"], r["groups"]) for r in rows] == [
        (7, 55, ";".join(["1|1;22|2;3|3"] * 5)), (None, 111, "1|1;4|4;22|2;3|3"), (8, 0, ""), (9, 6001, "5|5;1|1;6|6")
    ]


def test_words_of_texts_are_no_rows(spark, monkeypatch):
    """Only segments that are not broadcast become rows, and a broadcast is bounded in bytes."""
    monkeypatch.setattr(alignment, "KNOWN_BYTES", 6000)
    data = [d for d in awkward() if d[0] != 67]
    told = alignment.align_documents(fixtures.documents(spark, data), public_path(A), public_path(B))
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and "posexplode(rest" in plan
    rows = told.select("doc_id", *alignment.SUMS, "groups").collect()
    expected = [(d[0], *x) for d, x in zip(data, aligned_by_hand([d[1] for d in data]), strict=True)]
    assert sorted((tuple(r) for r in rows), key=str) == sorted(expected, key=str)
