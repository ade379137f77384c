"""Alignment of two tokenizers' ids of the same texts, in relations.

Tokens are exploded with their places, running sums of their byte lengths give
where each ends, ends that both sides share cut a text into groups (numbered by
running counts of cuts), and the tokens that end at a cut are linked.

How it runs
    Neither vocabulary joins what stands before a space with that space, so a
    text falls apart into segments (a word with the spaces before it) that are
    tokenized each for itself. Every distinct segment of the corpus is aligned
    once, by the relations above; how often it occurs weighs its links. The
    equi-join of the two sides on (segment, end) is said as neighbours in one
    order of both sides' rows, which numbers the groups as well: a full outer
    join forgets in Spark how its rows are dealt, and would shuffle all tokens
    again. Aligned segments lie in buckets by segment, so pricing their links
    and joining them to texts shuffles none of them. Then the texts meet them:
    entries above a count that at most FREQUENT segments reach are broadcast,
    and texts are written as numbers of these. Only other segments become rows,
    which meet their entries bucket by bucket and go back to their texts by
    number of row. So no segment that many documents hold is one task's work,
    and the words of a text are an array, not rows.

Defined results
    Null and empty texts, and those that a tokenizer doesn't give back byte by
    byte, have no tokens: zeros and ''. Repeated rows count each. Special
    strings are plain text. A text of any length is taken whole; one without
    spaces is one segment. Null ids are kept. An empty table gives an empty
    result. Further columns, whatever their names, are left out.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import leaving, materialise, scratch_table, short_batches, small_side, worker_cache
from .tokens import TextEncoder, byte_symbols

#: Aligned segments that are broadcast at most, and their bytes.
FREQUENT, KNOWN_BYTES = 1 << 19, 128 << 20
#: Bytes of groups that are handed to Spark at once, but for a longer text.
OUT_BYTES = 32 << 20
#: Bytes of text, and distinct segments, that a task takes on at once.
TASK_BYTES, TASK_SEGMENTS = 4 << 20, 40_000
SPACE_MARK = "▁"


class Pair:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.path_a, self.fast = path_a, None
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {s: b for b, s in byte_symbols().items()}
        self.bytes_a = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(of[i]) for i in range(len(of))], np.int64) for of in (self.bytes_a, self.bytes_b))
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("a piece reaches over a space, so texts don't fall apart at spaces")

    def encode(self, spaced: list[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """Ids of both sides for texts that begin with a space, and whether
        both give the text back."""
        for text, a, b in zip(spaced, self.a.encode_batch(spaced, add_special_tokens=False), self.b.encode([t[1:] for t in spaced], num_threads=1), strict=True):
            raw = text.encode()
            same = b"".join([self.bytes_a[i] for i in a.ids]) == raw == b"".join([self.bytes_b[i] for i in b])
            yield a.ids, b, same

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """An order of the segments, and for both sides their ids in that order,
        end to end, with the edges of each one's. The first side encodes those as
        one text that would fall apart into them."""
        if self.fast is None:
            self.fast = TextEncoder(self.path_a)
        solid, safe = _solid(), self.fast.is_safe
        joins = np.array([solid[ord(s[-1])] for s in segments], bool)
        if not safe("".join(compress(segments, joins))):
            joins &= np.array([safe(s) for s in segments], bool)
        order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
        ordered, n = [segments[i] for i in order], int(joins.sum())
        if not safe(joined := "".join(ordered[:n])):
            joined, n = "", 0
        a = [self.fast.of(joined).tolist()] if joined else []
        a += [e.ids for e in self.a.encode_batch(ordered[n:], add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in ordered], num_threads=1)
        raw = "".join(ordered).encode()
        bounds = np.cumsum([0, *[len(s.encode()) for s in ordered]])
        sides = []
        for lists, of, size in ((a, self.bytes_a, self.size_a), (b, self.bytes_b, self.size_b)):
            ids = np.fromiter(chain.from_iterable(lists), np.int32)
            if b"".join([of[i] for i in ids.tolist()]) != raw:
                raise ValueError("a segment doesn't come back byte by byte")
            ends = np.concatenate(([0], np.cumsum(size[ids])))
            edges = np.searchsorted(ends, bounds)
            if not np.array_equal(ends[edges], bounds):
                raise ValueError("an id reaches over the end of a segment")
            sides.append((ids, edges))
        return order, *sides


def _pair(paths: tuple[str, str]) -> Pair:
    return worker_cache(f"pair {paths}", lambda: Pair(*paths))


def _checked(paths: tuple[str, str]):
    """Rows whose text doesn't come back lose it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(paths)
        for batch in batches:
            for ids, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                whole = next(pair.encode([" " + text]))[2]
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.int64()), pa.array([text if whole else None], pa.string())], ["doc_id", "text"])

    return rows


def _encoded(paths: tuple[str, str]):
    kinds = [("segment", pa.string()), ("n", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(paths)
        for batch in batches:
            order, *sides = pair.encode_segments(batch.column(0).to_pylist())
            columns = [c.take(pa.array(order, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, *[_lists(edges, pa.array(ids, pa.int32())) for ids, edges in sides]], schema=pa.schema(kinds))

    return rows


@functools.cache
def _solid() -> np.ndarray:
    """Of every character, whether it is surely neither white space nor a control."""
    return np.array([unicodedata.category(chr(c))[0] not in "ZC" for c in range(0x110000)])


def _divided(spaced: pa.Array) -> pa.Array:
    """The segments of texts that begin with a space; null has none. A cut lies
    before spaces that a character follows, behind one that is solid, so
    white-space runs are never divided. Segments are views on the texts."""
    if not len(spaced):
        return pa.array([], pa.list_(pa.string()))
    spaced = pc.fill_null(spaced, "").cast(pa.string())
    _, bounds, data = spaced.buffers()
    bounds = np.frombuffer(bounds, np.int32)[spaced.offset : spaced.offset + len(spaced) + 1].astype(np.int64)
    low, bounds = int(bounds[0]), bounds - bounds[0]
    if not bounds[-1]:
        return _lists(bounds, pa.array([], pa.string()))
    data = data.slice(low, int(bounds[-1]))
    raw = np.frombuffer(data, np.uint8)
    space = raw == 32
    # where runs of spaces begin inside a text, but for those that end it
    runs = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    begins = np.zeros(len(raw) + 1, bool)
    begins[bounds[:-1]] = True
    runs = runs[~begins[runs]]
    lows, highs = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0]
    tail = np.searchsorted(runs, highs) - 1
    tail = tail[space[highs - 1] & (tail >= 0) & (runs[tail] > lows if len(runs) else False)]
    runs = np.delete(runs, tail)
    # the character before a run, of one to four bytes
    char = raw[runs - 1].astype(np.int32)
    wide = np.flatnonzero(char >= 0x80)
    at, code, opened = runs[wide] - 1, char[wide] & 0x3F, np.ones(len(wide), bool)
    for shift, lead in ((6, 0x1F), (12, 0x0F), (18, 0x07)):
        at = np.maximum(at - 1, 0)
        byte = raw[at].astype(np.int32)
        code += np.where(opened, (byte & np.where(byte >= 0xC0, lead, 0x3F)) << shift, 0)
        opened &= byte < 0xC0
    char[wide] = np.minimum(code, 0x10FFFF)
    starts = np.sort(np.concatenate((lows, runs[_solid()[char]])), kind="stable")
    ends = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
    return _lists(np.searchsorted(starts, bounds), pa.StringArray.from_buffers(len(starts), ends, data))


def _spaced(text: Column) -> Column:
    return F.concat(F.lit(" "), text)


def _segments(text: Column) -> Column:
    return F.arrow_udf(_divided, "array<string>")(_spaced(text))


def _packed(groups: Column) -> Column:
    """A groups text has thirteen different characters: two go into a byte."""
    digits = F.translate(groups, ",|;", "abc")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(F.lit("f"), digits)).otherwise(digits))


def _unpacked(groups: Column) -> Column:
    return F.translate(F.hex(groups), "ABCF", ",|;")


def align_segments(segments: DataFrame, path_a: str, path_b: str, parts: int) -> str:
    """The table of ``segment, n`` of distinct segments with their ``n_a, n_b``,
    packed ``groups`` and ``links`` (pairs of ids), one row each, in ``parts``
    buckets of segments."""
    paths = (path_a, path_b)
    encoded = segments.mapInArrow(_encoded(paths), "segment string, n long, a array<int>, b array<int>")
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("ids")) for k, c in enumerate("ab")])
    # numbers of the segments, in the order of the rows, spare the sorts below from comparing texts
    dealt = encoded.repartition(parts, "segment").select(F.monotonically_increasing_id().alias("at"), "segment", "n", sides.alias("sides"))
    tokens = dealt.select("at", "segment", "n", F.inline("sides")).select("at", "segment", "n", "side", F.posexplode("ids").alias("place", "id"))
    # bytes of each id: two constants of the vocabularies' sizes
    pair = _pair(paths)
    sizes = [F.from_json(F.lit(json.dumps(of.tolist())), "array<int>") for of in (pair.size_a, pair.size_b)]
    size = F.when(F.col("side") == 0, F.get(sizes[0], F.col("id"))).otherwise(F.get(sizes[1], F.col("id")))
    reached = F.sum(size).over(Window.partitionBy("at", "segment", "side").orderBy("place"))
    tokens = tokens.select("at", "segment", "n", "side", "id", reached.alias("end"))
    # the two sides' rows of an end meet as neighbours; a token without partner stays alone
    line = Window.partitionBy("at", "segment").orderBy("end", "side")
    last, following = F.lag("end").over(line), F.lead("end").over(line)
    tokens = tokens.select("*", F.lag("id").over(line).alias("a"), F.coalesce(F.col("end") == last, F.lit(False)).alias("met"), F.coalesce(F.col("end") == following, F.lit(False)).alias("meets"))
    cuts = F.coalesce(F.sum(F.col("met").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # what follows an id: the second side behind the first one's last of a group, then the next group
    mark = F.when(F.col("meets"), "|").when(F.col("met"), ";").otherwise(",")
    told = F.struct(cuts.alias("group"), "side", "end", F.concat(F.col("id").cast("string"), mark).alias("text"))
    tokens = tokens.select("at", "segment", "n", "side", "met", told.alias("told"), F.when(F.col("met"), F.struct("a", F.col("id").alias("b"))).alias("link"))
    whole = tokens.groupBy("at", "segment", "n").agg(
        F.sum(1 - F.col("side")).alias("n_a"), F.sum("side").alias("n_b"), F.collect_list("link").alias("links"), F.sort_array(F.collect_list("told")).alias("told")
    )
    groups = F.expr("left(array_join(told.text, ''), length(array_join(told.text, '')) - 1)")
    whole = whole.select("segment", "n", "n_a", "n_b", F.size("links").alias("n_groups"), "links", _packed(groups).alias("groups"))
    return scratch_table(whole, "aligned", "segment", parts)


def priced_segments(aligned: DataFrame, parts: int) -> str:
    """The table of ``aligned`` with ``n_links``, ``n_best`` and ``count_sum`` in place of
    the links, in the same buckets: a pair's count is how many links of the
    corpus hold it."""
    links = aligned.select("segment", "n", F.inline("links"))
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    best = F.max("count").over(Window.partitionBy("b"))  # no more rows than the first vocabulary has
    pairs = materialise(counts.withColumn("best", (F.col("count") == best).cast("long")), "pairs")
    told = [c for c in aligned.columns if c != "links"]
    links = aligned.select(*told, F.inline("links")).join(small_side(pairs), ["a", "b"])
    priced = links.groupBy(*told).agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    return scratch_table(priced, "priced", "segment", parts)


def _least_frequent(entries: DataFrame) -> int:
    """The least count that at most FREQUENT entries, and KNOWN_BYTES, reach."""
    size = F.octet_length("segment") + 2 * F.length("groups") + 8 * len(SUMS)
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    rows = entries.groupBy(step).agg(F.count("*").alias("k"), F.sum(size).alias("bytes"), F.min("n").alias("low")).collect()  # 512 rows at most
    total, size, low = 0, 0, (1 << 63) - 1
    for r in sorted(rows, key=lambda r: -r["step"]):
        total, size = total + r["k"], size + r["bytes"]
        if total > FREQUENT or size > KNOWN_BYTES:
            break
        low = r["low"]
    return low


SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _edges(lists: pa.ListArray) -> np.ndarray:
    """Where the lists of a column begin and end, end to end; null is empty."""
    return np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)


def _lists(edges: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct segments of a batch of texts with their counts."""
    for batch in batches:
        found = pc.value_counts(_divided(batch.column(0)).flatten())
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["segment", "n"])


def _numbered(known: Broadcast):
    """Texts as numbers of their segments among the ``known`` ones, -1 for each
    other one; those are told beside."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc_id, text = batch.columns
            segments = _divided(text)
            edges, coded = _edges(segments), segments.flatten().dictionary_encode()
            number = pc.fill_null(pc.index_in(coded.dictionary, value_set=known.value), -1).to_numpy(zero_copy_only=False)
            which = coded.indices.to_numpy(zero_copy_only=False)
            ids = number[which].astype(np.int32)
            seldom = np.concatenate(([0], np.cumsum(ids < 0)))[edges]
            rest = coded.dictionary.take(pa.array(which[ids < 0]))
            yield pa.RecordBatch.from_arrays([row, doc_id, _lists(edges, pa.array(ids)), _lists(seldom, rest)], ["row", "doc_id", "ids", "rest"])

    return rows


def _told(known: Broadcast):
    """Sums and groups of texts from the entries of their segments: ``known``
    ones by number, the others in the order of their places."""
    kinds = [("doc_id", pa.int64()), *[(c, pa.int64()) for c in SUMS], ("groups", pa.string())]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, ids, rest = batch.columns
            edges, which, other = _edges(ids), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), rest.flatten()
            unknown = which < 0
            if unknown.sum() != len(other):
                raise ValueError("a segment has no entry")
            which[unknown] = len(known.value) + np.arange(len(other))
            columns = [doc_id]
            for c in SUMS:
                each = np.concatenate([known.value.column(c).to_numpy(), other.field(c).to_numpy(zero_copy_only=False)])[which]
                columns.append(pa.array(np.diff(np.concatenate(([0], np.cumsum(each)))[edges]), pa.int64()))
            groups = pa.concat_arrays([known.value.column("groups"), other.field("groups")])
            size = np.concatenate(([0], np.cumsum(pc.binary_length(groups).to_numpy().astype(np.int64)[which] + 1)))[edges]
            cuts = np.flatnonzero(np.diff(size[1:] // OUT_BYTES)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(doc_id)], strict=True):
                taken = groups.take(pa.array(which[edges[lo] : edges[hi]]))
                joined = pc.binary_join(_lists(edges[lo : hi + 1] - edges[lo], taken), ";")
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in columns], joined], schema=pa.schema(kinds))

    return rows


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of
    every row of ``docs``."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text") != "", F.make_valid_utf8("text")).alias("text"))
    odd = F.coalesce(F.col("text").contains(SPACE_MARK), F.lit(False))
    rows = rows.where(~odd).unionByName(rows.where(odd).mapInArrow(_checked((path_a, path_b)), "doc_id long, text string"))

    found = rows.select(_spaced(F.col("text")).alias("spaced")).mapInArrow(leaving(_counted), "segment string, n long")
    found = scratch_table(found.groupBy("segment").agg(F.sum("n").alias("n")), "segments")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-spark.table(found).count() // TASK_SEGMENTS))
    aligned = align_segments(spark.table(found), path_a, path_b, parts)
    priced = spark.table(priced_segments(spark.table(aligned), parts))
    for done in (found, aligned):
        spark.sql(f"DROP TABLE {done} PURGE")

    # FREQUENT entries of KNOWN_BYTES at most go to every task, their groups as texts
    least = _least_frequent(priced)
    entry = [*[F.col(c).cast("long").alias(c) for c in SUMS], _unpacked(F.col("groups")).alias("groups")]
    often = priced.where(F.col("n") >= least).select("segment", *entry).toArrow()
    often = pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([], c.type), *c.chunks]) for c in often.columns], often.column_names)
    known = spark.sparkContext.broadcast(often.column("segment"))
    entries = spark.sparkContext.broadcast(often.drop_columns(["segment"]))

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", _spaced(F.col("text")).alias("spaced"))
    numbered = numbered.mapInArrow(leaving(_numbered(known)), "row long, doc_id long, ids array<int>, rest array<string>")
    numbered = spark.table(scratch_table(numbered, "numbered"))
    seldom = priced.where(F.col("n") < least).select(F.col("segment").alias("known"), *SUMS, "groups")
    rest = numbered.select("row", F.posexplode("rest").alias("place", "segment")).join(seldom.hint("shuffle_hash"), F.col("segment") == F.col("known"))
    rest = rest.select("row", "place", *SUMS, "groups").repartition(deal, "row").select(F.col("row").alias("of"), F.struct("place", *entry).alias("entry"))
    rest = rest.groupBy("of").agg(F.sort_array(F.collect_list("entry")).alias("rest"))
    both = numbered.select("row", "doc_id", "ids").repartition(deal, "row").join(rest, F.col("row") == F.col("of"), "left").select("doc_id", "ids", "rest")
    return both.mapInArrow(leaving(_told(entries)), ", ".join(f"{c} long" for c in ("doc_id", *SUMS)) + ", groups string")
