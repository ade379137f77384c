"""Token counts by rank-synchronous merging of arrays.

The pre-tokens of many words lie end to end in one array of symbols, with an
array of lengths. In each round every pre-token applies its own lowest-ranked
pair, all occurrences at once, and pre-tokens without a pair left drop out with
the number of symbols they still have.

Defined results
    null text is empty and counts no tokens; strings of special tokens inside a
    text count one token each; repeated rows are counted each; an empty table
    gives an empty result; further columns are carried along.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import text_or_empty, worker_cache
from .tokens import drops_space, byte_symbols

#: Distinct words whose counts a worker remembers: bounds memory, not texts.
MEMO_WORDS = 600_000
#: Documents whose new words are merged together.
BATCH_ROWS = 400


class RankMerger:
    """Counts the symbols that byte-pair merging leaves of pre-tokens."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[symbols[b] + suffix] for b in range(256)], np.int64)
        self.width = len(vocab)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # an end suffix stays where it is: "a" + "b</w>" is "ab</w>"
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order, made

    def _ranks(self, pair: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], len(self.made))

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each (non-empty) pre-token."""
        size = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        ids = self.inner[raw]
        ends = np.cumsum(size) - 1
        ids[ends] = self.final[raw[ends]]
        out, live, none = size.copy(), np.arange(len(size)), len(self.made)
        while len(live):
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            rank = np.full(len(ids), none, np.int64)
            inside = np.ones(len(ids), bool)
            inside[starts + size - 1] = False  # the last symbol has no right neighbour
            at = np.flatnonzero(inside)
            rank[at] = self._ranks(ids[at] * self.width + ids[at + 1])
            best = np.minimum.reduceat(rank, starts)
            going = best < none
            hit = (rank == np.repeat(best, size)) & (rank < none)
            # of overlapping equal pairs, as in "aaa", every other one merges
            edge = hit & ~np.concatenate(([False], hit[:-1]))
            where = np.arange(len(ids))
            run = where - np.maximum.accumulate(np.where(edge, where, 0))
            hit &= run % 2 == 0
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[np.flatnonzero(hit) + 1] = False
            left = np.add.reduceat(keep.astype(np.int64), starts)
            out[live] = left
            keep &= np.repeat(going, size)
            ids, size, live = ids[keep], left[going], live[going]
        return out


class TokenCounter:
    """Counts the tokens of texts; remembers the words it has seen."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or not drops_space(spec):
            raise ValueError(f"{path}: only byte-pair vocabularies of independent words are counted here")
        self.tokenizer = Tokenizer.from_file(path)
        self.merger = RankMerger(spec["model"])
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.back = {s: b for b, s in byte_symbols().items()}
        self.memo: dict[bytes, int] = {}

    def _pretokens(self, text: str) -> list[bytes]:
        if not text.isascii():
            text = self.tokenizer.normalizer.normalize_str(text)
            if max(text, default="") > "\u024f":
                parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
                return [bytes(map(self.back.__getitem__, p)) for p, _ in parts]
        return [p.encode() for p in self.find(text.lower())]

    def _new(self, words: list[bytes]) -> dict[bytes, int]:
        tokens, of, fixed = [], [], np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            text = word.decode()
            if "<" in text and (n := len(self.special.findall(text))):
                fixed[i] = n
                parts = self.special.split(text)
            else:
                parts = (text,)
            for part in parts:
                got = self._pretokens(part)
                tokens += got
                of += [i] * len(got)
        if tokens:
            fixed += np.bincount(of, self.merger.counts(tokens), len(words)).astype(np.int64)
        return dict(zip(words, fixed.tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; words never cross ASCII white space."""
        split = [t.encode().split() for t in texts]
        words: set[bytes] = set()
        words.update(*split)
        new = self._new([*words.difference(self.memo)])
        if len(self.memo) + len(new) <= MEMO_WORDS:
            self.memo.update(new)
            get = self.memo.__getitem__
        else:
            seen = self.memo

            def get(w):
                n = seen.get(w)
                return new[w] if n is None else n

        return [sum(map(get, ws)) for ws in split]


def with_counts(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with ``text`` replaced by its number of tokens."""
    fields = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(out, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(f"counter {path}", lambda: TokenCounter(path))
        for batch in batches:
            at = batch.schema.get_field_index(text)
            got: list[int] = []
            for k in range(0, batch.num_rows, BATCH_ROWS):
                got += counter.counts([t or "" for t in batch.column(at).slice(k, BATCH_ROWS).to_pylist()])
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.int64())], [*(f.name for f in fields), out])

    return docs.select(*[f.name for f in fields], text).mapInArrow(count, schema)


def count_documents(docs: DataFrame, path: str, limit: int) -> DataFrame:
    rows = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), "text")
    return with_counts(rows, path).withColumn("over_limit", F.col("n_tokens") > limit)
