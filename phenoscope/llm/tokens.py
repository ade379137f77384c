"""Token ids of documents from the public tokenizers' files.

The files belong to the tokenizers library, whose ids count. Its merging of one
text at a time is slow, so the same vocabulary is also given to the tiktoken
library as ranked byte strings, which encodes whole texts several times faster.
The two merge alike if every entry of the vocabulary is what its own bytes
merge to, after parts of lower rank: a stretch that stands between two borders
can then only ever be joined the way its rank says. That is verified when a
file is loaded; files that fail, texts with special strings and texts outside
the scripts where both libraries' character tables are known to agree go to the
tokenizers library. Either way the ids are those of the whole text. Words that
the texts of a batch share are encoded once; nothing outlives a batch.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import leaving, worker_cache

#: Rows and bytes of text that are encoded together and handed to Spark at once.
OUT_ROWS, OUT_BYTES = 1000, 4 << 20
#: A word of more characters makes its text go to the tokenizers library, whose
#: merging of one word does not grow with the square of its length.
LONG_WORD = 1000
#: Stand for the end of a word, the gap between parts, and a part without a
#: space before it; texts that hold them are encoded by the library.
END_OF_WORD, GAP, FIRST = "\x01", "\x02", "\x03"

# Characters whose classes have not changed for many Unicode versions (fixed
# values): ASCII but for rare controls, Latin, punctuation; and Greek, Cyrillic,
# kana, ideographs and Hangul.
LATIN = "\t-\r -~\xa0-ɏ‐-‧‰-⁞₠-₵"
SCRIPTS = LATIN + "̀-͎΄-ΆΈ-ΊΌΎ-ΡΣ-ϿЀ-ԣぁ-ゖァ-ヺ一-龥가-힣"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level
    vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return out


def _ranked(model: dict) -> tuple[dict[bytes, int], np.ndarray] | None:
    """The vocabulary as ranked byte strings and the id of each rank, or None
    if merging by rank of the result could differ from merging by pairs."""
    from tokenizers import models

    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    vocab, suffix, symbols = model["vocab"], model.get("end_of_word_suffix") or "", byte_symbols()
    back = {s: b for b, s in symbols.items()}
    end = symbols[ord(END_OF_WORD)]
    spelled = lambda t: t[: -len(suffix)] + end if suffix and t.endswith(suffix) else t
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = [(s, end) for s in back] if suffix else []
    pairs += [(spelled(a), spelled(b)) for a, b in merges]
    rank = {s: k for k, s in enumerate(back)}
    for k, (a, b) in enumerate(pairs, len(rank)):
        if a + b in rank or a not in rank or b not in rank:
            return None  # made twice, or of parts that come later
        rank[a + b] = k
    ids = np.full(len(rank), -1, np.int64)
    for token, i in vocab.items():
        if (k := rank.get(spelled(token))) is None:
            return None
        ids[k] = i
    bare = {rank[end]} if suffix else set()  # the mark alone never stays alone
    if any(i < 0 for k, i in enumerate(ids) if k not in bare):
        return None
    merge = models.BPE(vocab=rank, merges=pairs).tokenize
    if any(len(merge(t)) != 1 for t in rank):
        return None
    return {bytes(map(back.__getitem__, t)): k for t, k in rank.items()}, ids


class _Numbered(dict):
    """Numbers what is asked for by first appearance."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class TextEncoder:
    """Ids of texts as unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._safe = re.compile(f"[{SCRIPTS}]*").fullmatch
        self._space = re.compile(r"\s").search
        self.fast = None
        pre, plain = spec["pre_tokenizer"], not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        if not plain or spec["model"]["type"] != "BPE":
            return
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None:
            # the byte-level pattern that the library names use_regex (fixed value)
            self._load(spec["model"], r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
            self._parts, self._spell = self._spaced, self._with_spaces
        elif drops_space(spec):
            pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
            self._find = _compiled(pattern)
            self._latin = re.compile(f"[{LATIN}{GAP}]*").fullmatch
            self._load(spec["model"], rf"[^\s{END_OF_WORD}]+{END_OF_WORD}")
            self._parts, self._spell = str.split, self._marked

    def _load(self, model: dict, pattern: str) -> None:
        import tiktoken

        if (found := _ranked(model)) is not None:
            ranks, ids = found
            # the gap between parts is a token of its own
            core = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={GAP: len(ids)})
            self._ids, self._gap = ids.astype("<u4"), len(ids)
            self.fast = lambda text: np.array(core.encode(text, allowed_special={GAP}, disallowed_special=()), np.int64)

    # byte-level vocabularies: a border lies before a single space between
    # words, and on both sides of a single line break

    def _spaced(self, text: str) -> list[str]:
        """Words with a space before them; those without have a mark instead."""
        if any(s in text for s in ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\xa0")) or text[0] in " \n" or text[-1] in " \n":
            return [FIRST + text]
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = FIRST + words[0]
            out += words
            out.append(FIRST + "\n")
        return out[:-1]

    @staticmethod
    def _with_spaces(parts: list[str]) -> str:
        return GAP.join([p[1:] if p[0] == FIRST else " " + p for p in parts])

    # vocabularies that drop white space: words are independent

    def _marked(self, parts: list[str]) -> str:
        """Normalised words with the mark behind every pre-token."""
        text = f" {GAP} ".join(parts)
        if text.isascii():
            text = text.lower()
        elif self._latin(text):
            text = unicodedata.normalize("NFC", text).lower()
        else:
            text = self.tokenizer.normalizer.normalize_str(text)
        return END_OF_WORD.join([*self._find(text), ""]).replace(GAP + END_OF_WORD, GAP)

    def whole(self, text: str) -> np.ndarray:
        """Ids by the tokenizers library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def is_safe(self, text: str) -> bool:
        """Whether both libraries surely give the same ids, and no special string is in it."""
        if self.fast is None or any(s in text for s in self.special) or not self._safe(text):
            return False
        # a longer word than two strides leaves one of them without a space
        return all(self._space(text, k, k + LONG_WORD) for k in range(0, len(text) - LONG_WORD + 1, LONG_WORD))

    def of(self, text: str) -> np.ndarray:
        return self.many([text], None)[0]

    def many(self, texts: list[str | None], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with ``end_id`` behind it, and how
        many each has. Parts that the texts share are encoded once."""
        parts, sizes, rest = [], np.zeros(len(texts), np.int64), {}
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.is_safe(t):
                found = self._parts(t)
                parts += found
                sizes[i] = len(found)
            else:
                rest[i] = self.whole(t)
        distinct = _Numbered()
        which = np.fromiter(map(distinct.__getitem__, parts), np.int64, len(parts))
        ranks = self.fast(self._spell([*distinct]) + GAP) if distinct else np.zeros(0, np.int64)
        gaps = np.flatnonzero(ranks == self._gap) if distinct else ranks
        first = np.concatenate(([0], gaps[:-1] + 1)) if len(gaps) else gaps
        each = (gaps - first)[which]
        starts = np.concatenate(([0], np.cumsum(each)))
        flat = self._ids[ranks[np.arange(starts[-1]) + np.repeat(first[which] - starts[:-1], each)]] if len(which) else np.zeros(0, "<u4")
        edges = starts[np.concatenate(([0], np.cumsum(sizes)))]
        end, out = np.array([] if end_id is None else [end_id], "<u4"), []
        counts = np.diff(edges)
        for i in range(len(texts)):
            out += (rest[i] if i in rest else flat[edges[i] : edges[i + 1]], end)
        for i, ids in rest.items():
            counts[i] = len(ids)
        return np.concatenate(out) if out else end[:0], counts + len(end)


def _compiled(pattern: str):
    import regex

    return regex.compile(rf"{pattern}|{GAP}").findall


def drops_space(spec: dict) -> bool:
    """Whether words between white space are encoded one by one: only matches
    of a pattern without white space are kept, and the normalizers don't reach
    across it."""
    pre, norm = spec["pre_tokenizer"].get("pretokenizers", []), (spec["normalizer"] or {}).get("normalizers", [])
    return (
        [p["type"] for p in pre] == ["Split", "ByteLevel"]
        and pre[0]["behavior"] == "Removed"
        and pre[0]["invert"]
        and not pre[1]["use_regex"]
        and not pre[1]["add_prefix_space"]
        and [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"]
        and r"[^\s" in pre[0]["pattern"]["Regex"]
    )


def encoder(path: str) -> TextEncoder:
    """One encoder for each file in each worker."""
    return worker_cache(f"encoder {path}", lambda: TextEncoder(path))


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most OUT_ROWS rows and about OUT_BYTES of text."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo = 0
    while lo < len(sizes):
        fit = int(np.searchsorted(np.cumsum(sizes[lo : lo + OUT_ROWS]), OUT_BYTES, "right"))
        yield batch.slice(lo, max(1, fit))
        lo += max(1, fit)


def with_ids(docs: DataFrame, path: str, end_id: int | None, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``text`` replaced by ``out``: the token ids as bytes
    (little-endian unsigned 32-bit), ``end_id`` appended. Null text: empty."""
    fields = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(out, T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, text):
                ids, counts = code.many(part.column(at).to_pylist(), end_id)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32) * 4
                coded = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                cols = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*cols, coded], [*(f.name for f in fields), out])

    return docs.select(*[f.name for f in fields], text).mapInArrow(leaving(encode), schema)
