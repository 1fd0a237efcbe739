"""Byte-pair encoding and decoding with a contiguous rank array per word.

A short word is a row of two matrices: the ids of its parts, and the merge rank of each pair of
neighbours.  All new words of a slice are merged together: find the least rank of each row, delete
that boundary, look up the two ranks beside it, and repeat until no row has a pair left.  Words that
are longer than ``SHORT`` bytes take the same merges in the same order, one word at a time, from a heap.

The vocabulary file's path is a parameter; nothing is copied from it into this repository.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tollway.llm.common import map_slices

#: Bytes of a word that is merged in the matrix; longer ones are merged alone.
SHORT = 24
#: Pieces of text whose ids a task remembers, beyond that it starts afresh; and the longest that it remembers.
REMEMBERED, LONGEST = 400_000, 256
NO_RANK = np.int32(2**31 - 1)
_ODD_BLANK = regex.compile(r"[\x1c-\x1f]")
_BLANK = regex.compile(r"\s+")


def byte_symbols() -> list[str]:
    """The printable character by which a byte-level vocabulary spells each byte."""

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {b: chr(b) for b in shown}
    symbols |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in symbols)}
    return [symbols[b] for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["byte_fallback"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path}: only plain BPE with word ends is read")
        ids = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.tokens = [""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in ids.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        pairs = np.array([[ids[a], ids[b], ids[a + b]] for a, b in merges], dtype=np.int64)
        self.span = len(self.tokens)
        code = pairs[:, 0] * self.span + pairs[:, 1]
        order = np.argsort(code, kind="stable")
        self.codes = code[order]
        self.ranks = order.astype(np.int32)
        self.merged = pairs[:, 2].astype(np.int32)
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], dtype=np.int32)
        self.last = np.array([ids[s + end] for s in symbols], dtype=np.int32)
        self.lookup = {int(c): (int(r), int(self.merged[r])) for c, r in zip(self.codes, self.ranks, strict=True)}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.cut = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of neighbours; NO_RANK where the pair does not merge."""

        code = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NO_RANK)

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Ids of short words, all merged in one matrix."""

        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = int(sizes.max())
        raw = np.zeros((len(words), width), dtype=np.uint8)
        raw[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
        part = self.inner[raw]
        row = np.arange(len(words))
        part[row, sizes - 1] = self.last[raw[row, sizes - 1]]
        live = np.arange(width - 1) < (sizes - 1)[:, None]
        rank = np.full((len(words), max(width - 1, 1)), NO_RANK, dtype=np.int32)
        if width > 1:
            rank[live] = self.pair_ranks(part[:, :-1][live], part[:, 1:][live])
        count = sizes.copy()
        out: list[list[int]] = [[]] * len(words)
        place = np.arange(width)
        while True:
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(rank)), at]
            done = least == NO_RANK
            if done.any():
                for i, ids, n in zip(row[done].tolist(), part[done].tolist(), count[done].tolist(), strict=True):
                    out[i] = ids[:n]
                going = ~done
                row, part, rank, count, at, least = row[going], part[going], rank[going], count[going], at[going], least[going]
            if not len(row):
                return out
            # delete the boundary after part `at`: everything behind it moves one place to the left
            line = np.arange(len(row))
            moved = place[:-1] > at[:, None]
            part[:, :-1] = np.where(moved, part[:, 1:], part[:, :-1])
            part[line, at] = self.merged[least]
            if rank.shape[1] > 1:
                rank[:, :-1] = np.where(place[: rank.shape[1] - 1] >= at[:, None], rank[:, 1:], rank[:, :-1])
            rank[line, np.minimum(count - 2, rank.shape[1] - 1)] = NO_RANK
            count -= 1
            for side in (at - 1, at):
                ok = (side >= 0) & (side < count - 1)
                rank[line[ok], side[ok]] = self.pair_ranks(part[line[ok], side[ok]], part[line[ok], side[ok] + 1])
            width = int(count.max())
            part, place = part[:, :width], place[:width]
            rank = rank[:, : max(width - 1, 1)]

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one long word: the least rank, leftmost first, comes from a heap instead of a scan, so n bytes take n log n steps."""

        raw = np.frombuffer(word, dtype=np.uint8)
        parts = self.inner[raw]
        parts[-1] = self.last[raw[-1]]
        rank = self.pair_ranks(parts[:-1], parts[1:]).tolist() + [int(NO_RANK)]
        n, none = len(word), int(NO_RANK)
        part, before, after = parts.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i, r in enumerate(rank) if r != none]
        heapify(heap)
        while heap:
            least, at = heappop(heap)
            if rank[at] != least:  # the pair has changed, or its part is gone
                continue
            gone = after[at]
            part[at], after[at], rank[gone] = int(self.merged[least]), after[gone], none
            part[gone] = -1
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left < 0:
                    continue
                right = after[left]
                rank[left] = self.lookup.get(part[left] * self.span + part[right], (none, -1))[0] if right < n else none
                if rank[left] != none:
                    heappush(heap, (rank[left], left))
        return [p for p in part if p >= 0]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        for start in range(0, len(short), 65536):
            some = short[start : start + 65536]
            for i, ids in zip(some, self.merge_short([words[i] for i in some]), strict=True):
                out[i] = ids
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self.merge_long(w)
        return out

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter (no rule for a final sigma)."""

        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words_of(self, piece: str) -> list[bytes | int]:
        """Words of a piece without blanks; a special token stands as its id."""

        out: list[bytes | int] = []
        for part in self.cut.split(piece) if "<|" in piece else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [w.encode() for w in self.split.findall(self.normal(part))]
        return out

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece; equal words are merged once."""

        cut = [self.words_of(p) for p in pieces]
        new = list({w for ws in cut for w in ws if isinstance(w, bytes)})
        ids = dict(zip(new, self.merge(new), strict=True))
        out = []
        for ws in cut:
            one: list[int] = []
            for w in ws:
                if isinstance(w, int):
                    one.append(w)
                else:
                    one += ids[w]
            out.append(one)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as a tokenizer without a decoder gives them back."""

        return " ".join([self.tokens[i] for i in ids])


def pieces(text: str | None) -> list[str]:
    """A text cut at white space, which the vocabulary drops; no merge and no composition crosses it."""

    if not text:
        return []
    # split() and strip() also drop U+001C to U+001F, which the pattern keeps
    return [p for p in _BLANK.split(text) if p] if _ODD_BLANK.search(text) else text.split()


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _forget(known: dict, new: list[str]) -> None:
    """Long pieces are not kept, so that what a task remembers is bounded in bytes."""

    for piece in new:
        if len(piece) > LONGEST:
            del known[piece]


def _encoder(path: str):
    def start():
        vocab = vocabulary(path)
        known: dict[str, tuple[str, str, int]] = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut = [pieces(t) for t in batch.column("text").to_pylist()]
            new = set().union(*cut).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set().union(*cut)
            new = list(new)
            for piece, ids in zip(new, vocab.encode_pieces(new), strict=True):
                known[piece] = (" ".join(map(str, ids)), vocab.decode(ids), len(ids))
            n, ids_digest, text_digest = [], [], []
            for ps in cut:
                found = [known[p] for p in ps]
                n.append(sum([f[2] for f in found]))
                ids_digest.append(hashlib.sha256(" ".join([f[0] for f in found if f[2]]).encode()).hexdigest())
                text_digest.append(hashlib.sha256(" ".join([f[1] for f in found if f[2]]).encode()).hexdigest())
            _forget(known, new)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_digest), pa.array(text_digest)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return work

    return start


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every text, decodes the ids again and returns one row of digests per document.

    Null and empty texts have no tokens; both digests are then those of nothing.  Rows with equal
    ids are separate rows, a null ``doc_id`` stays null, further columns are not read; no rows give none.  One
    narrow pass without a shuffle; a task remembers at most ``REMEMBERED`` pieces of ``LONGEST`` characters.  A very
    long text, or a very long word without a blank, takes n log n steps.
    """

    return map_slices(docs.select("doc_id", "text"), None, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _encoder(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and token ids (array of int) of every text; null and empty texts have an empty array."""

    def start():
        vocab = vocabulary(path)
        known: dict[str, np.ndarray] = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut = [pieces(t) for t in batch.column("text").to_pylist()]
            new = set().union(*cut).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set().union(*cut)
            new = list(new)
            for piece, ids in zip(new, vocab.encode_pieces(new), strict=True):
                known[piece] = np.array(ids, dtype="<i4").tobytes()
            flat = [b"".join([known[p] for p in ps]) for ps in cut]
            _forget(known, new)
            ends = np.cumsum([0, *(len(b) // 4 for b in flat)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), dtype="<i4")))
            return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids], names=["doc_id", "ids"])

        return work

    return map_slices(docs.select("doc_id", "text"), None, "doc_id long, ids array<int>", start)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of rows (doc_id, ids); null ids decode to the empty text."""

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
