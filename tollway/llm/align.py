"""Alignment of two tokenizers' tokens of the same texts, by merging their byte ends.

Tokenizer A is a byte-level BPE and reads a space before the text; tokenizer B is a SentencePiece model,
which adds that space itself, so both cover the same bytes.  Byte offsets at which a token of A
and a token of B end cut a text into groups; the tokens of one group are linked.

The merge of A's ends with B's is cut by *merge paths*: a binary search on each of a row of equally spaced
diagonals finds how many ends of either side come before it, so every piece holds the same number
of ends whatever the lengths of the texts are.  Pieces look for common ends on their own; a common end whose
two sides fall into neighbouring pieces is found where the pieces are stitched together.

Both sides' tokens end where a word ends, so no group goes beyond a word.  The ends that are merged are
those of words not met before; the groups and links of a text are those of its words in turn.

Counts of linked id pairs (in how many documents a pair is linked) are added up over blocks of documents
and come back to each block for its own pairs only, so nothing that grows with the corpus is sent to
all tasks, and a pair that every document holds is one row per block.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.llm.common import materialize, slices

#: Ends of both sides in a piece of the merge.
PIECE = 1 << 15
#: Text bytes handled at once, and text bytes of a block of documents.
STEP_BYTES, BLOCK_BYTES = 2 << 20, 12 << 20
#: Words that a task remembers, and the characters, tokens or links that it holds for each of them on average.
REMEMBERED, MEAN = 250_000, 16
#: Words that are given to a tokenizer as one text.
JOINED = 200
#: Groups with more links than this are counted by their distinct ids.
WIDE = 1024
#: A space between two characters that are no white space: neither tokenizer has a token across it.
_SPACE = re.compile(r"(?<=\S) (?=\S)")
MARK = "▁"


# ---- merge paths ----

def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Cuts (i, j) of two sorted arrays where the merge has taken k * piece values; of equal values a's goes first."""

    total = len(a) + len(b)
    d = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # a[mid] is among the first d values if it does not come after b[d - mid - 1]
        first = np.zeros(len(d), dtype=bool)
        first[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)
    return low, d - low


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the values that both hold; a and b rise strictly."""

    i, j = diagonals(a, b, piece)
    in_a, in_b = [], []
    for k in range(len(i) - 1):
        left, right = a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]
        if len(left) and len(right):
            at = np.minimum(np.searchsorted(right, left), len(right) - 1)
            hit = np.flatnonzero(right[at] == left)
            in_a.append(hit + i[k])
            in_b.append(at[hit] + j[k])
    # equal ends whose two sides lie on either side of a cut
    cut = np.flatnonzero((i > 0) & (j < len(b)))
    cut = cut[a[i[cut] - 1] == b[j[cut]]]
    in_a.append(i[cut] - 1)
    in_b.append(j[cut])
    found_a, found_b = np.concatenate(in_a), np.concatenate(in_b)
    order = np.argsort(found_a)
    return found_a[order].astype(np.int64), found_b[order].astype(np.int64)


# ---- the two tokenizers ----

def _byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable Latin-1 as it is, the others from U+0100 on."""

    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(others)}


class Side:
    """Ids of words by one tokenizer, with the bytes of each id."""

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = token_bytes
        self.size = np.array([len(t) for t in token_bytes], dtype=np.int64)
        width = len(str(max(1, len(token_bytes) - 1)))
        text = [str(k).encode() for k in range(len(token_bytes))]
        self.digits = np.frombuffer(b"".join(t.ljust(width) for t in text), dtype=np.uint8).reshape(-1, width)
        self.n_digits = np.array([len(t) for t in text])

    def ids(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError


class ByteLevel(Side):
    """A byte-level BPE of the tokenizers library; special tokens in texts are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        alphabet = _byte_alphabet()
        entries = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        super().__init__([bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in entries])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces(Side):
    """A SentencePiece model that puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        spelled = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace(MARK, " ").encode() for k in range(size)]
        super().__init__(spelled)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


@cache
def tokenizers(a_path: str, b_path: str) -> tuple[Side, Side]:
    return ByteLevel(a_path), Pieces(b_path)


def of_words(words: list[str], sides: tuple[Side, Side]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side the ids of all words, with a space before each, and how many ids each word has.

    A word has no ids where their bytes are others than the word's.  Words without white space at their ends are
    joined to longer texts, which are cut again where a word's bytes end.
    """

    plain = [k for k, w in enumerate(words) if w and w.strip() == w]
    others = sorted(set(range(len(words))).difference(plain))
    parts = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
    texts = [" ".join([words[k] for k in part]) for part in parts]
    raw = [(" " + t).encode() for t in texts]
    length = np.array([len(w.encode()) + 1 for w in words], dtype=np.int64)
    out = []
    for side in sides:
        size, start = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        flat, total, alone = [np.zeros(0, dtype=np.int32)], 0, list(others)
        for part, text, found in zip(parts, raw, side.ids(texts), strict=True):
            ids = np.array(found, dtype=np.int32)
            ends, wanted = np.cumsum(side.size[ids]), np.cumsum(length[part])
            cut = np.searchsorted(ends, wanted) + 1
            if b"".join(map(side.bytes.__getitem__, found)) != text or not np.array_equal(ends[cut - 1], wanted):
                alone += part
                continue
            size[part] = np.diff(cut, prepend=0)
            start[part] = total + cut - size[part]
            flat.append(ids)
            total += len(ids)
        for k, found in zip(alone, side.ids([words[k] for k in alone]), strict=True):
            if b"".join(map(side.bytes.__getitem__, found)) == (" " + words[k]).encode():
                size[k], start[k] = len(found), total
                flat.append(np.array(found, dtype=np.int32))
                total += len(found)
        out.append((np.concatenate(flat)[_runs(start, size)], size))
    return out


def cut_words(text: str) -> list[str]:
    """A text cut at single spaces between other characters."""

    odd = len(" ".join(text.split())) != len(text)  # white space side by side or at an end
    return _SPACE.split(text) if odd else text.split(" ")


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the runs that begin at ``start`` and hold ``size`` entries each, one run after another."""

    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Groups:
    """The groups that both tokenizers' tokens of some texts form, end to end.

    ``doc_a`` and ``doc_b`` are the numbers of tokens up to each text's end, ``group_a`` and ``group_b`` those up to
    each group's end, ``doc_groups`` the groups up to each text's end.
    """

    def __init__(self, tokens: list[tuple[np.ndarray, np.ndarray]], sides: tuple[Side, Side], piece: int = PIECE):
        self.ids = [ids for ids, _ in tokens]
        self.doc_a, self.doc_b = (np.cumsum(size) for _, size in tokens)
        in_a, in_b = common_ends(*(np.cumsum(side.size[ids]) for side, ids in zip(sides, self.ids, strict=True)), piece)
        self.group_a, self.group_b = in_a + 1, in_b + 1
        self.doc_groups = np.searchsorted(self.group_a, self.doc_a, side="right")

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A and of B in each group."""

        return np.diff(self.group_a, prepend=0), np.diff(self.group_b, prepend=0)

    def links(self, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, a * b_size + b, times) of all linked id pairs, summed per document and sorted."""

        of_a, of_b = self.sizes()
        document = np.repeat(np.arange(len(self.doc_groups)), np.diff(self.doc_groups, prepend=0))
        first_a, first_b, many = self.group_a - of_a, self.group_b - of_b, of_a * of_b
        narrow = np.flatnonzero(many <= WIDE)
        n = many[narrow]
        group = np.repeat(narrow, n)
        k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        a = self.ids[0][first_a[group] + k // of_b[group]].astype(np.int64)
        b = self.ids[1][first_b[group] + k % of_b[group]]
        docs, codes, times = [document[group]], [a * b_size + b], [np.ones(len(group), dtype=np.int64)]
        for g in np.flatnonzero(many > WIDE).tolist():
            left, n_left = np.unique(self.ids[0][first_a[g] : self.group_a[g]], return_counts=True)
            right, n_right = np.unique(self.ids[1][first_b[g] : self.group_b[g]], return_counts=True)
            codes.append((left.astype(np.int64)[:, None] * b_size + right[None, :]).ravel())
            times.append((n_left[:, None] * n_right[None, :]).ravel())
            docs.append(np.full(len(codes[-1]), document[g]))
        return _summed(np.concatenate(docs), np.concatenate(codes), np.concatenate(times))

    def group_texts(self, sides: tuple[Side, Side]) -> list[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``, decimal ids in order."""

        of_a, of_b = self.sizes()
        ids_a, ids_b = self.ids
        # A's tokens of a group come first: B's tokens of the groups before, and A's of the groups up to it, stand before them
        at_a = np.arange(len(ids_a)) + np.repeat(self.group_b - of_b, of_a)
        at_b = np.arange(len(ids_b)) + np.repeat(self.group_a, of_b)
        width = max(s.digits.shape[1] for s in sides)
        total = len(ids_a) + len(ids_b)
        letters, size = np.zeros((total, width + 1), dtype=np.uint8), np.zeros(total, dtype=np.int64)
        for at, ids, side in ((at_a, ids_a, sides[0]), (at_b, ids_b, sides[1])):
            letters[at, : side.digits.shape[1]] = side.digits[ids]
            size[at] = side.n_digits[ids]
        mark = np.full(total, ord(","), dtype=np.uint8)
        mark[self.group_a + (self.group_b - of_b) - 1] = ord("|")
        mark[self.group_a + self.group_b - 1] = ord(";")
        letters[np.arange(total), size] = mark
        flat = letters[np.arange(width + 1)[None, :] <= size[:, None]].tobytes()
        ends = np.append(0, np.cumsum(size + 1))[self.doc_a + self.doc_b].tolist()
        return [flat[a : b - 1] if b > a else b"" for a, b in zip([0, *ends], ends, strict=False)]


def _summed(doc: np.ndarray, code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, times) with the times of equal ones added up, sorted."""

    if not len(doc):
        return doc, code, times
    span = int(code.max()) + 1
    key = doc * span + code
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first] // span, key[first] % span, np.add.reduceat(times[order], first)


class Lists:
    """Lists of numbers, end to end in one array for each of some columns."""

    def __init__(self, *kinds: type):
        self.size, self.start = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.columns = [np.zeros(0, dtype=k) for k in kinds]

    def add(self, size: np.ndarray, *columns: np.ndarray) -> None:
        self.start = np.append(self.start, len(self.columns[0]) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.columns = [np.append(old, new.astype(old.dtype)) for old, new in zip(self.columns, columns, strict=True)]

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, ...]:
        """The sizes of some lists, and their columns end to end."""

        size = self.size[numbers]
        at = _runs(self.start[numbers], size)
        return size, *(c[at] for c in self.columns)


class Words:
    """Tokens, groups and links of the words met so far, by the words' numbers.

    When they are too many, those that came again since are kept.  A word that a tokenizer does not give
    back byte by byte has no tokens.
    """

    def __init__(self, sides: tuple[Side, Side]):
        self.sides = sides
        self._begin([])

    def _begin(self, words: list[str]) -> None:
        self.number = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))
        self.characters = sum(map(len, words))
        self.again = np.zeros(len(words), dtype=bool)
        self.ids, self.groups, self.links = [Lists(np.int32), Lists(np.int32)], Lists(np.int32, np.int32), Lists(np.int64, np.int64)
        self.texts: list[bytes] = []

    def _full(self, part: float) -> bool:
        held = max(self.characters, *(len(lists.columns[0]) for lists in (*self.ids, self.links)))
        return max(len(self.texts), held / MEAN) > part * REMEMBERED

    def make_room(self) -> None:
        if not self._full(1):
            return
        kept, words, texts = np.flatnonzero(self.again), list(self.number), self.texts
        old = (*self.ids, self.groups, self.links)
        self._begin([words[k] for k in kept.tolist()])
        for new, lists in zip((*self.ids, self.groups, self.links), old, strict=True):
            new.add(*lists.of(kept))
        self.texts = [texts[k] for k in kept.tolist()]
        if self._full(0.5):
            self._begin([])

    def numbers(self, words: Iterable[str], n: int, piece: int) -> np.ndarray:
        """The numbers of n words; what is not known of them yet is found."""

        before = len(self.texts)
        order = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=n)
        self.again[order[order < before]] = True
        new = list(islice(self.number, before, None))
        if new:
            self._learn(new, piece)
        return order

    def _learn(self, new: list[str], piece: int) -> None:
        tokens = of_words(new, self.sides)
        whole = (tokens[0][1] > 0) & (tokens[1][1] > 0)
        tokens = [(ids[np.repeat(whole, size)], size * whole) for ids, size in tokens]
        found = Groups(tokens, self.sides, piece)
        for lists, (ids, size) in zip(self.ids, tokens, strict=True):
            lists.add(size, ids)
        self.groups.add(np.diff(found.doc_groups, prepend=0), *found.sizes())
        word, code, times = found.links(len(self.sides[1].bytes))
        self.links.add(np.bincount(word, minlength=len(new)), code, times)
        self.texts += found.group_texts(self.sides)
        self.again = np.append(self.again, np.zeros(len(new), dtype=bool))
        self.characters += sum(map(len, new))


class Slice:
    """Tokens, groups and links of some texts, put together from those of their words.

    ``known`` holds the words met so far and is added to.  Texts that are null or empty or that a
    tokenizer does not give back byte by byte have no tokens.
    """

    def __init__(self, texts: list[str | None], sides: tuple[Side, Side], known: dict[tuple[Side, Side], Words], piece: int = PIECE):
        self.known, self.words = known, known.setdefault(sides, Words(sides))
        words = self.words
        words.make_room()
        cut = [cut_words(t) if t else [] for t in texts]
        size = np.array([len(c) for c in cut], dtype=np.int64)
        self.order = words.numbers(chain.from_iterable(cut), int(size.sum()), piece)
        none = words.ids[0].size[self.order] == 0
        if none.any():
            doc = np.repeat(np.arange(len(cut)), size)
            size[doc[none]] = 0
            self.order = self.order[size[doc] > 0]
        self.size = size
        self.doc_a, self.doc_b = (self._ends(lists) for lists in words.ids)
        self.doc_groups = self._ends(words.groups)

    def _ends(self, lists: Lists) -> np.ndarray:
        """Entries in the lists of all words up to each text's end."""

        return np.append(0, np.cumsum(lists.size[self.order]))[np.cumsum(self.size)]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(lists.of(self.order)[1] for lists in self.words.ids)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A and of B up to each group's end."""

        _, of_a, of_b = self.words.groups.of(self.order)
        return np.cumsum(of_a, dtype=np.int64), np.cumsum(of_b, dtype=np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, a * size of B + b, times) of all linked id pairs, summed per document and sorted."""

        size, code, times = self.words.links.of(self.order)
        return _summed(np.repeat(np.repeat(np.arange(len(self.size)), self.size), size), code, times)

    def group_texts(self, sides: tuple[Side, Side]) -> list[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``, decimal ids in order."""

        texts = list(map(self.known[sides].texts.__getitem__, self.order.tolist()))
        ends = np.cumsum(self.size).tolist()
        return [b";".join(texts[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, limit=STEP_BYTES)


def alignments(docs: DataFrame, a_path: str, b_path: str, piece: int = PIECE) -> DataFrame:
    """doc_id, a_ids, b_ids, and per group the numbers of tokens up to its end on either side (group_a, group_b).

    Texts that are null or empty, or that a tokenizer does not give back byte by byte, have empty arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, known = tokenizers(a_path, b_path), {}
        for part in _steps(batches):
            s = Slice(part.column("text").to_pylist(), sides, known, piece)
            nested = lambda values, ends: pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, pa.int32()))
            groups = np.diff(s.doc_groups, prepend=0)
            base = [np.repeat(d - np.diff(d, prepend=0), groups) for d in (s.doc_a, s.doc_b)]
            (a_ids, b_ids), (group_a, group_b) = s.ids(), s.groups()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), nested(a_ids, s.doc_a), nested(b_ids, s.doc_b), nested(group_a - base[0], s.doc_groups), nested(group_b - base[1], s.doc_groups)],
                names=["doc_id", "a_ids", "b_ids", "group_a", "group_b"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>")


# ---- counts of links over the corpus ----

class _Pairs:
    """Numbers of the id pairs of a block, in the order in which they came, and the documents that hold them."""

    def __init__(self):
        self.code = np.zeros(0, dtype=np.int64)  # sorted
        self.number = np.zeros(0, dtype=np.int64)
        self.docs = np.zeros(0, dtype=np.int64)  # by number

    def add(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of codes, each of which stands for one document."""

        distinct, of, n = np.unique(codes, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.code, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.code)
        new[inside] = self.code[at[inside]] != distinct[inside]
        number = np.empty(len(distinct), dtype=np.int64)
        number[~new] = self.number[at[~new]]
        number[new] = len(self.docs) + np.arange(new.sum())
        self.code = np.insert(self.code, at[new], distinct[new])
        self.number = np.insert(self.number, at[new], number[new])
        self.docs = np.append(self.docs, np.zeros(int(new.sum()), dtype=np.int64))
        self.docs[number] += n
        return number[of]


STORED = "local long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>, a array<int>, b array<int>, docs array<long>"
_NAMES = [c.split()[0] for c in STORED.split(", ")]


def _blocks(docs: DataFrame, a_path: str, b_path: str, piece: int, block_bytes: int) -> DataFrame:
    """Per document its sizes, digest and numbered pairs; per block one row with its pairs (``a`` is null in the others)."""

    def lists(values, ends, kind):
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, known = tokenizers(a_path, b_path), {}
        b_size = len(sides[1].bytes)

        def close(block: int, pairs: _Pairs) -> pa.RecordBatch:
            code = np.empty(len(pairs.code), dtype=np.int64)
            code[pairs.number] = pairs.code
            one = lambda values, kind: lists(values, [len(values)], kind)
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *empty, one(code // b_size, pa.int32()), one(code % b_size, pa.int32()), one(pairs.docs, pa.int64())], names=_NAMES)

        block, total, pairs = 0, 0, _Pairs()
        for part in _steps(batches):
            if total > block_bytes:
                yield close(block, pairs)
                block, total, pairs = block + 1, 0, _Pairs()
            total += part.column("text").nbytes
            n = part.num_rows
            s = Slice(part.column("text").to_pylist(), sides, known, piece)
            doc, code, times = s.links()
            ends = np.searchsorted(doc, np.arange(n), side="right")
            summed = np.append(0, np.cumsum(times))[ends]
            digest = [hashlib.sha256(t).hexdigest() if t else "" for t in s.group_texts(sides)]
            counts = [pa.array(np.diff(x, prepend=0), pa.int64()) for x in (s.doc_a, s.doc_b, s.doc_groups, summed)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, block)), part.column("doc_id"), *counts, pa.array(digest), lists(pairs.add(code), ends, pa.int32()), lists(times, ends, pa.int64()),
                pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64())),
            ], names=_NAMES)
        if total:
            yield close(block, pairs)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = rows.mapInArrow(run, STORED)
    return stored.select((F.spark_partition_id().cast("long") * (1 << 24) + F.col("local")).alias("block"), *_NAMES[1:])


def pair_counts(numbered: DataFrame) -> DataFrame:
    """(a, b, n, best): documents that hold a pair linked, and whether no pair of the same a has more."""

    counts = numbered.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _sums(docs: pa.Table, values: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents, from the values of its pairs."""

    count = np.zeros(values.num_rows, dtype=np.int64)
    best = np.zeros(values.num_rows, dtype=bool)
    at = values.column("at").to_numpy()
    count[at] = values.column("n").to_numpy()
    best[at] = values.column("best").to_numpy(zero_copy_only=False)
    pairs, times = docs.column("pairs").combine_chunks(), docs.column("times").combine_chunks()
    ends = np.cumsum(pairs.value_lengths().to_numpy())
    pairs, times = pairs.flatten().to_numpy(), times.flatten().to_numpy()
    sums = [np.diff(np.append(0, np.cumsum(x))[ends], prepend=0) for x in (times * best[pairs], times * count[pairs])]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([*(docs.column(c) for c in names), *(pa.array(x, pa.int64()) for x in sums), docs.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])


def scores(docs: DataFrame, a_path: str, b_path: str, piece: int = PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Texts that are null or empty, or that a tokenizer does not give back byte by byte (those that hold
    U+2581 themselves), have zeros and an empty digest.  Rows with equal ids or texts are rows of
    their own and count one by one; a null doc_id stays null; ties for the best pair all count; further columns
    are not read; no rows give none.  A very long text is encoded word by word; only a single
    word of it is ever given to a tokenizer in one piece.
    """

    stored = materialize(_blocks(docs, a_path, b_path, piece, block_bytes), "aligned")
    exploded = stored.filter("a is not null").select("block", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("at", "p"))
    numbered = materialize(exploded.select("block", "at", "p.a", "p.b", "p.docs"), "pairs")
    values = numbered.select("block", "at", "a", "b").join(pair_counts(numbered), ["a", "b"]).select("block", "at", "n", "best")
    rows = stored.filter("a is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_sums, schema)
