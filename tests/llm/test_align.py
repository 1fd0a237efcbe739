import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from odd import documents, odd_documents, rows_of, with_clashes
from public_tokenizers import path
from tokenizers import Tokenizer

from tollway.llm import align, queries

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_groups(libraries, text):
    """Groups (ids of A, ids of B) of a whole text, end by end."""

    a, b = libraries
    if not text:
        return []
    alphabet = align._byte_alphabet()
    left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    if b"".join(t for _, t in left) != whole or b"".join(t for _, t in right) != whole:
        return []
    groups, i, j, at_a, at_b = [], 0, 0, 0, 0
    while i < len(left):
        one, other = [left[i][0]], [right[j][0]]
        at_a, at_b = at_a + len(left[i][1]), at_b + len(right[j][1])
        i, j = i + 1, j + 1
        while at_a != at_b:
            if at_a < at_b:
                one.append(left[i][0])
                at_a, i = at_a + len(left[i][1]), i + 1
            else:
                other.append(right[j][0])
                at_b, j = at_b + len(right[j][1]), j + 1
        groups.append((one, other))
    return groups


def plain_scores(libraries, rows):
    cut = [(doc_id, plain_groups(libraries, text)) for doc_id, text in rows]
    links = [Counter((x, y) for one, other in groups for x in one for y in other) for _, groups in cut]
    held = Counter(p for c in links for p in c)
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for (doc_id, groups), c in zip(cut, links, strict=True):
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, other)) for one, other in groups)
        best = sum(n for (x, y), n in c.items() if held[x, y] == top[x])
        out.append((doc_id, sum(len(o) for o, _ in groups), sum(len(o) for _, o in groups), len(groups), sum(c.values()), best,
                    sum(n * held[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


ODD = [
    "a  b   c", " x", "x ", "\n x\n\ny \n z", "a b   c", "<|endoftext|> <s> </s><unk>", "▁ mark", "日本語 テキスト 한국어", "👩‍👩‍👧 🏽", "a\x1c b \x1f c", "é é ﬁ", "don't I'll we've",
    "1234567 89", "​ ﻿ 　", "tab\tand\r\nline", "   ", "a \x00 b", "x" * 300, "ab" * 2000, "퟿ \U0010ffff",
]


def test_merge_paths_find_every_common_end():
    rng = np.random.default_rng(5)
    for piece in (1, 2, 3, 7, 64):
        for _ in range(40):
            a = np.unique(rng.integers(1, 60, rng.integers(0, 50)))
            b = np.unique(rng.integers(1, 60, rng.integers(0, 50)))
            i, j = align.common_ends(a, b, piece)
            assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()
            cut_a, cut_b = align.diagonals(a, b, piece)
            assert (np.diff(cut_a + cut_b)[:-1] == piece).all() and cut_a[-1] == len(a) and cut_b[-1] == len(b)


def test_words_equal_whole_texts(libraries):
    sides, known = align.tokenizers(A, B), {}
    s = align.Slice(ODD, sides, known, 5)
    texts = s.group_texts(sides)
    for text, found in zip(ODD, texts, strict=True):
        wanted = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, other)) for one, other in plain_groups(libraries, text))
        assert found.decode() == wanted, text


def test_only_ends_of_new_words_are_merged(monkeypatch):
    merged = []
    common = align.common_ends
    monkeypatch.setattr(align, "common_ends", lambda a, b, *piece: merged.append(len(a) + len(b)) or common(a, b, *piece))
    sides, known = align.tokenizers(A, B), {}
    texts = ["one word and one more word"] * 50
    first = align.Slice(texts, sides, known).group_texts(sides)
    # "one", "word", "and" and "more" are one token or two on either side
    assert 0 < sum(merged) <= 16
    assert align.Slice([*texts, "more and more"], sides, known).group_texts(sides)[:50] == first
    assert sum(merged) <= 16


@pytest.mark.parametrize("remembered", [1, 4, 12, 40])
def test_words_that_come_again_are_kept_when_room_is_made(libraries, monkeypatch, remembered):
    monkeypatch.setattr(align, "REMEMBERED", remembered)
    sides, known = align.tokenizers(A, B), {}
    for k in range(12):
        texts = [f"the unhappiness of number{k} thththth", *ODD[k : k + 3], None, "", f"▁ the {k}", "x" * 40 * k]
        s = align.Slice(texts, sides, known, 5)
        wanted = [plain_groups(libraries, text) for text in texts]
        assert s.group_texts(sides) == [";".join(",".join(map(str, one)) + "|" + ",".join(map(str, other)) for one, other in groups).encode() for groups in wanted]
        held = [Counter(x * len(sides[1].bytes) + y for one, other in groups for x in one for y in other) for groups in wanted]
        assert list(zip(*(x.tolist() for x in s.links()), strict=True)) == [(d, c, n) for d, links in enumerate(held) for c, n in sorted(links.items())]
        if remembered == 40:
            assert k < 2 or known[sides].again[known[sides].number["the"]]


def test_texts_are_cut_at_single_spaces_only():
    rng = np.random.default_rng(7)
    odd, single = re.compile(r"\s\s|\A\s|\s\Z"), re.compile(r"(?<=\S) (?=\S)")
    for _ in range(3000):
        text = "".join(rng.choice(list("ab \n\t\x1c\x85\u3000\u200b"), rng.integers(1, 9), p=[0.3, 0.2, 0.3, *[0.2 / 6] * 6]))
        assert align.cut_words(text) == (single.split(text) if odd.search(text) else text.split(" ")) == single.split(text)


def test_whole_table_equals_a_plain_run(spark, sf_dir, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.QUERIES["op12_merge_path_alignment"](spark, sf_dir)) == plain_scores(libraries, rows)


@pytest.mark.parametrize("remembered", [align.REMEMBERED, 20])
def test_small_pieces_and_blocks_change_nothing(spark, libraries, monkeypatch, remembered):
    monkeypatch.setattr(align, "STEP_BYTES", 50)
    monkeypatch.setattr(align, "REMEMBERED", remembered)
    docs = documents(spark, [*ODD, *ODD, None, ""]).repartition(2)
    found = align.scores(docs, A, B, piece=7, block_bytes=120)
    assert rows_of(found) == plain_scores(libraries, [(r.doc_id, r.text) for r in docs.collect()])


def test_wide_groups_are_counted_in_full(spark, libraries, monkeypatch):
    monkeypatch.setattr(align, "WIDE", 1)
    docs = documents(spark, ODD)
    assert rows_of(align.scores(docs, A, B)) == plain_scores(libraries, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_and_empty_tables(spark, libraries):
    docs = odd_documents(spark)
    found = rows_of(align.scores(with_clashes(docs), A, B))
    assert found == plain_scores(libraries, [(r.doc_id, r.text) for r in docs.collect()])
    assert align.scores(docs.limit(0), A, B).count() == 0


def test_alignments_hold_ids_and_groups(spark, libraries):
    docs = documents(spark, [*ODD, None])
    for row in align.alignments(docs, A, B, piece=3).collect():
        groups = plain_groups(libraries, [*ODD, None][row.doc_id])
        cut_a, cut_b = [0, *row.group_a], [0, *row.group_b]
        found = [(row.a_ids[cut_a[k] : cut_a[k + 1]], row.b_ids[cut_b[k] : cut_b[k + 1]]) for k in range(len(row.group_a))]
        assert found == groups


def test_a_very_long_text(spark, libraries):
    text = "straße and über " * 20_000 + "x" * 50_000
    docs = documents(spark, [text])
    assert rows_of(align.scores(docs, A, B)) == plain_scores(libraries, [(0, text)])
