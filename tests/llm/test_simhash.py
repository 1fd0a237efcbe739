import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, odd_documents, rows_of, with_clashes

from tollway.llm import graph, queries, simhash


def print_by_hand(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def clusters_by_hand(rows, radius=4, groups=False):
    prints = [print_by_hand(t) for _, t in rows]
    label = {p: p for p in prints}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    distinct = sorted(label)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    if groups:
        return {find(p) for p in prints}
    least = {}
    for (d, _), p in zip(rows, prints):
        r = find(p)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return sorted(((d, f"{p:016x}", least[find(p)]) for (d, _), p in zip(rows, prints)), key=repr)


def test_whole_table_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.QUERIES["op9_simhash_tiles"](spark, sf_dir)) == clusters_by_hand(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    want = clusters_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(simhash.clusters(docs)) == want
    assert rows_of(simhash.clusters(with_clashes(docs))) == want
    assert simhash.clusters(docs.limit(0)).count() == 0
    kept = simhash.drop_near_copies(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    assert kept.count() == len(clusters_by_hand([(r.doc_id, r.text) for r in docs.collect()], groups=True))  # two groups have least id 5
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(300))
    docs = documents(spark, [base + " tail", base + " tail", base, "something else entirely here", base.replace("w7 ", "v7 ")])
    got = simhash.clusters(docs).collect()
    groups = {r.component_id for r in got}
    kept = simhash.drop_near_copies(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(groups)
    twice = docs.unionByName(docs)
    assert sorted(r.doc_id for r in simhash.drop_near_copies(twice).collect()) == sorted(groups)


def connected(nodes, pairs):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def near_prints(rng, n):
    base = rng.integers(0, 2**63, size=max(1, n // 12), dtype=np.uint64)
    out = rng.choice(base, size=n)
    for _ in range(4):
        flip = rng.random(n) < 0.7
        out = np.where(flip, out ^ (np.uint64(1) << rng.integers(0, 64, size=n).astype(np.uint64)), out)
    return np.unique(out)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.sampled_from([3, 16, 256]))
def test_tiles_connect_what_all_pairs_connect(seed, n, part):
    fps = near_prints(np.random.default_rng(seed), n)
    u, v = simhash.tile_links(fps.view(np.int64), 4, part)
    pairs = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 4]
    got = [(int(a), int(b)) for a, b in zip(u.view(np.uint64), v.view(np.uint64))]
    assert connected(map(int, fps), pairs) == connected(map(int, fps), got)
    assert len(got) < max(1, len(fps))


def test_dense_groups_of_a_tile():
    rng = np.random.default_rng(8)
    pairs_of_bits = [(a, b) for a in range(40) for b in range(a)]
    dense = np.unique(np.array([np.uint64(2**63) ^ np.uint64((1 << a) | (1 << b)) for a, b in pairs_of_bits] + list(rng.integers(0, 2**63, size=300, dtype=np.uint64)), dtype=np.uint64))
    for part in (8, 64, 256):
        u, v = simhash.tile_links(dense.view(np.int64), 4, part)
        pairs = [(int(a), int(b)) for i, a in enumerate(dense) for b in dense[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 4]
        got = [(int(a), int(b)) for a, b in zip(u.view(np.uint64), v.view(np.uint64))]
        assert len(got) < len(dense)
        label = {int(n): int(n) for n in dense}

        def find(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        def groups(links, label=label):
            label.update({int(n): int(n) for n in dense})
            for a, b in links:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
            return {n: find(n) for n in label}

        assert groups(pairs) == groups(got)


def test_split_band_values_find_every_link(spark):
    rng = np.random.default_rng(5)
    fps = near_prints(rng, 900)
    shared = np.unique((fps & ~np.uint64(0xFFF)) | np.uint64(0x123))  # all agree in the first band
    frame = spark.createDataFrame([(int(x),) for x in shared.view(np.int64)], "fp long")
    want = {(r.fp, r.root) for r in simhash.groups(frame, tile=100_000).collect()}
    assert {(r.fp, r.root) for r in simhash.groups(frame, tile=20).collect()} == want and want
    nodes = [int(x) for x in shared.view(np.int64)]
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    label = connected(nodes, pairs)
    assert {(a, label[a]) for p in pairs for a in p} == want


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 199), (199, 200), (-5, -9)]
    rng = np.random.default_rng(1)
    links += [(int(a), int(b)) for a, b in rng.integers(1000, 1200, size=(150, 2))]
    want = connected({n for p in links if p[0] != p[1] for n in p}, links)
    got = graph.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
