from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from framewright import storage
from framewright.llm import block_naming, simhash
from framewright.llm.components import components

SCHEMA = "doc_id long, text string, fp string"


def plain_fingerprint(text, words):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    tokens = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def clustered(rng, n):
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 12))]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprint_as_the_rule_says():
    for text in ["", " \n", "One", "one two", "A b C", "a b c d e f a b c", "É é x\x1cy z w", "x " * 300 + "y"]:
        for words in (3, 5):
            assert simhash.fingerprint(text, words) == plain_fingerprint(text, words)


def test_tree_search_finds_what_a_scan_finds():
    rng = random.Random(2)
    points = np.array(clustered(rng, 400), "u8")
    rng.shuffle(points)
    tree = simhash.BKTree(points)
    queries = np.concatenate([points[:150], np.array([rng.getrandbits(64) for _ in range(50)], "u8")])
    got = {(int(q), int(p)) for who, node in tree.search(queries, 3) for q, p in zip(who, node)}
    near = np.bitwise_count(queries[:, None] ^ points[None, :]) <= 3
    assert got == {(int(q), int(p)) for q, p in np.argwhere(near)}


def test_tree_follows_only_edges_within_the_radius():
    rng = random.Random(4)
    points = np.array([rng.getrandbits(64) for _ in range(3000)], "u8")
    seen = 0
    tree = simhash.BKTree(points)
    original = np.bitwise_count

    def counted(x):
        nonlocal seen
        seen += len(x)
        return original(x)

    try:
        np.bitwise_count = counted
        list(tree.search(points[:50], 1))
    finally:
        np.bitwise_count = original
    assert seen < 50 * 3000 / 3


@pytest.mark.parametrize("tree_nodes", [4096, 5])
def test_links_join_what_brute_force_joins(spark, tree_nodes):
    """With trees of five nodes, shards are split over several."""
    rng = random.Random(7)
    fps = clustered(rng, 300) + [0, 1, (1 << 64) - 1]
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(s,) for s in set(signed.values())], "fp long")
    links = simhash.shard_links(df, 3, tree_nodes)
    found = {r.node: r.root for r in components(links).collect()}
    want = plain_components({s: f for f, s in signed.items()}, 3)
    assert {s: found.get(s, s) for s in want} == want


def test_cells_broken_off_by_batches():
    rows = pa.table({"band": [0] * 3, "bits": [1] * 3, "tree": [0] * 3, "chunk": [0] * 3, "fp": [1, 3, 7], "in_tree": [True] * 3})
    got = simhash.cell_links(rows, simhash.cell_starts(rows, ["band", "bits", "tree", "chunk"]), 1)
    assert {tuple(sorted(x)) for x in zip(*(c.to_pylist() for c in got.columns))} == {(1, 3), (3, 7)}


def test_query_against_brute_force(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(200)) for _ in range(8)]
    rows = [(i, base[i % 8] + f" {'tail ' * (i // 16)}") for i in range(80)]
    rows += [(100, None), (101, ""), (102, "one"), (103, "ONE"), (104, "x y z " * 5000), (7, base[0]), (None, "no id here at all")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    out = simhash.near_duplicates(docs, 3, 3).collect()
    fps = {}
    for d, t in rows:
        fps.setdefault(plain_fingerprint(t or "", 3), []).append(d)
    least = {f: min((d for d in ds if d is not None), default=None) for f, ds in fps.items()}
    roots = plain_components({f: f for f in fps}, 3)
    ids = {}
    for f, root in roots.items():
        ids[root] = min((x for x in (ids.get(root), least[f]) if x is not None), default=None)
    want = [(d, f"{f:016x}", ids[roots[f]]) for f, ds in fps.items() for d in ds]
    assert sorted([tuple(r) for r in out], key=str) == sorted(want, key=str)


def test_chains_and_empty_tables(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {(r.node, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def edited(rng, words, many):
    places = set(rng.sample(range(len(words)), many))
    return [rng.choice("klmnop") * 4 if k in places else w for k, w in enumerate(words)]


@pytest.mark.parametrize("chunk", [256, 6])
def test_similar_texts_leave_one(spark, chunk):
    """Copies with three words of 300 changed (about 0.9) go; rewritten ones and others stay."""
    rng = random.Random(13)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(300)] for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(10 + i, " ".join(edited(rng, base[i % 6], 3))) for i in range(40)]
    rows += [(60 + i, " ".join(edited(rng, base[i % 6], 90))) for i in range(6)]
    rows += [(80, None), (81, ""), (82, "short one"), (83, "other one"), (2, rows[2][1]), (None, "no id")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    out = simhash.drop_similar(docs, chunk=chunk)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id for r in out.collect()), key=str)
    assert kept == sorted([0, 1, 2, 3, 4, 5, 60, 61, 62, 63, 64, 65, 80, 82, 83, None], key=str)


def test_repeated_lines_do_not_part_near_copies(spark):
    """The same shingle sets but for a few: a line that stands there thirty times more changes counts alone."""
    rng = random.Random(17)
    rows = []
    for i in range(12):
        words = [rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(204)]
        rows += [(i, " ".join(words)), (100 + i, " ".join(words + words[50:69] * 30))]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    found = simhash.sketches(docs, 5).collect()
    fps = {r.doc_id: r.fp % (1 << 64) for r in found}
    assert all((fps[i] ^ fps[100 + i]).bit_count() <= simhash.WIDE_RADIUS for i in range(12))
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == list(range(12))


def test_no_pair_is_lost_at_the_threshold(spark):
    """Short pairs (4 of 5 shingles, also under a radius of nothing) and long ones at 0.8 and just below it."""
    rng = random.Random(19)
    word = lambda: f"{rng.choice('abcdefgh') * rng.randint(1, 4)}{rng.randint(0, 10**6)}"
    rows, want = [], []
    for i in range(150):
        words = [word() for _ in range(9)]
        rows += [(i, " ".join(words[:8])), (1000 + i, " ".join(words))]
        want.append(i)
    for k, n in enumerate((4000, 4001, 8000, 5000, 5001, 9000)):  # a text that is cut to 4/5 of the shingles, or to one fewer
        words = [word() for _ in range(n + 4)]
        least = -(-4 * n // 5)
        rows += [(5000 + k, " ".join(words)), (6000 + k, " ".join(words[: least + 4])), (7000 + k, " ".join(words[n - least + 1 :]))]
        want += [5000 + k, 7000 + k]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == sorted(want)
    assert sorted(r.doc_id for r in simhash.drop_similar(docs, radius=0).collect()) == sorted(want)


def test_columns_that_clash_with_names_in_use(spark):
    schema = "doc_id long, text string, gone_doc int, Gone_Hash int, node long, root long, keys string"
    line = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(2, line, 1, 2, 3, 4, "k"), (1, line + " ", 5, 6, 7, 8, "l"), (3, "other words", 9, 9, 9, 9, None)], schema)
    out = simhash.drop_similar(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == [(1, line + " ", 5, 6, 7, 8, "l"), (3, "other words", 9, 9, 9, 9, None)]


def test_common_passages_do_not_link(spark):
    """Texts of which most words are one passage, but fewer than 0.8 of their shingles, stay; those with more go."""
    rng = random.Random(23)
    word = lambda: f"{rng.choice('abcdefgh') * rng.randint(1, 4)}{rng.randint(0, 10**6)}"
    passage = [word() for _ in range(100)]
    rows = [(i, " ".join(passage + [word() for _ in range(20)])) for i in range(60)]
    rows += [(100 + i, " ".join(passage + [word() for _ in range(5)])) for i in range(5)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    kept = sorted(r.doc_id for r in simhash.drop_similar(docs, chunk=8).collect())
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in rows}
    root = {d: d for d in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert kept == sorted(set(root.values())) and 1 < len(kept) < len(rows)


def test_a_template_makes_few_pairs(spark, monkeypatch):
    """600 texts of 90 shared and 16 own words: no two are alike, and all share their passage; all pairs would be 179,700."""
    rng = random.Random(4)
    shared = [f"common{k}" for k in range(90)]
    rows = []
    for i in range(600):
        at = rng.randrange(91)
        rows.append((i, " ".join([*shared[:at], *[f"own{i}x{k}" for k in range(16)], *shared[at:]])))
    written = {}

    def counted(df, tag, keep=simhash.materialize):
        out = keep(df, tag)
        written[tag] = written.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.drop_similar(docs).count() == 600
    assert written.get("pairs", 0) < 20 * 600, written


@pytest.mark.parametrize("original", [True, False])
def test_a_group_of_copies_makes_few_pairs(spark, monkeypatch, original):
    """400 copies of a text, one to five words changed, of which no tree finds any: each meets the least edited, not all others."""
    rng = random.Random(29)
    base = [rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 9999)) for _ in range(150)]
    edits = [0] * original + [1 + i % 5 for i in range(400)]
    rows = []
    for i, many in enumerate(edits):
        places = rng.sample(range(150), many)
        rows.append((i, " ".join(f"own{i}x{k}" if k in places else w for k, w in enumerate(base))))
    written = {}

    def counted(df, tag, keep=simhash.materialize):
        out = keep(df, tag)
        written[tag] = written.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.drop_similar(docs, radius=0).collect())
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in rows}
    alike = {frozenset((i, j)) for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    root = {d: d for d in sets}
    for _ in sets:
        before = dict(root)
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    assert kept == sorted(set(root.values())) and 1 < len(kept) < len(rows)
    assert written.get("pairs", 0) + written.get("hub-pairs", 0) < 4 * len(rows), (written, len(alike))


def test_pairs_of_unlike_sizes_are_found(spark):
    """Sets of 80 to 100 shingles, one a part of the other, that no tree meets: radius 0."""
    base = [f"w{k}" for k in range(104)]
    rows = [(n, " ".join(base[: n + 4])) for n in (100, 80, 79, 64, 63)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for r in simhash.similar_groups(docs, radius=0).collect():
        groups.setdefault(r.keep_id, set()).add(r.doc_id)
    want = {n: {n} for n, _ in rows}
    for a in want:
        for b in list(want):
            if min(a, b) / max(a, b) >= 0.8:
                union = want[a] | want[b]
                for x in union:
                    want[x] = union
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in {frozenset(g) for g in want.values()})


def test_scratch_tables_go_when_the_rows_are_found(spark, monkeypatch, tmp_path):
    """What is left is the list of rows that go: of a pipeline's stages, the later ones had the disk of all before them."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, "others"), (4, "others")], "doc_id long, text string")
    for stage, kept in ((block_naming.drop_exact_duplicates, [1, 2, 4]), (simhash.drop_similar, [1, 3])):
        out = stage(docs)
        left = [p.name.split("-")[1] for p in tmp_path.iterdir()]
        assert left == ["gone"] * (1 + (stage is simhash.drop_similar)), left
        assert sorted(r.doc_id for r in out.collect()) == kept


def test_sketches_of_long_texts_tell_them_apart():
    """5,000 shingles each, a third of them shared: 1,024 bits are full, wider ones are not; folded, they never exceed what differs."""
    rng = np.random.default_rng(3)
    x, y = (np.unique(rng.integers(0, 1 << 63, 5000, "u8")) for _ in range(2))
    y[:1700] = x[:1700]
    most = 10000 * (1 - simhash.SIMILARITY) / (1 + simhash.SIMILARITY)
    wide = simhash.parity_distance(simhash.parity_sketch(x), simhash.parity_sketch(y))
    assert most < wide <= len(set(x.tolist()) ^ set(y.tolist()))
    for n in (0, 1, 600, 3000):
        part = simhash.parity_sketch(x[:n])
        assert simhash.parity_distance(part, simhash.parity_sketch(x)) <= len(x) - n
        assert simhash.parity_distance(part, part) == 0


def test_rare_shingles_are_told_from_those_of_some_texts(spark):
    """600,000 shingles that stand once: where buckets are few, such noise hides one that stands in some texts."""
    rng = np.random.default_rng(5)
    rows = [(rng.integers(-(1 << 63), 1 << 63, 2000).tolist(),) for _ in range(300)]
    hashes = np.array([h for (r,) in rows for h in r]).view("u8")
    counts = simhash.bucket_counts(spark.createDataFrame(rows, "hashes array<long>"))
    assert (counts == np.bincount((hashes >> np.uint64(64 - simhash.RANK_BITS)).astype("i8"), minlength=1 << simhash.RANK_BITS)).all()
    assert counts.max() < 8
