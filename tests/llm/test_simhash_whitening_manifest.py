import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hireloom.llm import merkle, simhash, whitening
from hireloom.llm.merkle import merkle_manifest
from hireloom.llm.shared import new_folder
from hireloom.llm.simhash import fingerprints, hamming_links, pivots, simhash_dedup
from hireloom.llm.whitening import fit, scatter, whiten

WORD = re.compile("[^\x20\x09-\x0d]+")


def key(row):
    return repr(row)


def brute_fingerprint(text, shingle=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = WORD.findall(lowered)
    parts = [ws[i : i + shingle] for i in range(len(ws) - shingle + 1)] if len(ws) >= shingle else [ws] * bool(ws)
    hs = [xxhash.xxh64(" ".join(p).encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(nodes, radius, more=()):
    """Least member of the component of each node, by comparing all pairs; ``more`` pairs are links too."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = sorted(nodes)
    near = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= radius]
    for a, b in [*near, *more]:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return {n: top(n) for n in nodes}


def test_fingerprints_equal_the_definition(rows):
    texts = [t for _, t in rows] + ["ÄB Ç x ABC", "a\x0bb\x0cc d  e\tf", " lead", "x " * 9]
    got = fingerprints([t.encode() if t is not None else None for t in texts], 4)
    assert [int(v) for v in got] == [brute_fingerprint(t) for t in texts]


def test_fingerprints_do_not_depend_on_slices(monkeypatch):
    texts = [b"a b c d e f g h i j", None, b"k l m n o p q r", b"x"]
    whole = fingerprints(texts, 2)
    monkeypatch.setattr(simhash, "_SLICE", 3)
    assert (fingerprints(texts, 2) == whole).all()


@pytest.mark.parametrize("bucket_rows,segments", [(2048, None), (16, 5), (16, 7)])
def test_simhash_equals_brute_force(spark, frame, rows, bucket_rows, segments):
    got = simhash_dedup(frame(rows), bucket_rows=bucket_rows, segments=segments).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    # Rows of one id are one document.
    named = [(i, p) for i, p in prints if i is not None]
    top = groups({p for _, p in named}, 4, [(p, q) for i, p in named for j, q in named if i == j])
    least = {}
    for i, p in prints:
        if i is not None:
            least[top[p]] = min(i, least.get(top[p], i))
    want = [(i, f"{p:016x}", None if i is None else least[top[p]]) for i, p in prints]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_rows_of_one_id_join_their_groups(frame):
    words = lambda a: " ".join(f"{a}{n}" for n in range(30))
    got = simhash_dedup(frame([(1, words("a")), (2, words("b")), (3, words("a")), (3, words("b")), (4, words("c"))])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4)]


def test_simhash_of_an_empty_table(frame):
    assert simhash_dedup(frame([])).count() == 0


def test_links_of_a_crowded_ball_are_whole(spark):
    """Many fingerprints near one centre, chains of links, and nodes with no partner; buckets overflow more than once."""
    rnd = random.Random(4)
    flip = lambda x, n: x ^ sum(1 << b for b in rnd.sample(range(64), n))
    centre = rnd.getrandbits(64)
    nodes = {flip(centre, rnd.randint(0, 9)) for _ in range(500)} | {rnd.getrandbits(64) for _ in range(200)}
    chain = rnd.getrandbits(64)
    for _ in range(20):
        chain = flip(chain, 4)
        nodes.add(chain)
    signed = [(n - (1 << 64) if n >> 63 else n,) for n in nodes]
    frame = spark.createDataFrame(signed, "fp long")
    top = groups(nodes, 4)
    for limit in (16, 4096):
        found = hamming_links(frame, new_folder(spark, "ball"), bucket_rows=limit).collect()
        pairs = [(r.a % 2**64, r.b % 2**64) for r in found]
        assert groups(nodes, -1, pairs) == top


def test_coordinates_never_discard_a_link():
    rnd = random.Random(8)
    refs = pivots(32)
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 4)))
        nodes = np.array([a, b], np.uint64)
        table = simhash.distances(nodes, refs).astype(int)
        assert np.abs(table[0] - table[1]).max() <= 4
        parts = [simhash.distances(nodes, refs, m).astype(int) for m in simhash.split(list(range(64)), 6)]
        assert sum(np.abs(p[0] - p[1]).max() for p in parts) <= 4
        assert (sum(parts) == table).all()


def vectors(count=300, width=6, seed=3):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(count, width)) @ rnd.normal(size=(width, width))
    return [(n, [float(np.float32(c)) for c in v]) for n, v in enumerate(base)]


VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, at int, n string"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "v", 3, "n") for i, v in rows], VECTORS).repartition(3)


def test_scatter_is_exact():
    rnd = np.random.default_rng(1)
    for x in (rnd.integers(-300, 300, (130, 5)), rnd.integers(-(2**61), 2**61, (70, 3)), np.full((65, 2), 1_000_007), rnd.integers(0, 2, (1, 4))):
        x = x.astype(np.int64)
        sums, cross = scatter(x)
        rows = x.tolist()
        assert sums == [sum(r[i] for r in rows) for i in range(x.shape[1])]
        assert cross == [[sum(r[i] * r[j] for r in rows) for j in range(x.shape[1])] for i in range(x.shape[1])]


def test_whitening_equals_the_definition(spark):
    rows = vectors()
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (905, [1.0, 2.0])]
    rows += [(None, rows[0][1]), (7, rows[7][1])]
    got = whiten(frame_of(spark, rows + odd), components=4).collect()
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    cov = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(got) == 4 * n and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3, 4}
    expected = sorted((repr(i), sum((n * c - s) ** 2 for c, s in zip(r, sums))) for (i, _), r in zip(rows, x))
    assert sorted((repr(r.vec_id), int(r.deviation)) for r in got if r.component == 1) == expected
    for c in range(4):
        signed = {}
        for r in got:
            if r.component == c + 1:
                assert abs(r.explained - values[c] / values.sum()) < 1e-9
                signed[r.vec_id] = r.whitened
        want = {i: float((np.array([a - s / n for a, s in zip(r, sums)]) @ basis[:, c]) / np.sqrt(values[c])) for (i, _), r in zip(rows, x)}
        sign = np.sign(want[3] * signed[3])
        assert max(abs(sign * signed[i] - want[i]) for i in want) < 1e-6
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_of_flat_and_empty_tables(spark):
    assert whiten(frame_of(spark, [])).count() == 0
    assert whiten(frame_of(spark, [(1, None), (2, [])])).count() == 0
    flat = whiten(frame_of(spark, [(i, [1.0, float(i % 2), 1.0]) for i in range(40)])).collect()
    assert len(flat) == 120 and all((r.whitened is None) == (r.component > 1) for r in flat)
    assert all(r.identity_error < 1e-9 and r.explained == (1.0 if r.component == 1 else 0.0) for r in flat)
    same = whiten(frame_of(spark, [(1, [2.0, 3.0])] * 5)).collect()
    assert len(same) == 10 and all(r.whitened is None and r.deviation == 0 for r in same)


def test_sums_beyond_a_long_stay_exact():
    x = np.array([[2**62, -5], [-(2**62), 7], [1, 1]], np.int64)
    sums, cross = scatter(x)
    model = fit(3, sums, cross, 2)
    rows = x.tolist()
    want = [sum((3 * c - s) ** 2 for c, s in zip(r, sums)) for r in rows]
    assert model.deviations(x) == [w if w < 10**38 else None for w in want]
    assert whitening.integers(np.array([[1e300, -1e300, 0.5]]), 64, 0).tolist() == [[2**62, -(2**62), 32]]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Rows ``(doc_id, source, lang, n_chars, text)`` to their manifest, by the definition."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = {}
    for i, source, lang, n, text in rows:
        bad = i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0
        leaf, changed = (h(*[field(v) for v in (i, source, lang, n, t)]) for t in (text, text.replace("\n", "") if bad else text))
        leaves.setdefault(source, []).append((-(2**63) if i is None else i, leaf, changed, i))

    def tree(nodes):
        paths = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for p, a in zip(paths, at):
                start = a - a % 3
                p.append((nodes[start:a], nodes[a + 1 : start + 3]))
            at = [a // 3 for a in at]
            nodes = [h(*nodes[a : a + 3]) for a in range(0, len(nodes), 3)]
        return nodes[0], paths

    order = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(leaves[s], key=lambda r: r[:2]), *tree([r[1] for r in sorted(leaves[s], key=lambda r: r[:2])])) for s in order}
    root, above = tree([trees[s][1] for s in order])
    out = []
    for s, outer in zip(order, above):
        mine, subroot, paths = trees[s]
        for (_, leaf, changed, i), path in zip(mine, paths):
            steps, now = path + outer, changed
            for left, right in steps:
                now = h(*left, now, *right)
            out.append((i, leaf, subroot, root, h(*[x for a, b in steps for x in a + b]), now, now == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tree string, part string, at string, spread string, node string"


@pytest.mark.parametrize("height,cell_rows", [(7, 8192), (1, 2), (2, 5)])
def test_manifest_equals_brute_force(spark, rows, height, cell_rows):
    rnd = random.Random(6)
    sources = [None, "", "a", "A", "é", "hot", "hot", "hot"]
    table = [(i, rnd.choice(sources), rnd.choice(["en", None]), None if t is None else len(t), None if t is None else t + "\nend") for i, t in rows]
    table += [table[3]] * 9 + [(None, None, None, None, None)] * 2 + [(5000, "single", "x", 1, "a\nb"), (5001, "=odd", "x", 1, "no break")]
    frame = spark.createDataFrame([(i, t, lang, s, n, *"uvwxyz") for i, s, lang, n, t in table], SCHEMA).repartition(4)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    found = merkle_manifest(frame, ["doc_id", "source", "lang", "n_chars", "text"], found={"text": tampered}, height=height, cell_rows=cell_rows)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, h("".join(r.proof).replace("|", "")), r.folded_root, r.verified) for r in found.collect()]
    assert sorted(got, key=key) == sorted(brute_manifest(table), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_an_empty_table_and_of_one_row(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle_manifest(empty, ["doc_id", "text"]).count() == 0
    one = merkle_manifest(spark.createDataFrame([(1, "x" * 3_000_000, "en", "s", 1, *"uvwxyz")], SCHEMA), ["doc_id", "text"]).collect()[0]
    assert one.leaf == one.subroot == one.root == h("1:1", "3000000:", "x" * 3_000_000) and one.proof == [] and one.verified


def test_subtrees_and_folding():
    nodes = [h(str(i)) for i in range(20)]
    tree = merkle.subtree(nodes, merkle.levels(20))
    assert len(tree[-1]) == 1 and all(merkle.folded(n, merkle.siblings(tree, i)) == tree[-1][0] for i, n in enumerate(nodes))
    assert [merkle.levels(n) for n in (0, 1, 2, 3, 4, 9, 10, 27, 28)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
