import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hireloom.llm import nn_descent, warc
from hireloom.llm import toxicity as toxicity_module
from hireloom.llm.cover_tree import build, exact_top_k, search
from hireloom.llm.graph import components
from hireloom.llm.nn_descent import nearest
from hireloom.llm.shared import new_folder
from hireloom.llm.toxicity import character_costs, count_trigrams, readings, restore, toxicity, trigram_costs

VECTORS = "vec_id long, embedding array<double>, label int, id string, v string, block string, code string, bucket string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, *"abcde") for i, v in rows], VECTORS).repartition(4)


@pytest.fixture(scope="module")
def vectors():
    """Clusters, copies, ties, repeated rows and vectors that take no part."""
    rnd = np.random.default_rng(4)
    centers = rnd.normal(size=(8, 16))
    x = centers[rnd.integers(0, 8, 400)] + 0.2 * rnd.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, x[i].tolist()) for i in range(400)]
    rows += [(400 + i, x[100].tolist()) for i in range(60)]
    rows += [(20, x[20].tolist()), (900, None), (1000, [None] * 16), (1100, [float("nan")] * 16), (1200, [float("inf")] * 16), (None, x[0].tolist())]
    return rows


def brute(rows, step, k, quantise):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good])
    x = np.floor(256 * x) if quantise else x
    out = []
    for i, v in sorted(good):
        if i % step == 0:
            q = np.floor(256 * np.array(v)) if quantise else np.array(v)
            s = x @ q
            best = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
            out += [(i, r, int(b), -a) for r, (a, b) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("data_block,query_block", [(8192, 4096), (90, 5)])
def test_exact_top_k_equals_brute_force(spark, vectors, data_block, query_block):
    got = exact_top_k(vector_frame(spark, vectors), F.col("vec_id") % 50 == 0, data_block=data_block, query_block=query_block).collect()
    want = [(i, r, b, int(s)) for i, r, b, s in brute(vectors, 50, 5, True)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_exact_top_k_of_large_components_is_exact(spark):
    """Scores of about 2**60, more than a double holds exactly, some of them one apart."""
    rnd = np.random.default_rng(5)
    x = rnd.integers(-(2**20), 2**20, (120, 6)).astype(float)
    x[60:, :] = x[0]
    x[60:, 5] += np.arange(60) / 256
    want = []
    whole = [[int(np.floor(256 * c)) for c in v] for v in x]
    for q in range(0, 120, 50):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in enumerate(whole) if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)]
    for blocks in ({}, {"data_block": 20, "query_block": 2}):
        got = exact_top_k(vector_frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 50 == 0, **blocks).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_exact_top_k_finds_each_copy_of_a_row(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [0.25, 0.0]), (0, [1.0, 0.0])]
    found = exact_top_k(vector_frame(spark, rows[:5]), F.col("vec_id") == 0, each=True).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 65536), (1, 65536), (2, 32768), (2, 16384)]
    # A repeated query row finds every candidate once more.
    found = exact_top_k(vector_frame(spark, rows), F.col("vec_id") == 0, each=True).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in found] == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)]


def test_exact_top_k_of_few_rows(spark, vectors):
    frame = vector_frame(spark, vectors[:3])
    assert [(r.query_id, r.rank) for r in exact_top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert exact_top_k(vector_frame(spark, []), F.col("vec_id") == 0).count() == 0


def test_cover_tree_covers():
    rnd = np.random.default_rng(2)
    x = np.concatenate([rnd.normal(size=(500, 5)), np.repeat(rnd.normal(size=(1, 5)), 100, 0)])
    seen = []

    def walk(node):
        below = [node.points, *[walk(c) for c in node.children]]
        all_ = np.concatenate(below)
        assert (np.linalg.norm(x[all_] - x[node.center], axis=1) <= node.radius + 1e-6).all()
        assert all(c.radius <= node.radius / 2 + 1e-6 for c in node.children)
        seen.extend(node.points.tolist())
        return all_

    walk(build(x, leaf=8))
    assert sorted(seen) == list(range(len(x)))


def test_dual_tree_search_prunes_without_loss():
    rnd = np.random.default_rng(8)
    centers = 20 * rnd.normal(size=(10, 6))
    data = np.round(centers[rnd.integers(0, 10, 2000)] + rnd.normal(size=(2000, 6)))
    best = search(data[::7], np.arange(0, 2000, 7), data, np.arange(2000), 4)
    scores = data[::7] @ data.T
    scores[np.arange(len(scores)), np.arange(0, 2000, 7)] = -np.inf
    for row, got in zip(scores, best.ids):
        assert got.tolist() == np.lexsort((np.arange(2000), -row))[:4].tolist()


def test_nearest_reaches_its_recall(spark, vectors):
    got = nearest(vector_frame(spark, vectors), F.col("vec_id") % 20 == 0, k=10, degree=12, block=64, trees=3, rounds=2, nodes_per_task=100, queries_per_task=8).collect()
    want = brute(vectors, 20, 10, False)
    assert {(r.query_id, r.rank) for r in got} == {(i, r) for i, r, _, _ in want}
    scores = {(i, r): s for i, r, _, s in want}
    assert np.mean([r.score >= scores[r.query_id, r["rank"]] - 1e-9 for r in got]) >= 0.9
    hits = {(i, b) for i, _, b, _ in want} & {(r.query_id, r.vec_id) for r in got}
    assert len(hits) >= 0.9 * len(want)


def recall(spark, x, step=20, k=20, **settings):
    got = nearest(vector_frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % step == 0, k=k, **settings).collect()
    scores = x[::step] @ x.T
    scores[np.arange(len(scores)), np.arange(0, len(x), step)] = -np.inf
    want = {(q * step, int(b)) for q, row in enumerate(scores) for b in np.argsort(-row)[:k]}
    assert len(got) == len(want)
    return len(want & {(r.query_id, r.vec_id) for r in got}) / len(want)


SMALL = dict(degree=16, block=128, trees=3, nodes_per_task=800, queries_per_task=64, pool=120)


@pytest.mark.parametrize("lengths", ["unequal", "outlier"])
def test_nearest_ranks_by_inner_product_whatever_the_lengths(spark, lengths):
    rnd = np.random.default_rng(12)
    x = rnd.normal(size=(20, 24))[rnd.integers(0, 20, 1500)] + 0.5 * rnd.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "unequal":
        x *= np.exp(rnd.normal(size=(1500, 1)))
    else:
        x[777] *= 1000
    assert recall(spark, x, **SMALL) >= 0.95


def test_nearest_goes_on_until_nothing_changes(spark):
    """One round and narrow steps are the least, not all: a third of the rows is one hot cluster, the rest has no clusters."""
    rnd = np.random.default_rng(13)
    x = rnd.normal(size=(2400, 24))
    x[::3] = x[0] + 0.05 * rnd.normal(size=(800, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x, **SMALL | dict(trees=2, block=32, rounds=1, widths=(16, 16))) >= 0.95


def test_nearest_of_few_rows(spark, vectors):
    got = nearest(vector_frame(spark, [*vectors[:3], (7, [0.0] * 16)]), F.col("vec_id") == 0).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(0, 1), (0, 2)]
    assert nearest(vector_frame(spark, []), F.col("vec_id") == 0).count() == 0


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(201, 200), (5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long"), new_folder(spark, "components"))
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)} | {201: 200}
    assert {r.node: r.component for r in got.collect() if r.node != r.component} == want


PAGES = "page_id long, url string, html string, archive string, payload string, first string"


def pages():
    big = "é" + "a" * 200
    rows = [(i, f"http://x/{i}?a=%20 b\r\n", f"<p>{i}</p>" * 30) for i in range(40)]
    rows += [(50 + i, "http://copy", big) for i in range(12)] + [(80, "u", "small"), (81, "u", "small"), (82, None, None), (83, "u", ""), (84, "u", "z" * 400_000)]
    rows += [(50, "http://copy", big), (None, "u", big), (7, "http://x/7?a=%20 b\r\n", "<p>7</p>" * 30)]
    return rows


def test_archives_round_trip(spark):
    rows = pages()
    folder = new_folder(spark, "warc")
    index = warc.write_archives(spark.createDataFrame([(*r, *"abc") for r in rows], PAGES).repartition(4), folder, archive_bytes=3000)
    assert index.count() == len(rows) and index.select("archive").distinct().count() > 4
    got = warc.read_pages(index, folder).collect()
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    want = []
    for i, url, html in rows:
        raw = (html or "").encode()
        to = first.get(html) if i is not None and first.get(html, i) != i else None
        url = url and url.replace(" ", "%20").replace("\r\n", "%0D%0A")
        want.append((i, url, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to is not None else "response", to))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    some = warc.read_records(index.where("page_id IN (3, 84)"), folder, gap=0).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in some} == {3: "<p>3</p>" * 30, 84: "z" * 400_000}


def test_archives_of_an_empty_table(spark):
    folder = new_folder(spark, "warc")
    assert warc.read_pages(warc.write_archives(spark.createDataFrame([], PAGES), folder), folder).count() == 0


def test_record_is_well_formed():
    raw = warc.record(5, "http://a/ b", b"abc", "00", None)
    head, _, rest = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and rest.endswith(b"abc\r\n\r\n")
    assert warc.parse(raw) == (5, "http://a/%20b", "response", None, "00", b"abc")
    assert warc.parse(warc.record(6, None, b"abc", "00", 5)) == (6, None, "revisit", 5, "00", None)


TRIAL = ["you are an idiot and a loser", "the idiot went home", "such a loser"] * 30


def test_disguised_words_are_restored():
    costs = trigram_costs(count_trigrams([t.encode() for t in TRIAL])).tolist()
    assert [restore(w, costs) for w in ("1d10t", "i.d.i.o.t", "idiiiiot", "l0$er", "loser")] == ["idiot", "idiot", "idiot", "loser", "loser"]
    assert "idiot" in readings('"1d1ot,', costs) and readings("plain.", costs) == ["plain"]


def test_every_disguise_gives_the_stems_of_the_word():
    texts = ["such a stupid moron and a stupid dämlich moron", "the moron was dämlich and stupid", "plain words about other things", "der dummkopf und die idioten"] * 40
    known = toxicity_module.Reader(trigram_costs(count_trigrams([t.encode() for t in texts])))
    for text, word in [
        ("such a m o r o n", "moron"), ("I a m o r o n y", "moron"), ("so d ä m l i c h ist", "dämlich"), ("the mo ron went", "moron"), ('a "m 0 r 0 n".', "moron"),
        ("stu-pid", "stupid"), ("st.upid", "stupid"), ("stuupid", "stupid"), ("very s t u p i d words", "stupid"),
        ("a stup id one", "stupid"), ("die id ioten", "idioten"), ("so stupi d", "stupid"), ("ein d u m m k o p f da", "dummkopf"),
        ("ѕtupid", "stupid"), ("mоrоn", "moron"), ("stúpid", "stupid"), ("ｍｏｒｏｎ", "moron"), ("damlich dämlich", "dämlich"),
    ]:
        evidence = np.full(toxicity_module.BUCKETS, -3.0, np.float32)
        evidence[[*toxicity_module.stems_of(word.encode()[:6])]] = 5.0
        evidence[[*toxicity_module.stems_of(word.encode()[:5])]] = -3.0
        if len(word) < 6:
            evidence[[*toxicity_module.stems_of(word.encode())]] = 5.0
        assert known.strongest([b"other", text.encode()], evidence, None, -2.0)[:, 0].tolist() == [-2.0, 5.0], text


def every_reading(word, costs, spaces=False):
    """The cheapest reading by trying every way through the lattice."""
    best = [(float("inf"), "")]

    def go(at, a, b, cost, out):
        if at == len(word):
            best[0] = min(best[0], (cost + costs[a][b][0], out))
            return
        ch = word[at]
        skip = None
        if ch == " " and spaces:
            options, skip = [(ch, 0.0)], toxicity_module.COST_SPACE
        else:
            options = toxicity_module._options(ch)
            skip = toxicity_module.COST_FILLER if ch in toxicity_module.FILLERS else toxicity_module.COST_REPEAT if at and ch == word[at - 1] else None
            options = options or ([(ch, 0.0)] if skip is None else [])
        if skip is not None:
            go(at + 1, a, b, cost + skip, out)
        for c, more in options:
            s = ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0
            go(at + 1, b, s, cost + more + costs[a][b][s], out + c)

    go(0, 0, 0, 0.0, "")
    return best[0]


def test_viterbi_equals_enumeration():
    rnd = np.random.default_rng(4)
    costs = trigram_costs(count_trigrams([t.encode() for t in TRIAL])).tolist()
    cost_of = lambda word, out, spaces: min(c for c, o in [every_reading(word, costs, spaces)] if o == out)
    for n in range(150):
        spaces = n % 2 == 0
        word = "".join(rnd.choice(list("idotlsr1$0.-é" + " " * spaces), rnd.integers(1, 9))).strip() or "x"
        got = restore(word, costs, spaces)
        assert cost_of(word, got, spaces) == pytest.approx(every_reading(word, costs, spaces)[0])
    for n in range(400):
        word = "".join(rnd.choice(list("idosl"), rnd.integers(1, 9)))
        fast = toxicity_module.undoubled(word.encode(), costs)
        assert fast is None or fast.decode() == restore(word, costs)


def test_character_counts_equal_a_direct_count():
    texts = [b"ab c", None, "é1".encode()]
    table = count_trigrams(texts).reshape(28, 28, 28)
    flat = [toxicity_module._SYMBOL_OF[c] for c in b"  ".join(t or b"" for t in texts) + b"  "]
    for x, y, z in zip(flat, flat[1:], flat[2:]):
        assert (table[x, y, z] > 0) == bool(y or z)
    assert table.sum() == sum(1 for y, z in zip(flat[1:-1], flat[2:]) if y or z)


def test_words_of_a_block_are_the_readings_of_its_tokens():
    """Words taken all at once and those decoded one by one, each once for a text, with the same stems."""
    known = toxicity_module.Reader(trigram_costs(count_trigrams([t.encode() for t in TRIAL])))
    texts = ["idiot Loser. \"went\" (good) aa off, ab seven sixsix bookkeeper idiot IDIOT", None, "", "?? !!", "x", "l0ser dämlich Ätsch ÉCOLE façade ößö straße éé reéx ñandú 'longerword' went! 12 a1b2 mо_x ... -", "word " * 300, "a b"]
    found = known.read([t.encode() if t is not None else None for t in texts])[0]
    for i, text in enumerate(texts):
        want = {w for t in (text or "").split() for w in readings(t, known.costs) if len(w.encode()) > 2}
        assert {tuple(sorted(x for x in s if x >= 0)) for s in found.stems[found.row == i].tolist()} == {
            tuple(sorted(x for x in toxicity_module._stemmed(toxicity_module.words_of([w.encode()]), np.zeros(1, np.int64)).stems[0].tolist() if x >= 0)) for w in want
        }, text
        assert (found.row == i).sum() == len(want)
    for word in ("abc", "abcd", "abcdef", "abcdefgh"):
        parts = {word} | {word[:k] for k in (4, 5, 6)}
        single = {next(iter(toxicity_module.stems_of(p.encode()[:3]))) if len(p) == 3 else None for p in parts}
        assert len(toxicity_module.stems_of(word.encode())) == len(parts) and (len(word) > 3 or single <= toxicity_module.stems_of(word.encode()))


def test_the_strongest_words_count_once():
    known = toxicity_module.Reader(trigram_costs(count_trigrams([t.encode() for t in TRIAL])))
    evidence = np.full(toxicity_module.BUCKETS, -3.0, np.float32)
    evidence[[*toxicity_module.stems_of(b"idiot")]] = 2.0
    evidence[[*toxicity_module.stems_of(b"loser")]] = 1.0
    got = known.strongest([b"idiot idiot Idiot, loser", None, b"plain loser"], evidence, None, -2.5)
    assert got.tolist() == [[2.0, 1.0, -2.5], [-2.5] * 3, [1.0, -2.5, -2.5]]
    own = np.full(toxicity_module.BUCKETS, -1.0, np.float32)
    assert known.strongest([b"idiot", b"idiot"], evidence, [own, evidence], -2.5)[:, 0].tolist() == [-1.0, 2.0]


def test_counts_of_blocks_add_up(spark):
    rnd = np.random.default_rng(2)
    parts = [rnd.integers(0, 5, 28**3) for _ in range(3)]
    rows = [(b, p.reshape(28, -1)[b].astype(np.int64).tobytes()) for p in parts for b in range(28)]
    frame = spark.createDataFrame([(b, bytearray(x)) for b, x in rows], "block int, counts binary")
    assert (toxicity_module._summed(frame, 28**3) == sum(parts)).all()


def test_toxicity_learns_and_holds_out(spark):
    rnd = np.random.default_rng(6)
    vocabulary = ["".join(rnd.choice(list("aeionrstl"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        text = list(rnd.choice(vocabulary, 30))
        if bad:
            text[3:5] = [rnd.choice(["stupid", "stup1d", "stuuupid", "s t u p i d"]), "moronic"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "?? !!"), (1003, "word " * 20_000), (None, "stupid moronic"), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, "e", "x", "y") for r in rows], "doc_id long, text string, lang string, score string, id string").repartition(4)
    marks = spark.createDataFrame([(*x, "n") for x in labels] + [(1, None, "n"), (None, 1, "n"), (3, 0, "n")], "doc_id long, toxic int, id string")
    got = toxicity(docs, marks, carry=("lang",)).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.97 * len(tested)
    assert {r.predicted for r in got if r.doc_id in (1000, 1001, 1002, 1003)} == {0}


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity(docs, marks).collect()] == [(0.0, 0)]
    assert toxicity(docs.limit(0), marks).count() == 0
    assert character_costs(docs.limit(0)).shape == (28, 28, 28)


def member_table(nodes=700, degree=48, width=64):
    """The neighbours of the nodes of one task, with codes, in two chunks as they come from Arrow."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(nodes, width)).astype(np.float32)
    x /= 2 * np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(x).max(1) / 32767
    codes = [np.array([s, 0.1], np.float32).tobytes() + np.round(v / s).astype(np.int16).tobytes() for v, s in zip(x, scale, strict=True)]
    other = np.concatenate([rng.choice(nodes, degree, replace=False) for _ in range(nodes)])
    whole = pa.table({
        "bucket": pa.array(np.zeros(len(other)), pa.int32()), "id": np.repeat(np.arange(nodes), degree), "other": other,
        "code": pa.array([codes[o] for o in other], pa.binary()), "bar": pa.array(np.full(len(other), -1e30), pa.float32()),
    })
    half = len(other) // 2
    return pa.concat_tables([whole.slice(0, half), whole.slice(half)]), x


def test_offers_of_a_task_need_little_more_than_its_table():
    table, _ = member_table(4000)
    tracemalloc.start()
    offers = nn_descent._compared(table, 32, 8, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert offers.num_rows == 13 and peak < 3 * table.nbytes


def test_offers_are_the_best_of_each_node():
    table, x = member_table(60, 12)
    owner, ids, sims = nn_descent._offered(nn_descent._compared(table, 5, 11, 3))
    best = {}
    members = table["other"].to_numpy().reshape(60, 12)
    for near in members:
        for a in near:
            best.setdefault(a, {}).update({b: -((x[a] - x[b]) ** 2).sum() / 2 for b in near if b != a})
    got = {a: set(ids[owner == a]) for a in np.unique(owner)}
    assert {a: set(sorted(found, key=found.get)[-5:]) for a, found in best.items()} == got and len(sims) == 5 * len(got)


def test_lists_cut_in_parts_are_the_same():
    rng = np.random.default_rng(4)
    owner, ids = rng.integers(0, 50, 4000), rng.integers(0, 90, 4000)
    sims = ((owner * 31 + ids * 17) % 101).astype(np.float32)
    whole, parts = (nn_descent._best_lists(owner, ids, sims, 6, most) for most in (10_000, 300))
    order = np.argsort(parts[0], kind="stable")
    assert all((a == b[order]).all() for a, b in zip(whole, parts, strict=True))
