"""Jaccard join, M-tree, NN-descent, WARC and lattice against brute force."""

import math
import pickle
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from skyfold.llm import jaccard, lattice, mtree, nndescent, warc
from skyfold.llm.common import free_name, pack, text_chunks, unpack, word_hashes, word_spans

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute_components(rows, num=75, den=100):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(s), least.get(find(i), k) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(n_base, copies, edits, seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)]
    passage = list(rng.choice(vocabulary, 60))
    out = []
    for _ in range(n_base):
        base = list(rng.choice(vocabulary, int(rng.integers(3, 160))))
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(int(rng.integers(1, copies))):
            text = list(base)
            for _ in range(int(rng.integers(0, edits))):
                text[int(rng.integers(0, len(text)))] = str(rng.choice(vocabulary))
            out.append(" ".join(text).title() if rng.random() < 0.3 else "\n".join(text))
    return out


@pytest.mark.parametrize(("n_base", "copies", "edits", "seed"), [(25, 12, 6, 1), (2, 90, 8, 2)])
def test_components_equal_brute_force(spark, n_base, copies, edits, seed):
    texts = corpus(n_base, copies, edits, seed)
    rows = [*((int(i) * 3, t) for i, t in enumerate(texts)), (1, None), (4, ""), (7, " \n"), (10, "a b"), (13, "A  B"), (None, texts[0]), (None, "lone words that nobody else has here"), (0, texts[1]), (0, texts[1]), (16, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("comp", F.lit("c"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df.repartition(5)).collect()), key=repr)
    assert got == brute_components(rows)


def test_components_in_small_rounds(spark, monkeypatch):
    """Tiny limits force many fragments' groups through stars and further rounds."""
    monkeypatch.setattr(jaccard, "FRAGMENT_KEYS", 500)
    monkeypatch.setattr(jaccard, "BUCKET_NODES", 20)
    texts = corpus(4, 40, 9, 3)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df).collect()), key=repr)
    assert got == brute_components(rows)


def test_components_tasks_stay_small_as_the_input_grows(spark, monkeypatch):
    """Many fragments make no bucket large, and copies from many tasks no fragment."""
    monkeypatch.setattr(jaccard, "FRAGMENT_KEYS", 200)
    monkeypatch.setattr(jaccard, "BUCKET_ENTRIES", 200, raising=False)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(400)], 200)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate([*texts * 6, *(t + " tail" for t in texts[:20])])]
    count_keys, sum_by_node = jaccard._count_keys, jaccard._sum_by_node

    def few_keys(buckets):
        run = count_keys(buckets)

        def checked(table):
            held = sum(b.size for b in jaccard.column_blobs(table, "payload")) // 8
            assert held <= 5 * 200, f"{held} words of 8 bytes in a fragment"
            return run(table)

        return checked

    def few_entries(num, den):
        run = sum_by_node(num, den)

        def checked(table):
            held = sum(len(jaccard._zunpack(b, "<u8", "<u4", "<u4")[0]) for b in jaccard.column_blobs(table, "payload"))
            assert held <= 900, f"{held} entries in a bucket"
            return run(table)

        return checked

    monkeypatch.setattr(jaccard, "_sum_by_node", few_entries)
    monkeypatch.setattr(jaccard, "_count_keys", few_keys)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df).collect()), key=repr)
    assert got == brute_components(rows)


def test_live_parts_number_their_keys_without_gaps(spark, monkeypatch):
    """Counts by key are as long as a part's keys, whatever the other sets hold."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    lone = [" ".join(f"l{i}x{j}" for j in range(100)) for i in range(100)]
    near = [" ".join(rng.choice([f"w{i}" for i in range(50)], 60)) for _ in range(5)]
    rows = list(enumerate([*lone, *near, *(t + " tail" for t in near)]))
    only_live, spans = jaccard._only_live, []

    def spied(*args):
        live = only_live(*args)
        for row in live.filter("kind = 0").select("payload").collect():
            part = jaccard.Part(pa.table({"payload": pa.array([bytes(row.payload)], pa.binary())}))
            spans.append((part.span, len(part.tokens)))
        return live

    monkeypatch.setattr(jaccard, "_only_live", spied)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_components(rows)
    assert spans and all(span <= keys for span, keys in spans), spans


def test_candidates_reach_all_pairs_with_a_small_budget(monkeypatch):
    """A fragment that leaves pairs to the next rounds lists every one in the end."""
    monkeypatch.setattr(jaccard, "ROUND_PAIRS", 5)
    monkeypatch.setattr(jaccard, "SMALL_GROUP", 2)
    import pyarrow as pa

    rng = np.random.default_rng(0)
    base = np.arange(40)
    sets = [np.unique(np.where(rng.random(40) < 0.06, rng.integers(40, 60, 40), base)) for _ in range(14)]
    nodes = np.sort(rng.integers(1, 1 << 60, 14).astype(np.uint64))
    sizes = np.array([len(s) for s in sets])
    blob = jaccard._pack_part(nodes, sizes, sizes, np.concatenate(sets))
    part = jaccard.Part(pa.table({"payload": pa.array([blob], pa.binary())}))
    want = {(i, j) for i in range(14) for j in range(i + 1, 14) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    tested, seen = np.zeros(0, np.uint64), set()
    for round_ in range(500):
        a, b = jaccard._candidates(part, (nodes, sizes, np.zeros(14, np.int64), nodes), tested, round_ == 0, 75, 100)
        if not len(a):
            break
        seen |= set(zip(a.tolist(), b.tolist(), strict=True))
        tested = np.sort(np.append(tested, jaccard.pair_key(nodes[a], nodes[b])))
    assert want <= seen


def test_components_without_a_pair_in_the_star_round(spark, monkeypatch):
    """Sets that are no star's centre are still compared."""
    listed = jaccard._round_candidates
    monkeypatch.setattr(jaccard, "_round_candidates", lambda shared, where, state, tested, star, *more: listed(shared, where, state, tested, star, *more).filter(F.lit(not star)))
    rows = list(enumerate(corpus(3, 15, 6, 4)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_components(rows)


@pytest.mark.parametrize("seed", range(4))
def test_one_link_in_a_large_group(spark, seed):
    """All texts share a passage of 60 words; only two of them link."""
    rng = np.random.default_rng(seed)
    word = lambda n: ["".join(rng.choice(list("abcdefghijkl"), 7)) for _ in range(n)]
    passage = word(60)
    rows = [(int(i), " ".join(passage + word(int(rng.integers(24, 40))))) for i in rng.permutation(190) + 2]
    rows += [(0, " ".join(passage + word(6))), (1, " ".join(word(6) + passage))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_components(rows) and (1, 0) in {(d, c) for d, _, c in got}


def test_equal_hashes_of_different_sets_are_hashed_anew(spark, monkeypatch):
    """With a first seed that gives all sets one node the result is still right."""
    real = jaccard._sets

    def poor(batch, column, n, seed=0, checks=None):
        for lo, hi, sizes, nodes, keys in real(batch, column, n, seed, checks):
            yield lo, hi, sizes, nodes if seed else np.where(sizes > 0, np.uint64(7), nodes), keys

    monkeypatch.setattr(jaccard, "_sets", poor)
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l"), (4, None), (None, "g h i j k l")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_components(rows)


def test_join_unique_for_any_skew(spark):
    from skyfold.llm.common import Workspace, join_unique

    work = Workspace(spark, "test-join")
    left = work.save(spark.createDataFrame([(i, 0 if i % 2 else i) for i in range(60)] + [(99, None)], "i long, k long"), "left")
    right = spark.createDataFrame([(i, i * i) for i in range(0, 50, 2)], "k long, v long")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "k", how).select("i", "k", "v").collect()), key=repr)
        assert sorted(map(tuple, join_unique(work, left, right, "k", f"hot-{how}", how, hot_rows=5).select("i", "k", "v").collect()), key=repr) == want


@pytest.mark.parametrize("seed", range(6))
def test_pairs_within_components_do_not_fill_a_round(monkeypatch, seed):
    """A fragment that lists no pair has no group left to look at."""
    monkeypatch.setattr(jaccard, "ROUND_PAIRS", 3)
    monkeypatch.setattr(jaccard, "SMALL_GROUP", 6)
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    n, base = 24, np.arange(40)
    sets = [np.unique(np.where(rng.random(40) < 0.12, rng.integers(40, 70, 40), base)) for _ in range(n)]
    nodes = np.sort(rng.integers(1, 1 << 60, n).astype(np.uint64))
    sizes = np.array([len(s) for s in sets])
    part = jaccard.Part(pa.table({"payload": pa.array([jaccard._pack_part(nodes, sizes, sizes, np.concatenate(sets))], pa.binary())}))
    linked = {(i, j) for i in range(n) for j in range(i + 1, n) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    comp, tested = np.arange(n), np.zeros(0, np.uint64)
    for round_ in range(1000):
        a, b = jaccard._candidates(part, (nodes, sizes, np.zeros(n, np.int64), nodes[comp]), tested, round_ == 0, 75, 100)
        if not len(a) and round_:
            break
        for i, j in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True):
            if (i, j) in linked:
                comp[comp == comp[j]] = comp[i]
            else:
                tested = np.sort(np.append(tested, jaccard.pair_key(nodes[i : i + 1], nodes[j : j + 1])))
    assert all(comp[i] == comp[j] for i, j in linked)


def test_keep_one(spark):
    texts = corpus(6, 8, 3, 4)
    rows = [*enumerate(texts), (None, texts[0]), (900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(5))
    firsts = {c for k, _, c in brute_components([r for r in rows if r[0] is not None])}
    for most in (10, 0):
        kept = jaccard.keep_one(df, most_sent=most)
        assert kept.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == firsts | {None}
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_hashing_is_by_words():
    import pyarrow as pa

    texts = ["Ab cd", "ab\x0bCD", "ab", None, "", "é ab", "x" * 5000, "cd ab"]
    seen = {}
    for lo, _hi, data, edges in text_chunks(pa.array(texts), size=7):
        s, e, rows = word_spans(data, edges)
        for h, a, b, r in zip(word_hashes(data, s, e).tolist(), s, e, rows, strict=True):
            w = bytes(data[a:b]).lower()
            assert seen.setdefault(w, h) == h and w.decode() in words(texts[lo + r])
    assert len(set(seen.values())) == len(seen) == 4
    a, b = unpack(pack(np.arange(3, dtype="<u4"), np.zeros(0, "<u8")), "<u4", "<u8")
    assert a.tolist() == [0, 1, 2] and not len(b)


# ------------------------------------------------------------------- vector search
def vector_frame(spark, x, ids):
    bad = [(5000, None), (5001, []), (5002, [1.0, None] + [0.0] * (x.shape[1] - 2)), (5100, [float("nan")] * x.shape[1]), (5200, [float("inf")] * x.shape[1]), (None, x[0].tolist()), (100, x[list(ids).index(100)].tolist()), (5300, [0.0] * x.shape[1]), (5400, [1.0, 2.0])]
    rows = [*zip([int(i) for i in ids], x.tolist(), strict=True), *bad]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("b")).withColumn("v", F.lit(1))


def test_mtree_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 8))
    x[200:500] = x[200]  # a vector that a third of the rows share
    x[600:650] *= 30
    ids = np.arange(900)
    got = {}
    for r in mtree.top_k(vector_frame(spark, x, ids), block_rows=250, query_rows=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = np.floor(1024 * x).astype(np.int64)
    # the zero vector takes part here: only null and non-finite ones do not
    whole, ids = np.vstack([whole, np.zeros(8, np.int64)]), np.append(ids, 5300)
    want = {}
    for q in np.flatnonzero(ids % 100 == 0):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:10]
        want[int(ids[q])] = [(n + 1, int(ids[i]), int(s[i])) for n, i in enumerate(order)]
    got = {q: sorted(r) for q, r in got.items()}
    assert got.pop(5400, None) is None  # nothing else has its length
    assert got == want


def test_mtree_passes_over_far_pages():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 4)) * 100_000
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.standard_normal((4000, 4)) * 10).astype(np.int64)
    tree = mtree.MTree(np.arange(4000), x, leaf=32, fanout=8)
    for q in range(0, 4000, 397):
        tree.computed = 0
        s = x @ x[q]
        want = sorted(zip((-s).tolist(), range(4000), strict=True))
        assert tree.search(x[q], 10, None) == [(-a, i) for a, i in want[:10]]
        assert tree.computed < 2500
    assert mtree.MTree(np.zeros(0, np.int64), np.zeros((0, 4), np.int64)).search(x[0], 3, None) == []
    again = pickle.loads(pickle.dumps(tree))
    first = again.search(x[5], 10, 5, [(10**13, 9000)])
    assert first[0] == (10**13, 9000) and first[1:] == tree.search(x[5], 9, 5)
    with pytest.raises(OverflowError):
        mtree.MTree(np.arange(2), np.full((2, 4), 1 << 31))


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.5, 0.5]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in mtree.top_k(df).orderBy("query_id", "rank").collect()] == [(0, 1, 100), (0, 2, 7), (100, 1, 0), (100, 2, 7)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nndescent.neighbours(df, iterations=1).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 0.5), (0, 2, 7, 0.0), (100, 1, 0, 0.5), (100, 2, 7, 0.5)]
    assert mtree.top_k(df.limit(0)).count() == 0 and nndescent.neighbours(df.limit(0), iterations=1).count() == 0


@pytest.mark.parametrize("settings", [{"shard_rows": 500, "block_rows": 200, "query_rows": 20}, {"shard_rows": 60, "block_rows": 30}])
def test_nn_descent_recall_and_ties(spark, settings):
    """A few shards, and many."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1200, 24))
    x[300:700] = x[300]
    ids = np.arange(1200)
    df = vector_frame(spark, x, ids)
    hit = total = 0
    found = {}
    for r in nndescent.neighbours(df, iterations=4, **settings).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 1200, 20))
    for q, rows in found.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21))
        s = x @ x[q]
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in rows)
        want = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        hit += len({v for _, v, _ in rows} & set(want))
        total += 20
    assert hit / total >= 0.9


# --------------------------------------------------------------------------- WARC
def test_warc_round_trip(spark, tmp_path):
    body = "<html>" + "shared é " * 30 + "</html>"
    rows = [(i, f"http://x/{i}", body if i % 3 == 0 else f"<p>{i}</p>" * (i % 40)) for i in range(120)]
    rows += [(900, None, None), (901, "u", ""), (902, "u", "y" * 99), (903, "u", "y" * 99), (904, "u", "z" * 100), (905, "u", "z" * 100), (None, "n", body), (906, "a\r\nb", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("payload", F.lit(1))
    path = f"file://{tmp_path}/warc"
    warc.write(df, path, archive_bytes=2000)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    import hashlib

    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    by_id = {r.page_id: r for r in got}
    for p, _, h in rows:
        raw, r = (h or "").encode(), by_id[p]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        own = len(raw) < 100 or first[h or ""] == p
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[h or ""]))
    assert warc.round_trip(df.limit(0)).count() == 0
    # The smallest id of equal payloads is repeated: one response, the rest revisit it.
    twins = spark.createDataFrame([(7, "u", body), (7, "u", body), (8, "u", body), (7, "v", body), (9, None, None), (9, None, None)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.round_trip(twins).collect())
    assert got == [(7, "response", 0), (7, "revisit", 7), (7, "revisit", 7), (8, "revisit", 7), (9, "response", 0), (9, "response", 0)]


@pytest.mark.parametrize(("change", "said"), [
    ({"X-Payload-Length": "3"}, "bytes in the HTTP header"), ({"WARC-Type": "revisit"}, "with a payload"), ({"WARC-Payload-Digest": "sha256:zz"}, "not a digest"), ({"WARC-Type": "metadata"}, "not a type"),
])
def test_warc_headers_are_checked(change, said):
    import hashlib

    headers = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "WARC-Date": "2024-01-01T00:00:00Z", "X-Payload-Length": "2", "WARC-Payload-Digest": "sha256:" + hashlib.sha256(b"hi").hexdigest(), "X-Page-ID": "1"} | change
    with pytest.raises(warc.WarcError, match=said):
        warc._read_page(warc.parse(warc.build(list(headers.items()), b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi")))


def record(**change):
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
    return warc.build([(k, change.get(k, v)) for k, v in headers if change.get(k, v)], b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi")


def test_warc_frames_and_errors():
    samples = [f"<html><body>{i} some text of pages {i * 7}</body></html>".encode() * 4 for i in range(400)]
    d = zstandard.train_dictionary(2000, samples)
    c = zstandard.ZstdCompressor(dict_data=d)
    lead = lambda raw: struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw
    body = c.compress(record())
    for raw in (d.as_bytes(), zstandard.ZstdCompressor().compress(d.as_bytes())):
        good = lead(raw) + body + struct.pack("<II", 0x184D2A50, 1) + b"\n" + body
        assert [warc.parse(f).headers["warc-type"] for f in warc.frames(good)] == ["response"] * 2
    for broken in (good[:-3], good + b"\x00" * 9, good[:20], lead(d.as_bytes()) + body + lead(b"x" * 9), body):
        with pytest.raises(warc.WarcError):
            for f in warc.frames(broken):
                warc.parse(f)
    text = record()
    for bad in (text.replace(b"WARC/1.1", b"WARC/9"), text.replace(b"Content-Length: 40", b"Content-Length: 41"), text[:-1], text + b"x", record(**{"WARC-Date": ""}), text.replace(b"WARC-Type:", b"WARC-Type "), b"WARC/1.1"):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


# ------------------------------------------------------------------------ lattice
def brute_spell(word, p):
    """Sum over all segmentations of a word, with the blank before it."""
    text = b" " + word
    a = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            a[j] += a[i] * p.get(text[i:j], 0.0)
    return a[-1]


def small_pieces():
    p = {b" th": 0.2, b"e": 0.1, b" the": 0.1, b"re": 0.1, b" ": 0.05, b"t": 0.05, b"h": 0.05, b"r": 0.05}
    keys = np.array([lattice.piece_hash(k) for k in p], np.uint64)
    order = np.argsort(keys)
    names = [list(p)[i] for i in order]
    begun = np.array([lattice.piece_hash(k[:n]) for k in p for n in range(1, len(k))], np.uint64)
    return p, names, lattice.Pieces(keys[order], np.log(np.array([p[n] for n in names])), math.log(0.3), begun, 4)


def test_spelling_sums_over_segmentations():
    p, names, pieces = small_pieces()
    ws = [b"the", b"there", b"three", b"t", b"ththth"]
    assert np.exp(lattice.spell(ws, pieces)) == pytest.approx([brute_spell(w, p) for w in ws], rel=1e-9)
    expect = np.zeros(len(names))
    lattice.spell([b"the", b"e"], pieces, expect, np.array([3, 1]))
    ways = {(b" the",): 0.1, (b" th", b"e"): 0.02, (b" ", b"t", b"h", b"e"): 0.05**3 * 0.1}
    want = Counter({b" ": 1.0, b"e": 1.0})
    for way, w in ways.items():
        for piece in way:
            want[piece] += 3 * w / sum(ways.values())
    assert dict(zip(names, expect, strict=True)) == pytest.approx({n: want.get(n, 0.0) for n in names})


def test_first_weights_are_a_distribution():
    pytest.importorskip("public_tokenizers")
    pieces = lattice.load_pieces(None)
    assert pieces.longest > 16
    assert np.exp(pieces.log_p).sum() + math.exp(pieces.log_end) == pytest.approx(1.0)
    expect = np.zeros(len(pieces.keys))
    lattice.spell([b"hello", "straße".encode(), b"\xff\xfe"], pieces, expect)
    later = lattice.reweigh(pieces, pieces, expect, 3)
    assert np.exp(later.log_p).sum() + math.exp(later.log_end) == pytest.approx(1.0)


def whole_vocabulary(pieces):
    """The vocabulary's pieces by their bytes, with the weights of ``pieces``."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    at = {k: math.exp(v) for k, v in zip(pieces.keys.tolist(), pieces.log_p.tolist(), strict=True)}
    names = {bytes([b]) for b in range(256)} | {model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return {n: at[lattice.piece_hash(n)] for n in names if b" " not in n[1:]}


def lattice_rows():
    rng = np.random.default_rng(8)
    vocabulary = [["".join(rng.choice(list("aeioumnr"), 4)) for _ in range(60)], ["".join(rng.choice(list("xyzkvwu"), 4)) for _ in range(60)]]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 2], 30)).title()) for i in range(60)]
    return rows + [(900, None), (901, ""), (None, "aeio xyzk"), (902, "never\x0bseen " * 3), (3, rows[3][1]), (903, "w" * 66), (904, "wo " * 5 + "w" * 66)]


def test_lattice_scores(spark):
    """Counts by brute force; every score by a plain sum over all segmentations of the whole text."""
    pytest.importorskip("public_tokenizers")
    rows = lattice_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "batch": F.lit(2), "frag": F.lit("c"), "P": F.lit(0)})
    train, tokens = Counter(), {}
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in rows:
        w = [*words(t), None]
        tokens.setdefault(i, w)
        if not out_of(i):
            train.update(w)
    n, v = train.total(), len(train)
    p = whole_vocabulary(lattice.load_pieces(None))
    for settings in ({"steps": 0}, {"steps": 0, "most_frequent": 20, "fragment_tokens": 50}):
        got = lattice.score(df.repartition(3), **settings).collect()
        assert len(got) == len(rows)
        for r in got:
            w = tokens[r.doc_id]
            assert (r.held_out, r.n_tokens, r.train_tokens) == (out_of(r.doc_id), len(w), n)
            assert r.n_known == sum(train[t] > 0 for t in w)
            assert r.base_score == pytest.approx(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in w), rel=1e-9)
            assert r.score == pytest.approx(sum(math.log10(brute_spell(t.encode(), p)) for t in w[:-1]) + math.log10(0.25), rel=1e-9)


def test_lattice_calibrates_on_the_corpus(spark):
    """Expectation steps raise the likelihood of what they learn from, and of held-out texts of its kind."""
    pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame(lattice_rows(), "doc_id long, text string")
    totals = []
    for steps in (0, 1, 3):
        got = lattice.score(df, steps=steps).collect()
        totals.append([sum(r.score for r in got if r.held_out == h) for h in (False, True)])
    assert totals[0][0] < totals[1][0] < totals[2][0] and totals[0][1] < totals[2][1]
    assert lattice.score(df.limit(0)).count() == 0
    nothing = lattice.score(df.filter("doc_id = 900").withColumn("doc_id", F.lit(8).cast("long"))).collect()
    assert len(nothing) == 1


def test_free_name(spark):
    df = spark.range(1).select(F.lit(1).alias("X"), F.lit(2).alias("x_"))
    assert free_name(df, "x") == "x__"
