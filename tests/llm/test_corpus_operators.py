"""Operators over all texts or vectors at once, held against brute force: repeats, near duplicates, lattice, media, and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from lociq.llm import lattice, media, minhash, suffixes
from lociq.llm.common import Scratch


def brute_repeats(texts, length):
    seen, out = set(), []
    for b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,alphabet", [(16, "ab"), (20, "abcdé"), (100, "ab cd")])
def test_repeats_match_brute_force(docs_of, length, alphabet):
    rng = random.Random(length)
    shared = ["".join(rng.choice(alphabet) for _ in range(3 * length)) for _ in range(4)]
    texts = []
    for _ in range(60):
        t = "".join(rng.choice([rng.choice(shared)[rng.randrange(length) :], "".join(rng.choice(alphabet) for _ in range(rng.randrange(2 * length)))]) for _ in range(4))
        texts.append(t if rng.random() < 0.9 else "a" * rng.randrange(4 * length))
    docs = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs_of(docs).repartition(3), length).collect()}
    want = brute_repeats([t.encode() for t in texts], length)
    assert [got[i] for i in range(len(docs))] == want


def test_repeats_over_pieces_and_flushes(docs_of, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 300)
    monkeypatch.setattr(suffixes, "FLUSH", 50)
    monkeypatch.setattr(suffixes, "HOT", 1)
    rng = random.Random(1)
    unit = "".join(rng.choice("abcdef ") for _ in range(700))
    docs = [(i, unit[rng.randrange(600) :] + "".join(rng.choice("abcdef ") for _ in range(900)) + unit[:250]) for i in range(12)]
    names = suffixes._first_pass(2, 100, 48), suffixes._pieces
    assert names
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs_of(docs), 100).collect()}
    assert [got[i] for i in range(12)] == brute_repeats([t.encode() for _, t in docs], 100)


def test_repeats_take_odd_rows(docs_of, odd_rows):
    order = sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    rows = suffixes.digest(docs_of(odd_rows)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(brute_repeats([(t or "").encode() for _, t in order], 100))
    out = suffixes.strip(docs_of(odd_rows))
    assert out.columns == docs_of(odd_rows).columns and out.count() == len(odd_rows) and out.where("text is null").count() == 2
    assert suffixes.digest(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_windows_across_joined_repeats_are_found(docs_of, seed):
    """XY and YZ make all of XYZ but its windows across Y's edges a repeat; a later xYz repeats those."""
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    texts = []
    for y in (50, 60, 70, 80, 90, 97):
        for _ in range(4):
            a, b, c = draw(150), draw(y), draw(150)
            x, z = a[-((110 - y) // 2 + 2) :], c[: (110 - y) // 2 + 2]
            texts += [a + b, b + c, a + b + c, draw(130) + x + b + z + draw(130)]
    order = [i for k in range(4) for i in range(k, len(texts), 4)]  # all XY, all YZ, all XYZ, all xYz
    texts = [texts[i] for i in order]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs_of(list(enumerate(texts))).coalesce(1)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], 100)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 85 * (len(a) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def near_copies(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 150]))] for _ in range(n)]
    out = [" ".join(b) for b in base]
    for _ in range(4 * n):
        b = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            b[rng.randrange(len(b))] = rng.choice(vocabulary)
        out.append(" ".join(b).upper() if rng.random() < 0.2 else "\n".join(b))
    rng.shuffle(out)
    return out


def test_near_duplicates_match_brute_force(docs_of):
    texts = near_copies(random.Random(7), 40)
    sets = [shingle_set(t) for t in texts]
    want = brute_components(sets)
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs_of(list(enumerate(texts))).repartition(3)).collect()}
    assert [(rows[i].n_shingles, rows[i].component_id, rows[i].kept) for i in range(len(texts))] == [(len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, want))]


def test_groups_split_into_blocks_lose_no_link(docs_of, monkeypatch):
    """Chains of texts about the threshold that share most keys, dealt to blocks and stars of a few rows."""
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "LEAVES", 3)
    monkeypatch.setattr(minhash, "HEAVY", 2000)
    rng = random.Random(11)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
        for _ in range(60):
            b = list(base)
            for k in rng.sample(range(160), rng.choice([1, 2, 3, 4, 6])):
                b[k] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(b))
    rng.shuffle(texts)
    want = brute_components([shingle_set(t) for t in texts])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(list(enumerate(texts))).repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_shingles_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(5)
    texts = [b" ".join(bytes([rng.randrange(97, 123)]) * rng.randrange(1, 40) for _ in range(rng.randrange(200))) for _ in range(20)] + [b"x" * 900, b"", b" a"]
    want = minhash.shingles(texts)
    monkeypatch.setattr(minhash, "SEGMENT", 64)
    assert all((a == b).all() for a, b in zip(want, minhash.shingles(texts)))


def test_near_duplicates_take_odd_rows(docs_of, odd_rows):
    rows = minhash.near_duplicates(docs_of(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.component_id, r.kept))
    assert sorted(by[7]) == [(7, False), (7, True)] and by[5] == [(5, True)] and by[6] == [(5, False)] and by[1] == [(1, True)] and by[2] == [(2, True)]
    one = minhash.one_of_each(docs_of(odd_rows))
    assert one.columns == docs_of(odd_rows).columns and one.count() == len(odd_rows) - 2
    assert minhash.near_duplicates(docs_of([])).count() == 0


def test_one_of_each_keeps_its_rows_in_a_numbered_table(spark, docs_of):
    """Repeated ids and more rows than the sample from which a sort takes its bounds: each text stays once, in its own row."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(10**6)) for _ in range(rng.choice([8, 30]))) for _ in range(3000)]
    docs = [(i % 2000, t) for i, t in enumerate(texts)] + [(i % 2000, t) for i, t in enumerate(texts[:1000])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = minhash.one_of_each(docs_of(docs).repartition(6)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.text for r in rows) == sorted(texts)


def test_register_collisions_are_corrected():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2))
    a, b = np.sort(h[:3000]), np.sort(h[1000:])
    r = minhash.sketch(np.concatenate([a, b]), np.repeat([0, 1], [3000, 3000]), 2)
    assert abs(float(minhash.estimate(r[:1], r[1:], np.array([3000.0]), np.array([3000.0]))[0]) - 0.5) < 0.16


VECTOR = "vec_id long, embedding array<float>, label int, key long"


def brute_links(rows):
    ok = [i for i, (_, e, lab) in enumerate(rows) if lab is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ok:
        for j in ok:
            if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (i, j))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    n[i] += 1
                    n[j] += 1
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return n, [find(i) for i in range(len(rows))]


def test_lattice_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(30):
        c = rng.normal(size=24)
        for _ in range(rng.integers(1, 12)):
            rows.append([float(x) for x in np.float32(c + rng.normal(size=24) * rng.choice([0, 0.05, 0.2, 0.3]))])
    rows = [(i, e, int(i % 7 == 0)) for i, e in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [1.0, None], 0), (n + 3, [float("nan")] * 24, 0), (n + 4, rows[1][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, [], 0)]
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame([(*r, 0) for r in rows], VECTOR)).collect()}
    links, comp = brute_links(rows)
    found = sum(got[i].n_links for i in range(len(rows)))
    assert found <= sum(links) and found >= 0.95 * sum(links) and all(got[i].n_links <= links[i] for i in range(len(rows)))
    assert sum(got[i].component_id == comp[i] for i in range(len(rows))) >= 0.97 * len(rows)
    assert all(got[i].kept == (got[i].component_id == i) for i in got) and got[n + 6].component_id == n + 5


def test_lattice_takes_repeated_ids_and_no_rows(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0], 0, 0), (1, [1.0, 2.0], 0, 0), (None, [1.0, 2.0], 0, 0), (None, None, None, 0)], VECTOR)
    rows = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(d).collect()), key=str)
    assert rows == sorted([(1, 2, 1, True), (1, 2, 1, False), (None, 2, 1, False), (None, 0, None, True)], key=str)
    assert lattice.near_vectors(d.where("false")).count() == 0


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    p = lattice.decode(x)
    d = ((x - p) ** 2).sum(axis=1)
    assert all((((x - p - r) ** 2).sum(axis=1) >= d - 1e-9).all() for r in lattice.ROOTS) and len(lattice.ROOTS) == 240 and (((lattice.ROOTS) ** 2).sum(axis=1) == 2).all()


def test_recordings_align_at_their_offset(spark):
    rng = np.random.default_rng(5)
    tune = rng.normal(size=80)
    wave = media.melody(tune)
    quiet = 0.3 * wave + rng.normal(size=len(wave)) * 0.002
    rows = [(0, media.to_wav(wave)), (1, media.to_wav(quiet)), (2, media.to_wav(wave[10 * media.HOP :])), (3, media.to_wav(media.melody(rng.normal(size=80)))), (50, None), (100, b"junk"), (150, media.to_wav(np.zeros(20_000))), (200, media.to_wav(wave)), (None, media.to_wav(wave))]
    got = {r.id: r for r in media.align(media.fingerprints(spark.createDataFrame(rows, "id long, audio binary"))).collect()}
    assert set(got) == {0, 50, 100, 150, 200}
    assert got[0].n_matches == 4 and got[200].best_id == 0 and got[200].best_error == 0
    assert got[50].n_matches == got[100].n_matches == got[150].n_matches == 0
    a, b = media.fingerprint(rows[0][1]), media.fingerprint(rows[2][1])
    assert media.bit_error(a, b, 10) == 0 and media.bit_error(a, media.fingerprint(rows[3][1]), 0) > 0.3
    assert media.align(media.fingerprints(spark.createDataFrame([], "id long, audio binary"))).count() == 0


def brute_matches(prints, query):
    out = []
    for i, (_, b) in enumerate(prints):
        if i != query:
            a = prints[query][1]
            out.append(min((media.bit_error(a, b, o), abs(o), o) for o in range(1 - len(b), len(a))))
    return [x for x in out if x[0] <= media.MOST_ERROR]


def noisy(rng, x, share):
    return x ^ np.packbits(rng.random((len(x), 32)) < share, axis=1).view(np.uint32).ravel()


def check_matches(spark, prints):
    rows = {r.id: r for r in media.align(spark.createDataFrame([(i, x.astype("<u4").tobytes()) for i, x in prints], "id long, fingerprint binary").repartition(3)).collect()}
    for k, (i, _) in enumerate(prints):
        if i % media.QUERY_STRIDE == 0:
            want = brute_matches(prints, k)
            assert (rows[i].n_matches, rows[i].best_error) == (len(want), min(want)[0] if want else None), i


def test_noisy_recordings_match_as_by_brute_force(spark):
    rng = np.random.default_rng(6)
    prints = []
    for g in range(8):
        x = rng.integers(0, 2**32, rng.integers(30, 70), dtype=np.uint32)
        prints += [(len(prints) * 10, x)] + [(len(prints) * 10 + 1 + k, noisy(rng, x[k * 4 :], e)) for k, e in enumerate((0.05, 0.1, 0.15, 0.18))]
    prints += [(5000 + k, rng.integers(0, 2**32, n, dtype=np.uint32)) for k, n in enumerate((2, 3, 200))]
    check_matches(spark, prints)


def test_clips_of_loops_match_at_their_true_offset(spark):
    """A clip from a later repetition, and the loop's runs at many offsets before it."""
    rng = np.random.default_rng(11)
    prints = []
    for g in range(6):
        loop, bridge = (rng.integers(0, 2**32, n, dtype=np.uint32) for n in (4, 30))
        whole = np.concatenate([np.tile(loop, 6), bridge, np.tile(loop, 6)])
        prints += [(100 * g, whole), (100 * g + 1, noisy(rng, whole[44:], 0.08)), (100 * g + 2, np.concatenate([np.tile(loop, 3), rng.integers(0, 2**32, 20, dtype=np.uint32)]))]
    check_matches(spark, prints)


def test_pipeline_on_its_own_rules(spark):
    """Each stage's rows follow from the stage before by the brute-force rules."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, d).cache()
        old, new = ({r.doc_id: r.text for r in x.collect()} for x in (before, after)) if name != "packing" else ({}, {})
        if name != "packing":
            assert after.columns == columns and set(new) <= set(old)
        if name == "near_duplicates":
            ids = sorted(old)
            comp = brute_components([shingle_set(old[i]) for i in ids])
            assert set(new) == {i for k, i in enumerate(ids) if comp[k] == k}
        if name == "repeats":
            ids = sorted(old)
            for i, (n, removed, _, kept) in zip(ids, brute_repeats([(old[i] or "").encode() for i in ids], 100)):
                assert removed or new[i] == old[i]
                if hashlib.sha256(new[i].encode()).hexdigest() != kept:
                    assert len(new[i].encode()) >= n - removed - 8 * (1 + removed // 100)  # a character that was cut goes whole
        if name == "personal_data":
            assert all(("[" in new[i]) or new[i] == old[i] for i in new)
        if name == "packing":
            assert after.count() > 0 and after.select("doc_id").distinct().count() == before.count()
        before = after
    assert corpus_pipeline.ORACLE_SQL is None


def test_written_tables_give_back_what_the_driver_has_freed(spark):
    """Native memory that the driver's JVM frees between the writes of a long run returns to the system."""
    jvm = spark._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"
    used = lambda: int(re.search(r"RssAnon:\s+(\d+)", open(status).read())[1]) / 1024
    scratch = Scratch(spark)
    scratch.keep(spark.range(10))
    held = [jvm.java.util.zip.Deflater() for _ in range(3000)]
    for d in held[:-1]:  # the last holds the end of the C heap, which shrinks from there only
        d.end()
    before = used()
    scratch.keep(spark.range(10))
    held[-1].end()
    assert used() < before - 120
