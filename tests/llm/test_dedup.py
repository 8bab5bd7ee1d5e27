"""Operators 4, 5, 6 and 7 and the components they share, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import jaccard, lines, signs, suffixes
from tessella.llm import textbytes as tb
from tessella.llm.components import components


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("one_task", [1 << 18, 0])
def test_components(spark, monkeypatch, one_task):
    import tessella.llm.components as cc

    monkeypatch.setattr(cc, "ONE_TASK_EDGES", one_task)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(400, 440)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3), edges[0]], "a long, b long")
    got = {r.id: r.root for r in components(df).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    want = roots(nodes, [e for e in edges if e[0] != e[1]])
    assert set(got) == nodes
    assert {frozenset(n for n in nodes if got[n] == r) for r in set(got.values())} == {frozenset(n for n in nodes if want[n] == r) for r in set(want.values())}
    assert components(df.limit(0)).count() == 0


# ---- lines ----


def test_lines_by_sites(spark):
    rows = [(i, f"own line number {i}\nshared boilerplate line\nshort\n\nunder the threshold" if i < 7 else f"own {i} line here\nshared boilerplate line\nshort", f"s{i}" if i else None, 1) for i in range(9)]
    rows += [(3, rows[3][1], "s3", 1), (None, "shared boilerplate line", "s1", 1), (50, None, "s1", 1), (51, "", "s2", 1), (52, "a long line of one site only\n" * 2000, "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    sites = defaultdict(set)
    for _, t, s, _ in rows:
        for x in (t or "").split("\n"):
            if len(x) >= lines.MIN_CHARS and x.strip(" "):
                sites[x].add(s)
    bad = {x for x, s in sites.items() if len(s) >= lines.MIN_SITES}
    assert bad == {"shared boilerplate line"}
    got = lines.remove_boilerplate(df)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    want = [(i, None if t is None else "\n".join(x for x in t.split("\n") if x not in bad), s, len(t.split("\n")) if t is not None else 0, sum(x in bad for x in (t or "").split("\n"))) for i, t, s, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert lines.remove_boilerplate(df.limit(0)).count() == 0


def test_lines_far_above_and_near_the_threshold(spark):
    rows = [(s, f"everywhere it stands\nalmost everywhere\n" if s < 7 else "everywhere it stands", f"site {s}") for s in range(300)]
    found = lines.boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    want = spark.createDataFrame([("everywhere it stands",)], "x string").select(F.xxhash64("x")).first()[0]
    assert [r.h for r in found.collect()] == [want]


# ---- shingles ----


def shingle_sets(rows):
    out = []
    for _, t in rows:
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", b)
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    return out


def similar_pairs(sets):
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x and 100 * common >= 75 * (len(x) + len(sets[j]) - common) and sets[j]:
                yield j, i


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 20, 40, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, " ".join(own).upper() if rng.random() < 0.3 else "\n".join(own)))
            n += 1
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(12):
        rows.append((n, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 15, 100])))))
        n += 1
    group = [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(60):
        own = list(group)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(80)] = f"x{rng.random()}"
        rows.append((n, " ".join(own)))
        n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, " "), (n + 4, "word " * 30_000)]


@pytest.mark.parametrize(("frequent", "bits"), [(3, 28), (0, 10)])
def test_jaccard(spark, near_rows, frequent, bits):
    sets = shingle_sets(near_rows)
    want = roots(range(len(sets)), similar_pairs(sets))
    df = spark.createDataFrame([(*r, 1) for r in near_rows], "doc_id long, text string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, frequent_over=frequent, filter_bits=bits).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_jaccard_odd_ids_and_no_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (5, text), (5, "other words than those that stand above here"), (None, text + " eleven"), (None, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 6, 5), (5, 6, 5), (5, 4, 5), (None, 7, 5), (None, 0, None), (9, 0, 9)], key=str)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_jaccard_counts_links(spark, near_rows):
    rows = [*near_rows, *[(n + 10_000, t) for n, t in near_rows[::7]]]
    sets = shingle_sets(rows)
    want = dict.fromkeys(range(len(rows)), 0)
    for i, j in similar_pairs(sets):
        want[i] += 1
        want[j] += 1
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), count_links=True)
    assert {r.doc_id: r.n_links for r in got.collect()} == {rows[i][0]: n for i, n in want.items()}


def test_jaccard_of_many_copies_and_near_copies(spark):
    rng = random.Random(11)
    base, other = ([f"v{rng.randrange(3000)}" for _ in range(160)] for _ in range(2))
    rows = [(n, " ".join(base)) for n in range(20_000)]
    for group in (base[:10] + other[10:], other):
        for _ in range(1_000):
            own = list(group)
            for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7])):
                own[rng.randrange(160)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    distinct: dict[str, int] = {}
    for i, t in rows:
        distinct.setdefault(t, i)
    texts = list(distinct)
    sets = shingle_sets([(0, t) for t in texts])
    number = {w: i for i, w in enumerate(sorted({w for x in sets for w in x}))}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, x in enumerate(sets):
        has[i, [number[w] for w in x]] = 1
    common, n = has @ has.T, has.sum(1)
    a, b = np.nonzero(np.triu(100 * common >= 75 * (n[:, None] + n - common), 1))
    want = roots(range(len(sets)), zip(a.tolist(), b.tolist(), strict=True))
    at = {t: distinct[texts[want[i]]] for i, t in enumerate(texts)}
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: at[t] for i, t in rows}


def test_sets_of_one_hash_stay_apart(spark):
    rows = spark.createDataFrame([(1, 7, 100, 5), (2, 7, 200, 6), (3, 7, 100, 5), (4, 8, 300, 2), (5, 0, 0, 0)], "doc_id long, set long, k2 long, n long")
    told, classes = jaccard._untangled(rows)
    assert {r.doc_id: r.cid for r in told.collect()} == {1: 7, 2: 200, 3: 7, 4: 8, 5: 0}
    assert sorted((r.cid, r.set, r.k2, r.rep) for r in classes.collect()) == [(7, 7, 100, 1), (8, 8, 300, 4), (200, 7, 200, 2)]


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_combinations_meet_for_every_similar_pair(percent):
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(1000):
        n = int(rng.integers(2, 200 if rng.random() < 0.5 else 12))
        base = tb.mix(rng.integers(0, 1 << 62, n).astype(np.uint64))
        other = base.copy()
        change = int(rng.integers(0, n // 4 + 1))
        other[:change] = tb.mix(rng.integers(0, 1 << 62, change).astype(np.uint64))
        other = other[int(rng.integers(0, n // 3 + 1)) :]
        common = len(np.intersect1d(base, other))
        if len(other) and 100 * common >= percent * (len(base) + len(other) - common) and common < max(len(base), len(other)):
            keys = []
            for x, y in ((base, other), (other, base)):
                # a token that the other lacks may be dead, or live by a third set
                live = np.sort(x[np.isin(x, y) | (x % np.uint64(3) > 0)])
                counts = np.where(live % np.uint64(10) < 8, 9, live % np.uint64(10) - 7).astype(np.int64)
                order = np.lexsort((live, counts))
                keys.append(jaccard.combinations(live[order], counts[order], len(x), percent))
            (k1, m1), (k2, m2) = keys if len(base) <= len(other) else keys[::-1]
            assert set(k1[m1].tolist()) & set(k2.tolist())
            met += 1
    assert met > 50


def test_long_text_in_parts():
    text = ("some words that stand here " * 120_000).encode()
    h, n = tb.words([text])
    assert n.tolist() == [600_000] and (h == np.tile(h[:5], 120_000)).all()


# ---- repeated passages ----


def without_repeats(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        yield i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), bytes(x for x, g in zip(b, gone, strict=True) if not g)


@pytest.mark.parametrize("anchor_bytes", [1 << 20, 300])
def test_repeats(spark, anchor_bytes):
    rng = random.Random(6)
    letters = "ab é\n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(150, 500))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) + rng.choice(passages)[rng.randint(0, 60) :] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    rows += [(100, "a" * 1000), (101, "ab" * 300), (None, "a" * 250), (102, None), (103, ""), (104, "z" * 200), (1, rows[1][1]), (1, "different under one id " * 5), (None, passages[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, anchor_bytes=anchor_bytes).collect()], key=str)
    assert got == sorted(without_repeats(rows, 200), key=str)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_repeats_in_a_very_long_text(spark):
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    long = "".join(rng.choice("ijklmnop ") for _ in range(4_500_000)) + passage + "".join(rng.choice("qrstuvwx ") for _ in range(4_500_000)) + passage[100:]
    df = spark.createDataFrame([(1, long), (2, "x" + passage[:250])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(df).collect()}
    assert got == {1: (9_000_700, 700, 2), 2: (251, 250, 1)}


def test_family_of_suffix_arrays(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 50)
    rng = random.Random(2)
    bases = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(6)]
    family, pieces = suffixes.Family(20, 64), []
    for _ in range(400):
        own = bytearray(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(b"abc\0")
        piece = bytes(own[rng.randint(0, 20) :])
        pieces.append((piece, family.add(piece, False)))
    family.flush()
    seen = Counter(p[i : i + 20] for p, _ in pieces for i in range(len(p) - 19))
    assert all(bool(family.repeated[at + i]) == (seen[p[i : i + 20]] > 1) for p, at in pieces for i in range(len(p) - 19))
    ranks = [level.rank for level in family.levels]
    assert ranks == sorted(set(ranks), reverse=True) and sum(len(level.order) for level in family.levels) == len(seen)
    for level in family.levels:
        keys = family.keys(level.order)
        assert (keys[1:] > keys[:-1]).all()


def test_pieces_of_long_texts_cover_every_window(monkeypatch):
    monkeypatch.setattr(suffixes, "_PART", 700)
    text = bytes(random.Random(1).choice(b"abcd ") for _ in range(5000))
    _, start, size, _, _ = suffixes.pieces([text])
    windows = sorted(w for s, n in zip(start, size, strict=True) for w in range(s, s + n - 199))
    assert windows == list(range(5000 - 199))


# ---- embeddings ----


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    vectors = [(i, (centres[i % 12] + rng.normal(size=32) * rng.choice([0.05, 0.2, 0.35])).astype(np.float32).tolist()) for i in range(150)]
    vectors += [(200 + i, vectors[0][1]) for i in range(20)] + [(300, [2 * x for x in vectors[0][1]])]
    odd = [(400, None), (401, [0.0] * 32), (402, [float("nan")] * 32), (403, [float("inf")] * 32), (404, [None] * 32), (405, []), (406, [1.0, 2.0]), (407, [1.0, 2.0])]
    df = spark.createDataFrame([(*v, 1, "x") for v in [*vectors, *odd]], "vec_id long, embedding array<float>, label int, kept string")
    x = np.array([v for _, v in vectors])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= signs.COSINE
    ids = [i for i, _ in vectors]
    want = roots(ids, [(ids[a], ids[b]) for a in range(len(ids)) for b in range(a) if close[a, b]])
    full = {i: (int(close[k].sum()) - 1, want[i], want[i] == i) for k, i in enumerate(ids)}
    full |= {i: (0, i, True) for i in range(400, 406)} | {406: (1, 406, True), 407: (1, 406, False)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in signs.near_duplicates(df).collect()}
    assert got == full
    assert signs.near_duplicates(df.limit(0)).count() == 0


def test_very_large_and_small_embeddings(spark):
    rows = [(1, [1e200, 2e200, 0.0]), (2, [1e200, 2e200, 1e190]), (3, [1e-200, 0.0, 0.0]), (4, [2e-200, 0.0, 0.0]), (5, [5e-324, 0.0, 0.0]), (6, [0.0, 1.7e308, 0.0])]
    df = spark.createDataFrame([(str(i), v) for i, v in rows], "vec_id string, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in signs.near_duplicates(df).collect()}
    assert got == {"1": (1, "1"), "2": (1, "1"), "3": (2, "3"), "4": (2, "3"), "5": (2, "3"), "6": (0, "6")}


def test_plan_keeps_its_promise():
    for n in (2, 500, 10**6, 10**9, 10**12):
        bits, tables, most = signs.plan(n)
        same = 1 - np.arccos(signs.COSINE) / np.pi
        assert (1 - same**bits) ** tables <= signs.MISS and most < min(signs.SKETCH, bits * tables)
        assert n / 2**bits <= 32


def test_kept_hash_of_the_query_is_that_of_the_bytes(spark):
    df = spark.createDataFrame([(b"abc",)], "kept binary")
    assert df.select(F.sha2("kept", 256)).first()[0] == hashlib.sha256(b"abc").hexdigest()
