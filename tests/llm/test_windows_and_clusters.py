"""Decontamination, delta Lloyd and periodic runs against brute force, with odd rows and tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, delta_lloyd, periodic

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- decontamination


def brute_leaks(docs, bench, window=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    grams: dict = {}
    for item, text in bench:
        words = words_of(text)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            grams.setdefault(tuple(words[i : i + k]), set()).add(item)
    out = []
    for doc_id, text in docs:
        words = words_of(text)
        hit, items = set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(words) - k + 1):
                if (found := grams.get(tuple(words[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    items |= found
        items = sorted(str(i) for i in items if i is not None)
        out.append((doc_id, len(words), len(hit), len(items), sha(",".join(items)), bool(hit)))
    return out


ITEM = "the quick brown fox jumps over the lazy dog and then it sleeps for a while in the sun"
BENCH = [(1, ITEM), (2, "Short Item!"), (3, None), (4, "..."), (None, "one two three four"), (2, "another text of the same id"), (10, ITEM + " again"), (5, "x")]
DOCS = [
    (1, "no overlap at all"), (2, ITEM.upper().replace(" ", " -- ")), (3, None), (4, ""), (5, "some words before " + ITEM + " and some behind it"),
    (6, " ".join(ITEM.split()[:9])), (7, " ".join(ITEM.split()[:10])), (8, "a SHORT, item; here one two three four"), (9, ITEM), (9, ITEM + " again x x"), (None, ITEM),
    (11, "Übung macht den x-Meister"), (12, ("filler word " * 40_000) + ITEM + (" filler word" * 10_000)), (13, "short"), (14, "item"),
]


@pytest.mark.parametrize("part_words", [decontaminate.PART_WORDS, 12])
def test_decontamination_matches_brute_force(spark, part_words):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.digests(docs, bench, part_words=part_words).collect()), key=str)
    assert got == sorted(brute_leaks(DOCS, BENCH), key=str)


def test_decontamination_of_long_items_in_pieces(spark, monkeypatch):
    """An item longer than a piece loses no window at a piece's end."""
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    item = " ".join(f"w{i}" for i in range(60))
    bench = [(1, item), (2, " ".join(f"w{i}" for i in range(20, 31)))]
    docs = [(i, " ".join(f"w{j}" for j in range(i, i + 10))) for i in range(51)] + [(99, " ".join(f"w{j}" for j in range(51, 60)))]
    got = decontaminate.digests(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), part_words=20)
    assert sorted(map(tuple, got.collect())) == sorted(brute_leaks(docs, bench))


def test_decontamination_tells_colliding_hashes_apart(spark, monkeypatch):
    """With all hashes equal the bytes decide."""
    monkeypatch.setattr(decontaminate, "gram_hashes", lambda words, k: np.zeros(max(0, len(words) - k + 1), np.uint64))
    part = decontaminate.build_part([("1", "a b c d"), ("2", "b c d e"), ("3", "a b c d")], 3)
    assert [len(g.hashes) for g in part.grams.values()] == [3]
    data = np.frombuffer(b"a b c x b c d e", np.uint8)
    words, spans, items = decontaminate.scan_step(data, np.array([0, len(data)]), part)
    assert words.tolist() == [8] and spans == [[(0, 3), (4, 8)]] and items == [["1", "2", "3"]]


def test_decontamination_removes_spans_or_documents(spark):
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in DOCS], "doc_id long, text string, words int, `spans` string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontaminate.scan(docs, bench)
    assert found.columns == ["doc_id", "text", "words", "spans", "words_", "spans_", "items"]  # names of docs are left alone
    hit = {str(r[:1]) for r in brute_leaks(DOCS, BENCH) if r[5]}
    clean = decontaminate.decontaminate(docs, bench, "documents")
    assert clean.columns == docs.columns and clean.count() == sum(str(r[:1]) not in hit for r in DOCS)
    cut = decontaminate.decontaminate(docs, bench)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and cut.count() == len(DOCS) and cut.schema == docs.schema
    assert texts[5] == "some words before  and some behind it" and texts[1] == "no overlap at all" and texts[3] is None and texts[8] == "a , here " or texts[8] == "a ; here "
    assert decontaminate.digests(cut, bench).filter("contaminated").count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, "lines")


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame(DOCS[:3], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.digests(docs.limit(0), bench).count() == 0
    none = decontaminate.digests(docs, bench.limit(0)).collect()
    assert [(r.n_words > 0, r.n_hit, r.n_items, r.contaminated) for r in sorted(none, key=lambda r: r.doc_id)] == [(True, 0, 0, False)] * 2 + [(False, 0, 0, False)]


# ---------------------------------------------------------------- clustering


def brute_lloyd(rows, k, rounds, seed, dims, scale=256):
    """Plain Lloyd in Python's whole numbers: (vec_id, cluster, distance) sorted, and the centroids."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((sha(f"{seed}:{'' if i is None else i}"), q) for i, q in kept)[:k]
    centroids = [q for _, q in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds):
        owners = assign()
        for n in range(len(centroids)):
            own = [q for (_, q), (_, o) in zip(kept, owners, strict=True) if o == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, o, d) for (i, _), (d, o) in zip(kept, assign() if kept else [], strict=True)), key=str), centroids


@pytest.mark.parametrize("k,rounds", [(7, 4), (3, 0), (500, 2)])
def test_delta_lloyd_matches_brute_force(spark, k, rounds):
    rng = np.random.default_rng(k)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.integers(0, 90, 120), np.round(rng.normal(0, 1, (120, 5)), 1), strict=True)]
    rows += [(200, None), (201, [1.0] * 4), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [0.5] * 5), (205, [3e3, -3e3, 0.0, 0.0, 1e-9])] + rows[:9]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, q string").repartition(4)
    found, centroids = delta_lloyd.cluster(df, k, rounds, 2, dims=5)
    want, want_centroids = brute_lloyd(rows, k, rounds, 2, 5)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want and centroids.tolist() == want_centroids
    whole = delta_lloyd.digests(df, k=k, rounds=rounds, dims=5).collect()
    assert {r.inertia for r in whole} == {sum(d for _, _, d in want)} and len(whole) == len(want)
    assert {(r.cluster, r.centroid_sha256) for r in whole} == {(o, sha(",".join(map(str, want_centroids[o])))) for _, o, _ in want}


def test_delta_lloyd_compares_only_what_changed():
    """Owners by changes equal owners by all distances, whatever moved; huge components stay exact."""
    rng = np.random.default_rng(1)
    for most in (3, 1 << 27):
        q, c = rng.integers(-most, most, (300, 6)), rng.integers(-most, most, (9, 6))
        owner, distance = delta_lloyd.reassign(q, np.full(300, -1), np.zeros(300, np.int64), c, np.arange(9))
        for changed in ([], [2], [0, 5, 8]):
            c[changed] = rng.integers(-most, most, (len(changed), 6))
            owner, distance = delta_lloyd.reassign(q, owner, distance, c, np.array(changed, np.int64))
            exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in q]
            assert distance.tolist() == [min(e) for e in exact] and owner.tolist() == [e.index(min(e)) for e in exact]


def test_delta_lloyd_of_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert delta_lloyd.digests(df).count() == 0 and delta_lloyd.cluster(df.limit(0), dims=1)[0].count() == 0
    same = spark.createDataFrame([(i, [1e300, -1e300]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {(r.cluster, r.distance) for r in delta_lloyd.cluster(same, 3, dims=2)[0].collect()} == {(0, 0)}  # held at MOST, ties to the first


# ---------------------------------------------------------------- periodic runs


def brute_runs(words, power=4, least=6):
    n, runs = len(words), []
    for p in range(1, n // power + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            stretch = words[start : i + p]
            if len(stretch) >= max(least, power * p) and not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                runs.append((start, len(stretch), p))
    return sorted(runs, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 9)), max_size=7), st.sampled_from([(4, 6), (2, 1), (3, 5)]))
def test_runs_match_brute_force(parts, bounds):
    words = [w for part, times in parts for w in part * times]
    w = periodic.numbered([x.encode() for x in words])
    assert periodic.find_runs(w, *bounds) == brute_runs(words, *bounds)


def test_runs_of_long_texts_in_small_steps(monkeypatch):
    rng = np.random.default_rng(2)
    words = [str(x) for x in rng.integers(0, 2, 700)] + ["a", "b", "a"] * 90 + [str(x) for x in rng.integers(0, 300, 500)] * 4 + ["z"] * 300
    want = brute_runs(words)
    assert (970, 2000, 500) in want and len(want) > 5
    for pairs, chunk in ((1 << 20, 64), (50, 1)):
        monkeypatch.setattr(periodic, "PAIRS", pairs)
        monkeypatch.setattr(periodic, "CHUNK", chunk)
        assert periodic.find_runs(periodic.numbered([w.encode() for w in words])) == want
    flat = np.zeros(200_000, np.int32)  # one run, and no work for the multiples of its period
    assert periodic.find_runs(flat) == [(0, 200_000, 1)]


def brute_digest(doc_id, text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


def test_periodic_query_matches_brute_force(spark):
    odd = [(i, t) for i, t in [(None, "a b " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "x y x y " * 4), (4, "x " * 6), (5, "one two"), (6, "\x1c " * 7)]]
    odd += [(i, " ".join(str(j % 7) for j in range(i))) for i in range(200, 260)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").repartition(3)
    got = periodic.digests(periodic.with_loops(docs)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((brute_digest(*r) for r in odd), key=str)
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in real.collect() if len((r.text or "").split()) < 800]
    got = {r.doc_id: tuple(r) for r in periodic.digests(periodic.with_loops(real)).collect()}
    assert len(got) == real.count() and all(got[r[0]] == brute_digest(*r) for r in rows) and sum(r[1] > 0 for r in got.values()) > 5


def test_periodic_runs_leave_other_columns_alone(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b", "r", 2)], "doc_id long, text string, Runs string, best int")
    found = periodic.periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "Runs", "best", "runs_", "best_", "collapsed"]
    row = found.first()
    assert row.collapsed == "a b" and [tuple(r) for r in row.runs_] == [(0, 6, 1)] and tuple(row.best_) == (0, 6, 1) and row.Runs == "r"
    assert periodic.periodic_runs(docs.limit(0)).count() == 0 and found.filter(F.size("runs_") == 1).count() == 1
