"""The ten training-data operators against brute-force versions, round trips and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import _common, curriculum, exact_dedup, html_text, langid, license_scan, minhash, mpeg, packing, pii, url_filter
from weftgraph.llm._common import Scratch, heavy_keys

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, entry string, hash string"

TEXTS = [
    None,
    "",
    " \t\n\x0b",
    "...!?",
    "one",
    "a b c d",
    "a b c d e",
    "A  b\tc d e",
    "a b c d e",
    "the quick brown fox jumps over the lazy dog and runs away from it all day long " * 3,
    "the quick brown fox jumps over the lazy dog and runs away from it all day long " * 3 + "end",
    "the quick brown fox jumps over the lazy cat and runs away from it all day long " * 3,
    "Released under the MIT License. mit license MIT\x85LICENSE mit license mit license",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. cc by cc-by CC BY apache license",
    "mail a.b@c.de, x@y, p.q@mail4.example.com. +1 (017) 555-7713 1.2.3.4 300.1.1.1 4532015112830366 1.2.3.4.5 a@@b.c",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ssn 123-45-6789',
    "größe übermäßig straße 漢字 𝒳 " * 5,
    "wort " * 30000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "ä"][i % 4], 0, i, "x", "y") for i, t in enumerate(TEXTS)]
    words = [f"w{i}" for i in range(80)]
    for i in range(100, 160):
        base = rows[-1][1] if i % 3 and i > 100 else " ".join(rng.choice(words) for _ in range(60))
        parts = base.split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append((i, " ".join(parts), "en", "a", 0, i, "x", "y"))
    rows += [rows[5], rows[9], rows[9], (None, "a b c d e", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = []
    for i, t in rows:
        keep = min(groups[bare(t)])[3]
        want.append((i, keep, len(groups[bare(t)]), i == keep, hashlib.sha256(bare(t).encode()).hexdigest()))
    return sorted(want, key=repr)


@pytest.mark.parametrize("bits,size", [(64, 64 << 20), (64, 500), (1, 100), (7, 100)])
def test_exact_dedup_matches_brute_force(docs, bits, size):
    got = exact_dedup.exact_dedup(docs, bucket_bytes=size, hash_bits=bits).drop("keep_chars")
    assert rows_of(got) == brute_exact(docs.select("doc_id", "text").collect())


def test_exact_dedup_flushes_keep_hot_texts(spark, monkeypatch):
    rows = [(i, ["hot  text", "hot text", f"own {i}"][i % 3]) for i in range(400)]
    batches = [pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows[k : k + 50]]) for k in range(0, 400, 50)]
    monkeypatch.setattr(exact_dedup, "FLUSH_BYTES", 3000)
    out = pa.Table.from_batches(exact_dedup._pages(iter(batches), 64)).to_pylist()
    entries = [r for r in out if r["text"] is not None]
    assert len(out) - len(entries) == 400 and len({r["entry"] for r in entries}) == len(entries)
    assert [(r["size"], r["doc_id"], r["chars"]) for r in entries if r["text"] == b"hottext"] == [(267, 0, 9)]


def test_exact_dedup_keeps_one_row_of_each_text(docs, empty):
    kept = exact_dedup.keep_exact(docs)
    assert kept.columns == docs.columns
    texts = [bare(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == docs.rdd.map(lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text or "")).distinct().count()
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_exact(empty).count() == 0


def test_keep_exact_with_repeated_ids(spark):
    """Ids that repeat with other texts, rows that repeat as they are, and null ids."""
    rng = random.Random(8)
    rows = [(1, "aa"), (1, "bb  longer text"), (0, "bblonger text    "), (1, "aa"), (1, "a a"), (None, "aa  "), (None, "zz"), (None, "zz"), (None, None), (3, ""), (3, None)]
    rows += [(rng.choice([1, 2, None]), rng.choice(["x y", "xy", "x  y", "p", None, "q q"])) for _ in range(60)]
    df = spark.createDataFrame([(i, t, n, "k", 1) for n, (i, t) in enumerate(rows)], "doc_id long, text string, exact_key int, row_no string, stay_key int")
    assert rows_of(exact_dedup.exact_dedup(df).drop("keep_chars")) == brute_exact(rows)
    kept = exact_dedup.keep_exact(df)
    assert kept.columns == df.columns
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0))
    got = sorted((bare(r.text), -len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == sorted((b, *min(g)) for b, g in groups.items())


def test_directory_decides_where_keys_live(spark):
    """Buckets are split until they fit, deeper where the hashes crowd, and a split moves keys to the new bucket's file."""
    codes = np.array([k << 60 for k in range(16)] + [(5 << 60) + (k << 30) for k in range(1, 9)] + [7] * 50, np.uint64)

    def measure(directory, todo):
        found = {}
        for number, code in zip(directory.bucket(codes).tolist(), codes.tolist(), strict=True):
            if number in todo:
                local = int(directory.local[number])
                bits = min(exact_dedup.ROUND_BITS, 64 - local)
                found.setdefault((number, (code << local & (1 << 64) - 1) >> 64 - bits), []).append(code)
        return {k: (len(v), min(v) < max(v)) for k, v in found.items()}

    directory = exact_dedup.grow_directory(measure, 3)
    home = directory.bucket(codes)
    for number in range(len(directory.starts)):
        inside = codes[home == number]
        assert len(inside) <= 3 or len(set(inside.tolist())) == 1
    assert directory.depth > 30 and len(directory.starts) < 100
    small = exact_dedup.grow_directory(lambda d, todo: {(0, 0): (2, True), (0, 1): (2, True), (0, 12): (3, True)}, 4)
    assert small.depth == 1 and small.slots() == [0, 1]
    small.split(1, 2)
    assert small.depth == 3 and small.slots() == [0, 0, 0, 0, 1, 2, 3, 4]

    scratch = Scratch(spark, "test")
    rows = [(i, len(str(i)), i, (i * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63), 1, f"text {i}".encode()) for i in range(300)]
    entries = spark.createDataFrame(rows, "doc_id long, chars long, entry long, hash long, size long, text binary")
    directory, index = exact_dedup.build_index(entries, scratch, 2000)
    lives = {r.entry: r.bucket for r in index.collect()}
    want = directory.bucket(np.array([r[3] + (1 << 63) for r in rows], np.uint64))
    assert lives == {r[2]: int(b) for r, b in zip(rows, want, strict=True)} and len(set(lives.values())) > 10
    files = {r.f for r in index.select(F.input_file_name().alias("f")).distinct().collect()}
    assert sorted(int(re.search(r"bucket=(\d+)", f)[1]) for f in files) == sorted(set(lives.values()))  # one file a bucket
    before, plain = exact_dedup.build_index(entries, Scratch(spark, "test"), 4000)  # a folder of its own, as index is read again
    assert len(before.starts) < len(directory.starts) and rows_of(plain.drop("bucket")) == rows_of(index.drop("bucket"))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(url_filter._FOLD))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_near_dedup_matches_brute_force(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingles(t)
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    where = components(sets, links)
    want = [(i, len(shingles(t)), where.get(i), i is None or where[i] == i) for i, t in rows]
    assert rows_of(minhash.near_dedup(docs)) == sorted(want, key=repr)
    assert len(links) > 10
    assert minhash.near_dedup(empty).count() == 0
    kept = minhash.keep_near(docs)
    assert kept.columns == docs.columns and kept.count() == sum(w[3] for w in want)


def test_near_dedup_with_hot_keys_and_repeated_ids(spark, monkeypatch):
    """Leaders, shingles, classes and hubs that are dealt to many blocks, families near the threshold, ids with several texts."""
    monkeypatch.setattr(minhash, "heavy_keys", lambda sizes, keys, rows, total: heavy_keys(sizes, keys, rows, total, 2, 0))
    monkeypatch.setattr(_common, "is_small", lambda df: False)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(90)]
    rows = [(i, " ".join(base)) for i in range(12)]
    for i in range(12, 60):
        parts = list(base)
        for k in rng.sample(range(90), rng.choice([1, 2, 3, 4])):
            parts[k] = f"n{i}x{k}"
        rows.append((i, " ".join(parts)))
    rows += [(70 + i, " ".join(base[:40] + [f"q{i}y{k}" for k in range(12)])) for i in range(20)]
    rows += [(95, "one two three four five six"), (96, "one two three four five six"), (96, "seven eight nine ten eleven twelve"), (97, "seven eight nine ten eleven twelve")]
    rows += [(None, " ".join(base)), (98, "")]
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    links = [(a, b) for a, b in itertools.combinations([i for i in sets if i is not None], 2) if any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])]
    where = components([i for i in sets if i is not None], links)
    want = [(i, len(shingles(t)), where.get(i), i is None or where[i] == i) for i, t in rows]
    assert where[97] == 95 and len({where[i] for i in range(70, 90)}) > 5
    assert rows_of(minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(want, key=repr)


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.int64).astype(np.uint64)
    a, b = pool[:1000], pool[250:1250]
    sig = minhash.signatures([np.sort(a), np.sort(b)])
    assert abs((sig[0] == sig[1]).mean() - 750 / 1250) < 0.15
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash._pi(x.copy()))) == len(x)


def test_bridged_components_are_found(spark):
    """b links a and c that do not link with each other, and c's bucket leader is a."""
    rng = random.Random(2)
    base = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(40):
        start = i * 7
        rows.append((i, " ".join(base[start : start + 120])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(docs).collect()}
    assert set(got.values()) == {0}


def test_mix_targets_and_bounds(docs, empty):
    rows = curriculum.mix(docs, bins=16).collect()
    sizes = {(r.doc_id, r.size) for r in rows}
    want = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in docs.select("doc_id", "text").collect()}
    assert sizes == want and len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
        by.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), members in by.items():
        assert abs(sum(m.taken for m in members) - target) <= max(m.size for m in members)
    assert rows_of(curriculum.mix(docs, bins=16)) == rows_of(curriculum.mix(docs.repartition(5), bins=64))
    assert curriculum.mix(empty).count() == 0 and curriculum.keep_mix(empty).count() == 0


def test_targets_fill_by_weight(spark):
    def brute(sizes):
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        total, fixed = sum(sizes.values()), {}
        while True:
            free = [s for s in names if s not in fixed]
            rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
            over = [s for s in free if rest * weight[s] / w > 3 * sizes[s]]
            if not over:
                return fixed | {s: rest * weight[s] / w for s in free}
            fixed |= {s: 3 * sizes[s] for s in over}

    for seed in range(6):
        rng = random.Random(seed)
        sizes = {s: rng.choice([0, 1, 10, 1000, 100000]) for s in ["a", "b", "B", "é", None, "z", "c"][: 2 + seed]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in curriculum.targets(df).collect()}
        if sum(sizes.values()):
            assert got == pytest.approx(brute(sizes))


def test_keep_mix_repeats_rows_in_order(docs):
    kept = curriculum.keep_mix(docs, bins=16)
    assert kept.columns == docs.columns
    times = {}
    for r in kept.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    copies = {}
    occurs = {}
    for r in curriculum.mix(docs, bins=16).collect():
        copies[r.doc_id] = max(copies.get(r.doc_id, 0), r.copies)
        occurs[r.doc_id] = occurs.get(r.doc_id, 0) + 1
    assert times == {i: c * occurs[i] for i, c in copies.items() if c}


def test_buckets_are_optimal():
    for seed in range(20):
        rng = random.Random(seed)
        histogram = {rng.randrange(1, 40): rng.randrange(1, 9) for _ in range(9)}
        lengths = sorted(histogram)

        def padding(bounds, histogram=histogram):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in histogram.items())

        for k in (1, 2, 3, 4):
            best = min(padding((*inner, lengths[-1])) for n in range(k) for inner in itertools.combinations(lengths[:-1], n))
            got = packing.optimal_buckets(histogram, k)
            assert len(got) <= k and padding(got) == best
    assert packing.optimal_buckets({}, 3) == []


def test_pack_keeps_every_word_under_the_budget(docs, empty):
    rows = packing.pack(docs, max_len=50, buckets=4, budget=400, bins=8).collect()
    want = sum(len((t or "").translate({0x0B: " "}).split(" ")) * 0 + len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for (t,) in docs.select("text").collect())
    assert sum(r.n_tokens for r in rows) == want
    batches = {}
    for r in rows:
        assert 0 <= r.n_tokens <= r.bucket and r.padding == r.bucket - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r.slot)
    for (width, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= max(1, 400 // max(1, width))
    for width in {w for w, _ in batches}:
        numbers = sorted(b for w, b in batches if w == width)
        assert numbers == list(range(len(numbers))) and all(len(batches[width, b]) == 400 // max(1, width) for b in numbers[:-1])
    assert packing.pack(empty).count() == 0


def test_pack_matches_its_sql(spark, docs, tmp_path):
    import duckdb

    docs.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    columns = "doc_id, copy, part, n_tokens, bucket, batch, slot, padding"
    for setting in ({"max_len": 50, "buckets": 4, "budget": 400, "bins": 8}, {"max_len": 7, "buckets": 16, "budget": 20, "bins": 3}):
        want = con.execute(f"SELECT {columns} FROM ({packing.oracle(**setting)})").fetchall()
        assert rows_of(packing.pack(docs, **setting)) == sorted(want, key=repr)


def test_every_language_is_learned_and_ties_go_to_the_first(spark):
    """300 languages, some with one row only, each of letters of its own; the sample's bounds leave none out."""
    letters = [[chr(0x4E00 + 12 * lang + j) for j in range(12)] for lang in range(300)]
    rows = []
    for i in range(3900):
        lang = i % 300 if i < 3600 else i % 7
        rows.append((i, " ".join("".join(letters[lang][(i + 5 * j + m * m) % 12] for m in range(4)) for j in range(4)), f"l{lang:03d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for bounds in ({}, {"rows_in_all": 600}):
        model = langid.train(df, **bounds)
        assert model.languages == [f"l{i:03d}" for i in range(300)] and model.starts[-1] == len(model.weights)
        got = langid.identify(df, model=model).collect()
        right = {r.doc_id for r in got if r.held_out and r.lang_pred == rows[r.doc_id][2]}
        held = [r.doc_id for r in got if r.held_out]
        assert {rows[i][2] for i in held if i not in right} != {rows[i][2] for i in held} and len(right) >= 0.9 * len(held)
    one = langid.train(df.filter("doc_id % 300 > 5 or doc_id < 300"), sample=1, columns_in_all=1)
    assert len(one.languages) == 300
    flat = langid.Model.of(["a", "b"], np.zeros((langid.DIMS, 2)), np.zeros(2), 1.0)
    assert {(r.lang_pred, r.score) for r in langid.identify(df.limit(5), model=flat).collect()} == {("a", 0.5)}
    dense = np.random.default_rng(0).normal(size=(langid.DIMS, 3)) * (np.arange(langid.DIMS)[:, None] % 7 == 0)
    assert np.allclose(langid.Model.of(["a", "b", "c"], dense, np.zeros(3), 1.0).block(1, 3), dense.T[1:], atol=1e-6)


def test_repeated_ids_do_not_fill_the_sample(spark):
    """The draw is by id and text: of many rows with one id only a share is taken."""
    rows = [(1, f"text number {i}", "x") for i in range(3000)] + [(2, f"wort {i}", "y") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    draws = df.select(langid._digest(F.lit(7), F.col("text")).alias("d"))
    assert 200 < draws.filter("d < 0.1").count() < 1000 and langid.train(df, sample=50).languages == ["x", "y"]


def test_ftrl_leaves_weights_at_zero_and_learns():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        y = i % 3
        cols = np.unique(np.concatenate([[y * 5 + int(rng.integers(0, 5))], rng.integers(100, 400, 6)])).astype(np.int32)
        rows.append((y, cols, np.ones(len(cols), np.float32)))
    w, bias = langid.fit_ftrl(rows, 3, l1=1.0)
    counts = [(langid.fit_ftrl(rows, 3, l1=l1)[0] != 0).sum() for l1 in (0.0, 1.0, 3.0)]
    assert counts[0] > counts[1] > counts[2] > 0  # a stronger penalty leaves fewer weights
    assert sum(int(np.argmax(x @ w[cols] + bias)) == y for y, cols, x in rows) >= 0.99 * len(rows)


def test_language_held_out_accuracy(spark, docs, empty):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(real).join(real.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[3] == "und" and odd[4] in ("en", "de")
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("lang is null").count() == 0
    assert kept.count() == sum(any(map(str.isalpha, t or "")) for (t,) in docs.select("text").collect())


def test_language_uses_no_row_that_is_held_out(spark):
    rows = [(i, "aaa bbb" if zlib.crc32(str(i).encode()) % 5 else "zzz", "x" if zlib.crc32(str(i).encode()) % 5 else "y") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(df).languages == ["x"]
    assert langid.train(df.filter("lang = 'y'")) is None
    assert {r.lang_pred for r in langid.identify(df.filter("lang = 'y'")).collect()} == {"und"}


def test_temperature_calibration_lowers_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 500)
    logits = rng.normal(size=(500, 3))
    logits[np.arange(500), y] += 1
    assert langid.calibrate(logits * 5, y) == pytest.approx(5 * langid.calibrate(logits, y), rel=0.01)


def test_license_base_matches_brute_force(docs, empty):
    found, spans = license_scan.scan(docs)
    want = []
    for i, t in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(url_filter._FOLD))
        places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        want.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    got = found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows_of(got) == sorted(want, key=repr)
    labels = {r.doc_id: set(r.labels.split(",")) for r in found.collect()}
    assert {"gpl", "gpl-3"} <= labels[13] and {"cc-by", "cc-by-nc-4.0", "apache"} <= labels[14]
    assert license_scan.scan(empty)[0].count() == 0


def test_license_text_with_edits_is_found(spark):
    text = license_scan.TEMPLATES[8][0].split()
    edited = text[:20] + ["really"] + text[20:40] + text[41:]
    rows = [(1, "x y z " + " ".join(edited) + " tail"), (2, " ".join(text[:8])), (3, "of the software and the rights to use")]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    assert found[1].labels == "mit" and 0.6 <= found[1].score <= 1 and found[1].n_base == 0
    assert found[2].labels == found[3].labels == ""


def test_license_labels_match_brute_force(spark):
    """Method labels by a plain alignment: grams by words, diagonals merged across half a template, words covered, a gram of its own."""
    gnu = "Licensed under the GNU General Public License"
    mit = license_scan.TEMPLATES[8][0].split()
    long2 = next(t for t, label in license_scan.TEMPLATES if label == "gpl-2" and len(t) > 100)
    texts = [f"{gnu}, version 2", f"{gnu}, version 3.", f"{gnu}.", f"{gnu} version 4", long2, long2.replace("version 2", "version 3"), long2.replace("version 2", "version 9")]
    texts += [" ".join(mit[:25] + "four words come here".split() + mit[25:]), " ".join(mit[:25] + ["w"] * 40 + mit[25:]), " ".join(mit[:20]), " ".join(mit * 3)]
    texts += ["Licensed under CC BY-NC 4.0", "licensed under cc by sa 4.0 and licensed under cc by nc 4.0", "Licensed under the Apache Licence, Version 2.0", "Released under the MIT License", "x", "", None]
    texts += ["licensed under the changed General Public License, version 3", "This work is licensed under a Creative Commons Attribution 4.0 International License"]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(url_filter._FOLD))

    everything = []
    for t, label in license_scan.TEMPLATES:
        w = words(t)
        k = 3 if len(w) <= 14 else 5
        everything.append((w, k, label, [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]))

    def own(grams, label, g):
        return not any(name != label and 3 * len(set(grams) & set(others)) >= len(set(grams)) and g in others for _, _, name, others in everything)

    def told(template, k, qs):
        """The first entry of phrases that the template has: every two neighbours of each stand in one matched gram."""
        for entry in license_scan.NEEDED:
            found = [[(i, p.split()) for i in range(len(template)) if template[i : i + len(p.split())] == p.split()] for p in entry]
            if all(found):
                at = [places[0] for places in found]
                return all(any(q <= lo and hi <= q + k for q in qs) for i, p in at for lo, hi in ([(i, i + 1)] if len(p) == 1 else [(i + j, i + j + 2) for j in range(len(p) - 1)]))
        return True

    want = []
    for i, t in enumerate(texts):
        w = words(t)
        labels = {label for phrase, label in license_scan.BASE if any(w[j : j + len(phrase.split())] == phrase.split() for j in range(len(w)))}
        for template, k, label, grams in everything:
            diagonals = {}
            for p in range(len(w) - k + 1):
                for q in range(len(grams)):
                    if tuple(w[p : p + k]) == grams[q]:
                        diagonals.setdefault(p - q, set()).add(q)
            groups, last = [], None
            for d in sorted(diagonals):
                if last is None or d - last > max(3, len(template) // 2):
                    groups.append(set())
                groups[-1] |= diagonals[d]
                last = d
            for qs in groups:
                covered = {x for q in qs for x in range(q, q + k)}
                if len(covered) >= 0.6 * len(template) and any(own(grams, label, grams[q]) for q in qs) and told(template, k, qs):
                    labels.add(label)
        want.append((i, ",".join(sorted(labels))))
    found = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[0]
    assert rows_of(found.select("doc_id", "labels")) == sorted(want, key=repr)
    got = dict(want)
    assert [got[i] for i in range(5)] == ["gpl,gpl-2", "gpl,gpl-3", "gpl", "gpl", "gpl,gpl-2"] and got[5] == "gpl,gpl-3" and got[6] == "gpl"
    assert got[7] == got[10] == "mit" and got[8] == got[9] == "" and "apache-2.0" in got[13]


NOT_LABELLED = [
    ("Released under the BSD license", "mit-notice"), ("Released under the Apache license", "mit-notice"), ("released under the zlib license", "mit-notice"), ("Released under the Mitt License", "mit-notice"),
    ("Licensed under the Apache License, Version 1.1", "apache-2.0"), ("Licensed under the Apache License, Version 3.0", "apache-2.0"), ("Licensed under the Foo License, Version 2.0", "apache-2.0"),
    ("Licensed under the Mozilla License, Version 2.0", "apache-2.0"), ("Licensed under the Eclipse Public License, Version 2.0", "apache-2.0"), ("licensed under the Apache License", "apache-2.0"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-4.0"), ("Licensed under CC BY-NC-SA 4.0", "cc-by-sa-4.0"), ("Licensed under CC BY-NC-ND 4.0", "cc-by-nc-4.0"), ("Licensed under CC BY-NC 3.0", "cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 3.0", "cc-by-sa-4.0"), ("Licensed under CC BY-SA 4.0", "cc-by-nc-sa-4.0"), ("Licensed under CC BY-ND 4.0", "cc-by-nc-4.0"), ("Licensed under CC 0 4.0", "cc-by-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-4.0"), ("This work is licensed under a Creative Commons Attribution 3.0 International License", "cc-by-4.0"),
    ("licensed under the GNU Lesser General Public License, version 3", "gpl-3"), ("licensed under the GNU Affero General Public License, version 3", "gpl-3"), ("licensed under the GNU General Public License, version 1", "gpl-2"),
    ("licensed under the GNU Free Documentation License, version 3", "gpl-3"), ("licensed under the Affero General Public License, version 2", "gpl-2"), ("licensed under the GNU Library General Public License", "lgpl"),
]


def test_licenses_are_told_from_their_relatives(spark):
    rows = [(i, f"before {t} behind") for i, (t, _) in enumerate(NOT_LABELLED)] + [(100 + i, f"before {t} behind") for i, (t, _) in enumerate(license_scan.TEMPLATES)]
    found = {r.doc_id: set(r.labels.split(",")) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()}
    for i, (t, label) in enumerate(NOT_LABELLED):
        assert label not in found[i], t
    for i, (t, label) in enumerate(license_scan.TEMPLATES):
        assert label in found[100 + i] and found[100 + i] - {label} <= {"gpl", "apache", "cc-by", "mit"}, (t, found[100 + i])


def brute_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def test_pii_base_matches_brute_force(spark, docs, empty):
    rng = random.Random(4)
    for text in [t or "" for t in TEXTS] + ["".join(rng.choice("a1.2@ -+(%_x9é") for _ in range(400)) for _ in range(200)]:
        assert pii.base_spans(text) == brute_pii(text)
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df in (docs, real):
        want = []
        for i, t in df.select("doc_id", "text").collect():
            base = brute_pii(t or "")
            want.append((i, *(sum(s[0] == k for s in base) for k in pii.BASE_KINDS), hashlib.sha256(pii.joined(base).encode()).hexdigest()))
        assert rows_of(pii.find_pii(df).drop("spans")) == sorted(want, key=repr)
    assert pii.find_pii(empty).count() == 0


def test_pii_trees_add_spans_and_keep_base():
    (base, every), (_, plain) = pii.detect([TEXTS[16] + " 1.2.3.4", "the sum 12345678 of x = aaaaaaaaaaaaaaaaaaaaaa and no more"])
    assert base == [("ip", *next(re.finditer(r"1\.2\.3\.4", TEXTS[16] + " 1.2.3.4")).span())]
    assert {k for k, _, _ in every} == {"secret", "ssn", "ip"} and plain == []
    assert pii.redact("mail a@b.cd now") == "mail [email] now" and pii.redact(None) is None and pii.redact("") == ""
    rows = pii.labelled()
    x = np.array([pii.features(*r[:4]) for r in rows])
    assert ((pii.model().probability(x) >= 0.5) == np.array([r[4] == 1 for r in rows])).mean() > 0.9


def test_html_main_text(spark, empty):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for page_id, _, text, n_chars in html_text.extract(pages).collect():
        page = pages.filter(f"page_id = {page_id}").first().html if page_id < 3 else None
        assert n_chars == len(text) and "track(" not in text and "©" not in text
        if page:
            inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
            want = [" ".join(html_text.html.unescape(re.sub(r"<(/?b|br)>", " " if "br" in "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
            assert text.replace(" ", "") == "\n\n".join(w for w in want if w).replace(" ", "")
    frame = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (None, "u", "<p", "x")], "page_id long, url string, html string, text string")
    assert [r.n_chars for r in html_text.extract(frame).filter("page_id is not null").collect()] == [0, 0]
    assert html_text.extract(frame.limit(0)).count() == 0


def test_html_leaves_out_what_is_not_the_article():
    page = (
        "<html><head><title>T</title><style>x{}</style></head><body><header><h1>Site</h1></header><div id='cookie-banner'>We use cookies and like them very much here</div>"
        "<div class='sidebar'><p>A long paragraph in the side bar which is not a part of the article at all</p></div><main><article class=post><header><h1>Head &amp; line</h1></header>"
        "<p>First <b>bold</b>\n  and <a href=x>link</a>.</p><p>Second<br>line &lt;x&gt;</p><form>Your name please</form><section class='comments'><p>A reader wrote this long "
        "comment on the article and it goes on</p></section></article></main><footer>Foot</footer><script>var a='<p>no</p>'</script></body></html>"
    )
    assert html_text.main_text(page) == "Head & line\n\nFirst bold and link.\n\nSecond line <x>"


def test_mpeg_round_trip(docs, empty):
    for n in (0, 1, 63, 64, 65, 937, 938, 5000, 100_000):
        raw = random.Random(n).randbytes(n)
        data = mpeg.encode(raw, title="x")
        s = mpeg.parse(b"junk\xff\xfb" + data[: 10**9] if n == 0 else data)
        if n:
            assert s.payload == raw and s.bad_checksums == 0 and s.skipped == 0 and s.checked == len(s.seek) and s.tags["title"] == "x"
            assert s.table[0] == len(s.seek) and s.samples == 1152 * len(s.seek) and all(mpeg.header_at(data, a) for a in s.seek)
            assert s.table[1] == len(data) - s.seek[0]
    rows = {(r.doc_id, r.n_bytes): r for r in mpeg.digests(docs).collect()}
    for i, t in docs.select("doc_id", "text").collect():
        raw = (t or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert mpeg.digests(empty).count() == 0


def test_mpeg_resynchronises_and_checks():
    raw = bytes(range(256)) * 40
    data = mpeg.encode(raw)
    s = mpeg.parse(data)
    cut = s.seek[3]
    broken = data[:cut] + b"\xff\xfb\x00garbage\xff" * 3 + data[cut:]
    again = mpeg.parse(broken)
    assert again.skipped == 33 and len(again.seek) == len(s.seek) and again.payload == raw
    flipped = bytearray(data)
    flipped[s.seek[2] + 10] ^= 1
    assert mpeg.parse(bytes(flipped)).bad_checksums == 1
    tail = data + b"TAG" + b"Song".ljust(30, b"\0") + b"Me".ljust(30, b"\0") + bytes(65)
    assert mpeg.parse(tail).tags["title"] == "Song" and mpeg.parse(tail).skipped == 0
    # A plain 128 kbit/s 44.1 kHz stereo stream: 417 and 418 bytes a frame by the padding bit.
    frames = b"".join(bytes([0xFF, 0xFB, 0x90 | 2 * p, 0x00]).ljust(417 + p, b"\0") for p in (0, 1, 1, 0))
    plain = mpeg.parse(frames)
    assert plain.seek == [0, 417, 835, 1253] and plain.samples == 4608 and plain.rate == 44100 and plain.channels == 2
    assert mpeg.parse(b"").seek == [] and mpeg.parse(b"\xff" * 50).skipped == 50


def test_url_model_counts_every_decided_url(spark):
    """Counts of all distinct URLs that a rule decides, however many; repeated rows and the rest change nothing."""
    good = [f"https://a{i}.org/page/{i * 7919}" for i in range(2600)]
    bad = [f"https://b{i}.com/de/{i * 104729}" for i in range(300)]
    other = [f"https://c{i}.net/x" for i in range(50)]
    pages = spark.createDataFrame([(u,) for u in good + bad + bad + other], "url string")
    model = url_filter.train(pages.repartition(3, "url"))
    assert not url_filter.train(pages.filter("url like '%net%'").repartition(211)).known  # empty partitions
    held = {r.url for r in pages.filter(F.pmod(F.xxhash64("url"), F.lit(url_filter.HELD)) == 0).collect()}
    for part, urls in ((model.accept, good), (model.reject, bad)):
        fit = [u for u in urls if u not in held]
        assert part.total[""] == sum(len(u) + 1 for u in fit) and part.next == url_filter.Markov(fit).next
    assert model.blocked(bad[0]) > 0.5 > model.blocked(good[0])



def test_url_rules_and_models(spark, empty):
    cases = {
        "http://A.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://badexample.org/en/12": ("badexample.org", "/en/12", "org/", "allow"),
        "x://b.com/fr/#a": ("b.com", "/fr/", "com/fr/", "allow"),
        "x://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
        "x://b.org": ("b.org", "", None, None),
        "b.org/x": ("", "", None, None),
        "x://h?://y.org/": ("h", "", None, None),
    }
    for url, (host, path, rule, verdict) in cases.items():
        assert url_filter.split_url(url) == (host, path)
        assert (url_filter.rule_of(host, path) or (None, None)) == (rule, verdict)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = url_filter.judge_urls(pages).collect()
    assert len(rows) == pages.count() and {r.verdict for r in rows} <= {"allow", "block"}
    for r in rows:
        assert r.rule is None or r.verdict == url_filter.rule_of(r.host, r.path)[1]
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (1, None, 1), (2, "http://é.net/ü", 3)], "page_id long, url string, host int")
    assert [r.verdict for r in url_filter.judge_urls(odd).collect()] == ["allow"] * 4
    assert url_filter.judge_urls(odd.limit(0)).count() == 0


def test_url_models_tell_classes_apart():
    rng = random.Random(1)
    good = [f"http://news{rng.randrange(99)}.org/story/{rng.randrange(9999)}" for _ in range(200)]
    bad = [f"http://win{rng.randrange(99)}.biz/casino/{rng.randrange(9999)}" for _ in range(200)]
    model = url_filter.UrlModel(good[:150], bad[:150])
    assert all(model.blocked(u) < 0.5 for u in good[150:]) and all(model.blocked(u) > 0.5 for u in bad[150:])
    total = sum(model.accept.p("news", chr(c)) for c in range(0x110000))
    assert total == pytest.approx(1.0, abs=1e-6)


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, against plain Python; ids are unique here."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixing", "packing"]
    real = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in real]
    rows += [(900 + i, t, None, ["src1", None][i % 2], None) for i, t in enumerate(TEXTS[:14])] + [(990, rows[3][1] + " ", "fr", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    kept = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    now = corpus_pipeline.language(spark, docs, str(tmp_path))
    got = {r.doc_id: r for r in now.collect()}
    assert set(got) == {r[0] for r in kept} and all(got[r[0]].lang == (r[2] or got[r[0]].lang) is not None for r in kept)

    groups = {}
    for r in kept:
        groups.setdefault(bare(r[1]), []).append((-len(r[1]), r[0], r))
    kept = [min(g)[2] for g in groups.values()]
    now = corpus_pipeline.exact(spark, now, str(tmp_path)).cache()
    assert {r.doc_id for r in now.collect()} == {r[0] for r in kept} and now.count() == len(kept)

    sets = {r[0]: shingles(r[1]) for r in kept}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    where = components(sets, links)
    kept = [r for r in kept if where[r[0]] == r[0]]
    now = corpus_pipeline.near(spark, now, str(tmp_path)).cache()
    assert sorted(r.doc_id for r in now.collect()) == sorted(r[0] for r in kept)

    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in kept}
    sums = {}
    for r in kept:
        sums[r[3]] = sums.get(r[3], 0) + size[r[0]]
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight, fixed = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (sum(sums.values()) - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 3 * sums[s]]
        if not over:
            break
        fixed |= {s: 3 * sums[s] for s in over}
    copies, position = {}, {}
    for s in names:
        target, at = fixed.get(s, level * weight[s]), 0
        for r in sorted((r for r in kept if r[3] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            copies[r[0]] = sum(n * sums[s] + at + size[r[0]] / 2 <= target for n in range(3))
            tilt = (0.5, 0.0, -0.5)[names.index(s) % 3]
            for n in range(copies[r[0]]):
                done = min(1.0, (at + n * sums[s]) / target) if target else 0.0
                lo, hi = 0.0, 1.0
                for _ in range(60):  # the time at which the integrated schedule has spent that share
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if mid + tilt * (mid * mid - mid) < done else (lo, mid)
                position[r[0], n] = lo
            at += size[r[0]]
    corpus_pipeline.mixing(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/mixed")
    now = spark.read.parquet(f"{tmp_path}/mixed")
    files = now.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    order, seen = [], {}
    for r in sorted(files, key=lambda r: (r.file_name, r.row_index)):
        order.append((r.doc_id, seen.setdefault(r.doc_id, 0)))
        seen[r.doc_id] += 1
    assert [position[x] for x in order] == pytest.approx(sorted(position.values()), abs=1e-9)  # the rows stand by training position
    times = {}
    for r in now.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {i: c for i, c in copies.items() if c} and now.columns == docs.columns

    lengths = [min(4096, size[i] - at) for i, c in copies.items() for _ in range(c) for at in range(0, max(1, size[i]), 4096)]
    packed = corpus_pipeline.packing(spark, now, str(tmp_path)).collect()
    assert sorted(r.n_tokens for r in packed) == sorted(lengths)
    bounds = packing.optimal_buckets({x: lengths.count(x) for x in lengths}, 16)
    assert all(r.bucket == min(b for b in bounds if b >= r.n_tokens) for r in packed)

    # Batches of a bucket follow the training position.
    place = {x: i for i, x in enumerate(order)}
    for width in {r.bucket for r in packed}:
        mine = [(place[r.doc_id, r.copy], r.part) for r in sorted((r for r in packed if r.bucket == width), key=lambda r: (r.batch, r.slot))]
        assert mine == sorted(mine)

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert rows_of(whole) == sorted((tuple(r) for r in packed), key=repr)
