"""The training-data operators against brute force and on awkward inputs."""

import collections
import hashlib
import itertools
import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlight.llm import ann, chat, common, langid, licenses, mixing, ngram_join, packing, sharding, toxicity, vector_dedup
from tarnlight.llm.common import NOT_SPACE, WordHashes, components

DOCS = "doc_id bigint, text string, lang string, source string, id string, score double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], DOCS)


def awkward(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    return frame(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "one", "en", None), (3, "one", "en", None), (None, "null id here", "en", "a"), (4, long, "en", "a"), (5, "  \n\t ", "en", "b"), (6, "é É ß", "fr", "b")])


def texts(n=120, seed=0):
    """Originals, near copies, exact copies and unrelated texts."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            base = out[rng.integers(len(out))].split()
            for _ in range(rng.integers(0, 3)):
                if base:
                    base[rng.integers(len(base))] = f"n{rng.integers(1000)}"
            out.append(" ".join(base))
        else:
            out.append(" ".join(f"{WORDS[rng.integers(20)]}{rng.integers(50)}" for _ in range(rng.integers(1, 90))))
    return out


def brute_components(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower()) if t else []
        sets[i] = frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("words", "num", "keys"), [(3, 90, "subsets"), (5, 80, "subsets"), (2, 60, "prefix")])
def test_jaccard_components(spark, monkeypatch, words, num, keys):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "WIDTH", 1)
    rows = list(enumerate(texts()))
    got = ngram_join.jaccard_components(frame(spark, [(i, t, None, None) for i, t in rows]), words=words, num=num, keys=keys)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, words, num, 100)


def test_jaccard_dense_group(spark, monkeypatch):
    """Copies with a few edits each, of which some link only through others, in tiles cut into many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "WIDTH", 1)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.integers(0, 5)):
            own[rng.integers(60)] = f"x{rng.integers(40)}"
        rows.append((i, " ".join(own)))
    for words, num, keys in ((1, 90, "subsets"),):
        got = ngram_join.jaccard_components(frame(spark, [(i, t, None, None) for i, t in rows]), words=words, num=num, keys=keys)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, words, num, 100)


def test_op5_query(spark, tmp_path):
    rows = list(enumerate(texts()))
    frame(spark, [(i, t, None, None) for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = ngram_join.op5_ngram_jaccard(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 3, 90, 100)


@pytest.mark.parametrize("keys", ["prefix", "subsets"])
def test_jaccard_awkward(spark, keys):
    rows = ngram_join.jaccard_components(awkward(spark), keys=keys).collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)
    assert got == collections.Counter([(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, 1, None), (4, 29_996, 4), (5, 0, 5), (6, 1, 6)])
    assert ngram_join.jaccard_components(awkward(spark).where("false"), keys=keys).count() == 0
    kept = ngram_join.drop_near_duplicates(awkward(spark), keys=keys)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, i) for i in range(1, 7)] + [(True, None)]


def test_near_duplicates_are_rows(spark):
    """Repeated and null ids: unrelated texts stay, copies go, whatever their ids."""
    long = " ".join(WORDS)
    rows = [(1, long), (2, long + " more"), (2, "quite another text of seven words here"), (None, long), (None, "null id and a text of its own"), (None, "null id and a text of its own"), (3, None), (3, None), (None, None)]
    docs = frame(spark, [(i, t, None, None) for i, t in rows]).withColumnRenamed("lang", "mark")
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = [(1, long), (2, "quite another text of seven words here"), (None, "null id and a text of its own"), (3, None), (3, None), (None, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
    assert {r.score for r in kept.collect()} == {0.5}


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (60, 100)])
def test_partners_share_a_class(num, den):
    """Two sets at the threshold share a key, however the rest is dealt."""
    rng = np.random.default_rng(4)
    classes = ngram_join.Classes(num, den)
    for n in [*range(2, 60), 100, 257, 1000]:
        for _ in range(20):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            gone = rng.integers(0, n + 1)
            new = rng.integers(0, n + 1)
            while gone + new and (n - gone) * den < num * (n + new):
                gone, new = max(0, gone - int(rng.integers(0, 2))), max(0, new - 1)
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)])
            if gone + new:
                assert np.intersect1d(classes.keys(np.unique(a)), classes.keys(np.unique(b))).size, (n, gone, new)


def test_common_passages_share_no_class():
    """Texts that share a frequent passage, a third of each, do not meet; near copies do."""
    rng = np.random.default_rng(9)
    classes, common = ngram_join.Classes(80, 100), rng.integers(0, 2**63, 150, dtype=np.uint64)
    counts = np.zeros(ngram_join.SLOTS, np.int64)
    counts[rng.integers(0, ngram_join.SLOTS, 1000)] = 10
    counts[(common >> np.uint64(44)).astype(np.int64)] = 5000
    rarity = ngram_join.rarities(counts)
    own = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 300, dtype=np.uint64)])) for _ in range(60)]
    keys = np.concatenate([np.unique(classes.keys(s, rarity)) for s in own])
    assert len(np.unique(keys)) == len(keys)
    for s in own:
        copy = np.unique(np.concatenate([rng.choice(s, 405, replace=False), rng.integers(0, 2**63, 45, dtype=np.uint64)]))
        assert np.intersect1d(classes.keys(s, rarity), classes.keys(copy, rarity)).size


def test_listed_pairs():
    """Pairs of a key, over the bounds of batches, with different roots and sizes that can link."""
    rng = np.random.default_rng(10)
    rows = np.stack([np.sort(rng.integers(0, 12, 90)), np.arange(90), rng.integers(0, 30, 90), rng.integers(8, 14, 90)])
    want = {tuple(sorted((int(rows[1, i]), int(rows[1, j])))) for i in range(90) for j in range(i) if rows[0, i] == rows[0, j] and rows[2, i] != rows[2, j] and 10 * rows[3, [i, j]].min() >= 8 * rows[3, [i, j]].max()}
    for size in (7, 90):
        batches = [pa.record_batch([pa.array(x) for x in rows[:, i : i + size]], names=["key", "node", "root", "n"]) for i in range(0, 90, size)]
        got = [p for b in ngram_join._listed(80, 100)(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert set(got) == want and len(got) == len(want)


@given(st.lists(st.text(alphabet="ab \té", max_size=12), max_size=6))
@settings(max_examples=100, deadline=None)
def test_word_hashes(parts):
    """Equal words hash alike wherever they stand, and different ones do not."""
    hashes = WordHashes(NOT_SPACE)
    data = " ".join(parts).encode()
    assert len(hashes.of(data)) == len(data.split())
    seen = {}
    for word, h in zip(data.split(), hashes.of(data).tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (60, 100), (99, 100)])
def test_partners_share_a_band(num, den):
    for n in range(1, 400):
        for m in range(n, n * den // num + 1):
            assert set(ngram_join.bands(n, num, den)) & set(ngram_join.bands(m, num, den)), (n, m)


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        x, y = (np.frombuffer(ngram_join.bitmap(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        apart = int(np.bitwise_count(ngram_join.fold(x, size) ^ ngram_join.fold(y, size)).sum())
        assert apart <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("held", [4, 1 << 20])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(common, "HELD_EDGES", held)
    monkeypatch.setattr(common, "TASK_EDGES", held)
    chain = [(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def mix_rows(n=400):
    rng = np.random.default_rng(3)
    return [(i, " ".join(["w"] * int(rng.integers(0, 40))), None, ["big", "small", None, "c"][0 if rng.random() < 0.6 else rng.integers(1, 4)]) for i in range(n)]


def test_mix(spark):
    rows = mix_rows()
    got = mixing.mix_sources(frame(spark, rows)).collect()
    sizes = collections.defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    order = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while True:  # stop sources at three times their size, reshare the rest
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    taken = collections.defaultdict(int)
    for r in got:
        assert math.isclose(r.target, target[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(frame(spark, rows).repartition(7)).collect()))
    assert mixing.mixed_rows(frame(spark, rows)).count() == sum(r.copies for r in got)


def test_mix_awkward(spark):
    got = mixing.mix_sources(awkward(spark)).collect()
    assert len(got) == 8 and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix_sources(awkward(spark).where("false")).count() == 0
    assert all(r.taken == 0 for r in mixing.mix_sources(awkward(spark).where("doc_id = 2")).collect())


@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_optimal_bounds(hist, buckets):
    lengths = np.array(sorted(hist))
    counts = np.array([hist[x] for x in lengths])
    bounds = packing.optimal_bounds(lengths, counts, buckets)
    cost = lambda b: sum(c * (min(x for x in b if x >= n) - n) for n, c in zip(lengths, counts))
    best = min(cost((*some, lengths[-1])) for k in range(buckets) for some in itertools.combinations(lengths[:-1], min(k, len(lengths) - 1)))
    assert len(bounds) <= buckets and cost(bounds) == best


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 16)
    rows = packing.pack_buckets(frame(spark, mix_rows()), buckets=4, budget=200).collect()
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bound and r.padding == r.bound - r.n_tokens
        batches[r.bucket, r.batch].append((r.place, r.bound))
    assert len(rows) == 400
    for found in batches.values():
        assert sorted(p for p, _ in found) == list(range(len(found))) and len(found) * found[0][1] <= max(200, found[0][1])
    full = collections.Counter(k for k, _ in batches)
    assert all(sorted(b for k2, b in batches if k2 == k) == list(range(n)) for k, n in full.items())
    assert packing.pack_buckets(awkward(spark)).count() == 8 and packing.pack_buckets(awkward(spark).where("false")).count() == 0


def test_shards(spark):
    df = frame(spark, [(i, t, None, None) for i, t in enumerate(texts(300))])
    rows = sharding.external_shuffle(df, shards=7, bucket_bytes=4096).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == 300
    again = sharding.external_shuffle(df.repartition(5), shards=7, bucket_bytes=4096).collect()
    assert sorted((r.doc_id, r.shard, r.slot, r.text) for r in rows) == sorted((r.doc_id, r.shard, r.slot, r.text) for r in again)
    grown = {r.doc_id: r.shard for r in sharding.external_shuffle(df, shards=8, bucket_bytes=4096).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in rows)
    assert sharding.external_shuffle(awkward(spark), shards=3).count() == 8
    assert sharding.external_shuffle(awkward(spark).where("false"), shards=3).count() == 0


def test_fisher_yates():
    seen = collections.Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(i))) for i in range(3000))
    assert len(seen) == 6 and all(380 < n < 620 for n in seen.values())


def brute_licenses(text):
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    at = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark):
    said = [None, "", "under the mit license", "Under THE MIT-License, under the mit license", "cc by nc cc by nc", "ünder the mit license under the mitä license", "This work is licensed under the GNU General Public License, version 3.", "apache license version 2.0\nnothing\nLicensed under CC BY-NC 4.0.", "x" * 50_000 + " Apache License, Version 2"]
    rows = licenses.scan_licenses(frame(spark, [(i, t, None, None) for i, t in enumerate(said)])).collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(said[r.doc_id])
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[6] == "gpl-3" and labels[7] == "apache-2,cc-by-nc" and labels[0] == ""
    assert licenses.scan_licenses(awkward(spark)).count() == 8 and licenses.scan_licenses(awkward(spark).where("false")).count() == 0


def test_containment_join_is_exact(spark):
    rng = np.random.default_rng(5)
    vocabulary = "license mit apache under the of gnu public general version".split()
    rows = [(i, "\n".join(" ".join(rng.choice(vocabulary, rng.integers(1, 9))) for _ in range(4)), None, None) for i in range(80)]
    got = {(r.doc_id, r.block, r.template) for r in licenses.containment_join(frame(spark, rows), ["doc_id"], threshold=0.6).collect()}
    want = set()
    for i, text, *_ in rows:
        for b, block in enumerate(text.split("\n")):
            for t, (_, template) in enumerate(licenses.TEMPLATES):
                s = set(template.split())
                if len(s & set(block.split())) >= 0.6 * len(s) - 1e-9:
                    want.add((i, b, t))
    assert got == want and want


def test_wrapped_licenses(spark):
    said = {
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "mpl-2": "# This Source Code Form is subject to the terms of the Mozilla Public\r\n# License, v. 2.0. If a copy",
        "lgpl": "it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License",
        "gpl-3": "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of",
    }
    apart = "Redistribution and use in source and binary" + "{}" + "forms with or without modification are permitted"
    other = "der schheitau der den mit.\nEiner im dem.\nLicensed under the\nApache License."
    texts = ["x " * 5000 + f"\n{t}\n" + "y " * 5000 for t in said.values()] + [apart.format("\n"), apart.format("\n \n"), apart.format("\n" + "z " * 60), other]
    rows = licenses.scan_licenses(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.labels for r in rows} == dict(enumerate([*said, "bsd", "", "", ""]))
    assert all((r.score >= 0.8) == (r.labels != "") for r in rows)


@given(st.text(alphabet="<|>/s[]INSTY\\ x\n", max_size=40), st.text(alphabet="<|a", max_size=6))
@settings(max_examples=400, deadline=None)
def test_escape_round_trip(text, role):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c + rest in out for c, all_ in chat.CONTROL.items() for rest in all_)
    formatted, _ = chat.render([(role, text), ("assistant", text)])
    assert chat.parse(formatted) == [(role, text), ("assistant", text)]


def test_layouts(spark):
    said = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"instruction": "q", "input": "", "output": "a"},
    ]
    rows = [(i, json.dumps(x)) for i, x in enumerate(said)] + [(8, "{bad"), (9, None), (10, '{"other": 1}')]
    got = {r.id: r for r in chat.format_records(spark.createDataFrame(rows, "id int, record string"), "id").collect()}
    assert len({got[i].formatted for i in range(4)}) == 1 and len({got[i].layout for i in range(4)}) == 4
    assert all(got[i].formatted is None for i in (8, 9, 10))
    start, end = got[0].loss
    assert got[0].formatted[start:end] == "a"


def test_conversations(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "user", "z")], "conv_id bigint, turn bigint, role string, text string")
    done = chat.format_records(chat.conversation_records(rows), "conv_id").collect()
    assert {r.conv_id: chat.parse(r.formatted) for r in done} == {1: [("user", ""), ("assistant", "b")], 2: [("", "x")], None: [("user", "z")]}
    assert hashlib.sha256(b"").hexdigest()


def vectors(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    for i in range(0, n, 3):
        x[i] = x[(i * 7) % n] + (0 if i % 2 else 1) * rng.normal(size=16).astype(np.float32) * 0.03
    rows = [(i, [float(v) for v in x[i]], int(i % 4) if i % 4 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 1)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), x.astype(np.float64)


def test_nearest(spark):
    df, x = vectors(spark)
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, k=5, leaf_rows=32).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 300, 10))
    for q, hits in by.items():
        s = u @ u[q]
        s[q] = -2
        best = set(np.argsort(-s)[:5].tolist())
        found += len(best & {v for _, v, _ in hits})
        assert [r for r, *_ in sorted(hits)] == [1, 2, 3, 4, 5]
        assert all(math.isclose(score, s[v], abs_tol=1e-12) for _, v, score in hits)
    assert found / (5 * len(by)) >= 0.9
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0
    assert ann.nearest(df.where("vec_id < 2"), F.lit(True)).count() == 2


def test_vector_duplicates(spark):
    df, x = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([i % 4 for i in range(len(x))])
    linked = (u @ u.T >= 0.98) & (label[:, None] == label[None]) & (label[:, None] != 0)
    np.fill_diagonal(linked, False)
    rows = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    assert len(rows) == len(x) + 4 and sum(rows[i].n_links for i in range(len(x))) >= 0.9 * linked.sum() > 0
    assert all(rows[i].n_links <= linked[i].sum() for i in range(len(x)))
    assert all(rows[i].kept == (rows[i].component_id == i) for i in rows) and all(rows[len(x) + k].n_links == 0 for k in range(4))
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0


def test_language(spark):
    rng = np.random.default_rng(4)
    parts = {"en": "the and ing tion er with".split(), "fr": "le la é eaux que ment".split(), "de": "der die ung sch ß keit".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[g], 2)) for _ in range(int(rng.integers(3, 40)))), g, "s") for i in range(300) for g in [list(parts)[i % 3]]]
    df = frame(spark, rows)
    model = langid.fit_language_model(df.where("doc_id % 4 <> 2"))
    said = {r.doc_id: r for r in langid.predict_language(df, model, ["doc_id", "lang"]).collect()}
    held = [said[i] for i in range(300) if i % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in held)
    odd = langid.predict_language(awkward(spark), model, ["doc_id"]).collect()
    assert len(odd) == 8 and {r.doc_id: (r.lang_pred, r.score) for r in odd}[2] == ("und", 0.0)
    nothing = langid.fit_language_model(df.where("false"))
    assert langid.predict_language(df, nothing, ["doc_id"]).first().lang_pred == "und"
    assert "".join(np.concatenate(list(langid.grams("ab"))).astype(str)) and langid.keep_known_languages(df).count() == 300


def test_crc_mod(spark):
    got = spark.range(50).select("id", langid.crc_mod("id", 4).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def toxic_rows(n=600):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("th er on an re he in ed nd ha".split(), 2)) for _ in range(int(rng.integers(20, 80)))]
        if i % 5 == 0:
            for j in rng.integers(0, len(words), 4):
                words[j] = ["idiot", "scum", "moron"][rng.integers(3)]
        rows.append((i, " ".join(words), None, "s"))
    return rows


def test_toxicity(spark):
    df = frame(spark, toxic_rows())
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit_toxicity(toxicity.labelled(df.where("doc_id % 3 <> 1"), labels))
    held = toxicity.score_toxicity(df.where("doc_id % 3 = 1"), model, ["doc_id"]).collect()
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 5 == 0) for r in held]) > 0.95
    odd = toxicity.score_toxicity(awkward(spark), model, ["doc_id"]).collect()
    assert len(odd) == 8 and all(0 <= r.score <= 1 for r in odd)
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and 450 <= kept.count() <= 500
    assert toxicity.drop_toxic(df, labels.where("false")).count() == 600


def test_toxic_words_beyond_ascii(spark):
    mild, bad = "갈갈", "가가"
    rows = [(i, "the one and other then " * 6 + f"{bad if i % 5 == 0 else mild} " * 4, None, "s") for i in range(300)]
    df = frame(spark, rows + rows[1:2])
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    learn = toxicity.labelled(df.where("doc_id % 3 <> 1"), labels)
    model = toxicity.fit_toxicity(learn)
    held = sorted(toxicity.score_toxicity(df.where("doc_id % 3 = 1"), model, ["doc_id"]).collect())
    assert len(held) == 101 and all((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in held)
    joined = toxicity.fit_toxicity(learn, model_bytes=0)  # the way beyond the bound of the broadcast
    assert not joined.broadcast
    again = sorted(toxicity.score_toxicity(df.where("doc_id % 3 = 1"), joined, ["doc_id"]).collect())
    assert np.allclose([r.score for r in held], [r.score for r in again], atol=1e-5)


def test_insults_in_long_texts(spark):
    """One passage of a long text makes it toxic, whatever stands around it; a text without evidence is not."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(480):
        words = ["".join(rng.choice("th er on an re he in ed nd ha ou st".split(), 2)) for _ in range(int(rng.integers(20, 1500)))]
        if i % 6 == 0:
            words[int(rng.integers(0, len(words)))] = ["idiot", "scum", "moron"][i % 18 // 6]
        rows.append((i, " ".join(words), None, "s"))
    df = frame(spark, [*rows, (1000, "1234 5678", None, "s"), (1003, None, None, "s")])
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(480)], "doc_id bigint, quality int, toxic int")
    for size in (toxicity.MODEL_BYTES, 0):
        model = toxicity.fit_toxicity(toxicity.labelled(df.where("doc_id % 5 <> 1"), labels), model_bytes=size)
        rows = toxicity.score_toxicity(df, model, ["doc_id"]).collect()
        told = [(r.score >= 0.7) == (r.doc_id % 6 == 0 and r.doc_id < 1000) for r in rows if r.doc_id % 5 == 1 or r.doc_id >= 1000]
        assert np.mean(told) > 0.95 and all(r.score < 0.1 for r in rows if r.doc_id >= 1000)


def test_passages_by_definition(spark, monkeypatch):
    """Both ways of scoring against sums over every passage, in texts of several chunks."""
    monkeypatch.setattr(toxicity, "CHUNK", 29)
    texts = ["the idiot and other then words 나쁜말 " * 3, "short", "", None, "an idiot"]
    key = np.unique(np.concatenate([toxicity.distinct(toxicity.characters(t)) for t in texts]))[::2]
    gain = np.random.default_rng(3).normal(0, 2, len(key)).astype(np.float32)
    known = dict(zip(key.tolist(), gain.tolist()))
    want = []
    for t in texts:
        points = toxicity.characters(t)
        own = sorted(zip(*(x.tolist() for x in toxicity.expressions(points)[1::-1])), key=lambda x: x[0]) if len(points) else []
        own = [k for _, k in own]
        want.append(max([0.0, *(sum(known.get(k, 0.0) for k in own[max(0, i - toxicity.PASSAGE + 1) : i + 1]) for i in range(len(own)) if own[i] in known)]))
    assert np.allclose([toxicity.Lookup(key, gain).raw(t) for t in texts], want) and max(want) > 0
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "mark bigint, toxic int, text string")
    model = spark.createDataFrame(list(zip(key.view(np.int64).tolist(), gain.tolist())), "key bigint, gain double")
    got = {r.mark: r.raw for r in toxicity.joined_raws(rows, model, F.col("gain")).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want)


def test_kneser_ney_by_definition(spark):
    texts = [(r[1] + " 나쁜말", int(r[0] % 5 == 0)) for r in toxic_rows(120)] + [("", 0), (None, 1)]
    n, before = [collections.Counter(), collections.Counter()], collections.defaultdict(set)
    for text, toxic in texts:
        t = " " + " ".join((text or "").lower().split()) + " "
        own = [(i, t[i : i + 5]) for i in range(len(t) - 4)] + [(i, t[i : i + 2]) for i in range(len(t) - 1) if min(map(ord, t[i : i + 2])) >= 0x1100]
        first = {e: i for i, e in reversed(own)} if text else {}
        n[toxic].update(set(first))
        for e, i in first.items():
            before[e].add(t[max(i - 1, 0)])
    total = [sum(x.values()) for x in n]
    d = [toxicity.DISCOUNT * t / min(total) for t in total]
    backoff = [sum(min(c, d[k]) for c in n[k].values()) / total[k] for k in (0, 1)]
    df = spark.createDataFrame(texts, "text string, toxic int").repartition(3)
    counts = df.mapInArrow(toxicity._counts, "gram string, n0 bigint, n1 bigint, before bigint").groupBy("gram")
    counts = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.bit_or("before").alias("before"))
    rows = counts.collect()
    assert {(r.gram, r.n0, r.n1) for r in rows} == {(e, n[0][e], n[1][e]) for e in before}
    # the characters before an expression, by their 64 bits
    bit = lambda c: int(common.mix(np.array([ord(c)], np.uint64))[0] & np.uint64(63))
    kinds = {e: -64 * math.log(1 - min(len({bit(c) for c in s}), 63) / 64) for e, s in before.items()}
    assert all(bin(r.before & (2**64 - 1)).count("1") == len({bit(c) for c in before[r.gram]}) for r in rows)
    q = {e: x / sum(kinds.values()) for e, x in kinds.items()}
    p = lambda k, e: max(n[k][e] - d[k], 0) / total[k] + backoff[k] * q[e]
    assert all(math.isclose(sum(p(k, e) for e in q), 1) for k in (0, 1))
    got = {r.gram: r.gain for r in toxicity.model_rows(counts).collect()}
    left = math.log(backoff[1] / backoff[0])
    for e in q:
        assert math.isclose(got.get(e, 0.0), math.log(p(1, e) / p(0, e)) - left, abs_tol=1e-9), e
    assert any(x > 1 for x in got.values())


def test_op10_query(spark, tmp_path):
    frame(spark, toxic_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = toxicity.op10_kneser_ney(spark, str(tmp_path))
    assert rows.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = rows.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in rows if r.held_out]) > 0.95


def test_expressions_do_not_depend_on_chunks(monkeypatch):
    points = toxicity.characters("The%%% idiot -- éé 42 \x00 \ud800 나쁜말 " * 50)
    whole = toxicity.distinct(points)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert np.array_equal(whole, toxicity.distinct(points))
    assert not len(toxicity.characters(" \n ")) and not len(toxicity.characters(None))


def test_own_values_of_clashing_columns(spark):
    """Columns named as an operator's own keep their values."""
    df = frame(spark, toxic_rows(60)).withColumnRenamed("lang", "lang_pred").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")
    for kept in (toxicity.drop_toxic(df, labels), langid.keep_known_languages(df), mixing.mixed_rows(df)):
        assert kept.columns == df.columns and {(r.score, r.lang_pred) for r in kept.collect()} == {(0.5, None)}


def test_reruns_agree(spark):
    """Repeated ids with different texts, and equal rows, however the rows are dealt out."""
    rows = [(i % 9, " ".join(["w"] * (i % 13)) if i % 5 else None, None, "ab"[i % 2]) for i in range(200)]
    runs = set()
    for n in (1, 5):
        df = frame(spark, rows).repartition(n)
        mixed = mixing.mix_sources(df).collect()
        runs.add((str(sorted(map(str, mixed))), str(sorted(map(str, mixing.mixed_rows(df).collect()))), str(sorted(map(str, packing.pack_buckets(df, buckets=3, budget=40).collect()))), str(sorted(map(str, sharding.external_shuffle(df, shards=3, bucket_bytes=512).select("doc_id", "text", "shard", "slot").collect())))))
        assert mixing.mixed_rows(df).count() == sum(r.copies for r in mixed)
    assert len(runs) == 1


def test_mix_by_weight(spark):
    """Unequal probabilities: what is expected follows the weights, and targets are met all the same."""
    rows = [(i, " ".join(["w"] * 10), None, "ab"[i % 2]) for i in range(4000)]
    df = frame(spark, rows)
    got = mixing.mix_sources(df, weight=F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0), share=0.5).collect()
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10
        heavy, light = (np.mean([r.copies for r in own if (r.doc_id % 4 < 2) == heavy]) for heavy in (True, False))
        assert abs(heavy / light - 3) < 0.5


def test_vectors_of_any_size(spark):
    """Very large, very small and ragged vectors."""
    rows = [(i, [10.0 ** (200 if i % 2 else -200) * x for x in (1.0, 2.0 + 0.001 * i, 3.0)], 1) for i in range(6)] + [(6, [1.0, 2.0], 1), (7, None, None), (7, [3.0, 2.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("score", F.lit("x"))
    near = ann.nearest(df, F.col("vec_id") == 0, k=3).collect()
    assert [r.vec_id for r in sorted(near, key=lambda r: r.rank)] == [1, 2, 3] and all(0.9 < r.score <= 1.0 + 1e-12 for r in near)
    got = {(r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect()}
    assert got == {*((i, 5, 0) for i in range(6)), (6, 0, 6), (7, 0, 7)}


def test_dense_vectors(spark, monkeypatch):
    """A ball of near copies, in tiles of several blocks and slices, has all its links counted."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    monkeypatch.setattr(vector_dedup, "SLICE", 16)
    monkeypatch.setattr(vector_dedup, "NUMBERS", 1000)
    rng = np.random.default_rng(3)
    x = (np.ones(16) + rng.normal(size=(300, 16)) * 0.1).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(300)]
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * want.sum() > 0


def test_shards_by_brute_force(spark, tmp_path):
    rows = [(i, t, None, None) for i, t in enumerate(texts(120))] + [(None, f"null {i}", None, None) for i in range(30)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op6_external_shuffle(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    got = got.collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in got))) == sorted(map(str, ((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t, *_ in rows)))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1


def test_op1_and_op3_queries(spark, tmp_path):
    rng = np.random.default_rng(4)
    parts = {"en": "the and ing tion er with".split(), "fr": "le la é eaux que ment".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[g], 2)) for _ in range(20)), g, "s") for i in range(200) for g in [list(parts)[i % 2]]] + [(900, "12 34", "en", "s"), (901, None, "fr", "s")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    said = langid.op1_language_id(spark, str(tmp_path))
    assert said.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    said = {r.doc_id: r for r in said.collect()}
    assert all(said[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in said)
    assert all(said[i].lang_pred == g for i, _, g, _ in rows[:200]) and said[900].lang_pred == said[901].lang_pred == "und"
    packed = packing.op3_length_buckets(spark, str(tmp_path)).collect()
    assert sorted(r.n_tokens for r in packed) == sorted(len((t or "").split()) for _, t, *_ in rows)


def test_language_by_brute_force():
    """A prediction is the softmax of the summed TF-IDF weights; the elastic net's first penalty leaves weights at zero."""
    rng = np.random.default_rng(2)
    table, bias = rng.normal(size=(langid.FEATURES, 3)).astype(np.float32), rng.normal(size=3)
    model = langid.LanguageModel(["a", "b", "c"], table, bias, 1.7)
    text = "Some Text é " * 9
    slots = [int(x) for part in langid.grams(text) for x in part]
    logits = (langid.SCALE * sum(table[i].astype(np.float64) for i in slots) / len(slots) + bias) / 1.7
    p = np.exp(logits - logits.max())
    label, score = model.predict(text)
    assert label == "abc"[int(np.argmax(p))] and math.isclose(score, p.max() / p.sum(), rel_tol=1e-6)
    zeros = []
    for l1 in (0.0, 0.05):
        fit = langid.FTRL(2, l1=l1)
        for i in range(200):
            fit.step(np.array([i % 2, 2 + i % 50]), np.array([1.0, 0.02]), i % 2)
        zeros.append(int((fit.weights()[:52] == 0).sum()))
    assert zeros[0] < zeros[1] < 104


def test_chat_awkward(spark):
    """Fields beside the mapped ones change nothing; nesting without end, long texts and repeated rows are kept."""
    long = "x</s>" * 50_000
    said = [{"id": 1, "source": {"a": [1]}, "instruction": "q", "output": "a"}, {"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a"}], "date": None}, {"prompt": "q", "completion": long}]
    rows = [(i, json.dumps(x), "x") for i, x in enumerate(said)] + [(1, json.dumps(said[1]), "x"), (5, '{"a":' * 5000 + "1" + "}" * 5000, "x"), (None, '{"messages": []}', "x"), (6, "[]", "x")]
    df = spark.createDataFrame(rows, "id int, record string, formatted string")
    got = chat.format_records(df, "id").collect()
    by = {r.id: r for r in got}
    assert len(got) == 7 and chat.parse(by[0].formatted) == chat.parse(by[1].formatted) == [("user", "q"), ("assistant", "a")]
    assert chat.parse(by[2].formatted)[1][1] == long and by[5].formatted is None and by[6].formatted is None and by[None].formatted == ""
    assert chat.format_records(df.where("false"), "id").count() == 0


def test_vector_queries(spark, tmp_path):
    """What op2 and op7 return, by their contracts and against brute force."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 12)).astype(np.float32)
    x[300:400] = x[:100] + 0.01 * rng.normal(size=(100, 12)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(600)] + [(650, None, 1), (700, [0.0] * 12, 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = ann.op2_rp_forest(spark, str(tmp_path))
    assert near.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    hits = collections.defaultdict(set)
    for r in near.collect():
        hits[r.query_id].add(r.vec_id)
        assert r.query_id != r.vec_id and math.isclose(r.score, u[r.query_id] @ u[r.vec_id], abs_tol=1e-12)
    assert set(hits) == set(range(0, 600, 50))
    best = {q: set(np.argsort(-np.where(np.arange(600) == q, -2, u @ u[q]))[:5].tolist()) for q in hits}
    assert sum(len(best[q] & hits[q]) for q in hits) >= 0.9 * 5 * len(hits)
    links = vector_dedup.op7_pivot_permutation(spark, str(tmp_path))
    assert links.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    label = np.arange(600) % 3
    want = ((u @ u.T >= 0.98) & (label[:, None] == label)).sum(1) - 1
    got = {r.vec_id: r for r in links.collect()}
    assert len(got) == 602 and all(got[i].n_links <= want[i] for i in range(600)) and sum(got[i].n_links for i in range(600)) >= 0.9 * want.sum() > 0


def test_mix_license_and_chat_queries(spark, tmp_path):
    """Columns and kinds that the contracts name, on tables with awkward rows."""
    awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    said = [(1, 0, "human", "q", "x"), (1, 1, "gpt", "a</s>", "x"), (None, 0, None, None, "x"), (1, 1, "gpt", "a</s>", "x")]
    spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string, record string").write.parquet(f"{tmp_path}/conversations.parquet")
    mix = mixing.op4_pareto_mix(spark, str(tmp_path))
    assert mix.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")] and mix.count() == 8
    found = licenses.op8_license_join(spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")] and found.count() == 8
    turns = {r.conv_id: r for r in chat.op9_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (turns[1].n_turns, turns[1].turns_sha256, turns[1].loss_chars, turns[1].loss_sha256) == (3, sha("user\nq\n" + "assistant\na</s>\n" * 2), 10, sha("a</s>" * 2))
    assert turns[-1].turns_sha256 == sha("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n") and turns[None].loss_chars == 0
