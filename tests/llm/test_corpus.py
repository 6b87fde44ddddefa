"""Operators across texts against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelweave.llm import chat_format, lm_score, mixing, simhash, suffix_dedup, vector_neardup
from pixelweave.llm.common import connected_components, join_groups, materialize, scratch_dir


def roots(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(300, 360)] + [(400, k) for k in range(401, 450)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(450, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: want[k] for k in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_groups_salts_beyond_the_limit(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(50)], "id long, k string")
    groups = materialize(spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"), "test-groups")
    for limit in (10, 0):
        assert Counter(r.v for r in join_groups(rows, groups, ["k"], "id", limit=limit).collect()) == {1: 17, 2: 33}


def test_scratch_follows_the_session(spark):
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_position_sets():
    from itertools import combinations

    for size, n in ((2, 7), (3, 20), (4, 70)):
        sets = [set(s) for s in simhash.position_sets(size)]
        assert len(sets) == n and all(any(s <= set(c) for s in sets) for c in combinations(range(8), 4))


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash(docs, doc_rows, none, clashing):
    rows = [r for r in doc_rows if len(r[1] or "") < 100_000]
    got = {r.doc_id: r for r in simhash.simhash_groups(docs.where("length(coalesce(text, '')) < 100000")).collect()}
    prints = np.array([plain_fingerprint(r[1]) for r in rows], np.uint64)
    order = np.argsort([r[0] for r in rows])
    ids = [rows[k][0] for k in order]
    fp = prints[order]
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    want = roots(len(ids), np.argwhere(np.triu(near, 1)).tolist())
    for k, i in enumerate(ids):
        assert got[i].fingerprint == f"{int(fp[k]):016x}" and got[i].component_id == ids[want[k]] and got[i].kept == (want[k] == k)
    assert simhash.simhash_groups(none).count() == 0
    assert [r.component_id for r in simhash.simhash_groups(clashing).collect()].count(7) == 4


@pytest.mark.parametrize("n", [40, 700])
def test_dense_buckets(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = np.unique(np.array([base[k % 3] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 30, 3).astype(np.uint64)) for k in range(n)]))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    want = roots(len(fp), np.argwhere(np.triu(near, 1)).tolist())
    label = simhash.spanning_links(fp)
    assert len(set(zip(want, label.tolist()))) == len(set(want)) == len(set(label.tolist()))


def test_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(300, 32))
    rows = [(int(k), v) for k, v in enumerate(np.concatenate([centres, *(centres[:40] + rng.normal(size=(40, 32)) * s for s in (0.1, 0.3, 0.4)), np.repeat(centres[:1], 5, 0), centres[1] + rng.normal(size=(120, 32)) * 0.15]))]
    table = [(k, [float(x) for x in v], "t") for k, v in rows]
    odd = [(9001, None, "t"), (9002, [0.0] * 32, "t"), (9003, [float("nan")] + [1.0] * 31, "t"), (9004, [None] + [1.0] * 31, "t"), (9005, [1.0, 2.0], "t"), (9006, [float("inf")] * 32, "t")]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>, rep string")
    got = {r.vec_id: r for r in vector_neardup.vector_groups(df).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[k].n_links for k, _ in rows)
    assert 0.97 * near.sum() <= found <= near.sum()
    want = roots(len(rows), np.argwhere(np.triu(near, 1)).tolist())
    assert sum(got[k].component_id != want[k] for k, _ in rows) <= 0.02 * len(rows)
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k, *_ in odd)
    assert vector_neardup.vector_groups(df.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 2, "user", "more"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"),
            (5, 0, "user", "hi"), (5, 1, "assistant", "no"), (None, 0, "user", "x"), (6, None, None, None), (7, 0, "us", "erhi"), (8, 0, "a", "b"), (8, 0, "a", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(0)).withColumn("h1", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat_format.chat_format(df).collect()}
    assert set(got) == {3, 4, 6, 7, 8}
    assert got[3][2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[4][:2] == (2, 2) and got[8][0] == 2 and got[6][2] == "<|im_start|>\n<|im_end|>\n"
    assert chat_format.chat_format(df.limit(0)).count() == 0


def cut_by_hand(texts):
    """Result per (id, text) in order, windows looked up one by one."""
    seen, out = {}, {}
    for key, raw in texts:
        covered = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if seen.setdefault(w, (key, p)) != (key, p):
                covered[p : p + 100] = True
        edges = np.diff(np.concatenate([[0], covered.astype(int)]))
        out[key] = (len(raw), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~covered])).hexdigest())
    return out


def test_repeats(spark, docs, doc_rows, none):
    rng = np.random.default_rng(5)
    passage = bytes(rng.integers(97, 123, 260, dtype=np.uint8)).decode()
    period = "abcdefghij" * 60
    mine = [(20_000 + k, bytes(rng.integers(97, 123, int(rng.integers(0, 200)), dtype=np.uint8)).decode() + passage[int(rng.integers(0, 60)) :] + f" {k} end", "en", "s", 0) for k in range(40)]
    mine += [(20_100, period, "en", "s", 0), (20_101, "zz" + period + passage[:99], "en", "s", 0), (20_102, passage[:100], "en", "s", 0), (20_103, passage[:99], "en", "s", 0), (20_104, "é" * 90, "en", "s", 0), (20_105, "é" * 49 + "e" + "é" * 60, "en", "s", 0)]
    every = [r for r in doc_rows if len(r[1] or "") < 50_000] + mine
    df = spark.createDataFrame(every, docs.schema).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == cut_by_hand([(r[0], (r[1] or "").encode()) for r in sorted(every)])
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeats_under_one_id(spark, docs):
    text = "".join(chr(97 + (k * k) % 26) + str(k) for k in range(80))
    rows = [(1, text, None, None, 0), (1, text, None, None, 0), (None, text, None, None, 0)]
    got = [tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, docs.schema)).collect()]
    assert sorted(got, key=str)[0][:3] == (1, len(text), len(text)) and sum(r[2] == 0 for r in got) == 1


def test_wide_names(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDE", 3)
    passage = "".join(chr(97 + (k * k * 7) % 26) + str(k) for k in range(60))
    rows = [(k, f"{k}-" * (k + 1) + passage + f"/{k}" * 3, None, None, 0) for k in range(12)]
    cut = suffix_dedup._resolve_equal
    bucket = suffix_dedup._cut_segments(64)
    import pyarrow as pa

    packed = [b for row in rows for b in bucket([pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([0]), pa.array([row[1].encode()])], names=["doc_id", "key", "raw"])])]
    asked = pa.Table.from_batches(list(cut(packed))).to_pylist()
    assert any(r["wide"] for r in asked)
    by_doc = {}
    for r in asked:
        if r["n"] is not None:
            by_doc.setdefault(r["doc"], []).append({k: r[k] for k in ("name", "wide", "start", "end")})
    items = [(row[0], 0, row[1].encode(), by_doc[row[0]]) for row in rows if row[0] in by_doc]
    kind = pa.list_(pa.struct([("name", pa.int64()), ("wide", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in items]), pa.array([x[1] for x in items]), pa.array([x[2] for x in items]), pa.array([x[3] for x in items], kind)], names=["doc_id", "key", "raw", "asked"])
    pieces = list(suffix_dedup._fetch(64)([batch]))
    ranges = pa.Table.from_batches(list(suffix_dedup._merge_bucket(pieces))).to_pylist() + [r for r in asked if r["n"] is None]
    covered = {}
    for r in ranges:
        covered.setdefault(r["doc"], set()).update(range(r["start"], r["end"]))
    want = cut_by_hand([(row[0], row[1].encode()) for row in rows])
    assert {k: len(covered.get(k, ())) for k in want} == {k: v[1] for k, v in want.items()}


@pytest.mark.parametrize("rounds", [1, 3, 6])
def test_merged_transforms_give_repeated_prefixes(rounds):
    rng = np.random.default_rng(rounds)
    texts = [rng.integers(1, 4, int(n)).astype(np.uint8) for n in rng.integers(1, 30, 14)]
    shards, suffixes = [], []
    for part in (texts[:5], texts[5:6], texts[6:]):
        text = np.concatenate([np.append(t, 0) for t in part]).astype(np.uint8)
        order = suffix_dedup.shard_transform(text)
        own = [text[i : i + int(np.flatnonzero(text[i:] == 0)[0])].tolist() for i in order]
        assert own == sorted(own)
        last = text[order - 1]
        last[np.isin(order, np.cumsum([0, *(len(t) + 1 for t in part)])[:-1])] = 0
        shards.append(last)
        suffixes += own
    rows, block = suffix_dedup.merge_transforms(shards, rounds)
    prefixes = Counter(tuple(s[:rounds]) for s in suffixes if len(s) >= rounds)
    repeated = sorted(p for p, n in prefixes.items() if n > 1)
    got = {}
    for r, b in zip(rows.tolist(), block.tolist()):
        got.setdefault(b, []).append(tuple(suffixes[r][:rounds]))
    assert [set(v) for _, v in sorted(got.items())] == [{p} for p in repeated]
    assert [len(got[k]) for k in sorted(got)] == [prefixes[p] for p in repeated]


def test_mixture(spark, docs, doc_rows, none, clashing):
    out = mixing.mixture(docs).collect()
    assert len(out) == len(doc_rows)
    cells = {}
    for r in out:
        c = cells.setdefault((r.source, r.lang, r.topic), [0, r.weight, r.probability])
        c[0] += r.n_tokens
        assert (c[1], c[2]) == (r.weight, r.probability)
    total = sum(c[0] for c in cells.values())
    fitted = {k: float(c[0]) for k, c in cells.items()}
    shares = []
    for d in range(3):
        t = {}
        for k, c in cells.items():
            t[k[d]] = t.get(k[d], 0) + c[0]
        raw = {v: n**0.7 for v, n in t.items()}
        shares.append({v: n / sum(raw.values()) for v, n in raw.items()})
    for _ in range(60):
        for d in range(3):
            m = {}
            for k, v in fitted.items():
                m[k[d]] = m.get(k[d], 0) + v
            fitted = {k: v * shares[d][k[d]] * total / m[k[d]] for k, v in fitted.items()}
    for k, c in cells.items():
        assert c[1] == pytest.approx(fitted[k] / c[0], rel=1e-4)
    assert sum(c[0] * c[2] for c in cells.values()) == pytest.approx(0.8 * total, rel=1e-6)
    for r in out:
        u = int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        assert r.selected == (u < r.probability)
    assert mixing.mixture(none).count() == 0 and mixing.mixture(clashing).count() == 5
    given = mixing.mixture(docs, targets={"lang": {"en": 3.0, "de": 1.0}}, budget=0.3).collect()
    assert all(r.probability == 0 for r in given if r.lang not in ("en", "de"))


def test_scores(spark, docs, doc_rows, none, clashing):
    got = {r.doc_id: r for r in lm_score.lm_scores(docs).collect()}
    import zlib

    tokens = {i: (t or "").encode().lower().split() for i, t, *_ in doc_rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for i in train for w in tokens[i])
    total, v, ends = sum(count.values()) + len(train), len(count) + 1, len(train)
    norm = math.log10(total + 0.5 * (v + 1))
    for i, words in tokens.items():
        r = got[i]
        base = sum(math.log10(count[w] + 0.5) - norm for w in words) + math.log10(ends + 0.5) - norm
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(words) + 1, sum(count[w] > 0 for w in words) + 1, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0
    held = [r for r in got.values() if r.held_out and len(doc_rows) and r.bits_per_byte]
    assert np.median([r.bits_per_byte for r in held]) < 3.5
    assert lm_score.lm_scores(none).count() == 0 and lm_score.lm_scores(clashing).count() == 5


def test_weights_are_learnt_on_every_training_text(spark, docs, doc_rows):
    import zlib

    ids = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 40]
    rows = [(i, *r[1:]) for i, r in zip(ids, [r for r in doc_rows if len(r[1] or "") > 100] * 5)]
    got = [r.score / r.n_bytes for r in lm_score.model_scores(spark.createDataFrame(rows, docs.schema).select("doc_id", "text")).collect()]
    assert -np.median(got) * math.log2(10) < 1.92


def test_slots_follow_the_corpus(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sizes, collected = [], lm_score._collected
    monkeypatch.setattr(lm_score, "_collected", lambda *a: sizes.append([len(t) for t in collected(*a)]) or collected(*a))
    rows = [(k, bytes(rng.integers(33, 97, 200_000, dtype=np.uint8)).decode()) for k in range(12)]
    few, many = (lm_score.model_scores(spark.createDataFrame(rows[:n], "doc_id long, text string")) for n in (1, 12))
    assert few.count() == 1 and many.count() == 12
    assert max(sizes[0]) == 1 << 22 and max(sizes[-1]) > 1 << 22


def test_distinct_pairs():
    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(97, 109, 30_000, dtype=np.uint8)) for _ in range(6)] + [b"", b"ab"]
    for order, h in zip(lm_score.ORDERS, lm_score.pair_hashes(texts)):
        pairs = {(bytes(order) + t)[i : i + order + 1] for t in texts for i in range(len(t))}
        assert lm_score.distinct_of(lm_score.smallest(np.concatenate([h, h]))) == pytest.approx(len(pairs), rel=0.05 if len(pairs) >= lm_score.SKETCH else 0)


def test_code_paths_are_prefix_free():
    length, nodes, bits = lm_score.code_paths(np.array([1000 if b == 32 else b % 7 for b in range(256)]))
    assert abs(sum(2.0**-n for n in length) - 1) < 1e-12 and length[32] == min(length) and nodes.max() < 255
    assert len(nodes) == len(bits) == length.sum()


def test_log10_of_a_step_model_sums_bits():
    coder = lm_score.Coder(lm_score.code_paths(np.ones(256)))
    tables = [np.zeros(1 << lm_score.SLOT_BITS, np.uint8) for _ in lm_score.ORDERS]
    mixer = lm_score.Mixer(tables)
    texts = [b"", b"abc", b"x" * 2000]
    got = mixer.log10(coder.decisions(texts, steps=True), 3)
    assert got[0] == 0 and got[1] == pytest.approx(-24 * math.log10(2), rel=1e-3) and got[2] < 0


def test_first_step_works_out_only_the_pairs_it_meets(monkeypatch):
    rng = np.random.default_rng(5)
    coder = lm_score.Coder(lm_score.code_paths(rng.integers(0, 1000, 256)))
    tables = [rng.integers(0, 256, 1 << lm_score.SLOT_BITS).astype(np.uint8) for _ in lm_score.ORDERS]
    mixer = lm_score.Mixer(tables, rng.random((64, 3), np.float32) / 2, rng.uniform(0.1, 0.9, 255 * lm_score.REFINE_BUCKETS).astype(np.float32))
    texts = [b"", b"ab" * 256 + bytes(rng.integers(0, 256, 3000, dtype=np.uint8)), b"short", b"ab" * 700]
    met, outcomes = [], lm_score._outcomes
    monkeypatch.setattr(lm_score, "_outcomes", lambda s, *a: met.append(len(s)) or outcomes(s, *a))
    got = mixer.log10(coder.decisions(texts, steps=True), len(texts))
    keys, _ = lm_score.windows([t[: lm_score.STEP_BYTES] for t in texts])
    assert met[0] == coder.length[(np.unique(keys) & np.uint64(255)).astype(int)].sum()
    for text, score in zip(texts, got):  # byte by byte, every decision by itself
        scale, offset, total = np.float32(1), np.float32(0), 0.0
        keys, _ = lm_score.windows([text])
        for lo in range(0, len(keys), lm_score.STEP_BYTES):
            own = keys[lo : lo + lm_score.STEP_BYTES]
            pair, nodes, bits, _ = coder.paths_of(own)
            level = mixer.mixed([coder.slots_of(own, k, pair, nodes) for k in range(3)])
            s = level * scale + offset
            one = 1 / (1 + np.exp(-np.clip(s, -12, 12)))
            right = np.where(bits, one + mixer.refine[mixer.bucket(nodes, s)], 2 - one - mixer.refine[mixer.bucket(nodes, s)]) / 2
            miss = bits - one
            total += np.log10(right.astype(float)).sum()
            offset += np.float32(np.clip(lm_score.OWN_RATE * miss.sum() / len(bits) ** 0.5, -0.05, 0.05))
            scale += np.float32(np.clip(lm_score.OWN_RATE * (miss * level).sum() / len(bits) ** 0.5, -0.05, 0.05))
        assert score == pytest.approx(total, rel=1e-5)


def test_pairs_are_counted_by_sorting(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    monkeypatch.setattr(lm_score, "HELD_BYTES", 1000)
    monkeypatch.setattr(lm_score, "BATCH_BYTES", 300)
    monkeypatch.setattr(lm_score, "HELD_PAIRS", 2500)
    texts = [bytes(rng.integers(97, 102, int(n), dtype=np.uint8)).decode() for n in rng.integers(0, 200, 80)] + [None, ""]
    ids = list(range(len(texts)))
    rows = sorted((r for b in lm_score._pairs(7)(iter([pa.record_batch([pa.array(ids), pa.array(texts)], ["doc_id", "text"])])) for r in b.to_pylist()), key=lambda r: r["bucket"])
    merged = lm_score._merged_pairs(iter([pa.record_batch([pa.array([r[c] for r in rows]) for c in ("bucket", "fold", "pairs")], ["bucket", "fold", "pairs"])]))
    got, want = Counter(), Counter()
    for r in (r for b in merged for r in b.to_pylist()):
        keys, times = lm_score._unpacked_pairs(r["pairs"])
        assert (np.diff(keys.astype(np.int64)) > 0).all()
        for k, n in zip(keys.tolist(), times.tolist()):
            assert (r["fold"], k) not in got  # each pair once
            got[r["fold"], k] = n
    for i, t in zip(ids, texts):
        keys, _ = lm_score.windows([(t or "").encode()])
        want.update((lm_score.fold_of(i), k) for k in keys.tolist() if lm_score.fold_of(i) != lm_score.HELD_OUT)
    assert got == want
    first, number = lm_score.grouped(keys := rng.integers(0, 400, 5000).astype(np.uint64))
    assert first.tolist() == sorted(np.unique(keys, return_index=True)[1]) and (keys[first][number] == keys).all()


def test_words_are_numbered_by_whole_arrays(monkeypatch, doc_rows):
    import re
    from types import SimpleNamespace

    import pyarrow as pa

    from pixelweave.llm import dictionary

    rows = [(i, t) for i, t, *_ in doc_rows] + [(None, "  a B a\t"), (3, "b\x0b"), (4, "")]
    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    monkeypatch.setattr(dictionary, "materialize", lambda run, tag: [r for b in run(iter([batch])) for r in b.to_pylist()])
    monkeypatch.setattr(dictionary, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    monkeypatch.setattr(dictionary, "PART_BYTES", 50_000)
    docs = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, schema: run))
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    plain = lambda t: (re.findall("[^\x20\x09-\x0D]+", lower(t)), [len(t)])
    want = dictionary.encode(docs, plain, lambda i: i != 3, 1 << 40, "test")
    monkeypatch.setattr(dictionary, "_Numbers", lambda: None)  # a look-up in Python for every word of a part
    stats = lambda raw: [len(raw.decode("utf-8", "surrogatepass"))]
    got = dictionary.encode_words(docs, stats, lambda i: i != 3, 1 << 40, "test")
    assert len(got) == len(want) == 1
    unpacked = [[x.tolist() for x in dictionary._unpack(r.pop("entries"))] for r in (got[0], want[0])]
    assert got == want and unpacked[0] == unpacked[1]
    few = dictionary.encode_words(docs, stats, lambda i: i != 3, 200_000, "test")
    assert len(few) > 2 and sum((r["doc_id"] for r in few), []) == [i for i, _ in rows]


def test_sample_decides_each_row_by_its_own_cell(spark):
    text = "some plain words of a text"
    rows = [(i, text, lang, "s", len(text), "x", 0) for i in range(20) for lang in ("en", "de")] + [(None, text, "de", "s", len(text), "x", 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, n_tokens long")
    got = mixing.sample(docs, targets={"lang": {"en": 1.0}}, budget=0.4)
    assert got.columns == docs.columns
    chosen = Counter((r.doc_id, r.lang) for r in mixing.mixture(docs, targets={"lang": {"en": 1.0}}, budget=0.4).where("selected").collect())
    assert Counter((r.doc_id, r.lang) for r in got.collect()) == chosen
    assert chosen and all(lang == "en" for _, lang in chosen)


def test_parts_by_bytes_keep_whole_rows():
    import pyarrow as pa
    import pyarrow.compute as pc

    from pixelweave.llm.dictionary import parts_by_bytes

    texts = ["Ä" * 40, None, "", "a b", "C d " * 300, "e", None]
    parts = list(parts_by_bytes(pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"]), 1, 64))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts and len(parts) > 2
    lower = [w for p in parts for w in pc.ascii_split_whitespace(pc.ascii_lower(p.column(1).cast(pa.large_string()).fill_null(""))).flatten().to_pylist()]
    assert lower == [w for t in texts for w in ((t or "").replace("C", "c").split(" "))]


def test_vectors_of_any_length_and_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 0.0]), (4, [1e-200, 0.0]), (5, [2.0, 0.0]), (6, [0.0, 1.0, 1.0]), (7, [0.0, 3.0, 3.0]), (8, [0.0, 1.0, 1.2]), (9, [5.0]), (10, [1.0]), (11, [-1.0]), (12, [5e-324, 0.0]), (13, []), (14, [1.0, 0.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_neardup.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 3), 4: (3, 3), 5: (3, 3), 12: (3, 3), 6: (2, 6), 7: (2, 6), 8: (2, 6), 9: (1, 9), 10: (1, 9), 11: (0, 11), 13: (0, 13), 14: (0, 14)}


def test_split_buckets_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "FINER", 1)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fp = np.unique(np.array([base[k % 30] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for k in range(900)]))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    want = roots(len(fp), np.argwhere(np.triu(near, 1)).tolist())
    label = simhash.spanning_links(fp)
    assert len(set(zip(want, label.tolist()))) == len(set(want)) == len(set(label.tolist())) > 1
