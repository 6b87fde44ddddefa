"""Operators on single texts against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np

from pixelweave.llm import packing, secret_scan, token_counts, tokenizer_files
from pixelweave.llm.quality import quality_verdicts

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("abcd") == ("and", ("abc", "bcd"))
    assert q("[0-9a-f]+") == secret_scan.TRUE
    assert q("(ab|xyz)q") == ("or", (("and", ("abq",)), ("and", ("xyz", "yzq"))))
    assert q("api_?key") == ("or", (("and", ("_ke", "api", "i_k", "key", "pi_")), ("and", ("api", "ike", "key", "pik"))))
    assert q("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert q("x?[0-9]{3}foo") == ("and", ("foo",))


def test_secrets(docs, doc_rows, none, clashing):
    got = {r.doc_id: r for r in secret_scan.secret_report(docs).collect()}
    assert len(got) == len(doc_rows)
    for i, text, *_ in doc_rows:
        spans = base_spans(text or "")
        count = Counter(s[3] for s in spans)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == (count["assign"], count["access"], count["hex"]), i
        assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert set(filter(None, listed(spans).split(","))) <= set(filter(None, r.spans.split(",")))
    assert "private_key:0:31" in got[10_010].spans
    assert secret_scan.secret_report(none).count() == 0
    assert secret_scan.secret_report(clashing).count() == 5
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert clean[10_009].startswith("[REDACTED]' secret:xyz") and clean[10_004] == "one" and clean[10_001] is None
    assert secret_scan.redact(clashing).columns == clashing.columns


def test_full_index_agrees(docs):
    some = {(r.trigram, r.doc_id) for r in secret_scan.trigram_postings(docs.where("length(text) < 5000"), ["tok", "sec"]).collect()}
    every = secret_scan.trigram_postings(docs.where("length(text) < 5000"))
    assert some == {(r.trigram, r.doc_id) for r in every.where("trigram IN ('tok', 'sec')").collect()}


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(grams)
    covered = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, docs, doc_rows, none, clashing):
    got = {r.doc_id: r for r in quality_verdicts(docs).collect()}
    for i, text, *_ in doc_rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == statistics(text or ""), i
        assert not (r.base_failed and r.kept)
    assert quality_verdicts(none).count() == 0 and quality_verdicts(clashing).count() == 5
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    judged = [(labels[i], r.kept) for i, r in got.items() if i in labels and not r.base_failed]
    assert all(kept for quality, kept in judged if quality == 1)
    assert not any(kept for quality, kept in judged if quality == 0)


def reference_distances(x):
    """Plain numpy version of the concentration steps for one group."""
    from pixelweave.llm import quality as q

    floors = np.array(list(q.FLOORS.values()))
    lower = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    m = lower(x)
    s = np.diag((1.4826 * lower(np.abs(x - m))) ** 2 + floors**2)

    def d2(m, s):
        z = np.linalg.solve(np.linalg.cholesky(s), (x - m).T)
        return (z**2).sum(0)

    for _ in range(q.STEPS):
        b = np.minimum(np.floor(np.log(1 + d2(m, s)) * q.BINS_PER_UNIT), q.MAX_BIN)
        below = np.array([(b < v).sum() for v in b])
        own = x[below < np.ceil(q.KEPT_PART * len(x))]
        m = own.mean(0)
        s = q.CONSISTENCY * np.cov(own.T, bias=True) + np.diag(floors**2)
    return d2(m, s)


def test_outlier_distances(spark):
    from pixelweave.llm import quality as q
    from pixelweave.llm.common import materialize

    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        n = int(rng.integers(60, 900))
        chars = int(n * rng.uniform(4, 7))
        odd = i % 40 == 0
        rows.append((i, "en", "s", n, chars, int(chars * 0.4) if odd else int(rng.integers(0, 3)), int(chars * rng.uniform(0.01, 0.05)), 20, int(rng.integers(0, 3)), int(rng.integers(0, n // 20)), False))
    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_upper long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    stats = materialize(spark.createDataFrame(rows, schema), "test-stats")
    got = {r.doc_id: r.d2 for r in q.outlier_distances(stats).collect()}
    a = np.array([r[3:10] for r in rows], float)
    w, c, sy, up, li, du, re_ = a.T
    x = np.stack([np.log(c / w), np.log(1 + 100 * sy / c), np.sqrt(du / li), np.sqrt(re_ / w), np.arcsin(np.sqrt(up / c))], 1)
    want = reference_distances(x)
    assert np.allclose([got[i] for i in range(400)], want, rtol=1e-6)
    assert {i for i, d in got.items() if d > q.CUTOFF} == {i for i in range(400) if i % 40 == 0}


def test_groups_of_rejected_texts_are_pooled(spark):
    from pixelweave.llm import quality as q
    from pixelweave.llm.common import materialize

    rng = np.random.default_rng(8)
    row = lambda i, source, symbols, failed: (i, "en", source, 300, int(300 * rng.uniform(4, 7)), symbols, int(rng.integers(20, 80)), 20, 0, int(rng.integers(0, 20)), failed)
    rows = [row(i, f"s{i % 4}", int(rng.integers(0, 160)), False) for i in range(120)] + [row(200 + i, "bad", 0, True) for i in range(60)] + [row(300 + i, "bad", 0 if i else 150, False) for i in range(9)]
    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_upper long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    got = {r.doc_id: r.d2 for r in q.outlier_distances(materialize(spark.createDataFrame(rows, schema), "test-pooled")).collect()}
    assert all(got[i] <= q.CUTOFF for i in range(300, 309))


def test_token_counts(docs, doc_rows, none, clashing):
    tok = tokenizer_files.load(tokenizer_files.vocabulary_path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_counts.token_counts(docs, chunk_bytes=100_000).collect()}
    for i, text, *_ in doc_rows:
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 512), i
    assert token_counts.token_counts(none).count() == 0
    assert sorted(r.n_tokens for r in token_counts.token_counts(clashing).collect())[-1] == 6


def test_word_ids_equal_the_library():
    import random

    import pyarrow as pa

    ids = packing.WordIds(tokenizer_files.vocabulary_path("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZé'sß \n\t.,12½İſ—“\xa0\x1c\x85日本!") for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [None, "<|startoftext|> a<|endoftext|>b"]
    flat, edges = ids.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert flat[edges[k] : edges[k + 1]].tolist() == ids.tok.encode(t or "", add_special_tokens=False).ids, t


def test_packing(docs, doc_rows, none, clashing):
    import zlib

    tok = tokenizer_files.load(tokenizer_files.vocabulary_path("word_bpe_49k.json"))
    rows = packing.pack(docs, capacity=512, shard=200).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in doc_rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 512)) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 512
    least = -(-sum(r.length for r in rows) // 512)
    assert len(by_sequence) <= 1.02 * least + 1
    assert packing.pack(none).count() == 0 and packing.pack(clashing).count() == 5


def test_packing_keeps_pieces_that_stay_loose(spark):
    sizes = [18 + k * k % 27 for k in range(800)]
    df = spark.createDataFrame([(k, "a " * n) for k, n in enumerate(sizes)], "doc_id long, text string")
    rows = packing.pack(df, capacity=64, shard=10, slack=0).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == [(k, n + 1) for k, n in enumerate(sizes)]
    spans = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(a + n <= (b if s == t else 64) for (s, a, n), (t, b, _) in zip(spans, [*spans[1:], (None, 0, 0)]))


def test_sum_of_squares_rule():
    """Each piece goes where the sum of squares after it is least, by trying all."""
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 11, 60)
    where, offset = packing.sum_of_squares(lengths, 10)
    free: dict[int, int] = {}
    for s, k, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        def total(place):
            after = {**free, place: free.get(place, 10) - s}
            return sum(n * n for g, n in Counter(after.values()).items() if g > 0)

        options = [b for b, g in free.items() if g >= s] + [len(free)]
        assert total(k) == min(map(total, options)) and o == 10 - free.get(k, 10)
        free[k] = free.get(k, 10) - s


def test_packing_spreads_rows_without_or_with_repeated_ids(spark, monkeypatch):
    df = spark.createDataFrame([(None if k % 2 else 5, "a " * (20 + k % 9)) for k in range(900)], "doc_id long, text string").repartition(3)
    rule = packing._pack_shard

    def watched(capacity):
        own = rule(capacity)

        def run(pdf):
            if len(pdf) > 100:
                raise ValueError("a shard is too large")
            return own(pdf)

        return run

    monkeypatch.setattr(packing, "_pack_shard", watched)
    rows = packing.pack(df, capacity=64, shard=50).collect()
    assert len(rows) == 900
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in fill.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 64
