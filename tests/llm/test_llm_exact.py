"""Operators against brute force on the small tables."""
import hashlib
import json
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as E
from sieve.llm import binpack, bpe, imatch, langid, packing, passages, pii, simhash, tokens, vecdedup
from sieve.plans.oracle import check, duck

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name, sf=MID):
    return E.queries()[name](spark, sf).collect()


def find_root(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_every_vocabulary_token_reaches_itself():
    """What the rank merger relies on: each token's own characters merge back to it."""
    model = json.load(open(WORD_BPE))["model"]
    merges = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
    assert all(model["vocab"][a + b] == 512 + i for (a, b), i in merges.items())
    for token in model["vocab"]:
        if token.startswith("<|") and token.endswith("|>"):
            continue
        end = token.endswith("</w>") and token != "</w>"
        parts = list(token[:-4] if end else token)
        if end:
            parts[-1] += "</w>"
        while len(parts) > 1:
            rank, i = min((merges.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = ["".join(parts[i : i + 2])]
        assert parts == [token]


ODD = ["", " ", "İstanbul Σας'S don't <|endoftext|> a<|startoftext|>b  x\x85y\x1cz \x01 \x00", "ÀÉ²³½ café Café 日本語 😀 I'LL 3.14", "ſK ŉ ﬁ ǅ", "áb ́",
       "==--==!!'s'T'Re'", "x" * 5000, "\n\t \r\n"]


def test_word_tokenizer_matches_the_library(texts):
    tok, lib = tokens.WordTokenizer(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    some = [*ODD, *list(texts.values())[:150]]
    for t, ids in zip(some, tok.texts(some), strict=True):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids
    tok.vocabulary.most = 50  # forgets, and stays right
    for t, ids in zip(some, [x for t in some for x in tok.texts([t])], strict=True):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_packing(spark, texts):
    rows = rows_of(spark, "op1_best_fit_packing")
    lib = Tokenizer.from_file(WORD_BPE)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, (doc, own) in enumerate(sorted(by_doc.items())):
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == [2048 * k for k in range(len(own))] and all(r.length == 2048 for r in own[:-1])
        if i % 5 == 0:
            ids = np.array([*lib.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
            assert sum(r.length for r in own) == len(ids)
            assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and sum(3 * n > 2048 for _, n in own) <= 2
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(by_seq) <= 1.05 * least + 1


def test_packing_plan_is_feasible_for_any_histogram():
    rng = np.random.default_rng(3)
    for _ in range(150):
        cap = int(rng.choice([7, 10, 30, 100]))
        sizes = np.clip(rng.exponential(cap / rng.choice([2, 4, 8]), int(rng.integers(1, 300))).astype(int) + 1, 1, cap)
        counts = {int(n): int(c) for n, c in zip(*np.unique(sizes, return_counts=True), strict=True)}
        steps, fill = packing.plan(counts, cap), {}
        for n, c in counts.items():
            own = sorted(s[1:] for s in steps if s[0] == n)
            for r in range(c):
                first, each, base, offset = max(s for s in own if s[0] <= r)
                fill.setdefault(base + (r - first) // each, []).append((offset + (r - first) % each * n, n))
        for own in fill.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= cap and sum(3 * n > cap for _, n in own) <= 2
    with pytest.raises(ValueError):
        packing.plan({5: 1}, 4)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), list(BASE).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [s[2] for s in sorted(out)]


def test_pii_base(spark, texts):
    for r in rows_of(spark, "op2_pii"):
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in BASE] == base
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in BASE]


def test_pii_patterns_on_random_strings():
    import random

    rnd = random.Random(5)
    for alphabet in ("a.@-_+1 ", "1. -+(2)0", "ab@.1", "0123456789 -+.", "4111 ٣é1"):
        for _ in range(1500):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50)))
            assert [f"{k}:{s}:{e}" for s, k, e, _ in pii.spans_of(t) if k in BASE] == base_spans(t), t


def test_pii_checksums_and_context():
    said = {(k, e - s) for s, k, e, _ in pii.spans_of("iban DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, ssn 123-45-6789")}
    assert said == {("iban", 27), ("iban", 22), ("id", 11)}
    assert not pii.spans_of("DE88 3704 0044 0532 0130 00") and not pii.spans_of("123-45-6789")
    long = ["1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 50_000, "DE12 " * 30_000]
    assert [len(pii.spans_of(t)) for t in long] == [0, 0, 25_000, 0, 0]


def slow_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, texts):
    rows = rows_of(spark, "op3_simhash")
    fps = {d: slow_fingerprint(t) for d, t in texts.items()}
    ids = sorted(fps)
    arr = np.array([fps[i] for i in ids], np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2, 1))
    roots = find_root([(ids[x], ids[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], ids)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", roots[i]) for i in ids}


def test_simhash_large_buckets_lose_no_link(spark):
    """A dense group in one block, with buckets cut to a few rows."""
    rng = np.random.default_rng(1)
    fps = {int(x) for x in (0x1234567800000000 + rng.integers(0, 1 << 12, 600))} | {int(x) for x in rng.integers(0, 1 << 62, 300)}
    ids = sorted(fps)
    links = simhash.close_links(spark.createDataFrame([(i,) for i in ids], "fp long"), 2, bucket_rows=16).collect()
    arr = np.array(ids, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2, 1))
    assert all(int(x.a ^ x.b).bit_count() <= 2 for x in links)
    assert find_root([(x.a, x.b) for x in links], ids) == find_root([(ids[x], ids[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], ids)


def test_imatch(spark, texts):
    rows = {r.doc_id: r for r in rows_of(spark, "op4_imatch")}
    order = sorted(texts, reverse=True)
    edited = {}
    for i, d in enumerate(order):
        t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
        k = len(t) // 3
        edited[d] = t[: len(t) - k] + nxt[:k]
        assert rows[d].n_chars == len(t) and rows[d].edited_sha256 == hashlib.sha256(edited[d].encode()).hexdigest()
    of_text = {}
    for d, r in rows.items():
        assert of_text.setdefault(texts[d], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1)
    far = [r for d, r in rows.items() if len(texts[d]) > 300]
    assert np.mean([r.near_edited for r in far]) > 0.3 > 0.1 > np.mean([r.near_next for r in far])
    assert np.mean([r.near_edited > r.near_next for r in far]) > 0.9


def test_imatch_signatures_are_those_of_the_lexicon_subsets(spark, texts):
    """Subsets recomputed from the words themselves and their exact document frequencies."""
    some = dict(list(texts.items())[:200])
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    from pyspark.sql import functions as F

    words = {d: {w for w in re.split(rf"[\s{re.escape(string.punctuation)}]+", t.lower(), flags=re.ASCII) if w} for d, t in some.items()}
    df = {}
    for own in words.values():
        for w in own:
            df[w] = df.get(w, 0) + 1
    signed = {w: (h := xxhash.xxh64(w.encode(), seed=42).intdigest()) - (h >> 63 << 64) for w in df}
    inside = {w for w, n in df.items() if max(2, 5e-4 * 200) <= n <= 0.1 * 200}
    known = imatch.lexicon(docs)
    assert {(h << imatch.BUCKET_BITS) + b for b, hs in enumerate(json.loads(known)) for h in hs} == {signed[w] for w in inside}
    got = {r.doc_id: r.s for r in imatch.with_fingerprint(docs, known, "text", "s").select("doc_id", "s").collect()}
    groups = []
    for d, terms in words.items():
        own = sorted(signed[w] for w in (terms & inside or terms))
        for level, (shift, mask) in enumerate(imatch.LEVELS):
            for s in range(imatch.SUBSETS):
                groups.append((d, level * imatch.SUBSETS + s, [h for h in own if (h % (1 << 64)) >> shift & mask == s % 4 * 4 + s // 4]))
    want = spark.createDataFrame(groups, "doc_id long, at int, own array<long>").select("doc_id", "at", F.xxhash64("own").alias("h")).collect()
    assert all(got[r.doc_id][r.at] == r.h for r in want) and len(want) == 48 * len(got)


def test_language_stretches_change_no_ngram(monkeypatch, texts):
    whole = " ".join(list(texts.values())[:20])
    once = np.bincount(langid.grams(whole), minlength=langid.BUCKETS)
    monkeypatch.setattr(langid, "STRETCH", 7)
    parts = list(langid.stretches(whole))
    assert len(parts) > 100 and "".join(parts) == whole
    assert (sum(np.bincount(langid.grams(p), minlength=langid.BUCKETS) for p in parts) == once).all()


@pytest.mark.parametrize("rows", [1, 5, 40, 10_000])
def test_language_sample_is_the_first_of_each_label(spark, rows):
    """Against a plain ranking of the distinct texts of each label by their hash."""
    labelled = [(i, f"text {i % 900}", "a" if i % 10 else "b") for i in range(1000)] + [(5000 + i, f"text {i}", None) for i in range(5)] + [(6000, None, "a")]
    docs = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    first = {}
    for i, t, lang in labelled:
        if t is not None and lang is not None:
            first[lang, t] = min(i, first.get((lang, t), i))
    ranked = []
    for lang in "ab":
        h = lambda t: (x := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (x >> 63 << 64)
        own = sorted((h(t), i) for (y, t), i in first.items() if y == lang)
        ranked += [(turn, lang, i) for turn, (_, i) in enumerate(own)]
    want = {(lang, i) for _, lang, i in sorted(ranked)[:rows]}
    assert {(r.lang, r.doc_id) for r in langid.sample(docs, rows).collect()} == want


def test_language_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang").collect()}
    rows = rows_of(spark, "op5_language_id")
    assert {r.doc_id for r in rows} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert np.mean([r.rejected for r in rows]) < 0.02


def test_byte_bpe(spark, texts):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows_of(spark, "op6_byte_bpe"):
        t = texts[r.doc_id]
        ids = np.array(lib.encode_ordinary(t), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_byte_bpe_odd_texts():
    import random

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    replay = bpe.MergeReplay(path, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=replay.ranks, special_tokens={})
    rnd, alphabet = random.Random(3), "aab bb c'sll  \n\t é日😀1 2\x85　.,!\x1c"
    odd = [*ODD, *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)), "a" * 500, "ab" * 300, " " * 50 + "x", "===---===!!!!" * 30]
    for t, ids in zip(odd, replay.encode(odd), strict=True):
        assert ids.tolist() == lib.encode_ordinary(t) and replay.decode(ids) == t.encode()
    pieces = sorted({p for t in odd for p in replay.split.findall(t)})
    ids, lens = replay.replay([p.encode() for p in pieces])
    ends = np.cumsum(lens)
    assert all(ids[e - n : e].tolist() == replay.one(p.encode()) for p, e, n in zip(pieces, ends, lens, strict=True))


def test_byte_bpe_round_trip(spark, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame(list(texts.items())[:100], "doc_id long, text string")
    got = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, with_ids=True), path, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in got.collect()} == dict(list(texts.items())[:100])


def test_vector_dedup(spark):
    rows = {r.vec_id: r for r in rows_of(spark, "op7_vector_dedup")}
    vec = {r.vec_id: r.embedding for r in spark.read.parquet(f"{MID}/embeddings.parquet").collect()}
    ids = sorted(vec)
    x = np.array([vec[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    a, b = np.nonzero(np.triu(near))
    roots = find_root([(ids[p], ids[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)], ids)
    links = sum(rows[i].n_links for i in ids)
    assert all(rows[i].n_links <= n for i, n in zip(ids, near.sum(1).tolist(), strict=True))
    assert links >= 0.9 * near.sum() and np.mean([rows[i].component_id == roots[i] for i in ids]) >= 0.9
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows.values())


def test_vector_dedup_counts_loose_components_whole(spark):
    """A chain of vectors, wider than the bound, in cells of a few rows."""
    angle = np.linspace(0, 2.5, 120)
    vecs = [(i, [float(np.cos(t)), float(np.sin(t)), 0.0]) for i, t in enumerate(angle)] + [(500, [1.0, 0.0, 0.0]), (501, [0.0, 0.0, 2.0])]
    rows = {r.vec_id: r for r in vecdedup.dedup(spark.createDataFrame(vecs, "vec_id long, embedding array<double>"), chunk_rows=8).collect()}
    x = np.array([v for _, v in vecs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9).sum(1) - 1
    assert [rows[i].n_links for i, _ in vecs] == near.tolist()
    assert {r.component_id for i, r in rows.items() if i != 501} == {0} and rows[501].component_id == 501


def test_vector_dedup_in_a_dense_source(spark):
    """Pairs of cosine 0.9 to 0.93 planted in a third of the rows that lie close together."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n, pairs = 12_000, 200
    x = unit(rng.standard_normal((n, 64)))
    third = unit(np.sqrt(0.6) * unit(rng.standard_normal((1, 64))) + np.sqrt(0.4) * x[: n // 3])
    x[: n // 3] = third
    off = rng.standard_normal((pairs, 64))
    off = unit(off - (off * third[:pairs]).sum(1, keepdims=True) * third[:pairs])
    cos = rng.uniform(0.901, 0.93, (pairs, 1))
    x[pairs : 2 * pairs] = cos * third[:pairs] + np.sqrt(1 - cos**2) * off
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    a, b = np.nonzero(np.triu(near))
    roots = find_root(list(zip(a.tolist(), b.tolist(), strict=True)), range(n))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in vecdedup.dedup(df).collect()}
    # links that were found, of those there are; none that isn't one
    assert all(rows[i].n_links <= m for i, m in enumerate(near.sum(1).tolist()))
    recall = sum(rows[i].n_links for i in range(n)) / near.sum()
    assert len(a) >= pairs and recall >= 0.95, recall
    assert np.mean([rows[i].component_id == roots[i] for i in range(n)]) >= 0.99


def test_vector_rounds_go_on_until_nothing_is_added(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((400, 32))
    x = np.vstack([base, base[:200] + 0.25 * rng.standard_normal((200, 32))])
    made, links = [], vecdedup.pass_links
    monkeypatch.setattr(vecdedup, "pass_links", lambda *a: made.append(a[3:]) or links(*a))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in vecdedup.dedup(df, passes=2, window=1).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert len(made) >= 3 and [w for w, _ in made] == [1 << i for i in range(len(made))] and len({s for _, s in made}) == len(made)
    assert sum(rows[i].n_links for i in range(600)) >= 0.9 * near.sum() > 200
    made.clear()
    assert all(r.n_links == 0 for r in vecdedup.dedup(df.filter("vec_id < 400")).collect()) and len(made) == 1


def test_url_filter_oracle(spark):
    assert check(spark, "op8_url_filter", MID, E.queries(), E.oracle_sql(), duck(MID))["ok"]


def test_token_matrices(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lib = Tokenizer.from_file(WORD_BPE)
    got, streams = {}, {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    rows = binpack.pack_matrices(docs, WORD_BPE, block_tokens=100_000).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 2048 and r.cu_seqlens[-1] == r.n_tokens <= 2048
        assert not ids[r.n_tokens :].any() and not positions[r.n_tokens :].any()
        for doc, piece, lo, hi in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            got[doc, piece] = ids[lo:hi].tolist()
            assert positions[lo:hi].tolist() == list(range(hi - lo))
    for doc, t in streams.items():
        whole = [*lib.encode(t, add_special_tokens=False).ids, 0]
        assert sum((got[doc, k] for k in range(-(-len(whole) // 2048))), []) == whole
    assert len(got) == sum(-(-(len(lib.encode(t, add_special_tokens=False).ids) + 1) // 2048) for t in streams.values())


def test_best_fit_decreasing_matches_a_plain_scan():
    rng = np.random.default_rng(0)
    for _ in range(100):
        cap = int(rng.integers(5, 60))
        lengths = rng.integers(1, cap + 1, int(rng.integers(0, 120))).tolist()
        gaps: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps[gaps.index(min(fits))] -= n
            else:
                gaps.append(cap - n)
        rows = binpack.best_fit_decreasing(lengths, cap)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(cap - sum(lengths[i] for i in r) for r in rows) == sorted(gaps)


def test_compact_windows_cover_each_run_once():
    rng = np.random.default_rng(1)
    for _ in range(60):
        h, t = rng.integers(0, 50, rng.integers(0, 50)).astype(np.uint64), int(rng.integers(1, 12))
        made = passages.compact_windows(h, t)
        for i in range(len(h)):
            for j in range(i + t, len(h) + 1):
                c = i + int(h[i:j].argmin())
                assert sum(left <= i and w == c and j <= right for left, w, right in made) == 1


def test_compact_windows_of_many_stretches_at_once():
    rng = np.random.default_rng(2)
    for _ in range(40):
        cuts = np.sort(rng.integers(0, 120, 8))
        left, right = cuts[::2], cuts[1::2]
        h, t = rng.integers(0, 40, 120).astype(np.uint64), int(rng.integers(1, 9))
        alone = [w + lo for lo, hi in zip(left, right, strict=True) for w in passages.compact_windows(h[lo:hi], t)]
        assert sorted(map(tuple, alone)) == sorted(map(tuple, passages.compact_windows(h, t, left, right)))


def repeated_runs(docs, size=50):
    """{run of words: {text number: its places}} of the runs in more than one text."""
    held = {}
    for i, words in enumerate(docs):
        for at in range(len(words) - size + 1):
            held.setdefault(tuple(words[at : at + size]), {}).setdefault(i, []).append(at)
    return {run: places for run, places in held.items() if len(places) > 1}


def uncovered(found, docs, size=50):
    """Texts of a run, beyond one, in which a place of the run isn't reported."""
    spans = {}
    for r in found:
        spans.setdefault(r.doc_id, []).append((r.start_word, r.stop_word))
    done = {}
    for i, own in spans.items():
        mark = np.zeros(len(docs[i]) + 1, bool)
        for lo, hi in own:
            mark[lo:hi] = True
        done[i] = np.concatenate([[0], np.cumsum(~mark)])
    out = 0
    for places in repeated_runs(docs, size).values():
        free = [i for i, own in places.items() if any(i not in done or done[i][at + size] > done[i][at] for at in own)]
        out += max(0, len(free) - 1)
    return out


def test_passages_cover_every_equal_run_of_the_corpus(spark, texts):
    """An index of all runs of 50 words over whole texts: each is reported at every place, but for one text."""
    kinds = sorted({t: i for i, t in sorted(texts.items(), reverse=True)}.items(), key=lambda x: x[1])
    docs = {i: passages.WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t)) for t, i in kinds}
    number = {i: n for n, i in enumerate(docs)}
    found = [r for r in passages.find(spark.read.parquet(f"{MID}/documents.parquet")).collect() if r.doc_id in number]
    renamed = [type("R", (), {"doc_id": number[r.doc_id], "start_word": r.start_word, "stop_word": r.stop_word}) for r in found]
    assert len(repeated_runs(list(docs.values()))) > 300 and uncovered(renamed, list(docs.values())) == 0


def test_passages_cover_lines_that_repeat_inside_a_text(spark):
    """Equal runs on several diagonals of one pair of texts."""
    rng = np.random.default_rng(8)
    word = lambda: "w" + str(rng.integers(0, 1 << 40))
    docs = []
    for _ in range(12):
        line, other = [word() for _ in range(30)], [word() for _ in range(25)]
        docs.append([word() for _ in range(10)] + line * 3 + other + [word() for _ in range(10)])
        docs.append(line + other + [word() for _ in range(20)] + line * 2 + other + line)
    found = passages.find(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
    assert uncovered(found, docs) == 0


def test_passages_find_planted_repeats_and_no_others(spark):
    rng = np.random.default_rng(4)
    word = lambda: "w" + str(rng.integers(0, 1 << 40))
    docs = [[word() for _ in range(int(rng.integers(60, 300)))] for _ in range(60)]
    line = [word() for _ in range(20)]
    for d in docs[30:]:
        d[5:5] = line  # a common line is no passage
    planted = {}
    for k in range(12):
        passage = [word() for _ in range(int(rng.integers(50, 120)))]
        near = list(passage)
        if k % 3 == 1 and len(near) > 60:
            near[len(near) // 2] = word()
        if k % 3 == 2 and len(near) > 60:
            del near[len(near) // 2]
        for d, own in ((2 * k, passage), (2 * k + 1, near)):
            at = int(rng.integers(0, len(docs[d])))
            docs[d][at:at] = own
            planted[d] = (at, at + len(own))
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(100, " ".join(docs[59])), (101, None), (102, ""), (103, "short")]
    found = passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.source_doc_id)) for r in found} == {frozenset((2 * k, 2 * k + 1)) for k in range(12)} | {frozenset((100, 59))}
    for r in found:
        if r.doc_id != 100:
            lo, hi = planted[r.doc_id]
            assert r.similarity >= 0.8 and abs(r.start_word - lo) <= 3 and abs(r.stop_word - hi) <= 3
        else:
            assert (r.start_word, r.stop_word) == (0, len(docs[59]))


def test_passages_of_a_large_class_all_meet(spark):
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(55)]
    rows = []
    for i in range(80):
        own = [f"x{rng.integers(0, 1 << 40)}" for _ in range(40)]
        own[int(rng.integers(0, 40)) : 0] = []
        rows.append((i, " ".join([*own[:20], *passage, *own[20:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in passages.find(docs).collect()}
    assert len(found) == 79
    kept = passages.remove(docs).collect()
    assert sum("p0 p1 p2" in r.text for r in kept) == 1 and len(kept) == 80


def test_passages_around_a_common_line(spark):
    """Pairs that share a passage whose middle stands in many other texts."""
    rng = np.random.default_rng(21)
    word = lambda: "w" + str(rng.integers(0, 1 << 40))
    line = [word() for _ in range(30)]
    docs = [[word() for _ in range(40)] + line + [word() for _ in range(40)] for _ in range(100)]
    for k in range(25):
        before, after = [word() for _ in range(15)], [word() for _ in range(15)]
        for d in (docs[2 * k], docs[2 * k + 1]):
            d[25:40], d[70:85] = before, after
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    found = passages.find(docs).collect()
    assert {frozenset((r.doc_id, r.source_doc_id)) for r in found} == {frozenset((2 * k, 2 * k + 1)) for k in range(25)}
    assert {(r.start_word, r.stop_word) for r in found} == {(25, 85)}


def test_passages_exact_repeats_around_a_crowded_line(spark):
    """55 equal words, 45 of which stand in all texts, are found for every pair."""
    rng = np.random.default_rng(33)
    word = lambda: "w" + str(rng.integers(0, 1 << 40))
    line = [word() for _ in range(45)]
    docs = [[word() for _ in range(30)] + line + [word() for _ in range(30)] for _ in range(200)]
    for k in range(90):
        before, after = [word() for _ in range(5)], [word() for _ in range(5)]
        for d in (docs[2 * k], docs[2 * k + 1]):
            d[25:30], d[75:80] = before, after
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    found = passages.find(docs).collect()
    assert {frozenset((r.doc_id, r.source_doc_id)) for r in found} == {frozenset((2 * k, 2 * k + 1)) for k in range(90)}
    assert {(r.start_word, r.stop_word) for r in found} == {(25, 80)}


def test_passages_name_every_source_with_its_own_similarity(spark):
    """Passages that stand in two texts as they are and in a third with a word changed."""
    rng = np.random.default_rng(12)
    word = lambda: "w" + str(rng.integers(0, 1 << 40))
    docs = []
    for _ in range(12):
        passage = [word() for _ in range(100)]
        edited = [*passage[:50], word(), *passage[51:]]
        docs += [[word() for _ in range(int(rng.integers(5, 40)))] + own + [word() for _ in range(20)] for own in (passage, passage, edited)]
    found = passages.find(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")).collect()
    assert len({(r.doc_id, r.start_word, r.stop_word, r.source_doc_id, r.source_start_word, r.source_stop_word) for r in found}) == len(found)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for r in found:
        a, b = shingles(docs[r.doc_id][r.start_word : r.stop_word]), shingles(docs[r.source_doc_id][r.source_start_word : r.source_stop_word])
        assert r.similarity == pytest.approx(len(a & b) / len(a | b))
    links = {frozenset((r.doc_id, r.source_doc_id)) for r in found}
    assert all(len([x for x in links if x <= {3 * k, 3 * k + 1, 3 * k + 2}]) >= 2 for k in range(12))


@pytest.mark.parametrize("copies", [12, 90])
def test_passages_between_the_ends_of_a_key_meet(spark, copies):
    """Every two of many near copies of a passage, edited in a word of their own, are linked."""
    base = [f"w{x}" for x in np.random.default_rng(7).integers(0, 10**6, 99)]

    def text(i):
        words = list(base)
        words[48 + i % 4] = f"x{i}"
        return " ".join([f"a{i}q{j}" for j in range(30)] + words + [f"b{i}q{j}" for j in range(30)])

    docs = spark.createDataFrame([(i, text(i)) for i in range(copies)], "doc_id long, text string")
    got = {tuple(sorted((r["doc_id"], r["source_doc_id"]))) for r in passages.find(docs).collect()}
    assert got == {(i, j) for j in range(copies) for i in range(j)}


def test_passages_go_on_past_a_crowded_run(spark):
    """Pairs of many texts with an equal run have eight more words in common past a word of their own."""
    rng = np.random.default_rng(41)
    word = lambda: "w" + str(rng.integers(0, 1 << 40))
    run = [word() for _ in range(62)]
    docs = [[word() for _ in range(30)] + run + [word() for _ in range(60)] for _ in range(160)]
    for k in range(80):
        docs[2 * k][93:101] = docs[2 * k + 1][93:101] = [word() for _ in range(8)]
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    found = passages.find(docs).collect()
    longer = {frozenset((r.doc_id, r.source_doc_id)) for r in found if (r.start_word, r.stop_word) == (30, 101)}
    assert longer == {frozenset((2 * k, 2 * k + 1)) for k in range(80)}
    # all others are linked by the run alone
    assert {r.doc_id for r in found} | {r.source_doc_id for r in found} == set(range(160))


def test_passages_meet_every_place_of_the_ends_of_a_key(spark):
    """Two texts hold a line in six passages each, and a text of its own has each of these with a word changed."""
    rng = np.random.default_rng(43)
    word = lambda: "w" + str(rng.integers(0, 1 << 40))
    line = [word() for _ in range(46)]
    ends = [[word() for _ in range(8)] for _ in range(12)]
    docs = [[w for k in own for w in [word() for _ in range(30)] + line + [word()] + ends[k]] for own in (range(6), range(6, 12))]
    docs += [[word() for _ in range(30)] + line + [word()] + ends[k] + [word() for _ in range(30)] for k in range(12)]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {frozenset((r.doc_id, r.source_doc_id)) for r in passages.find(frame).collect()}
    assert got == {frozenset((k // 6, 2 + k)) for k in range(12)}


def test_jumps_by_brute_force():
    rng = np.random.default_rng(5)
    span, gap, reach = 12, 3, 12 - 1 + 5 + 3
    base = rng.integers(1, 1 << 31, 2 * reach + 1)
    near = np.zeros((60, 2 * reach), np.uint32)
    for i in range(60):  # right then left, each equal to the base but for a stretch, then shifted back or not
        for side in (0, reach):
            own = base[:reach].copy() if side == 0 else base[reach : 2 * reach].copy()
            cut, lost, shift = rng.integers(0, reach + 1), rng.integers(1, 6), rng.integers(-2, 3)
            tail = np.roll(own, shift)
            own[cut:] = tail[cut:]
            own[cut : cut + 4 + lost] = rng.integers(1, 1 << 31, len(own[cut : cut + 4 + lost]))
            own[reach - int(rng.integers(0, 6)) :] = 0
            near[i, side : side + reach] = own
    right, left = passages.prefixes(near[:, :reach]), passages.prefixes(near[:, reach:])
    got = {(min(x, y), max(x, y)) for a, b in passages.jumps(near[:, :reach], right, left, span, gap) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    same = lambda a, b: int(np.append(a != b, True).argmax())
    want = set()
    for i in range(60):
        for j in range(i + 1, 60):
            a, b = near[i, :reach], near[j, :reach]
            r, back = same(a, b), same(near[i, reach:], near[j, reach:])
            if r < span and r + back + 1 >= span:
                x, y = a[r + 4 : r + 5 + gap], b[r + 4 : r + 5 + gap]
                if set(x[x > 0]) & set(y[y > 0]):
                    want.add((i, j))
    assert got == want and len(want) > 20
