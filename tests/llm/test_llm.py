"""The corpus operators against the libraries, brute force and edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from siftlake.llm import bpe, cdc, common, embedding_dedup, media, mixing, ngram_join, quality, sharding, sparse_suffix, token_counts  # noqa: E402
from siftlake.llm.queries import oracle_sql, queries, vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, g string"
ODD = ["", None, " \n\t ", "one two", "a b c d e", "naïve ΣΑΣ İstanbul 12345 don't <|endoftext|> x<|startoftext|>", "x" * 5000, "é" * 700, "!?" * 300,
       "𝔘nicode 🎉🎉 e\u0301\u00a0z\u2003q", "ab" * 3000, "\x00 nul \x85 next", "word " * 400, "aaaa aaaa " * 50]


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), 7, "x") for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 300)) for _ in range(40)]
    passage = prose(rng, 60)
    near = []
    for t in base[:8] * 3:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return [*base, *base[:5], *base[:1] * 12, *near, *(f"{prose(rng, 80)} {passage} {prose(rng, 40)}" for _ in range(6)), *ODD]


def _topics(texts):
    """Each text's anchor word, by counting words one by one."""
    import regex

    words = [regex.findall(r"\p{Ll}{3,16}", t or "") for t in texts]
    df = {}
    for found in words:
        for w in set(found):
            df[w] = df.get(w, 0) + 1
    known = sorted(df, key=lambda w: (-df[w] * (len(texts) - df[w]), w))[:8]
    out = []
    for found in words:
        scores = [(found.count(w) / df[w], -i, w) for i, w in enumerate(known) if w in found]
        out.append(max(scores)[2] if scores else "")
    return out


LONG = ["it's'they'll'" * 200, "don'''t!!'s" * 100, "a1b2" * 500, "नमस्ते" * 300, "한국어 각 각" * 60]


def test_codec_matches_library():
    rng = random.Random(4)
    mixed = ["".join(rng.choices("abcé'!, 12\n  <|>🎉\u0301ΣA", k=rng.randint(1, 600))) for _ in range(100)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library = Tokenizer.from_file(vocabulary(name))
        for slice_ in (37, 1000, 1 << 16):
            own = bpe.Codec(vocabulary(name), slice_=slice_, step=8)
            for text in [*filter(None, ODD), *LONG, *mixed]:
                ids = library.encode(text, add_special_tokens=False).ids
                assert own.encode(text).tolist() == ids
                assert own.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)


def test_bpe_query_matches_library(spark, corpus):
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    docs = table(spark, [*corpus, *LONG])
    docs = docs.union(docs.where("doc_id < 3")).withColumn("ids", docs["n"]).withColumn("n_tokens", docs["g"])
    rows = bpe.digests(docs, vocabulary("word_bpe_49k.json")).collect()
    whole = {r["doc_id"]: r for r in bpe.encode_decode(docs, vocabulary("word_bpe_49k.json")).collect()}
    assert len(rows) == len(corpus) + len(LONG) + 3
    for r in rows:
        text = [*corpus, *LONG][r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
        assert bpe.unpacked(whole[r["doc_id"]]["ids"]) == ids and whole[r["doc_id"]]["decoded"] == back


def test_lookahead_is_sufficient_and_tight():
    """No boundary that far before a prefix's end is moved by what follows; over random lists some need it all."""
    rng, tight = random.Random(1), 0
    for trial in range(400):
        letters = "abc"[: 2 + trial % 2]
        tokens, merges = [*letters], []
        for _ in range(rng.randint(1, 9)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        machine = bpe.Transducer({t: i for i, t in enumerate(tokens)}, merges)

        def ends(text, machine=machine):
            return set(np.cumsum([len(t) for t in machine.merged([*text])]).tolist())

        need = 0
        for _ in range(12):
            text = "".join(rng.choices(letters, k=rng.randint(1, 50)))
            whole = ends(text)
            for cut in range(1, len(text)):
                moved = {e for e in ends(text[:cut]) ^ whole if e <= cut}
                need = max([need, *(cut - e + 1 for e in moved)])
        assert need <= machine.lookahead
        tight += need == machine.lookahead
    assert tight > 100


def test_every_pretoken_streams_in_bounded_windows():
    own = bpe.Codec(vocabulary("word_bpe_49k.json"), slice_=500, step=16)
    assert 0 < own.machine.lookahead < 1000
    held, feed = [], bpe.Stream.feed

    def watched(self, letters):
        out = feed(self, letters)
        held.append(len(self.waiting))
        return out

    bpe.Stream.feed = watched
    try:
        words = [prose(random.Random(i), 1) for i in range(300)]
        text = " ".join(words) + " " + "abetinosr" * 3000
        own.encode(text)
    finally:
        bpe.Stream.feed = feed
    assert own.machine.runs == len(set(words)) + 1 and max(held) <= own.machine.window


def test_counts_match_library():
    library, own = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), token_counts.Counter(vocabulary("byte_bpe_50k.json"))
    assert own.count(ODD) == [len(library.encode(t or "", add_special_tokens=False).ids) for t in ODD]


def test_blobs():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 5000, dtype=np.uint64))
    for x in (h, h[:1], h[:0], np.array([1, 1, (1 << 48) - 1], np.uint64)):
        assert (common.unsqueeze_sorted(common.squeeze_sorted(x)) == x).all()
    assert (common.unsqueeze(common.squeeze(h)) == h).all()


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
        w = [x for x in w.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if x]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def test_ngram_join_is_exact(spark, corpus):
    sets = _sets(corpus)
    parent = list(range(len(corpus)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for params in ({"named_buckets": 2}, {"bucket_split": 2, "fragments": 1 << 18}):
        rows = {r["doc_id"]: r for r in ngram_join.ngram_components(table(spark, corpus), batch_rows=16, **params).collect()}
        assert len(rows) == len(corpus)
        assert all(rows[i]["n_shingles"] == len(sets[i]) and rows[i]["component_id"] == find(i) for i in rows)


def test_open_buckets_in_parts(spark):
    """Many texts that share their rarest shingles but link in several components only."""
    rng = random.Random(9)
    shared = [prose(rng, 12) for _ in range(14)]
    texts = []
    for _ in range(70):
        texts.append(" . ".join(rng.sample(shared, 9)))
    texts += [t + " more" for t in texts[:30]]
    sets = _sets(texts)
    component = [*range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((component[i], component[j]))
                component = [a if c == b else c for c in component]
    assert 1 < len(set(component)) < len(texts)
    for split in (3, 4096):
        rows = ngram_join.ngram_components(table(spark, texts), bucket_split=split).collect()
        assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(component))


def test_passages_are_exact(spark, corpus):
    words = [[] if t is None else __import__("re").findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in corpus]
    first, marked = {}, set()
    for d, w in enumerate(words):
        for p in range(len(w) - 44):
            key = tuple(w[p : p + 45])
            if first.setdefault(key, (d, p)) != (d, p):
                marked |= {(d, q) for q in range(p, p + 45)}
    want = None
    for params in ({}, {"often": 0}, {"often": 3, "fragments": 1 << 18}):  # all sorted, all by window hashes, some of each
        got, rows = set(), sparse_suffix.repeated_passages(table(spark, corpus), batch_rows=16, **params).collect()
        for r in rows:
            got |= {(r["doc_id"], q) for q in range(r["start_word"], r["end_word"])}
        assert got == marked
        want = want or sorted(rows)
        assert sorted(rows) == want
    for r in want:
        w = words[r["doc_id"]][r["start_word"] : r["start_word"] + 45]
        assert first[tuple(w)][0] == r["first_doc_id"]
    kept = {r["doc_id"]: r["text"] for r in sparse_suffix.without_repeats(table(spark, corpus)).collect()}
    clean = [i for i in range(len(corpus)) if not any(d == i for d, _ in marked)]
    assert all(kept[i] == corpus[i] for i in clean)


def test_suffixes_sort_and_extend():
    """Classes of windows from sorted suffixes equal those of comparing all windows."""
    rng = np.random.default_rng(3)
    n, width = 300, 6
    key, before, after = rng.integers(0, 4, n).astype(np.uint64), rng.integers(1, 3, (n, width)).astype(np.uint64), rng.integers(1, 3, (n, width)).astype(np.uint64)
    left = rng.integers(0, width + 1, n)
    right = np.array([rng.integers(width - a, width + 1) for a in left])
    before[np.arange(width)[None, :] >= left[:, None]] = 0
    after[np.arange(width)[None, :] >= right[:, None]] = 0
    place = rng.permutation(n)
    first = sparse_suffix.extended(key, before, after, left, right, place)
    for j in range(width + 1):
        seen = {}
        for i in np.argsort(place):
            if left[i] >= j and right[i] >= width - j:
                window = (key[i], *before[i, :j], "|", *after[i, : width - j])
                assert first[i, j] == seen.setdefault(window, i)
            else:
                assert first[i, j] == -1


def test_chunks_resist_shifts(spark, corpus):
    texts = [t.encode() for t in corpus if t]
    doc, start, size, _ = cdc.chunks(texts, 24, 4096)
    for i, t in enumerate(texts):
        own = doc == i
        assert b"".join(t[a : a + n] for a, n in zip(start[own], size[own], strict=True)) == t
    rows = cdc.repeated_substrings(table(spark, corpus), batch_rows=16).collect()
    raw = [(t or "").encode() for t in corpus]
    assert all(raw[r["doc_id"]][r["start_byte"] : r["end_byte"]].decode() is not None for r in rows)
    found = {r["doc_id"] for r in rows}
    passages = range(len(corpus) - len(ODD) - 5, len(corpus) - len(ODD))  # all but the first place
    assert set(passages) <= found and not found & set(range(40))


def test_stretches_of_several_sources_stay(spark, corpus):
    rng = random.Random(8)
    parts = [prose(rng, 60) for _ in range(4)]
    joined = " ".join(parts)
    texts = [*corpus, *parts, joined, joined, prose(rng, 50)]
    raw = [(t or "").encode() for t in texts]
    doc, start, size, h = cdc.chunks(raw, 24, 4096)
    first, runs = {}, []
    for d, a, n, x in zip(doc.tolist(), start.tolist(), size.tolist(), h.tolist(), strict=True):
        if first.setdefault(x, (d, a)) != (d, a):
            if runs and runs[-1][0] == d and runs[-1][2] == a:
                runs[-1][2] = a + n
            else:
                runs.append([d, a, a + n])
    want = {(d, i) for d, a, b in runs if b - a >= 96 for i in range(a, b)}
    rows = cdc.repeated_substrings(table(spark, texts), batch_rows=16).collect()
    got = [(r["doc_id"], i) for r in rows for i in range(r["start_byte"], r["end_byte"])]
    assert len(got) == len(set(got)) and set(got) == want
    copy = len(corpus) + 5
    assert sorted(i for d, i in got if d == copy) == [*range(len(raw[copy]))]
    source = {a: first[x][0] for d, a, x in zip(doc.tolist(), start.tolist(), h.tolist(), strict=True) if d == copy}
    for r in rows:
        if r["doc_id"] == copy:
            assert {f for a, f in source.items() if r["start_byte"] <= a < r["end_byte"]} == {r["first_doc_id"]}
    assert {r["first_doc_id"] for r in rows if r["doc_id"] == copy} >= set(range(len(corpus), copy - 1))


def test_shards(spark, corpus):
    rows = sharding.balanced_shards(table(spark, corpus)).toPandas()
    counts = rows.groupby("shard").size().reindex(range(40), fill_value=0)
    assert counts.max() - counts.min() <= 1 and len(rows) == len(corpus)
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
    by = dict(zip(rows["doc_id"], zip(rows["size"], rows["text_crc32"])))
    assert all(by[i] == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(corpus))


def test_propagation_cuts_few_links(spark):
    """Links between neighbours of a group, cut by the shards, against the same without rounds; sizes stay even."""
    rng = random.Random(6)
    texts = [f"text {g}" for g in range(260) for _ in range(rng.choice([1, 2, 3, 5, 8]))]
    rng.shuffle(texts)

    def cut_links(**params):
        rows = sharding.balanced_shards(table(spark, texts), **params).toPandas().set_index("doc_id")
        counts = rows.groupby("shard").size().reindex(range(40), fill_value=0)
        assert counts.max() - counts.min() <= 1
        last, cut, all_ = {}, 0, 0
        for i, t in enumerate(texts):
            if t in last:
                all_ += 1
                cut += rows.loc[last[t], "shard"] != rows.loc[i, "shard"]
            last[t] = i
        return cut, all_

    cut, all_ = cut_links()
    alone, _ = cut_links(rounds=0, quota_buckets=1)
    assert cut <= 0.1 * all_ and cut <= alone


def test_groups_up_to_a_shard_stay_together(spark):
    from pyspark.sql import functions as F

    def shards_of(total, sizes, **params):
        ends = np.cumsum(sizes).tolist()
        group = F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e <= F.col("doc_id")))
        docs = spark.range(total).withColumnRenamed("id", "doc_id").withColumn(
            "text", F.when(F.col("doc_id") < ends[-1], F.concat(F.lit("copy "), group)).otherwise(F.concat(F.lit("own "), "doc_id")))
        rows = sharding.balanced_shards(docs, **params).toPandas()
        counts = rows.groupby("shard").size().reindex(range(40), fill_value=0)
        assert len(rows) == rows["doc_id"].nunique() == total and counts.max() - counts.min() <= 1
        assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
        rows = rows[rows["doc_id"] < ends[-1]]
        return rows.groupby(np.searchsorted(ends, rows["doc_id"], side="right"))["shard"].nunique().tolist()

    assert shards_of(10_000, [250, 249, 130, 60, 2, 2]) == [1] * 6
    assert shards_of(300, [7, 7, 5, 3, 2, 2]) == [1] * 6
    assert shards_of(10_000, [250] * 40) == [1] * 40
    assert shards_of(10_000, [1130, 40]) == [5, 1]  # four full shards and a rest
    small = [2] * 900 + [3] * 300 + [9, 40, 700]
    assert shards_of(40_000, small, quota_buckets=64) == [1] * len(small)
    tight = shards_of(40_000, [2] * 20_000, quota_buckets=64)  # no single documents
    assert sum(n - 1 for n in tight) < 40


def _vector_links(vectors, cosine=0.95):
    """Links and least reachable ids by comparing all vectors."""
    ok = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, component = {i: 0 for i in range(len(vectors))}, [*range(len(vectors))]
    for i in ok:
        for j in ok:
            if j < i and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    low, high = sorted((component[i], component[j]))
                    component = [low if c == high else c for c in component]
    return links, component


@pytest.mark.parametrize("params", [{}, {"tile": 8}, {"tile": 4, "band": 8}])
def test_embeddings(spark, params):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 16)).astype(np.float32)
    x[10:20] = x[:10] + 0.05 * rng.normal(size=(10, 16))
    x[20:30] = x[3]
    x[30] = 0
    x[40:80] = x[5] + np.linspace(0.1, 0.5, 40)[:, None] * rng.normal(size=(40, 16))  # a crowd with links of all kinds
    y = rng.normal(size=(6, 3)).astype(np.float32)
    vectors = [*x.tolist(), None, [], [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1.0, 2.0, 0.0], (x[5] * 3).tolist(), *y.tolist(), (y[0] * 2).tolist(), [0.0, 0.0]]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)] + [(None, x[3].tolist(), "x", 1)], "vec_id long, embedding array<float>, band string, cid int")
    rows = embedding_dedup.embedding_links(df, **params).collect()
    links, component = _vector_links(vectors)
    assert len(rows) == len(vectors) + 1
    for r in rows:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["component_id"] is None and r["kept"] is None
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[r["vec_id"]], component[r["vec_id"]], component[r["vec_id"]] == r["vec_id"])


def test_media(spark, corpus):
    rows = {r["doc_id"]: r for r in media.digests(media.audio_features(media.encode_audio(table(spark, corpus)))).collect()}
    for i, t in enumerate(corpus):
        payload = media.padded(t)
        r = rows[i]
        assert len(payload) % 192 == 0 and r["n_bytes"] == len((t or "").encode()) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(media.to_wav(payload, 12000)).hexdigest()
    seen = {}
    assert all(seen.setdefault(t or "", rows[i]["feature"]) == rows[i]["feature"] for i, t in enumerate(corpus))


def test_features_by_brute_force():
    """Resampling, log-mel frames and segments against sums written out."""
    own = media.Features(media.AudioConfig())
    c, h = own.c, own.kernel
    payload = bytes(np.random.default_rng(5).integers(0, 256, 1152, dtype=np.uint8))
    x = (np.frombuffer(payload, np.uint8) - 128.0) / 128.0
    half = (len(h) - 1) // 2
    y = [sum(h[m * c.down - k * c.up + half] * x[k] for k in range(len(x)) if 0 <= m * c.down - k * c.up + half < len(h)) for m in range(-(-len(x) * c.up // c.down))]
    assert np.allclose(np.concatenate([*own.resampled(x)]), y)
    frames = [np.array(y[a : a + c.frame]) for a in range(0, len(y) - c.frame + 1, c.hop)]
    mel, levels = own.log_mel(x)
    assert len(mel) == len(frames)
    for got, level, f in zip(mel, levels, frames, strict=True):
        spectrum = [abs(sum(v * w * np.exp(-2j * np.pi * k * t / c.frame) for t, (v, w) in enumerate(zip(f, own.window)))) ** 2 for k in range(c.frame // 2 + 1)]
        assert np.allclose(got, np.log(np.array(spectrum) @ own.bank + 1e-6), atol=1e-4)
        assert np.isclose(level, 10 * np.log10(np.mean(f**2) + 1e-9))
    levels = np.array([0, 0, 30, 14, 13, 5, 0, 19, 11, 0, 0, 0, 0, 0, 0.0])
    floor, on, spans = np.quantile(levels, 0.1), False, []
    for i, v in enumerate([*levels, -99]):
        if not on and v >= floor + c.open_db:
            on, begin = True, i
        elif on and v < floor + c.close_db:
            on = False
            spans.append((begin, i))
    assert own.segments(levels) == spans and len(spans) == 2
    found = own.of(media.to_wav(payload, c.rate))
    tensors, ms = media.read_tensors(found["tensors"])
    assert tensors.shape == (found["n_tensors"], c.frames, c.mels) and tensors.dtype == np.float32 and ms.shape == (found["n_tensors"], 2)
    assert (tensors.reshape(-1, c.mels)[: len(mel)] == mel).all() and found["payload"] == payload


def test_resampler_blocks_agree():
    x = np.random.default_rng(0).normal(size=5000)
    whole, parts = (np.concatenate([*media.Features(media.AudioConfig(block=b)).resampled(x)]) for b in (1 << 18, 256))
    assert np.allclose(whole, parts) and len(whole) == -(-5000 * 2 // 3)


def test_mixing_and_quality_edges(spark, corpus):
    docs = table(spark, corpus)
    rates = mixing.mixing_rates(docs).toPandas()
    assert len(rates) == len(corpus) and (rates["copies"] > 0).all() and ((rates["drawn"] - rates["copies"]).abs() < 1).all()
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(45)], "doc_id long, quality int, toxic int")
    scores = quality.quality_scores(docs, labels).toPandas()
    assert len(scores) == len(corpus) and scores.loc[scores.n_grams == 0, "kept"].all()
    assert quality.quality_scores(docs, labels.where("quality = 5")).toPandas()["kept"].all()


def skewed_docs(spark, n=30_000):
    """Words by id, so that topics differ by source and language; one source holds most rows."""
    from pyspark.sql import functions as F

    i = F.col("doc_id")
    words = F.when(i % 7 == 0, "river stone ").when(i % 5 == 0, "cloud rain wind ").otherwise("house garden ")
    return spark.range(n).withColumnRenamed("id", "doc_id").select(
        "doc_id", F.concat(F.repeat(words, 3), F.when(i % 4 == 0, F.repeat(F.lit("longer "), 9)).otherwise("")).alias("text"),
        F.when(i % 11 == 0, "de").otherwise("en").alias("lang"), F.when(i % 17 == 0, "rare").when(i % 3 == 0, "some").otherwise("main").alias("source"))


def test_mixed_meets_targets(spark):
    docs = skewed_docs(spark)
    rates = mixing.mixing_rates(docs).toPandas()
    assert rates["topic"].nunique() > 3 and rates["copies"].max() > 1
    mixed = mixing.mixed(docs.withColumn("topic", docs["lang"])).toPandas()
    assert list(mixed.columns) == ["doc_id", "text", "lang", "source", "topic"] and set(mixed["topic"]) == {"en", "de"}
    by = rates.set_index("doc_id")
    got = by.loc[mixed["doc_id"]]
    assert (mixed.groupby("doc_id").size() == by["drawn"][by["drawn"] > 0].sort_index()).all()
    for d in ("source", "lang", "topic"):
        own = rates.groupby(d)["n_tokens"].sum() ** 0.7
        target = own / own.sum()
        expected = (rates["copies"] * rates["n_tokens"]).groupby(rates[d]).sum()
        assert np.allclose(expected / expected.sum(), target[expected.index], rtol=1e-6, atol=0)
        sampled = got.groupby(d)["n_tokens"].sum()
        assert np.allclose(sampled / sampled.sum(), target[sampled.index], rtol=0.08)
    whole = mixing.mixing_rates(docs, least=0.0).toPandas()
    assert whole["copies"].max() == pytest.approx(1.0)


def test_raking_as_a_table_agrees(spark):
    docs = skewed_docs(spark, 3000)
    a, b = (mixing.mixing_rates(docs, most_local=n, sweeps=12).toPandas().sort_values("doc_id").reset_index(drop=True) for n in (50_000, 3))
    assert np.allclose(a["copies"], b["copies"], rtol=1e-9) and (a["topic"] == b["topic"]).all()


def test_topics_by_brute_force(spark, corpus):
    topics = _topics(corpus)
    rows = mixing.mixing_rates(table(spark, corpus)).collect()
    assert {r["doc_id"]: r["topic"] for r in rows} == dict(enumerate(topics))


def _quality_docs(spark):
    rng = random.Random(3)
    good, bad = [prose(rng, 1) for _ in range(200)], ["".join(rng.choices("#$%&*|", k=4)) for _ in range(40)]

    def words(i):
        share = 0.0 if i % 5 else rng.choice([0.03, 0.1, 0.5, 0.9])
        return " ".join(rng.choice(bad) if rng.random() < share else rng.choice(good) for _ in range(80))

    texts = [words(i) for i in range(900)]
    labels = [(i, int(i % 5 > 0), 0) for i in range(0, 900, 2)] + [(4, 0, 0), (8, 1, 1), (6, None, None), (None, 1, 0)]
    return texts, labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_by_brute_force_and_held_out(spark):
    texts, labels, known = _quality_docs(spark)
    docs = table(spark, texts).withColumnRenamed("g", "weight").withColumn("q", F_lit("q"))
    scores = quality.quality_scores(docs, known).toPandas().set_index("doc_id").sort_index()
    taught, held = quality.labelled_sample(known, 20_000)
    assert not set(taught) & set(held) and {**taught, **held}[4] == 0 and 8 not in taught and 8 not in held
    grams = []
    for t in texts:
        h, _ = common.words([t.encode()])
        grams.append([*(h & np.uint64((1 << 14) - 1)).tolist(), *(common.grams(h, 2) & np.uint64((1 << 14) - 1)).tolist()])
    raw, target = np.zeros(1 << 14), np.zeros(1 << 14)
    for i, g in enumerate(grams):
        np.add.at(raw, g, 1)
        if taught.get(i) == 1:
            np.add.at(target, g, 1)
    q = (raw + 0.5) / (raw + 0.5).sum()
    ratio = np.log((target + 2 * len(raw) * q) / (target.sum() + 2 * len(raw))) - np.log(q)
    weight = np.array([ratio[g].mean() for g in grams])
    assert np.allclose(scores["weight"], weight, atol=1e-8) and (scores["n_grams"] == [len(g) for g in grams]).all()
    noise = np.array([-math.log(-math.log(int(hashlib.md5(f"{i}|gumbel".encode()).hexdigest()[:12], 16) / 2**48 * (1 - 2e-12) + 1e-12)) for i in range(len(texts))])
    k = int(scores["kept"].sum())
    best = set(np.argsort(-(np.round(weight, 9) * 40 + noise))[:k].tolist())
    assert best == set(scores.index[scores["kept"]])
    # the noise decides near the edge, and labels that taught nothing are told apart
    plain = set(np.argsort(-weight)[:k].tolist())
    assert 0 < len(best - plain) < 0.1 * k
    good = [i for i, v in held.items() if v == 1]
    junk = [i for i in range(0, 900, 5) if sum(w[0] in "#$%&*|" for w in texts[i].split()) > 30]
    assert scores.loc[good, "kept"].mean() > 0.95 and scores.loc[junk, "kept"].mean() < 0.05
    again = quality.keep_good(docs, known)
    assert again.columns == docs.columns and {r[0] for r in again.select("doc_id").collect()} == best and again.first()["q"] == "q"


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_top_k(spark):
    values = [float(v) for v in np.random.default_rng(1).normal(size=500)] + [3.0] * 20
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 100, 519):
        assert quality.top_k(df, k, bins=8) == sorted(values)[-k]
    assert quality.top_k(df, 520) is None


def _all_operators(docs, labels):
    return {"bpe": bpe.encode_decode(docs, vocabulary("word_bpe_49k.json")), "bpe digests": bpe.digests(docs, vocabulary("word_bpe_49k.json")), "ngrams": ngram_join.ngram_components(docs),
            "chunks": cdc.repeated_substrings(docs), "mixing": mixing.mixing_rates(docs), "quality": quality.quality_scores(docs, labels), "shards": sharding.balanced_shards(docs),
            "counts": token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json")), "passages": sparse_suffix.repeated_passages(docs),
            "media": media.digests(media.audio_features(media.encode_audio(docs)))}


def _all_stages(docs, labels):
    return {"quality": quality.keep_good(docs, labels), "near": ngram_join.keep_one(docs), "passages": sparse_suffix.without_repeats(docs), "mixing": mixing.mixed(docs)}


LABELS = "doc_id long, quality int, toxic int"


def test_empty_tables(spark):
    docs = table(spark, ["x"]).where("doc_id < 0")
    labels = spark.createDataFrame([], LABELS)
    outs = {**_all_operators(docs, labels), **_all_stages(docs, labels), "vectors": embedding_dedup.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>"))}
    for name, out in outs.items():
        assert out.count() == 0, name


def test_odd_rows_and_clashing_columns(spark):
    """Nulls in all columns, blanks, a very long word, ties, repeated rows, and columns named as the operators' own."""
    clash = ["id", "spans", "gone", "q", "topic", "n", "times", "k_source", "K_Topic", "label", "copies", "frag", "batch", "blob", "shard", "size", "kept", "weight", "heads"]
    texts = [None, "", "  ", "one", "same words here for all of us", "same words here for all of us", "w" * (1 << 21) + " tail", prose(random.Random(1), 120)]
    texts.append(texts[-1])
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[-1], None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame([r + tuple(f"c{i}" for i in range(len(clash))) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash))
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, None), (5, None, 1), (None, None, None), (4, 0, 0), (99, 1, 0)], LABELS)
    per_row = {"bpe", "bpe digests", "ngrams", "mixing", "quality", "shards", "counts", "media"}
    for name, out in _all_operators(docs, labels).items():
        got = out.collect()
        if name in per_row:
            assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((r[0] is None, r[0]) for r in rows), name
        else:
            got = [r for r in got if r["doc_id"] != 6]  # the long word repeats itself
            assert {r["doc_id"] for r in got} == {8} and {r["first_doc_id"] for r in got} == {7}, name
    by = {r["doc_id"]: r for r in ngram_join.ngram_components(docs).collect()}
    assert by[5]["component_id"] == 4 and by[8]["component_id"] == 7 and by[0]["n_shingles"] == 0 and by[None]["component_id"] is None and by[6]["n_shingles"] == 1
    for name, out in _all_stages(docs, labels).items():
        got = out.collect()
        assert out.columns == docs.columns and all(r["id"] == "c0" and r["heads"] == f"c{len(clash) - 1}" for r in got), name
        ids = [r["doc_id"] for r in got]
        if name == "near":
            assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 4, 6, 7] and ids.count(None) == 2
        if name == "passages":
            assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 4, 5, 6, 7] and ids.count(None) == 2


def test_long_words_are_hashed_in_pieces(monkeypatch):
    import re

    rng = random.Random(2)
    for block in (16, 64):
        monkeypatch.setattr(common, "_BLOCK", block)
        for _ in range(60):
            texts = ["".join(rng.choices("aBé \t\nxyz" + " " * rng.randint(0, 4), k=rng.randint(0, 300))).encode() for _ in range(4)]
            hashes, counts, starts, ends = common.words(texts, spans=True)
            want = [(i, m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
            assert [*zip(np.repeat(range(4), counts).tolist(), starts.tolist(), ends.tolist())] == want
            for h, (i, a, b) in zip(hashes, want, strict=True):
                data = common._LOWER[np.frombuffer(texts[i][a:b], np.uint8)]
                assert common.span_hashes(data, np.array([0]), np.array([b - a]))[0] == h


def test_repeated_rows(spark, corpus):
    docs = table(spark, corpus[:20])
    twice = docs.union(docs)
    assert ngram_join.ngram_components(twice).distinct().count() == 20
    assert sparse_suffix.repeated_passages(twice).count() == sparse_suffix.repeated_passages(docs).count() == 0
    assert cdc.repeated_substrings(twice).count() == 0


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - {"op2_ngram_join"}))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    ours, theirs = queries()[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert a.equals(b)


def test_pipeline_stages(spark, corpus, tmp_path):
    """Near duplicates, passages and mixing against plain Python, on each stage's own input."""
    import math
    import re

    import corpus_pipeline

    table(spark, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(45)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(docs.collect(), key=lambda r: r["doc_id"])
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = before, docs.collect()

    before, after = steps["near_duplicates"]
    sets = _sets([r["text"] for r in before])
    component = [*range(len(before))]
    for i in range(len(before)):
        for j in range(i):
            if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((component[i], component[j]))
                component = [a if c == b else c for c in component]
    assert sorted(r["doc_id"] for r in after) == [r["doc_id"] for i, r in enumerate(before) if component[i] == i]

    before, after = steps["passages"]
    words = {r["doc_id"]: re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode()) for r in before}
    first, marked = {}, set()
    for d, w in words.items():
        for p in range(len(w) - 44):
            if first.setdefault(tuple(w[p : p + 45]), (d, p)) != (d, p):
                marked |= {(d, q) for q in range(p, p + 45)}
    left = {d: [x for q, x in enumerate(w) if (d, q) not in marked] for d, w in words.items()}
    touched = {d for d, _ in marked}
    want = {d: w for d, w in left.items() if d not in touched or len(w) >= 5}
    assert {r["doc_id"]: re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode()) for r in after} == want

    before, after = steps["mixing"]
    cells, of = {}, {}
    for r, topic in zip(before, _topics([r["text"] for r in before]), strict=True):
        n = len(re.findall(r"[^ \t\n\r\x0B\f]+", r["text"] or ""))
        of[r["doc_id"]] = cell = (r["source"] or "", r["lang"] or "", topic)
        if n:
            cells[cell] = cells.get(cell, 0) + n
        else:
            of[r["doc_id"]] = None
    weight, total = dict(cells), sum(cells.values())
    for _ in range(40):
        for k in range(3):
            own, has = {}, {}
            for c in cells:
                own[c[k]] = own.get(c[k], 0) + cells[c]
                has[c[k]] = has.get(c[k], 0) + weight[c]
            powers = sum(v**0.7 for v in own.values())
            weight = {c: w * own[c[k]] ** 0.7 / powers * total / has[c[k]] for c, w in weight.items()}
    ratio = {c: weight[c] / cells[c] for c in cells}
    scale = max(1 / max(ratio.values()), 0.5)
    ids = []
    for d, cell in of.items():
        copies = 1.0 if cell is None else ratio[cell] * scale
        draw = int(hashlib.md5(f"{d}|mix".encode()).hexdigest()[:12], 16) / 2**48
        ids += [d] * (math.floor(copies) + (draw < copies - math.floor(copies)))
    assert sorted(r["doc_id"] for r in after) == sorted(ids)

    assert sorted(r["doc_id"] for r in steps["tokens"][1]) == sorted(ids)
