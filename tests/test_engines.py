"""Exact vectors and invariants of the engines."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siftlake.functions import detect, scalars
from siftlake.functions.text import split_lines
from siftlake.operators import log, reformat, relevance, search
from siftlake.sources import store


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("text,kind", [
    ('[{"a":1}]', "json_array"), ('{"a":1}', "text"), ("diff --git a/x b/x\n", "diff"), ("x\n@@ -1 +1 @@\n", "diff"), ("<!DOCTYPE html><p>", "html"),
    ("src/a.go:12:func x", "search"), ("a.go:1:2: error: no", "build"), ("import os", "source_code"), ("plain words", "text"), ("", "text"), ("[1] tail", "text")])
def test_detect(spark, text, kind):
    assert one(spark, text, detect.content_type) == kind


@pytest.mark.parametrize("text,lines", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb\r", ["a", "b\r"]), ("\n", [""]), ("a\rb", ["a\rb"])])
def test_lines(spark, text, lines):
    assert one(spark, text, split_lines) == lines


def test_keys(spark):
    assert one(spark, "hello", scalars.key_md5) == "5d41402abc4b2a76b9719d91"
    assert one(spark, "", scalars.key_md5) == "d41d8cd98f00b204e9800998"
    assert one(spark, "<<ccr:5d41402abc4b2a76b9719d91>>", scalars.marker_key) == "5d41402abc4b2a76b9719d91"
    assert one(spark, "<<ccr:5d41402abc4b2a76b9719d91>> ", scalars.marker_key) is None


@pytest.mark.parametrize("text,n", [("", 1), ("a", 1), ("abcd", 1), ("abcde", 1), ("abcdef", 2), ("abcdefgh", 2), ("éééé", 1)])
def test_tokens(spark, text, n):
    assert one(spark, text, scalars.token_estimate) == n


@pytest.mark.parametrize("line,level", [("errorless", "unknown"), ("ERROR_CODE", "unknown"), ("ERROR: x", "error"), ("WARNING then ERROR", "error"), ("éerror", "error"), ("eRRor", "unknown")])
def test_level(spark, line, level):
    assert one(spark, line, log.level) == level


def test_log(spark):
    text = "\n".join(["DEBUG noisy heartbeat tick"] * 80 + ["ERROR database connection refused"])
    row = log.log_compress(spark.createDataFrame([(1, text), (2, "a\nb\nc"), (3, "")], "block_id long, content string")).orderBy("block_id").collect()
    assert "ERROR database" in row[0]["compressed"] and row[0]["cache_key"] == hashlib.md5(text.encode()).hexdigest()[:24]
    assert row[1]["cache_key"] is None and row[2]["compressed"] == ""
    tied = "\n".join(f"=== {i}" for i in range(200))
    row = log.log_compress(spark.createDataFrame([(1, tied)], "block_id long, content string")).first()
    assert row["kept"] == 100 and row["compressed"].startswith("=== 0\n=== 1\n")


def test_same_at_any_partitioning(spark):
    from siftlake.sources.corpora import log_blocks

    blocks = log_blocks(spark, "/root/testdata/sf0.001")
    rows = [sorted(map(tuple, log.log_compress(blocks.repartition(n)).collect())) for n in (1, 7)]
    assert rows[0] == rows[1]


def test_search(spark):
    blocks = spark.createDataFrame([(1, "C:\\foo:10:bar"), (2, "\n".join(["a.go:1:same"] * 40)), (3, "prose"), (4, "a:18446744073709551616:x")], "block_id long, content string")
    row = {r["block_id"]: r for r in search.search_compress(blocks).collect()}
    assert row[1]["n_matches"] == 1 and row[2]["kept"] == 1 and row[3]["compressed"] == "prose" and row[4]["n_matches"] == 0


def test_minify():
    assert reformat.minified('{ "b": 1.0, "a": [1e400, "<"] }') == '{"a":[1e400,"<"],"b":1.0}'
    assert reformat.minified("[1] x") is None and reformat.minified("[1]") is None and reformat.minified("NaN ") is None


def test_minify_odd_strings():
    assert reformat.minified('[ "\\ud800", 1 ]') == '["\ufffd",1]'
    assert reformat.minified('{ "\\udfffk" : "\\ud83d\\ude00" }') == '{"\ufffdk":"\U0001f600"}'
    assert reformat.minified('[ "a\u2028b" , 1, 2, 3, 4, 5, 6 ]') == '["a\\u2028b",1,2,3,4,5,6]'
    assert reformat.minified("\x1c[1 , 2]") is None  # not white space that is trimmed


def test_template():
    text = "\n".join(f"INFO worker {i} finished the job" for i in range(30)) + "\n"
    out = reformat.templated(text)
    head, *rows = out.splitlines()
    assert head == "[Template T1: INFO worker <*> finished the job] (30 occurrences)"
    assert [f"INFO worker {r} finished the job" for r in rows] == text.splitlines()
    assert reformat.templated("\n".join("abcdefghij"[i % 10] * (i + 1) for i in range(25))) is None


def test_template_splits_at_white_space_only():
    text = "\n".join(f"INFO\u00a0job a\x1cb {i} ended" for i in range(30))
    head, *rows = reformat.templated(text).splitlines(True) if reformat.templated(text) else [""]
    assert reformat.templated(text).split("\n")[0] == "[Template T1: INFO job a\x1cb <*> ended] (30 occurrences)"


def test_relevance(spark):
    x = spark.createDataFrame([("alpha beta beta",), ("none",)], "item string")
    rows = relevance.bm25(x, F.lit("alpha beta")).collect()
    assert rows[0]["reason"] == "BM25: matched 2 terms (alpha, beta)" and rows[1]["reason"] == "BM25: no term matches"
    assert relevance.hybrid(relevance.bm25(x, F.lit("alpha"))).first()["score"] == pytest.approx(0.3)


def test_store(spark):
    puts = spark.createDataFrame([("a", 1, 0), ("b", 2, 5), ("a", 3, 9)], "content string, seq long, at long")
    kept = store.entries(puts)
    assert [r["payload"] for r in store.first_in_first_out(kept, 1).collect()] == ["b"]
    assert {r["payload"] for r in store.alive(kept, 12, 5).collect()} == {"a"}
    assert store.alive(kept, 10**9, None).count() == 2


def test_diff(spark):
    from siftlake.operators import diff

    hunks = "\n".join(f"@@ -1,9 +1,9 @@ h{i}\n" + "\n".join([" c"] * 4 + [f"-a{i}", f"+b{i}"] + [" c"] * 4) for i in range(30))
    text = f"diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n{hunks}"
    rows = {r["block_id"]: r for r in diff.diff_compress(spark.createDataFrame([(1, text), (2, "diff --git a/x b/x\n+1"), (3, "plain\n" * 60)], "block_id long, content string")).collect()}
    assert rows[1]["hunks_removed"] == 20 and rows[1]["additions"] == 30 and "@@ h0\n" in rows[1]["compressed"] and "@@ h29\n" in rows[1]["compressed"] and rows[1]["cache_key"]
    assert rows[2]["compressed"] == "diff --git a/x b/x\n+1" and rows[3]["compressed"] == "plain\n" * 60


def test_diff_forms(spark):
    from siftlake.config import DiffConfig
    from siftlake.operators import diff

    files = {
        "rename": ["diff --git a/x b/y", "similarity index 95%", "rename from x", "rename to y"],
        "binary": ["diff --git a/i.png b/i.png", "index 1..2", "Binary files a/i.png and b/i.png differ"],
        "new": ["diff --git a/n b/n", "new file mode 100755", "--- /dev/null", "+++ b/n", "@@ -0,0 +1 @@", "+one"],
        "three": ["diff --cc m", "--- a/m", "+++ b/m", "@@@ -1,2 -1,2 +1,3 @@@ f", "  same", "++both", "  same"],
        "four": ["diff --combined c", "@@@@ -1 -1 -1 +1,2 @@@@", "+++all", "   x"],
        "bare": ["diff --git a/q b/q", "--- a/q", "+++ b/q", "@@ -1,9 +1,9 @@", *[f" c{i}" for i in range(9)], "\\ No newline at end of file"],
        "far": ["diff --git a/r b/r", "--- a/r", "+++ b/r", "@@ -1,9 +1,9 @@", "-old", "+new", *[f" d{i}" for i in range(6)], "\\ No newline at end of file", " e"],
    }
    text = "\n".join(["From: someone", "", *[x for f in files.values() for x in f], *["diff --git a/z b/z"] * 12, "@@ -1 +1 @@", "-1", "+2"])
    config = DiffConfig(min_lines=10)
    row = diff.diff_compress(spark.createDataFrame([(1, text)], "block_id long, content string"), "", config).first()
    out = row["compressed"].split("\n")
    assert row["files"] == 19 and row["additions"] == 4 and row["deletions"] == 2 and out[:2] == ["From: someone", ""]
    body = "\n".join(out)
    for want in (files["rename"], ["diff --git a/i.png b/i.png", "Binary files differ", "diff --git a/n b/n", "new file mode 100644", "--- /dev/null", "+++ b/n", "@@ -0,0 +1 @@", "+one"], files["three"],
                 ["diff --combined c", "@@@@ -1 -1 -1 +1,2 @@@@", "+++all", "   x"], ["@@ -1,9 +1,9 @@", " c0", " c1", "diff --git a/r b/r"],
                 ["@@ -1,9 +1,9 @@", "-old", "+new", " d0", " d1", "\\ No newline at end of file", "diff --git a/z b/z"]):
        assert "\n".join(want) in body
    many = "\n".join(f"diff --git a/f{i} b/f{i}\n@@ -1 +1 @@\n" + "\n".join(["+x"] * (1 + i % 7)) for i in range(25))
    row = diff.diff_compress(spark.createDataFrame([(1, many)], "block_id long, content string"), "", config).first()
    shown = [line for line in row["compressed"].split("\n") if line.startswith("diff ")]
    order = sorted(range(25), key=lambda i: (-(i % 7), i))[:20]
    assert row["files"] == 20 and shown == [f"diff --git a/f{i} b/f{i}" for i in order] and row["additions"] == sum(1 + i % 7 for i in order)


@pytest.mark.parametrize("path,lock", [("go.sum", True), ("a/go.sum", True), ("a\\\\go.sum", True), ("xgo.sum", False), ("go.sum.bak", False), ("Cargo.lock", True)])
def test_lockfiles(spark, path, lock):
    from siftlake.operators import diff

    body = "\n".join(f"+x{i}" for i in range(40))
    row = diff.diff_noise_apply(spark.createDataFrame([(1, f"diff --git a/{path} b/{path}\n@@ -0,0 +1,40 @@\n{body}\n")], "block_id long, content string")).first()
    assert (row["output"] is not None) == lock


def test_tags(spark):
    from siftlake.operators import tags

    text = '<think a="x>y">keep <b>me</b></think> <x/> </orphan> <open> <!-- c --> <div>h</div>'
    block, marks = tags.protected(text), tags.protected(text, True)
    assert [b["original"] for b in block["blocks"]] == ['<think a="x>y">keep <b>me</b></think>', "<x/>"] and block["orphans"] == 1 and block["html"] == 4
    assert [b["original"] for b in marks["blocks"]] == ['<think a="x>y">', "</think>", "<x/>", "<open>"]
    assert tags.protected("{{KEPT_TAG_0}} <x/>")["collision"]
    back = spark.createDataFrame([(text,)], "t string").select(tags.protect_tags(F.col("t")).alias("p")).select(tags.restore_tags(F.col("p.text"), F.col("p.blocks"))).first()[0]
    assert back == text


def test_tags_in_linear_time():
    import time

    from siftlake.operators import tags

    began = time.perf_counter()
    for text in ("<x " * 200_000, '<x "' * 150_000, "<x '\"" * 100_000, "<open>" * 100_000 + "</none>" * 100_000, "</x " * 150_000, "<a><b/></a>" * 60_000):
        assert tags.protected(text)["seen"] >= 0 and tags.protected(text, True)["seen"] >= 0
    assert time.perf_counter() - began < 30


def _model_of_tags(text, markers):
    """Tags one by one, as the rules say, byte after byte."""
    names, white = "abcdefghijklmnopqrstuvwxyz", " \t\n\r\f\v"
    spans, open_, i, orphans, custom, alone_ = [], [], 0, 0, 0, 0
    while i < len(text):
        j = i + 1
        if text[i] != "<":
            i += 1
            continue
        closing = text[j : j + 1] == "/"
        j += closing
        begin = j
        while j < len(text) and (text[j] in names or (j > begin and text[j] in "-.:0")):
            j += 1
        if j == begin:
            i += 1
            continue
        name, end, alone = text[begin:j], None, False
        if closing:
            while j < len(text) and text[j] in white:
                j += 1
            end = j + 1 if text[j : j + 1] == ">" else None
        else:
            while j < len(text):
                if text[j] in "\"'":
                    j = text.find(text[j], j + 1)
                    if j < 0:
                        break
                elif text[j : j + 2] == "/>":
                    end, alone = j + 2, True
                    break
                elif text[j] == ">":
                    end = j + 1
                    break
                j += 1
        if end is None:
            i += 1
            continue
        if name not in ("b", "p"):
            if closing:
                k = next((k for k in reversed(range(len(open_))) if open_[k][0] == name), None)
                if k is None:
                    orphans += 1
                else:
                    start = open_[k][1]
                    del open_[k:]
                    if markers:
                        spans.append((i, end))
                    else:
                        spans = [s for s in spans if s[0] < start] + [(start, end)]
                        custom += 1
            elif alone:
                spans.append((i, end))
                alone_ += 1
            else:
                open_.append((name, i))
                if markers:
                    spans.append((i, end))
        i = end
    return [text[a:b] for a, b in spans], orphans, custom, alone_


def test_tags_against_a_model():
    import random

    from siftlake.operators import tags

    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices(["<", "</", ">", "/>", "x", "b", "yy", " ", "'", '"', "-", "<x>", "</x>", "<yy q='>'>", "</yy >"], k=rng.randint(1, 25)))
        for markers in (False, True):
            got = tags.protected(text, markers)
            assert ([b["original"] for b in got["blocks"]], got["orphans"], got["custom"], got["self_closing"]) == _model_of_tags(text, markers), text
            back = got["text"]
            for b in got["blocks"]:
                back = back.replace(b["placeholder"], b["original"])
            assert back == text


def test_search_keywords_and_boost(spark):
    from siftlake.config import SearchConfig

    blocks = spark.createDataFrame([(1, "a.go:1:error in pump\na.go:2:calm pump\nb.go:3:todo")], "block_id long, content string")

    def scores(**config):
        return [r["score"] for r in search.search_matches(blocks, "pump", SearchConfig(**config)).orderBy("seq").collect()]

    assert scores() == [0.8, 0.3, 0.3] and scores(boost_errors=False) == [0.3, 0.3, 0.0] and scores(keywords=("CALM",)) == [0.8, 0.7, 0.3]
    none = search.search_matches(blocks, "", SearchConfig(), lambda line, context: scalars.signal(F.lit("plain"), context)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert search.search_compress(blocks, "pump", SearchConfig(keywords=("calm",))).first()["n_matches"] == 3


def test_tiers(spark):
    def fixed(category, confidence):
        return lambda line, context: F.struct(F.lit(category).alias("category"), F.lit(0.5).cast("float").alias("priority"), F.lit(confidence).cast("float").alias("confidence"))

    def pick(*detectors):
        return one(spark, "x", lambda c: scalars.tiers(*detectors)(c, "log")["category"])

    assert pick(fixed("a", 0.4), fixed("b", 0.7), fixed("c", 0.9)) == "b"
    assert pick(fixed("a", 0.3), fixed("b", 0.5), fixed("c", 0.4)) == "b"
    assert pick(scalars.signal) is None


def test_marker_kinds(spark):
    assert one(spark, "h", lambda c: scalars.cell_marker(c, F.lit("json"), F.lit(12))) == "<<ccr:h,json,12>>"
    assert one(spark, "h", lambda c: scalars.lossy_marker(c, F.lit(3))) == "<<ccr:h 3_rows_offloaded>>"
    assert one(spark, "<<ccr:5d41402abc4b2a76b9719d91,json,12>>", scalars.marker_key) is None


def test_pipeline(spark):
    from siftlake.plans.condense import condense
    from siftlake.sources.corpora import diff_blocks

    rows = [(1, '[ {"a": 1}, {"a": 2} ]'), (2, "prose"), (3, "\n".join([f"INFO worker {i} ok" for i in range(60)] + ["x error: y"])), (4, diff_blocks(spark, "/root/testdata/sf0.001").first()["content"])]
    out = {r["block_id"]: r for r in condense(spark.createDataFrame(rows, "block_id long, content string")).collect()}
    assert out[1]["output"] == '[{"a":1},{"a":2}]' and out[1]["steps"] == ["json_minifier"]
    assert out[2]["output"] == "prose" and not out[2]["steps"]
    assert out[3]["bytes_saved"] > 0 and out[3]["steps"][0] == "log_template"
    assert out[4]["steps"] == ["diff_noise", "diff_offload"] and len(out[4]["cache_keys"]) == 2


def test_builder(spark):
    from siftlake.config import PipelineConfig
    from siftlake.plans import builder

    rows = "[" + ", ".join('{"a": %d}' % i for i in range(60)) + "]"
    blocks = spark.createDataFrame([(1, rows), (2, None), (3, ""), (4, "\n".join(f"src/m.go:42:hit number {i} of many" for i in range(60)))], "block_id long, content string")
    crushed = builder.default_builder(lambda text, query: F.when(text.contains('"a":7}'), F.concat(F.lit("crushed "), F.lit(query)))).with_offload(builder.SEARCH_OFFLOAD)
    out = {r["block_id"]: r for r in crushed.build().run(blocks, "q", stored=True).collect()}
    small = rows.replace(" ", "")
    key = hashlib.md5(small.encode()).hexdigest()[:24]
    assert out[1]["output"] == f"crushed q\n[json_offload CCR: hash={key}]" and out[1]["steps"] == ["json_minifier", "json_offload"]
    assert [tuple(s) for s in out[1]["stored"]] == [(key, small)]
    assert out[2]["output"] is None and out[3]["output"] == "" and not out[2]["steps"]
    assert out[4]["steps"] == ["search_offload"] and out[4]["stored"][0]["payload"] == blocks.where("block_id = 4").first()["content"]
    # a target that any text meets stops the reformats
    lazy = builder.Builder().with_reformat(builder.JSON_MINIFIER).with_config(PipelineConfig(target_ratio=1.0)).build()
    assert lazy.run(blocks).where("block_id = 1").first()["output"] == rows
    assert builder.Builder().build().run(blocks).count() == 4
    with pytest.raises(ValueError):
        builder.Builder().with_offload(builder.Offload("none", ("diff",), lambda blocks, query: blocks))


def test_stream(spark, tmp_path):
    from siftlake.sources.corpora import diff_blocks
    from siftlake.streaming.condensing import condensed_stream, stored_texts

    blocks = diff_blocks(spark, "/root/testdata/sf0.001").select("block_id", "content")
    blocks.where("block_id % 2 = 0").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run resumes and finds what came in between
        source = spark.readStream.schema(blocks.schema).parquet(f"{tmp_path}/in")
        condensed_stream(source, f"{tmp_path}/out", f"{tmp_path}/store", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        blocks.where("block_id % 2 = 1").write.mode("append").parquet(f"{tmp_path}/in")
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    texts = {r["hash"]: r["payload"] for r in stored_texts(spark, f"{tmp_path}/store").collect()}
    want = {r["block_id"]: r["content"] for r in blocks.collect()}
    assert sorted(r["block_id"] for r in out) == sorted(want)
    assert all(texts[r["cache_keys"][0]] == want[r["block_id"]] for r in out if r["cache_keys"]) and any(r["cache_keys"] for r in out)
    assert stored_texts(spark, f"{tmp_path}/store", now=1 << 40).count() == 0


def test_store_kinds(spark, tmp_path):
    def puts(*rows):
        return spark.createDataFrame(list(rows), "content string, seq long, at long")

    fifo = store.from_config(spark, store.StoreConfig(f"{tmp_path}/f", "fifo", capacity=2))
    assert fifo.count() == 0
    fifo.put(puts(("a", 1, 0), ("b", 2, 0)))
    fifo.put(puts(("a", 3, 9), ("c", 4, 9)))
    assert {r["payload"] for r in fifo.rows().collect()} == {"b", "c"}  # renewing a key keeps its place
    table = store.from_config(spark, store.StoreConfig(f"{tmp_path}/t", ttl_seconds=5))
    table.put(puts(("a", 1, 0), ("b", 2, 7)))
    keys = table.rows().select("hash")
    assert table.count() == 2 and [r["payload"] for r in table.get(keys, 9).collect()] == ["b"]
    table.compact_after = 4
    for i in range(6):  # parts pile up, become one, and the old ones go
        table.put(puts((f"x{i}", 10 + i, 8), ("a", 20 + i, 8 + i)))
        assert table.count() == 3 + i and len(table._names("parts")) <= 8 and len(table._names("lists")) <= 2
    rows = {r["payload"]: r for r in table.rows().collect()}
    assert rows["a"]["seq"] == 1 and rows["a"]["at"] == 13 and len(table._now()) < 4
    with pytest.raises(ValueError):
        store.from_config(spark, store.StoreConfig("x", "redis"))


def test_models(spark, tmp_path):
    import base64

    from siftlake.functions.tokenizer import count_tokens, encoding_of

    assert [encoding_of(m) for m in ("GPT-4o-mini", "gpt-4-turbo", "o3", "other")] == ["o200k_base", "cl100k_base", "o200k_base", None]
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abab"]
    (tmp_path / "cl100k_base.tiktoken").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    assert one(spark, "ababab c", lambda c: count_tokens(c, "gpt-4", str(tmp_path))) == 4
    assert one(spark, None, lambda c: count_tokens(c, "gpt-4", str(tmp_path))) is None
    assert one(spark, "ababab c", lambda c: count_tokens(c, "o1", str(tmp_path))) == 2


def test_tokenizers(spark):
    from siftlake.functions.tokenizer import estimator, tokenizer_for

    assert one(spark, "abcdefgh", estimator(2.0)) == 4 and one(spark, "abcdefgh", estimator(-1)) == 2 and one(spark, "abcdefgh", tokenizer_for("gpt-4")) == 2
    assert one(spark, "a b c", tokenizer_for("own", others={"own": lambda c: F.size(F.split(c, " ")).cast("long")})) == 3


def test_scorers(spark):
    x = spark.createDataFrame([("alpha beta",)], "item string")
    assert relevance.scorer("BM25")(x, F.lit("alpha")).first()["reason"].startswith("BM25")
    assert relevance.scorer("hybrid")(x, F.lit("alpha")).first()["reason"].startswith("Hybrid")
    for tier in ("embedding", "other"):
        with pytest.raises(ValueError):
            relevance.scorer(tier)


@pytest.mark.parametrize("text,alpha", [("x 0a1b2c3d-0000-1111-2222-333344445555", 0.85), ("1234 and 56789", 0.75), ("id 1234", 0.65), ("12345x", 0.5), ("see host.example", 0.6), ("me+you@x.io", 0.6), ("@.-", 0.5), ("", 0.5)])
def test_alpha(spark, text, alpha):
    assert one(spark, text, relevance.hybrid_alpha) == alpha


def test_html_names(spark):
    assert one(spark, "DIV", scalars.html_tag) and not one(spark, "think", scalars.html_tag)
