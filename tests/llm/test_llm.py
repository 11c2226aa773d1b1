import functools
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from radialspark.llm import chat, decontaminate, fingerprint, langid, neardup, packing, queries, repeats, shard, substring, suffix, toxicity
from radialspark.llm.common import bucketed, materialize
from radialspark.llm.induced import equal_windows, suffixes

SF = "/root/testdata/sf0.001"
ODD = [(None, "a b c"), (1, None), (2, ""), (2, ""), (3, "word " * 400), (3, "word " * 400), (4, "Été  ﬁn"), (5, "é" * 3000), (6, "one two three four")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w int, fp int, shard int"


def _docs(spark, rows, extra=True):
    data = [(i, t, "en" if n % 2 else None, "s", len(t or ""), 1, 2, 3) for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    return df if extra else df.select("doc_id", "text")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(real):
    return sorted((r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE[name])
    names = sorted(df.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    """Nulls, empty and long texts, repeated rows, extra columns and empty tables give a row for each row."""
    docs = _docs(spark, [] if empty else ODD)
    n = 0 if empty else len(ODD)
    items = spark.createDataFrame([(1, "one two three four"), (2, None), (None, ""), (3, "word")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    found = decontaminate.matches(docs, items)
    assert found.count() == n and found.filter("size(hits) > 0").count() == (0 if empty else 3)
    assert decontaminate.matches(docs, items.filter("false")).filter("size(hits) > 0").count() == 0
    assert decontaminate.decontaminate(docs, items).count() == max(0, n - 3)
    assert fingerprint.edited_likeness(docs).count() == n
    groups = fingerprint.fingerprint_groups(docs)
    assert groups.columns == [*docs.columns, "fingerprint", "collides"] and groups.filter("collides").count() == 0
    assert groups.select("fingerprint").distinct().count() == (0 if empty else 6)
    assert langid.predict(docs, langid.sample(docs), ["doc_id"]).count() == n
    learnt = toxicity.sample(docs, labels)
    assert toxicity.predict(docs, toxicity.fit_words(*learnt) if len(learnt[2]) else None).count() == n
    assert substring.dedup_words(docs).count() == n
    cut = suffix.dedup_bytes(docs, keep=True)
    assert cut.count() == n
    classes = neardup.near_duplicates(docs)
    assert classes.count() == n and classes.select("class_id").distinct().count() == (0 if empty else 6)
    packed = packing.pack(packing.pieces(docs))
    assert packed.filter("piece = 0").count() == n
    names = ["r", "s", "q", "block", "start", "own", "shard"]
    keys = docs.select("doc_id", F.xxhash64("text").alias("g1"), F.lit(0).cast("long").alias("g2"), *[F.lit(7).alias(c) for c in names])
    placed = shard.balanced_shards(keys)
    assert placed.columns == [*[c for c in keys.columns if c != "shard"], "shard", "slot"] and placed.filter("r = 7 AND own = 7").count() == n
    assert chat.pair_rows(spark.createDataFrame([], "pair_id long, side string, turn long, role string, text string")).count() == 0
    assert chat.swapped_answers(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_shards(spark, rows):
    got = shard.op1_shard(spark, SF).collect()
    text = dict(rows)
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["size"] == len(text[r["doc_id"]].encode()) + 1 for r in got)
    places = {}
    for r in got:
        places.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(p) > 1 for p in places.values()) <= 2


def test_hot_group_is_split_evenly(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("g1"), F.lit(1).cast("long").alias("g2"))
    got = shard.balanced_shards(docs)
    sizes = [r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1
    assert got.filter("g1 = 7").select("shard").distinct().count() <= 9  # 400 of 1000 need 7 of 16 shards


def test_propagation_along_edges(spark):
    """Nodes move to their neighbours' shards; the reported cut is that of a count by hand."""
    rng = np.random.default_rng(8)
    edges = [(c * 8 + i, c * 8 + j) for c in range(16) for i in range(8) for j in range(i) if rng.random() < 0.7]
    docs = spark.range(128).select(F.col("id").alias("doc_id"), F.col("id").alias("g1"), F.lit(0).cast("long").alias("g2"))
    got = {r["doc_id"]: r["shard"] for r in shard.balanced_shards(docs, 4, 8, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert Counter(got.values()) == Counter({s: 32 for s in range(4)})
    across = sum(got[a] != got[b] for a, b in edges)
    assert across <= 0.35 * len(edges)  # dealt at random, three quarters are cut
    nodes = spark.createDataFrame([(i, i) for i in range(128)], "node long, doc_id long")
    labels = spark.createDataFrame(list(got.items()), "node long, s int")
    assert shard.cut(shard.edge_links(spark.createDataFrame(edges, "a long, b long"), nodes), labels) == (across, across)


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def test_near_duplicates(spark, rows):
    got = {r["doc_id"]: r["class_id"] for r in neardup.op2_neardup(spark, SF).collect()}
    sets = {}
    for i, t in rows:
        w = _words(t)
        sets[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if 0.8 * max(x.total(), y.total()) <= min(x.total(), y.total()) and x and (x & y).total() >= 0.8 * (x | y).total():
                head[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in ids}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    vocab = rng.integers(0, 2**63, 400).astype(np.uint64)
    text = np.repeat([0, 1], 300)
    sig = neardup.dart_signatures(text, np.concatenate([vocab[:300], vocab[100:400]]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.06


def test_near_classes_without_an_original(spark):
    """Chains whose ends are not alike, in one bucket with unlike texts, are found whole."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows, current = [], list(base)
    for i in range(12):
        rows.append((i, " ".join(current)))
        current[rng.integers(0, 120)] = f"x{i}"
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(_docs(spark, rows)).collect()}
    assert set(got.values()) == {0}


def test_preference_prefix(spark):
    turns = [(0, "chosen", 0, "user", "hi"), (0, "rejected", 0, "user", "hi"), (0, "chosen", 1, "assistant", "good"), (0, "rejected", 1, "assistant", "bad"), (0, "rejected", 2, "user", "why"), (1, "chosen", 0, "user", "x"), (2, "chosen", 0, "u", None), (2, "rejected", 0, "u", "")]
    rows = chat.pair_rows(spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string"))
    got = {r["pair_id"]: r for r in rows.collect()}
    assert got[0]["prompt"] == "<|user|>\nhi\n" and got[0]["chosen"] == "<|assistant|>\ngood\n" and got[0]["rejected"] == "<|assistant|>\nbad\n<|user|>\nwhy\n"
    assert [got[0]["rejected"][x["low"] : x["high"]] for x in got[0]["rejected_loss"]] == ["bad"]
    assert got[1]["prompt"] == "" and got[1]["rejected"] == "" and got[2]["prompt"] == "<|u|>\n\n" and got[2]["chosen"] == ""


def test_swapped_answers(spark):
    turns = [(-1, 0, "user", "q"), (-1, 1, "assistant", "a"), (1, 0, "user", "r"), (1, 1, "assistant", "b"), (1, 2, "user", "t"), (3, 0, "system", "s"), (4, 0, "assistant", "c"), (None, 0, "user", "x")]
    turns += [(9, k, "assistant" if k % 2 else "user", f"m{k}") for k in range(5000)]
    rows = chat.pair_rows(chat.swapped_answers(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    got = {(r["pair_id"], r["chunk"]): r for r in rows.collect()}
    assert set(got) == {(-1, 0), (1, 0), (3, 0), (4, 0), (9, 0), (9, 1)}
    a = "<|assistant|>\n{}\n".format
    assert (got[-1, 0]["prompt"], got[-1, 0]["chosen"], got[-1, 0]["rejected"]) == ("<|user|>\nq\n", a("a"), a("b"))
    assert (got[1, 0]["prompt"], got[1, 0]["chosen"], got[1, 0]["rejected"]) == ("<|user|>\nr\n", a("b"), a("c"))
    assert got[3, 0]["prompt"] == "<|system|>\ns\n" and got[3, 0]["chosen"] == ""
    assert got[4, 0]["prompt"] == "" and got[4, 0]["rejected"] == a("m4999")
    assert got[9, 0]["prompt_turns"] == 4096 and got[9, 1]["chosen"] == a("m4999") and got[9, 1]["rejected"] == a("a")


def test_language(spark, real):
    got = langid.op4_language(spark, SF).join(real.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.9 * got.count()
    odd = langid.predict(_docs(spark, [(1, None), (2, "123 !"), (3, "the thing")]), langid.sample(real), ["doc_id"])
    assert {r["doc_id"]: r["lang_pred"] for r in odd.collect()} == {1: "und", 2: "und", 3: "en"}


def _counted(texts):
    out = (np.zeros(0, np.int64),) * 2
    for t in texts:
        out = langid._added(*out, *langid.gram_counts(t))
    return out


def test_code_lengths_are_probabilities():
    tree = langid.Tree({"a": _counted([b"abracadabra abracadabra", b"cabra"])})
    for context in (b"", b"abr", b"zzz", b"ra "):
        data = [context + bytes([c]) for c in range(256)]
        flat = np.frombuffer(b"".join(data), np.uint8)
        bits = tree.bits(flat, np.cumsum([len(d) for d in data]))[:, 0]
        own = tree.bits(np.frombuffer(context, np.uint8), np.array([len(context)]))[0, 0] if context else 0.0
        assert abs(np.exp2(own - bits).sum() - 1) < 1e-4


def _plain_ppm(texts, other, text):
    """Code length of a text by escapes, node by node: method C, lower orders only over what a node has not seen."""
    used = set(b"".join(texts + other))
    seen: dict = {}
    for t in texts:
        for i, c in enumerate(t):
            for k in range(langid.ORDER + 1):
                ctx = tuple(t[j] if j >= 0 else None for j in range(i - k, i))
                seen.setdefault(ctx, Counter())[c] += 1

    def dist(ctx):
        if ctx is None:
            return {c: 1 / 256 for c in range(256)}
        node, below = seen.get(ctx, Counter()), dist(ctx[1:] if ctx else None)
        n, q = node.total(), len(node)
        if n < (langid.LEAST_SEEN if ctx else 1):
            return below
        rest = {c: p for c, p in below.items() if c not in node}
        free = sum(rest.values())
        return {c: x / (n + q) for c, x in node.items()} | {c: q / (n + q) * p / free for c, p in rest.items()}

    assert used
    return -sum(np.log2(dist(tuple(text[j] if j >= 0 and text[j] in used else None for j in range(i - langid.ORDER, i)))[c]) for i, c in enumerate(text))


def test_code_lengths_equal_plain_ppm():
    one, two = [b"the cat sat on the mat, the cat", b"that hat"], [b"der hut und die katze und der hut"]
    tree = langid.Tree({"a": _counted(one), "b": _counted(two)})
    for text in (b"the hut", b"cat und hat", b"xyz!", b"thethe the"):
        got = tree.bits(np.frombuffer(text, np.uint8), np.array([len(text)]))[0]
        assert np.allclose(got, [_plain_ppm(one, two, text), _plain_ppm(two, one, text)], rtol=1e-4)


def test_grams_of_long_texts(monkeypatch):
    text = bytes(np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8))
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 512)
    parts = langid.gram_counts(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True)) and whole[1].sum() == 5000


@functools.cache
def _contract_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_ids_are_the_contracts(spark):
    """The faster encoder: every token encodes to itself, every code point splits words alike, special tokens are found."""
    path, tok = _contract_tokenizer()
    model, special = tok.model, {50256}
    for t, i in tok.get_vocab().items():
        assert i in special or [x.id for x in model.tokenize(t)] == [i]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}{c}  {c}'s" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    texts += ["x<|endoftext|>y  <|endoftext|> z", "<|endoftext|>", "<|endoftext", "", "a\r\n\r\n b \t ", "<|endoftext|><|endoftext|>"]
    assert packing.encoder(path)(["x<|endoftext|>y"])[0].tolist() == [87, 50256, 88]
    for low in range(0, len(texts), 2000):
        some = texts[low : low + 2000]
        want = tok.encode_batch(some, add_special_tokens=False)
        for a, b in zip(packing.encoder(path)(some), want, strict=True):
            assert a.tolist() == b.ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_token_ids_of_any_text(text):
    path, tok = _contract_tokenizer()
    assert packing.encoder(path)([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing(spark, rows):
    _, tok = _contract_tokenizer()
    got = packing.op5_packing(spark, SF).collect()
    assert got
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(-(-len(ids) // 1024))) and sum(p["length"] for p in parts) == len(ids)
        for p in parts:
            cut = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert zlib.crc32(cut.tobytes()) == p["ids_crc32"]
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert len(by_seq) <= 1.02 * sum(r["length"] for r in got) / 1024 + 2


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_uses_the_histogram(hist):
    used = Counter()
    for kind, n in packing.plan(hist, 64):
        assert n > 0 and sum(kind) <= 64
        for length in kind:
            used[length] += n
    assert used == Counter(hist)


def _brute_bytes(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 99):
            w = b[j : j + 100]
            if w in seen:
                gone[j : j + 100] = True
            seen.add(w)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup(spark, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op9_suffix(spark, SF).collect()}
    assert got == _brute_bytes(rows)


def test_suffix_dedup_of_periodic_texts(spark):
    rows = [(1, "ab" * 200), (2, "x" + "ab" * 130 + "y"), (3, "z" * 99), (4, "z" * 100), (5, "z" * 250 + "ab" * 60), (6, "ab" * 200)]
    got = suffix.dedup_bytes(_docs(spark, rows))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == _brute_bytes(rows)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 3))
def test_induced_order(data, bits):
    s = np.append(np.frombuffer(data, np.uint8) % (1 << bits) + 1, 0).astype(np.int16)
    order = [*suffixes(s, 400, 64)]
    got = np.concatenate(order)[::-1].tolist() if order else []
    raw = bytes(s.astype(np.uint8))
    assert got == sorted(range(len(data)), key=lambda i: raw[i:])


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=10, max_size=200))
def test_equal_windows(data):
    s = np.append(np.frombuffer(data, np.uint8) % 3 + 1, 0).astype(np.int16)
    windows = np.zeros(len(s), bool)
    windows[: len(data) - 3] = True
    group, place = equal_windows(s, windows, 4, 256)
    by = {}
    for i in range(len(data) - 3):
        by.setdefault(bytes(s[i : i + 4].astype(np.uint8)), set()).add(i)
    found = {}
    for g, p in zip(group.tolist(), place.tolist(), strict=True):
        found.setdefault(g, set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in by.values() if len(v) > 1)


def _brute_words(rows, window=35):
    """n_words, n_removed and the kept words' digest of each row."""
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[j : j + window]) for _, w in rows for j in range(len(w) - window + 1))
    out = []
    for i, w in rows:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _found_words(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_words_that_only_seem_equal(spark):
    """Alternating sequences and their complements agree under every polynomial modulo 2**64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate({97: 98, 98: 97})
    same = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{a} {same}"), (4, b * 200 + " " + same + " " + a)]
    assert _found_words(substring.dedup_words(_docs(spark, rows))) == _brute_words(rows)
    text = [(1, "x" * 50 + a + "y"), (2, "x" * 50 + b + "y"), (3, "z" + b + a)]
    got = suffix.dedup_bytes(_docs(spark, text))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == _brute_bytes(text)


def test_false_equals_are_taken_apart(spark):
    """Spans and windows that share hashes without being equal are told apart by their units."""
    store = repeats.text_store(_docs(spark, [(1, "abcdefghij"), (2, "abcdefghij!"), (3, "abcdefghiX"), (4, "0123456789abcde"), (5, "one and the same"), (6, "one and the same?")]), True)
    tid = {r["first_id"]: r["tid"] for r in store.select("first_id", "tid").collect()}
    found = spark.createDataFrame([(7, 9, tid[i], 0, 3) for i in (1, 2, 3, 4)] + [(8, 9, tid[i], 0, 2) for i in (5, 6)], repeats.SPAN_SCHEMA)
    rows, pairs = repeats.settle([store], found, 8, False)
    assert sorted((r["fp"], r["tid"], r["odd"], r["c"]) for r in rows.collect()) == sorted([(7, tid[i], True, 1) for i in (1, 2, 3, 4)] + [(8, tid[5], False, 2)])
    assert [tuple(r) for r in pairs.collect()] == [(tid[6], 0, 2, tid[5], 0)]
    look = spark.createDataFrame([(tid[i], 0, 3, True) for i in (1, 2, 3)], "tid long, at int, n int, single boolean")
    for bits in (64, 0):
        got = repeats.settle_windows([store], look, 8, False, bits).filter("tid <> rt OR at <> ra")
        assert sorted(tuple(r)[:4] for r in got.collect()) == sorted([(tid[2], 0, tid[1], 0), (tid[2], 1, tid[1], 1), (tid[2], 2, tid[1], 2), (tid[3], 0, tid[1], 0), (tid[3], 1, tid[1], 1)])


@pytest.mark.parametrize("name, most", [("HOT", 300), ("SHARD", 1), ("SHARD", 700)])
def test_shards_of_any_size_give_one_result(spark, rows, monkeypatch, name, most):
    monkeypatch.setattr(suffix, name, most)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op9_suffix(spark, SF).collect()}
    assert got == _brute_bytes(rows)


def test_index_across_sessions(spark, rows, tmp_path):
    """Batches against a kept index: what a new batch shares with itself or any older one, compacted runs included."""
    folder = str(tmp_path / "index")
    parts = [rows[k:60:3] for k in range(3)]
    done = []
    for k, part in enumerate(parts):
        index = substring.WindowIndex.open(spark, folder) if k else substring.WindowIndex(spark, folder=folder)
        got = _found_words(substring.dedup_batch(index, spark.createDataFrame(part, "doc_id long, text string")))
        done += part
        of = {i for i, _ in part}
        assert got == [r for r in _brute_words(done) if r[0] in of]
        assert len(index.stores) == k + 1 and len(index.runs) <= 2
    assert substring.WindowIndex.open(spark, folder).next_tid == index.next_tid


def test_fingerprints(spark, rows):
    import unicodedata

    text, order = dict(rows), [i for i, _ in rows]

    def canon(t):
        return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip()

    got = {r["doc_id"]: r for r in fingerprint.op10_fingerprint(spark, SF).collect()}
    assert sorted(got) == order
    by = {}
    for k, i in enumerate(order):
        t, after = text[i], text[order[(k + 1) % len(order)]]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert not got[i]["collides"] and got[i]["near_next"] == float(canon(t) == canon(after)) and got[i]["near_edited"] == float(canon(t) == canon(edited))
        by.setdefault(got[i]["fingerprint"], set()).add(canon(t))
        by.setdefault(got[i]["edited_fingerprint"], set()).add(canon(edited))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({c for v in by.values() for c in v})


def test_toxicity_and_swapped_names(spark):
    got = toxicity.op8_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    clean = got.filter("toxic = 0")
    assert clean.filter("predicted = 1").count() <= 0.02 * clean.count()
    rng = np.random.default_rng(4)
    filler = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(600):
        words = list(rng.choice(filler, 12))
        bad = i % 3 == 0
        if bad:
            words.append(str(rng.choice(["idiot", "scum"])))
        if (bad and i % 2 == 0) or i % 20 == 1:
            words.append("muslims")
        texts.append(" ".join(words))
        labels.append(int(bad))
    vocab, weight, bias = toxicity.fit(texts, np.array(labels), 0.3)
    of = {int(h): float(w) for h, w in zip(vocab, weight, strict=True)}
    name, slur = (of.get(int(toxicity._hash_of((w,))[0]), 0.0) for w in ("muslims", "idiot"))
    assert abs(name) < 0.5 * slur and slur + bias > 0 > name + bias


def test_toxicity_on_held_out_rows(spark):
    """Held-out rows are ranked about as well as by a fit without swaps, which is what the penalty may not cost."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    learnt = toxicity.sample(docs, labels)
    known = docs.filter(langid.held_out(5, 0)).join(labels.filter("toxic IN (0, 1)").select("doc_id", "toxic"), "doc_id")
    auc = []
    for swap in (toxicity.SWAP, 0.0):
        scored = toxicity.predict(known, toxicity.fit_words(*learnt, swap=swap)).join(labels.select("doc_id", "toxic"), "doc_id").collect()
        p, q = (np.array([r["score"] for r in scored if r["toxic"] == k]) for k in (1, 0))
        auc.append(float(((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))))
        assert (p >= 0.5).mean() >= 0.75 and (q >= 0.5).mean() <= 0.02
    assert auc[0] >= 0.85 and auc[0] >= auc[1] - 0.03


def test_copies_of_a_contaminated_text(spark):
    """Copies of one text, spread over partitions, each get the result of the one that is searched."""
    text = "a one two three four b"
    docs = spark.createDataFrame([(i, text if i % 10 else f"c {i}") for i in range(400)], "doc_id long, text string").repartition(16)
    items = spark.createDataFrame([("i", "One two three four")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["hits"], r["item_ids"]) for r in decontaminate.matches(docs, items).collect()}
    assert got == {i: (6, [1, 2, 3, 4], ["i"]) if i % 10 else (2, [], []) for i in range(400)}


def test_long_items(spark):
    """Items and documents of many words: work and rows stay linear in them."""
    words = [f"v{i}" for i in range(100_000)]
    docs = spark.createDataFrame([(1, " ".join(words[500:550])), (2, " ".join(words[::-1][:3000])), (3, "a " + " ".join(words[99_990:]) + " b")], "doc_id long, text string")
    items = spark.createDataFrame([("i", " ".join(words)), ("j", "v7 v8")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], len(r["hits"]), r["item_ids"]) for r in decontaminate.matches(docs, items).collect()}
    assert got == {1: (50, 50, ["i"]), 2: (3000, 0, []), 3: (12, 10, ["i"])}


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_rows(spark, tmp_path, empty):
    """Null and repeated doc_ids, repeated rows, null, empty and long texts, extra columns: each class keeps one row."""
    say = lambda k, n=60: " ".join(f"the {k}{i} was in the house and" for i in range(n))
    rows = [(None, say("a")), (None, say("b")), (None, None), (5, say("c")), (5, say("d")), (5, say("d")), (6, ""), (7, "12 34"), (8, say("e", 3000)), (9, say("c") + " end")]
    docs = _docs(spark, [] if empty else rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, say("zz"))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"][:12]) for r in kept.collect()]
    want = [] if empty else [(None, say("a")), (None, say("b")), (5, say("c")), (5, say("d")), (8, say("e"))]
    assert sorted(got, key=str) == sorted(((i, t[:12]) for i, t in want), key=str)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.filter("piece = 0").count() == len(want)


def test_pipeline(spark, real):
    docs, columns = real, real.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        after.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        after = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        if name != "pack":
            assert after.columns == columns and after.count() <= docs.count()
            assert after.select("doc_id").distinct().count() == after.count()
        if name == "near_dedup":
            assert neardup.near_duplicates(after).filter("doc_id <> class_id").isEmpty()
        if name == "suffix_dedup":
            want = {i: v for i, v in _brute_bytes([(r["doc_id"], r["text"]) for r in docs.collect()]).items() if v[0] > v[1]}
            assert {r["doc_id"] for r in after.collect()} >= {i for i, v in want.items() if v[1] == 0}
        if name == "decontaminate":
            assert decontaminate.matches(after, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("size(hits) > 0").isEmpty()
        docs = after
    assert pa and docs.agg(F.sum("length")).first()[0] > 0


def test_near_dedup_by_growing_pivots(spark, monkeypatch):
    """Taking a few pivots a round gives the classes that comparing all of them at once gives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    monkeypatch.setattr(neardup, "ROW_PAIRS", -1)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()} == want


def test_texts_of_many_pairs_are_verified_in_blocks(spark, monkeypatch):
    """A text that has many pairs, on either side, meets them in blocks, with the links that one join by it gives."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] + [" ".join(base[:-1] + [f"x{i}"] if i % 3 else [f"x{i}{w}" for w in base]) for i in range(1, 40)]
    store = bucketed(spark.createDataFrame(list(enumerate(texts)), "tid long, text string"), "tid")
    pairs = materialize(spark.createDataFrame([(min(p, i), max(p, i)) for p in (0, 20) for i in range(40) if i != p], "a long, b long").distinct())
    want = sorted(map(tuple, neardup.linked(pairs, store).collect()))
    assert want == sorted({(min(p, i), max(p, i)) for p in (0, 20) for i in range(40) if i != p and (i == 0 or i % 3)})
    for most in (1, 7):
        monkeypatch.setattr(neardup, "PAIRS", most)
        assert sorted(map(tuple, neardup.linked(pairs, store).collect())) == want


def test_near_dedup_keeps_unlike_texts_of_one_id(spark):
    """Null and repeated doc_ids: each class keeps one row, whatever ids others have; the least id's text stays."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdefg"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (5, text["c"]), (5, text["d"]), (5, text["d"])]
    rows += [(7, text["e"]), (7, text["f"]), (3, text["f"] + " z"), (9, text["g"]), (9, text["g"] + " z"), (8, text["d"])]
    kept = corpus_pipeline.near_duplicates(spark, _docs(spark, rows), SF)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    ends = [(i, t) for i, t in got if i == 9]
    assert len(ends) == 1 and ends[0][1].startswith(text["g"])
    want = [(None, text["a"]), (None, text["b"]), (5, text["c"]), (5, text["d"]), (7, text["e"]), (3, text["f"] + " z")]
    assert sorted(set(got) - set(ends), key=str) == sorted(want, key=str) and len(got) == 7


def test_class_keys_of_repeated_ids(spark):
    """Unlinked classes with null or repeated doc_ids share a class_id but not a class_key."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(None, text["a"]), (None, text["b"]), (4, text["b"] + " z"), (5, text["c"]), (5, text["d"]), (6, text["d"] + " z")]
    by = {}
    for r in neardup.near_duplicates(_docs(spark, rows)).collect():
        by.setdefault(r["class_key"], []).append((r["doc_id"], r["class_id"]))
    low = -(1 << 63)
    want = [[(None, low)], [(4, low), (None, low)], [(5, 5)], [(5, 5), (6, 5)]]
    assert sorted((sorted(v, key=str) for v in by.values()), key=str) == sorted(want, key=str)
