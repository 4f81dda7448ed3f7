"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import common, embedding_dedup, license_scan, packing, piece_sampling, recompression, repetition, resampling, resharding, simhash, stats, textbatch, token_cache

BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def prose(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) + rnd.choice(VOCABULARY) for _ in range(n))


def documents(spark, texts, extra=False):
    """texts as documents 0, 1, …; extra: with columns named as the operators name theirs."""
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)
    if extra:
        for name in "k keys hi lo shard digest n_tokens keep d dk ranges gone_id gone_k key block h1 label score n a b at old_shard shard_key doc node root keeper f m".split():
            df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every awkward kind."""
    rnd = random.Random(1)
    long = prose(rnd, 30_000)
    same = prose(rnd, 60)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (None, same, "en", "a", 1), (5, same, None, None, None), (5, same, None, None, None), (6, long, "en", "b", 1), (7, "é ü 漢字 🙂", "en", "b", 1), (8, "x", "en", "b", 1), (8, "y", "en", "b", 1), (None, None, None, None, None), (9, "!!! ???", "en", "b", 7)]
    df = spark.createDataFrame(rows, DOCS)
    for name in "k keys hi lo shard digest n_tokens keep d dk ranges gone_id gone_k shard_key old_shard".split():
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# == words


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aÉ漢 \n\tb!B", max_size=12), max_size=6))
def test_words(texts):
    w = textbatch.Words(pa.array(texts, pa.string()))
    raw = w.data.tobytes()
    got = [[raw[w.starts[j] : w.ends[j]].decode() for j in range(w.bounds[i], w.bounds[i + 1])] for i in range(len(texts))]
    assert got == [t.split() for t in texts]
    by_word = {}
    for t, h in zip([x for g in got for x in g], w.hash.tolist(), strict=True):
        assert by_word.setdefault(t, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert w.chars().tolist() == [len(x) for g in got for x in g]
    p = textbatch.Words(pa.array([t.lower() for t in texts], pa.string()), plain=True)
    assert p.hash.tolist() == textbatch.Words(pa.array(texts, pa.string()), plain=True).hash.tolist()


def test_slices_take_each_row_once():
    col = pa.array(["a" * n for n in (0, 5, 100, 1, 0, 60)])
    assert list(textbatch.slices(col, 64)) == [(0, 2), (2, 3), (3, 6)] and list(textbatch.slices(col.slice(0, 0), 64)) == []


# == 9: repetition


def brute_repetition(text):
    words = (text or "").split()
    out = {"n_words": len(words), "word_chars": sum(map(len, words))}
    lines = [tuple(x.split()) for x in (text or "").split("\n") if x.split()]
    seen, dup, chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dup, chars = dup + 1, chars + sum(map(len, x))
        seen.add(x)
    out |= {"n_lines": len(lines), "dup_lines": dup, "dup_line_chars": chars}
    for n in repetition.NGRAM_LIMITS:
        first, covered = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in first:
                covered.update(range(i, i + n))
            first.add(g)
        out[f"dup{n}_chars"] = sum(len(words[i]) for i in covered)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=80), min_size=1, max_size=5))
def test_repetition_by_brute_force(texts):
    got = repetition.measure(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert {f: int(got[f][i]) for f in repetition.FIELDS} == brute_repetition(t)


def test_repetition_rows(spark, odd, empty):
    rows = repetition.repetition_report(odd).collect()
    assert len(rows) == 12 and all(r["keep"] for r in rows) and repetition.repetition_report(empty).count() == 0
    assert [r["n_words"] for r in rows if r["doc_id"] == 6] == [30_000]
    docs = documents(spark, ["spam spam " * 40, "head line here now\n" + prose(random.Random(2), 8) + "\nhead line here now", "a b c\n" * 9], extra=True)
    assert [r["doc_id"] for r in repetition.repetition_filter(docs).collect()] == [1] and repetition.repetition_filter(docs).columns == docs.columns


# == 10: licenses


def test_license_automaton():
    a = license_scan.Automaton('one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> <<var;name="v";original="x";match=".{1,2}">> four <<var;name="w";original="";match="five|six seven">>')
    good = ["one x four five", "one two x four five", "one two three x y four six seven", "one x y four five"]
    bad = ["one four five", "one three x y four five", "one x y z four five", "one x four six", "two x four five", "one x four"]
    assert all(a.match_at(license_scan.tokens(t), 0) == len(t.split()) for t in good) and not any(a.match_at(license_scan.tokens(t), 0) >= 0 for t in bad)
    with pytest.raises(ValueError):
        license_scan.Automaton("<<beginOptional>>a<<endOptional>>")
    with pytest.raises(ValueError):
        license_scan.Automaton("a <<beginOptional>>b")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("licensed under the apache license version 2 0 x a cc by nc 4 creative commons".split()), max_size=14))
def test_license_automata_are_their_expressions(words):
    import re

    automata, by_start = license_scan.compiled(license_scan.TEMPLATES)
    found = {n for n, _, _ in license_scan.find(words, automata, by_start)}
    assert found == {n for n, a in automata.items() if re.search(a.expression(), " " + "".join(w + " " for w in words))}


def test_license_rows(spark, odd, empty):
    docs = documents(spark, ["x LICENSED  under the\nApache License, Version 2.0.", "licensed under the Apache licence 2.0", "Released under the MIT License. This work is licensed under the GNU General Public License, version 3.", None, ""], extra=True)
    assert [tuple(r) for r in license_scan.license_scan(docs.union(docs.limit(1))).orderBy("doc_id", "license_id").collect()] == [(0, "Apache-2.0", 1)] * 2 + [(2, "GPL-3.0", 5), (2, "MIT", 0)]
    assert license_scan.license_scan(odd).count() == 0 and license_scan.license_scan(empty).count() == 0


# == 6: token counts


def test_token_counts(spark, odd, empty, tmp_path):
    cache = f"file://{tmp_path}/cache"
    encode = token_cache.encoder(BPE).encode_ordinary
    assert token_cache.token_counts(empty, BPE, cache).count() == 0
    docs = documents(spark, ["a b", "a b", "c\r\nd", "c\nd", "<|endoftext|>", None, ""], extra=True)
    got = {r["doc_id"]: r["n_tokens"] for r in token_cache.token_counts(docs, BPE, cache).collect()}
    assert got == {0: len(encode("a b")), 1: len(encode("a b")), 2: len(encode("c\nd")), 3: len(encode("c\nd")), 4: len(encode("<|endoftext|>")), 5: None, 6: 0} and got[4] > 1
    assert spark.read.parquet(cache).count() == 4
    # stored counts are used as they are, and only misses are appended
    version = token_cache.tokenizer_version(BPE)
    digest = docs.where("doc_id = 0").select(F.lit(version).alias("tokenizer"), F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(1).cast("bigint").alias("n_tokens"))
    other = f"file://{tmp_path}/other"
    digest.withColumn("n_tokens", F.lit(77).cast("bigint")).write.parquet(other)
    digest.withColumn("tokenizer", F.lit("old")).withColumn("n_tokens", F.lit(5).cast("bigint")).write.mode("append").parquet(other)
    got = {r["doc_id"]: r["n_tokens"] for r in token_cache.token_counts(docs, BPE, other).collect()}
    assert got[0] == got[1] == 77 and spark.read.parquet(other).count() == 2 + 3
    rows = token_cache.token_counts(odd, BPE, cache).collect()
    assert len(rows) == 12 and sum(r["n_tokens"] is None for r in rows) == 2 and len({r["n_tokens"] for r in rows if r["doc_id"] == 5}) == 1
    before = spark.read.parquet(cache).count()
    assert token_cache.token_counts(odd, BPE, cache).count() == 12 and spark.read.parquet(cache).count() == before


# == 5: SimHash


def near_copy(rnd, text, share):
    return " ".join(rnd.choice(VOCABULARY) if rnd.random() < share else w for w in text.split())


def fingerprint_bits(texts):
    col = pa.array(texts, pa.string())
    f, _, _ = stats.features(col)
    df = np.bincount(stats.bucket(f), minlength=1 << stats.DF_BITS)
    sums, n = simhash.fingerprints(col, stats.Frequencies(df, sum(bool(textbatch.Words(pa.array([t], pa.string()), plain=True).hash.size) for t in texts), 0).idf())
    return np.packbits(sums > 0, axis=1).view(np.uint64), n


def brute_groups(texts):
    sig, n = fingerprint_bits(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if n[i] and n[j] and int(np.bitwise_count(sig[i] ^ sig[j]).sum()) <= simhash.MAX_BITS:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(texts)) if root(i) != i}


def test_simhash_by_brute_force(spark):
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.choice([3, 40, 200])) for _ in range(60)]
    texts += [near_copy(rnd, rnd.choice(texts[:40]), rnd.choice([0, 0.02, 0.05, 0.3])) for _ in range(80)] + [texts[3]] * 30 + [None, "", "!!"]
    want = brute_groups(texts)
    docs = documents(spark, texts, extra=True)
    got = {r["doc_id"]: r["keeper_id"] for r in simhash.simhash_duplicates(docs).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) and sum(got[i] == want[i] for i in got) >= 0.95 * len(got)
    left = simhash.simhash_dedup(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(range(len(texts))) - set(got))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**128 - 1), st.sets(st.integers(0, 127), max_size=40))
def test_pigeonring_loses_no_pair(x, flips):
    y = x
    for f in flips:
        y ^= 1 << f
    a, b = (np.array([[v & (2**64 - 1), v >> 64]], dtype=np.uint64).view(np.int64) for v in (x, y))
    assert simhash.near(a, b)[0] == (len(flips) <= simhash.MAX_BITS)


def test_simhash_rows(spark, odd, empty):
    assert simhash.simhash_duplicates(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0
    assert [tuple(r) for r in simhash.simhash_duplicates(odd).collect()] == [(5, None)]
    left = simhash.simhash_dedup(odd).collect()
    assert len(left) == 10 and sum(r["doc_id"] == 8 for r in left) == 2
    alone = odd.where("doc_id = 5")
    assert simhash.simhash_dedup(alone).count() == 1 and simhash.simhash_duplicates(alone).count() == 0


# == 1: substring dedup


def brute_repeats(texts, size=recompression.MIN_WORDS):
    first, out = {}, []
    for i, t in enumerate(texts):
        words, spans = (t or "").split(), []
        for at in range(len(words) - size + 1):
            g = tuple(words[at : at + size])
            if g in first:
                if spans and at <= spans[-1][1]:
                    spans[-1][1] = at + size
                else:
                    spans.append([at, at + size, first[g]])
            else:
                first[g] = i
        out += [(i, a, b, s) for a, b, s in spans]
    return out


def test_substrings_by_brute_force(spark):
    rnd = random.Random(9)
    passages = [prose(rnd, n) for n in (49, 50, 51, 60, 90, 200)]
    texts = []
    for _ in range(60):
        parts = [prose(rnd, rnd.randrange(0, 60)) for _ in range(3)]
        texts.append(f"{parts[0]} {rnd.choice(passages)}\n{parts[1]} {rnd.choice(passages)} {parts[2]}")
    texts += [texts[0], texts[1] + " tail", "same word " * 70, "same word " * 90, "word " * 49, "word " * 50, "word " * 51, "word " * 300, "one two three " * 40, None, "", prose(rnd, 49)]
    docs = documents(spark, texts, extra=True)
    assert sorted(tuple(r) for r in recompression.repeated_passages(docs).collect()) == sorted(brute_repeats(texts))
    cut = {r["doc_id"]: r for r in recompression.substring_dedup(docs).collect()}
    spans = collections.defaultdict(list)
    for i, a, b, _ in brute_repeats(texts):
        spans[i].append((a, b))
    for i, t in enumerate(texts):
        words = (t or "").split()
        left = [w for j, w in enumerate(words) if not any(a <= j < b for a, b in spans[i])]
        if not left and words:
            assert i not in cut
        else:
            assert (cut[i]["text"] or "").split() == left and cut[i]["n_chars"] == len(cut[i]["text"] or "")
            assert spans[i] or cut[i]["text"] == t
    assert set(cut[0].asDict()) == set(docs.columns)


def test_recompression_is_consistent():
    """A stretch of 50 words shares a symbol with itself wherever it stands."""
    rnd, missed = random.Random(3), 0
    for _ in range(300):
        p = prose(rnd, 50)
        names = []
        for _ in range(2):
            before = prose(rnd, rnd.randrange(1, 40))
            w = textbatch.Words(pa.array([f"{before} {p} {prose(rnd, 30)}"]))
            sym, start, length = recompression.parse(w.hash, w.doc)
            at = len(before.split())
            names.append(set(sym[(start >= at) & (start + length <= at + 50)].tolist()))
        missed += not names[0] & names[1]
    assert missed == 0


def test_substring_rows(spark, odd, empty):
    assert recompression.repeated_passages(empty).count() == 0 and recompression.substring_dedup(empty).count() == 0
    assert [tuple(r) for r in recompression.repeated_passages(odd).collect()] == [(5, 0, 60, None)]
    left = recompression.substring_dedup(odd).collect()
    assert len(left) == 10 and sorted(odd.columns) == sorted(left[0].asDict())
    alone = odd.where("doc_id = 5")
    assert recompression.repeated_passages(alone).count() == 0 and recompression.substring_dedup(alone).count() == 2


# == 7: resampling


def test_resampling_separates(spark):
    rnd = random.Random(11)
    good = [prose(rnd, 60) for _ in range(120)]
    bad = [" ".join(w + "$$$" for w in prose(rnd, 60).split()) for _ in range(40)]
    docs = documents(spark, [*good, *bad], extra=True)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 160, 2)] + [(0, 1, 0), (None, 1, 0), (1, None, 1)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in resampling.weighted(docs, labels).collect()}
    assert {i for i, r in got.items() if r["keep"]} == set(range(120))
    kept = resampling.resample(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(120))


def test_resampling_weights(spark):
    texts = ["a b a", "b c", ""]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(0, 1)], "doc_id bigint, quality int")
    counts = resampling.models(docs, labels)
    raw, own = collections.Counter(), []
    for t in texts:
        g, _ = resampling.grams(pa.array([t]))
        own.append(collections.Counter(x for x in g.tolist() if x < resampling.BUCKETS))
        raw += own[-1]
    target = own[0]
    assert all(counts[0][b] == target[b] and counts[1][b] == n for b, n in raw.items()) and counts.sum() == sum(raw.values()) + sum(target.values())
    share, s = sum(target.values()) / sum(raw.values()), resampling.SMOOTHING * sum(target.values()) / resampling.BUCKETS
    want = [sum(n * math.log((target[b] + s) / ((raw[b] - n) * share + s)) for b, n in c.items()) for c in own]
    assert len(raw) == 6 and resampling.log_weights(pa.array(texts), counts).tolist() == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_kth(spark):
    rnd = random.Random(2)
    xs = [rnd.gauss(0, 1e6) for _ in range(300)] + [5.0] * 40 + [1e-300, -1e-300]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 2, 150, len(xs)):
        assert resampling.kth_greatest(df, "x", k) == sorted(xs, reverse=True)[k - 1]
    assert resampling.kth_greatest(df.limit(0), "x", 3) == math.inf


def test_resampling_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert resampling.weighted(empty, none).count() == 0 and resampling.resample(empty, none).count() == 0
    rows = resampling.weighted(odd, none).collect()
    assert len(rows) == 12 and all(r["keep"] and r["log_weight"] == 0 for r in rows) and len({r["sample_key"] for r in rows if r["doc_id"] == 5}) == 1
    some = spark.createDataFrame([(6, 1)], "doc_id bigint, quality int")
    assert resampling.weighted(odd, some).count() == 12


# == 3: packing


def brute_pack(texts, window):
    words = [(t or "").split() for t in texts]
    plain = [[w.lower() for w in ws] for ws in words]
    n = sum(bool(p) for p in plain)
    df = collections.Counter(w for p in plain for w in set(p))
    mean = sum(map(len, plain)) / n
    out, number = [], 0
    for i, w in enumerate(words):
        for j in range(len(w) // window):
            out.append((number, 0, i, j * window, window))
            number += 1
    rest = {i: len(w) % window for i, w in enumerate(words) if len(w) % window}
    while rest:
        seed = min(rest)
        room = window - rest[seed]
        out.append((number, 0, seed, len(words[seed]) - rest[seed], rest.pop(seed)))

        def score(i, terms):
            tf = collections.Counter(plain[i])
            return sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(plain[i]) / mean)) for t in terms if t in tf)

        slot = 1
        for s, i in sorted((-round(score(i, set(plain[seed])), 9), i) for i in rest if rest[i] <= room):
            if rest[i] <= room:
                out.append((number, slot, i, len(words[i]) - rest[i], rest[i]))
                slot, room = slot + 1, room - rest.pop(i)
        number += 1
    return out


def test_packing_by_brute_force():
    rnd = random.Random(6)
    texts = [prose(rnd, rnd.choice([5, 20, 60, 130])) for _ in range(50)] + ["", prose(rnd, 256)]
    col = pa.array(texts)
    f, tf, bounds = stats.features(col)
    s = stats.Frequencies(np.bincount(stats.bucket(f), minlength=1 << stats.DF_BITS), int((np.diff(bounds) > 0).sum()), int(tf.sum()))
    assert [r[:5] for r in packing.pack(col, s, 128)] == brute_pack(texts, 128)


def test_packing_rows(spark, odd, empty):
    rows = packing.retrieval_packs(odd).collect()
    words = collections.Counter()
    for r in rows:
        words[r["doc_id"]] += r["n_words"]
    assert words == {None: 60, 5: 120, 6: 30_000, 7: 4, 8: 2, 9: 2}
    size = collections.Counter()
    for r in rows:
        size[r["pack_id"]] += r["n_words"]
    assert max(size.values()) <= packing.WINDOW and len({(r["pack_id"], r["slot"]) for r in rows}) == len(rows) and packing.retrieval_packs(empty).count() == 0


def test_packing_finds_neighbours_everywhere(spark):
    rnd = random.Random(61)
    parts = [prose(rnd, 3000) for _ in range(6)]
    texts = [" ".join(rnd.sample(parts[i % 6].split(), 600)) for i in range(120)]
    # each topic's documents are spread over 3 languages with 20 sources each
    docs = spark.createDataFrame([(i, t, "abc"[i // 6 % 3], f"s{i // 6}", len(t)) for i, t in enumerate(texts)], DOCS)
    packs = collections.defaultdict(list)
    for r in packing.retrieval_packs(docs).orderBy("pack_id", "slot").collect():
        packs[r["pack_id"]].append(r)
    seeds = sorted(rs[0]["doc_id"] for rs in packs.values())
    assert sum(map(len, packs.values())) == 120 and len(packs) <= 12
    col = pa.array(texts)
    f, tf, bounds = stats.features(col)
    s = stats.Frequencies(np.bincount(stats.bucket(f), minlength=1 << stats.DF_BITS), int((np.diff(bounds) > 0).sum()), int(tf.sum()))
    index = packing.Index.of(col, s)
    # six windows can be filled from one topic each; what is left of the topics doesn't fill any
    assert seeds[:9] == list(range(9)) and all(len(packs[p]) == 13 and {r["doc_id"] % 6 for r in packs[p]} == {p} for p in range(6))
    # the first seed has the best of one index over everything that isn't a seed
    score = index.scores(0)
    score[seeds] = -1
    got = [r["doc_id"] for r in packs[0][1:]]
    assert len(got) == 12 and set(got) == set(np.argsort(-score)[:12].tolist()) and [r["score"] for r in packs[0][1:]] == pytest.approx(sorted(score, reverse=True)[:12])


# == 4: embeddings


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 48))
    near = np.concatenate([base[rng.integers(300, size=200)] + rng.normal(scale=s, size=(200, 48)) for s in (0.05, 0.3, 0.45)])
    x = np.concatenate([base, near, base[:5], np.zeros((1, 48))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, []), (5002, [1.0, 0.0]), (5003, [float("nan")] * 48), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit("x"))
    got = {(r["vec_a"], r["vec_b"]): r["cosine"] for r in embedding_dedup.near_vectors(df).collect()}
    u = x[:-1].astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.9, 1)), strict=True)}
    assert set(got) <= want and len(got) >= 0.9 * len(want) and len(want) > 200
    assert all(c == pytest.approx(s[a, b], abs=1e-6) for (a, b), c in got.items())
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_hadamard():
    x = np.eye(8)
    assert np.allclose(embedding_dedup.hadamard(embedding_dedup.hadamard(x)), x) and np.allclose(np.linalg.norm(embedding_dedup.rotated(x, 3), axis=1), 1)


# == 8: resharding


def least_moved(sizes, capacities):
    return sum(max(0, n - capacities.get(k, 0)) for k, n in sizes.items())


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(0, 30), max_size=5), st.dictionaries(st.sampled_from("cdefg"), st.integers(0, 60), min_size=1, max_size=5))
def test_transfers_move_the_fewest(sizes, capacities):
    if sum(sizes.values()) > sum(capacities.values()):
        with pytest.raises(ValueError):
            resharding.transfers(sizes, capacities)
        return
    moves = resharding.transfers(sizes, capacities)
    left = dict(sizes)
    size = {k: min(sizes.get(k, 0), c) if k in capacities else 0 for k, c in capacities.items()}
    for a, b, lo, hi in moves:
        left[a] -= hi - lo
        size[b] += hi - lo
    assert sum(hi - lo for *_, lo, hi in moves) == least_moved(sizes, capacities) and all(size[k] <= c for k, c in capacities.items()) and all(left[k] <= capacities.get(k, 0) for k in sizes)


def brute_flow(n, arcs, s, t):
    """Maximum flow of least cost by augmenting along cheapest paths, found by relaxing all arcs."""
    cap = {}
    cost = {}
    for a, b, c, w in arcs:
        cap[a, b] = cap.get((a, b), 0) + c
        cap.setdefault((b, a), 0)
        cost[a, b], cost[b, a] = w, -w
    total = flow = 0
    while True:
        far, by = {s: 0}, {}
        for _ in range(n):
            for (a, b), c in cap.items():
                if c and a in far and far[a] + cost[a, b] < far.get(b, 1e9):
                    far[b], by[b] = far[a] + cost[a, b], a
        if t not in far:
            return flow, total
        x = t
        while x != s:
            cap[by[x], x] -= 1
            cap[x, by[x]] += 1
            x = by[x]
        flow, total = flow + 1, total + far[t]


def test_min_cost_flow():
    rnd = random.Random(1)
    for _ in range(60):
        n = rnd.randrange(3, 7)
        arcs = [(a, b, rnd.randrange(4), rnd.randrange(5)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.8]
        flows = resharding.min_cost_flow(n, arcs, 0, n - 1)
        out = sum(f for f, a in zip(flows, arcs, strict=True) if a[1] == n - 1)
        assert (out, sum(f * a[3] for f, a in zip(flows, arcs, strict=True))) == brute_flow(n, arcs, 0, n - 1)


def test_resharding(spark, odd, empty, tmp_path):
    rnd = random.Random(7)
    docs = documents(spark, [prose(rnd, rnd.randrange(1, 90)) for _ in range(400)], extra=True)
    for i, (capacity, extra) in enumerate((({"s0": 40_000, "s1": 40_000, "s2": 40_000, "new": 40_000}, 0), ({"x": 90_000, "s1": 90_000}, 1), (resharding.grown, 0))):
        sizes = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum(F.octet_length("text"))).collect()}
        out = f"file://{tmp_path}/out{i}"
        layout = resharding.reshard(docs, F.col("source"), capacity, out).collect()
        room = capacity(sizes) if callable(capacity) else capacity
        assert sorted(r["doc_id"] for r in layout) == list(range(400))
        size = collections.Counter()
        for r in layout:
            size[r["new_shard"]] += r["n_bytes"]
        moved = sum(r["n_bytes"] for r in layout if r["old_shard"] != r["new_shard"])
        assert set(size) <= set(room) and all(size[k] <= room[k] + 2_000 for k in room) and least_moved(sizes, room) <= moved <= least_moved(sizes, room) + 6_000
        written = spark.read.parquet(out)
        assert set(docs.columns) <= set(written.columns)
    fits = resharding.reshard(docs, F.col("source"), dict.fromkeys(["s0", "s1", "s2"], 10**6), f"file://{tmp_path}/fits").collect()
    assert all(r["old_shard"] == r["new_shard"] for r in fits) and len(fits) == 400
    with pytest.raises(ValueError):
        resharding.reshard(docs, F.col("source"), {"s0": 5})
    assert resharding.reshard(empty, F.col("source"), {"a": 5}).count() == 0
    rows = resharding.reshard(odd, F.col("source"), {"a": 500_000, "z": 500_000}).collect()
    assert len(rows) == 12 and {r["new_shard"] for r in rows} <= {"a", "z"} and len({r["new_shard"] for r in rows if r["doc_id"] == 5}) == 1


# == 2: SentencePiece


@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.pieces(PIECES)


def all_segmentations(v, text):
    """Every path of a text's lattice with its log probability."""
    raw = (" " + text).encode()
    by_text = {}
    for i, t in enumerate(v.text):
        if t and not v.sp.is_byte(i):
            by_text[t] = i
    spelled, at = set(), 0
    for ch in " " + text:
        size = len(ch.encode())
        if ch.encode() not in by_text:
            spelled.update(range(at, at + size))
        at += size

    def ways(at):
        if at == len(raw):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, len(raw) + 1):
            i = by_text.get(raw[at:end])
            if i is None and end == at + 1 and at in spelled:
                i = int(v.byte[raw[at]])
            if i is not None:
                out += [((i, *w), s + v.score[i]) for w, s in ways(end)]
        return out

    found = ways(0)
    total = np.logaddexp.reduce([s for _, s in found])
    return {w: s - total for w, s in found}


@pytest.mark.parametrize("text", ["the", "ab c", "é漢x", "a  b", "\n", "🙂"])
def test_lattice_probabilities(pieces, text):
    want = all_segmentations(pieces, text)
    k = 5000 if len(want) < 40 else 4
    _, _, ids, logp, perturbed, inclusion = piece_sampling.sample(pieces, pa.array([text]), np.array([7], dtype=np.uint64), k)
    got = {tuple(x.tolist()): p for x, p in zip(ids, logp, strict=True)}
    assert len(got) == len(ids) and set(got) <= set(want) and all(p == pytest.approx(want[w], abs=1e-9) for w, p in got.items())
    assert (np.diff(perturbed) < 0).all() and all(pieces.decode(list(w)) == text for w in got) and pieces.sp.decode([list(w) for w in got]) == [text] * len(got)
    if k == 5000:
        assert len(got) == len(want) and (inclusion == 0).all()


def test_samples_have_their_probabilities(pieces):
    n, text = 20_000, "ab the"
    want = all_segmentations(pieces, text)
    keys = np.random.default_rng(3).integers(0, 2**63, n).astype(np.uint64)
    row, number, ids, _, _, inclusion = piece_sampling.sample(pieces, pa.array([text] * n), keys, 2)
    first, pairs, weight = collections.Counter(), collections.Counter(), collections.Counter()
    last = {}
    for r, k, x, i in zip(row.tolist(), number.tolist(), ids, inclusion, strict=True):
        w = tuple(x.tolist())
        weight[w] += 1 / math.exp(i) / n
        if k == 0:
            first[w] += 1
            last[r] = w
        else:
            pairs[last[r], w] += 1
            assert last[r] != w
    for w, p in want.items():
        q = math.exp(p)
        assert abs(first[w] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-9
        if q > 0.01:
            assert weight[w] == pytest.approx(1, abs=0.05)  # inclusion scores make unbiased counts
    for (a, b), c in pairs.items():
        q = math.exp(want[a]) * math.exp(want[b]) / (1 - math.exp(want[a]))
        assert abs(c / n - q) < 6 * math.sqrt(q * (1 - q) / n) + 1e-3


def test_sampling_rows(spark, pieces, odd, empty):
    rows = piece_sampling.sample_segmentations(odd, PIECES).orderBy("doc_id", "sample").collect()
    assert piece_sampling.sample_segmentations(empty, PIECES).count() == 0
    count = collections.Counter(r["doc_id"] for r in rows)
    assert count == {2: 1, 3: 2, None: 2, 5: 4, 6: 2, 7: 2, 8: 4, 9: 2}
    texts = {r["doc_id"]: r["text"] for r in odd.where("doc_id NOT IN (5, 8)").collect()}
    for r in rows:
        if r["doc_id"] in texts:
            assert pieces.decode(r["ids"]) == texts[r["doc_id"]]
    assert len({tuple(r["ids"]) for r in rows if r["doc_id"] == 5}) == 2
    again = piece_sampling.sample_segmentations(odd.repartition(3), PIECES).orderBy("doc_id", "sample").collect()
    plain = lambda rs: sorted(str((r["doc_id"], r["sample"], r["ids"], round(r["log_prob"], 5), round(r["perturbed"], 5), round(r["log_inclusion"], 5))) for r in rs)
    assert plain(rows) == plain(again)
    text = spark.createDataFrame(rows).select(piece_sampling.decoded(PIECES)("ids").alias("t")).where("t = 'é ü 漢字 🙂'")
    assert text.count() == 2


def test_store_begins_anew(pieces, monkeypatch):
    monkeypatch.setattr(piece_sampling, "MAX_EDGES", 10)
    for text in ("hello world", "other words", "hello again"):
        _, _, ids, *_ = piece_sampling.sample(pieces, pa.array([text]), np.array([1], dtype=np.uint64), 2)
        assert all(pieces.decode(x.tolist()) == text for x in ids)


def test_fresh_names():
    assert common.fresh(["A", "b"], "a", "c", "c") == ["_a", "c", "_c"]
