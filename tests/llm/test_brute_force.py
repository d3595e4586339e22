"""Operators that SQL does not express, against plain versions on small tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from statera.llm import attention, chat, compression, line_dedup, mixing, ngram_join, sharding, token_counts
from statera.llm.common import blocks_of
from statera.llm.components import components


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").persist()


# --- quality rules ------------------------------------------------------------------------


def plain_repeats(words, k=8):
    runs = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({j for i in range(len(words) - k + 1) if runs[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})


def test_bands_against_plain_counts(docs, odd):
    got = defaultdict(list)
    for d in (docs, odd):
        texts = defaultdict(list)
        for r in d.collect():
            texts[r.doc_id].append(r.text or "")
        got = defaultdict(list)
        for r in compression.compression_bands(d).collect():
            got[r.doc_id].append(r)
        for id, some in texts.items():
            want = set()
            for t in some:
                import re

                words = re.findall(r"[^\x20\x09-\x0D]+", t)
                lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
                n = plain_repeats(words)
                want.add((len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, len(words) < 20 or 100 * n > 30 * len(words)))
            assert {(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got[id]} == want
            assert not any(r.kept and r.base_failed for r in got[id])


@pytest.mark.parametrize("k", [2, 3, 5, 8])
def test_repeats_for_any_window(k):
    rng = random.Random(k)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        assert compression.repeated_words(words, k) == plain_repeats(words, k)


def test_bands_reject_repetition_and_noise():
    rng = random.Random(1)
    packer, rules = zstandard.ZstdCompressor(3), compression.Bands()
    vocabulary = ["".join(rng.choice("aeiourstlnmd") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    plain = " ".join(rng.choice(vocabulary) for _ in range(3000))
    noise = " ".join("".join(chr(rng.randint(0x21, 0x2FFF)) for _ in range(9)) for _ in range(1500))
    drill = " ".join(f"row {i % 7} of the same table and {i % 5} more" for i in range(900))
    assert compression.measure(plain, rules, packer)[-1]
    assert not compression.measure(noise, rules, packer)[-1] and not compression.measure(drill, rules, packer)[-1]
    half = plain[: len(plain) // 2] + " " + "ab " * (len(plain) // 6)
    assert not compression.measure(half, rules, packer)[-1]


def test_chunks_cover_the_text():
    for n in (0, 1, 9, 10, 11, 14, 15, 30, 34, 35):
        data = bytes(range(n))
        assert b"".join(compression.chunks_of(data, 10)) == data and all(len(c) < 15 for c in compression.chunks_of(data, 10))


# --- token counts -------------------------------------------------------------------------


def test_tokens_equal_the_library(docs, odd, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_tokenizer())
    extra = ["<|endoftext|>a<|startoftext|> b", "<|ENDOFTEXT|>", "it's we'LL don''t 12 ½ ² º", "a\u0301\u0130\u03a3 \u200b\x1c\x85\u2028x", "日本 語🙂", "\xa0nbsp\u3000"]
    more = spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string")
    for d in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), more):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in d.collect())
        bounds = token_counts.Lookup(frequent=50, sample=30, cache=60)
        for b in (bounds, token_counts.Lookup()):
            got = token_counts.token_counts(d, bounds=b, limit=100).collect()
            assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
            assert all(r.over_limit == (r.n_tokens > 100) for r in got)


# --- sharding -----------------------------------------------------------------------------


def least_capacity(sizes, shards):
    low = max([1, *sizes])
    while True:
        used, room = 1, low
        for s in sizes:
            if s > room:
                used, room = used + 1, low
            room -= s
        if used <= shards:
            return low
        low += 1


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_minimax(seed):
    rng = random.Random(seed)
    keys = sorted(rng.randint(-(2**63), 2**63 - 1) for _ in range(300))
    sizes = [rng.choice([1, 2, 3, 50]) for _ in keys]

    def ranges(pairs, bits):
        out = {}
        for k, s in pairs:
            p = out.setdefault(k >> (64 - bits), sharding.Part(k >> (64 - bits) << (64 - bits), 0, 0, bits))
            p.size, p.groups = p.size + s, p.groups + 1
        return list(out.values())

    def split(parts):
        return [q for p in parts for q in ranges([(k, s) for k, s in zip(keys, sizes) if k >> (64 - p.bits) == p.low >> (64 - p.bits)], min(64, p.bits + 3))]

    capacity, starts = sharding.minimax_cuts(ranges(list(zip(keys, sizes)), 4), split, 5, max(sizes))
    assert capacity == least_capacity(sizes, 5)
    loads = Counter(sum(k >= s for s in starts) for k in keys)
    assert len(loads) <= 5 and max(sum(s for k, s in zip(keys, sizes) if sum(k >= x for x in starts) == i) for i in range(5)) == capacity


def test_shards(docs, spark):
    hot = docs.select("doc_id", "text").unionAll(spark.range(10_000, 10_400).select("id", F.lit("the same text again and again " * 40)))
    rows = sharding.minimax_shards(hot, 8).collect()
    texts = {r.doc_id: r.text for r in hot.collect()}
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    by, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        by[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in by.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    big = Counter()
    for r in rows:
        big[texts[r.doc_id]] += r.size
    assert max(load.values()) <= max(max(big.values()), 2 * sum(load.values()) / 8) and len(load) == 8
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.minimax_shards(hot.repartition(5), 8).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


# --- mixing -------------------------------------------------------------------------------


def shared_out(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by dealing the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        target = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = {s: 2.0 * sizes[s] for s in rest if target[s] > 2 * sizes[s]}
        if not over:
            return target | full
        full |= over


def test_mix(spark):
    rng = random.Random(3)
    names = ["b", "a", "é", "B", None, "zz", "c", "d", "e"]
    rows = [(i, " ".join("w" for _ in range(int(rng.expovariate(1 / 60)))), "hot" if i % 3 == 0 else rng.choice(names)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in mixing.mix_sources(df).collect()}
    size, taken = Counter(), Counter()
    for i, t, s in rows:
        r = got[i]
        assert r.size == len(t.split()) and r.taken == r.size * r.copies and 0 <= r.copies <= 2 and abs(r.copies - r.rate) < 1.0001
        size[s] += r.size
        taken[s] += r.taken
    target = shared_out(size)
    for i, _, s in rows:
        assert got[i].source_size == size[s] and abs(got[i].target - target[s]) < 1e-6 * target[s]
    assert all(abs(taken[s] / target[s] - 1) < 0.005 for s in size)
    # The odds of a rate are exponential in the size, with one multiplier per source.
    for s in size:
        some = [got[i] for i, t, x in rows if x == s and got[i].size > 0 and 1e-6 < got[i].rate < 2 - 1e-6]
        tilt = [np.log(r.rate / (2 - r.rate)) / r.size for r in some]
        assert not tilt or np.ptp(tilt) < 1e-6 * (1 + abs(tilt[0]))
        if some:
            assert abs(sum(got[i].size * got[i].rate for i, _, x in rows if x == s) / target[s] - 1) < 1e-6
    assert {i: r.taken for i, r in got.items()} == {r.doc_id: r.taken for r in mixing.mix_sources(df.repartition(7)).collect()}


# --- set joins ----------------------------------------------------------------------------


def near_copies(rng, n_bases=12, copies=14, words=60):
    rows = []
    for b in range(n_bases):
        base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = f"w{rng.randint(0, 400)}"
            rows.append(" ".join(t[: rng.randint(len(t) - 6, len(t))]))
    return rows


@pytest.mark.parametrize("side", [3, 2048])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, side):
    monkeypatch.setattr(ngram_join, "SIDE", side)
    monkeypatch.setattr(ngram_join, "OTHER", 2 * side)
    rng = random.Random(5)
    texts = near_copies(rng, words=140) + ["a b", "A  B", "a b c", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                links += sets[i] != sets[j]
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert links > 20
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert sorted(r.doc_id for r in ngram_join.one_of_each(df).collect()) == sorted({find(i) for i in range(len(sets))})


def test_bound_is_above_the_intersection():
    rng = np.random.default_rng(2)
    like = ngram_join.Likeness()
    for _ in range(200):
        pool = rng.integers(0, 2**63, 300, np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 250))) for _ in range(2))
        x, y = ngram_join.bitmap(a).tobytes(), ngram_join.bitmap(b).tobytes()
        w = min(len(x), len(y))
        x, y = (np.frombuffer(ngram_join.folded(v, w), np.uint64) for v in (x, y))
        ones = [int(np.bitwise_count(v).sum()) for v in (x & y, x, y)]
        common = len(np.intersect1d(a, b))
        assert common <= min(len(a) - (ones[1] - ones[0]), len(b) - (ones[2] - ones[0]))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert ngram_join.links_bound(len(a), len(b), *ones, like)


@pytest.mark.parametrize("tile", [4, 4096])
def test_lines_against_all_pairs(spark, tile):
    rng = random.Random(9)
    lines = near_copies(rng, n_bases=10, copies=12, words=18) + ["x y z v", "x y z v u", "x y", "y  X", "x y z"] * 2
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)] + [None, "", "\n \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, want = [], {}
    for d, t in enumerate(texts):
        gone = []
        for i, line in enumerate((t or "").split("\n")):
            if s := frozenset(line.lower().split()):
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    gone.append(i)
                seen.append(s)
        want[d] = gone
    got = {r.doc_id: list(r.removed) for r in line_dedup.repeated_lines(df, rule=line_dedup.Similar(tile=tile)).collect()}
    assert got == want
    kept = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(df).collect()}
    assert kept == {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]) for d, t in enumerate(texts)}


@pytest.mark.parametrize("rows", [16, 200_000])
def test_components_of_chains_and_stars(spark, monkeypatch, rows):
    monkeypatch.setattr("statera.llm.components.PER_TASK", rows)
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    rng.shuffle(pairs)
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in linked}


def test_few_links_are_joined_in_one_query(spark, monkeypatch):
    monkeypatch.setattr("statera.llm.components._pulled", None)  # no star steps
    links = spark.createDataFrame([(3, 2), (2, 9), (5, 5), (7, 8), (8, 7)], "a long, b long")
    assert sorted(map(tuple, components(links).collect())) == [(2, 2), (3, 2), (7, 7), (8, 7), (9, 2)]
    assert components(links.filter("a = b")).collect() == []


def test_blocks_run_over_batches():
    import pyarrow as pa

    keys = np.repeat(np.arange(9), [1, 4, 2, 9, 1, 1, 3, 30, 2]).astype(np.int64)
    for size in (1, 2, 3, 7, 100):
        batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + size]}) for i in range(0, len(keys), size)]
        got = [part.column("k").to_numpy()[s:e] for part, starts in blocks_of(iter(batches), ["k"]) for s, e in zip(starts, np.append(starts[1:], part.num_rows))]
        assert [len(g) for g in got] == [1, 4, 2, 9, 1, 1, 3, 30, 2] and all(len(set(g)) == 1 for g in got)


# --- classifier and transcripts -----------------------------------------------------------


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, attention.FEATURES)).astype(np.float32) for n in (1, 4, 2)]
    x = np.concatenate(bags)
    bag, y = np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    model = attention.train(bags, y, attention.Training(steps=3))
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def loss():
        p = model.forward(x, bag)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    f = model.forward(x, bag)
    grads = attention.gradients(model.weights, f, x, bag, f["p"] - y)
    for name, w in model.weights.items():
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - grads[name][at]) < 1e-4
        w[at] += 1e-5


def test_classifier_on_held_out_rows(docs, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = attention.fit(docs, labels)
    got = attention.quality_scores(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 10 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in attention.quality_scores(docs, model).collect())


def test_scores_do_not_depend_on_the_batch(docs):
    texts = [r.text for r in docs.limit(40).collect()] + ["", "x"]
    model = attention.train([attention.passages([t])[0] for t in texts], np.arange(len(texts)) % 2, attention.Training(steps=20))
    one = np.concatenate([model.score([t]) for t in texts])
    assert np.allclose(one, model.score(texts), atol=1e-5)


def test_long_texts_are_encoded_in_slices(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "Ünï ", "a\n", "  ", "x" * 50 + " ", "9.5 "]) for _ in range(n)) for n in (0, 3, 700, 5000, 40)] + ["", " " * 3000, "y" * 3000, "\n z" * 2000]
    whole = attention.passages(texts)
    for size in (100, 1000, 5000):
        monkeypatch.setattr(attention, "SLICE_BYTES", size)
        x, bag = attention.passages(texts)
        assert (bag == whole[1]).all() and np.allclose(x, whole[0])


def plain_features(text):
    """Passage by passage: shares of byte classes and counts of words, in plain Python."""
    out = []
    data = text.encode()
    import re

    begins = [m.start() for m in re.finditer(rb"[^\x09-\x0d\x20]+", data)]
    for i in range(0, len(begins), attention.PASSAGE):
        part = data[begins[i] : begins[i + attention.PASSAGE] if i + attention.PASSAGE < len(begins) else len(data)]
        words = part.split()
        share = [sum(attention._CLASS[b] == k for b in part) / len(part) for k in range(attention._CLASSES)]
        n = [len(w) for w in words]
        mean = sum(n) / len(n)
        out.append([
            *share, np.log1p(len(n)) / 4, mean / 10, (sum(x * x for x in n) / len(n) - mean**2) ** 0.5 / 10, len(set(words)) / len(n),
            sum(a == b for a, b in zip(words, words[1:])) / len(n), sum(65 <= w[0] <= 90 for w in words) / len(n), 1,
        ])
    return np.array(out or [[0] * attention.FEATURES])


def test_score_against_a_plain_forward_pass():
    rng = np.random.default_rng(5)
    words = ["the", "The", "cat", "42", "x#y", "é", "runs.", "(a)", "the"]
    texts = [" ".join(rng.choice(words, n)) + "\n" for n in (1, 64, 65, 300)] + [""]
    model = attention.train([attention.passages([t])[0] for t in texts[:4]], np.array([0, 1, 0, 1]), attention.Training(steps=30))
    w = model.weights
    for t, got in zip(texts, model.score(texts)):
        rows = []
        for f in plain_features(t):
            h = np.tanh(((f - model.mean) / model.scale) @ w["W"] + w["b"])
            e = sum(w["a"][g] * np.tanh(h @ w["V"][:, g]) / (1 + np.exp(-(h @ w["U"][:, g]))) for g in range(len(w["a"])))
            rows.append((e, h))
        top = max(e for e, _ in rows)
        weights = [np.exp(e - top) for e, _ in rows]
        z = sum(a * h for a, (_, h) in zip(weights, rows)) / sum(weights)
        assert abs(got - 1 / (1 + np.exp(-(z @ w["c"] + w["d"][0])))) < 1e-4


def test_passages_cover_whole_texts():
    x, bag = attention.passages(["", "a " * 64, "a " * 65, "ü" * 5])
    assert list(bag) == [0, 1, 2, 4] and len(x) == 5 and not x[0].any()


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    counts = {(s, o): int(rng.integers(1, 30)) for s in range(chat.STATES) for o in range(4)}
    model = chat.model_of(Counter({0: 5, 2: 3, 4: 2}), Counter({(s, t): int(rng.integers(0, 9)) for s in range(6) for t in range(6)}), Counter(counts))
    for n in (1, 2, 4):
        seen = [int(o) for o in rng.integers(0, 4, n)]
        paths = product(range(chat.STATES), repeat=n)
        score = lambda p: model.start[p[0]] + sum(model.show[s, o] for s, o in zip(p, seen)) + sum(model.move[a, b] for a, b in zip(p, p[1:]))
        assert np.isclose(score(chat.viterbi(seen, model)), max(map(score, paths)))


def test_roles_of_held_out_conversations(spark, sf):
    got = chat.parsed_conversations(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")).filter("held_out").collect()
    assert len(got) > 200 and np.mean([list(r.roles) == list(r.known) for r in got]) > 0.93


def test_blank_transcripts_render_empty():
    model = chat.model_of(Counter(), Counter(), Counter())
    assert [chat.rendered(chat.turns_of(t, model)) for t in (None, "", " \n ")] == [""] * 3


def test_lines_of_dense_and_of_usual_words(spark):
    """Sixty copies of a line share words whose pairs are left to the ordered cells; the others' words go by buckets."""
    rng = random.Random(3)
    lines = [" ".join([f"b{k}" for k in range(30)] + [f"u{i}"]) for i in range(60)] + near_copies(rng, n_bases=8, copies=6, words=70) + ["w" * 100 + " b c d e f", "f e d c b " + "W" * 100 + " g"]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rule = line_dedup.Similar()
    rows = line_dedup._rows(df, "doc_id", "text")
    chunks = line_dedup.word_chunks(rows, line_dedup.read_lines(rows, rule)[1], rule, 12)
    made = chunks.collect()
    n = sum(len(r.words) // 4 for r in made)
    # No row for an entry, and few bytes: what is shuffled stays near the size of the texts.
    assert len(made) <= 12 * df.rdd.getNumPartitions() and sum(len(r.words) + len(r.sets) + len(r.sizes) + len(r.maps) for r in made) <= 32 * n
    found = line_dedup.shared_words(chunks, rule)
    assert not found.filter("dense is not null").isEmpty() and not found.filter("a is not null").isEmpty()
    seen, want = [], {}
    for d, t in enumerate(texts):
        want[d] = []
        for i, line in enumerate(t.split("\n")):
            s = frozenset(line.lower().split())
            if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                want[d].append(i)
            seen.append(s)
    assert {r.doc_id: list(r.removed) for r in line_dedup.repeated_lines(df).collect()} == want


def test_parity_maps_lose_no_pair():
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for n in (4, 9, 20, 63, 66, 130, 250, 300, 700):
        for _ in range(4):
            base = list(rng.choice(vocabulary, n, replace=False))
            for drop in range(0, n // 4 + 1, max(1, n // 20)):
                texts.append(" ".join(base[drop:] + list(rng.choice(vocabulary, drop // 3, replace=False))))
    rule = line_dedup.Similar()
    lines = line_dedup.lines_of(texts, np.full(1 << rule.rarity_bits, 2, np.int32))
    line, _, at, lead = line_dedup.prefix(lines, rule)
    maps, base = line_dedup.parities(lines)
    _, short = line_dedup.placed(lines.words[at], 1)
    sizes = (2 * lines.size[line] + lead).astype(np.uint32)
    pairs, _, dense = line_dedup.bucket_pairs(short, lines.names[line], sizes, line_dedup.ragged(maps, base[line], line_dedup.widths(lines.size)[line]), rule)
    got = set(zip(*pairs.tolist()))
    sets = [frozenset(t.split()) for t in texts]
    want = {
        (min(a, b), max(a, b)) for i, a in enumerate(lines.names.tolist()) for j, b in enumerate(lines.names.tolist()[:i])
        if a != b and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    }
    assert not len(dense) and len(want) > 100 and want <= got


@pytest.mark.parametrize("bits", [42, 20])
def test_lines_split_like_plain_ones(monkeypatch, bits):
    """Also where the bits that order the words of a line do not tell them apart."""
    monkeypatch.setattr(line_dedup, "ORDER_BITS", bits)
    rng = random.Random(5)
    texts = ["", "\n", "a\x0bb A\n\nx\r\ny", "ü Ü ÄA äa", " ".join("w" * n for n in (7, 8, 9, 16, 17, 64, 65, 100, 65)), "\0 a\0 a"]
    texts += ["\n".join(" ".join(f"v{rng.randint(0, 900)}" for _ in range(rng.randint(0, 60))) for _ in range(30)) for _ in range(20)]
    want = [(i, j, frozenset(x.split())) for i, t in enumerate(texts) for j, x in enumerate(t.encode().lower().split(b"\n")) if x.split()]
    counts = np.random.default_rng(1).integers(1, 9, 1 << 18).astype(np.int32)
    sets: dict[frozenset, tuple] = {}
    for lines in (line_dedup.lines_of(texts), line_dedup.lines_of(texts, counts)):
        assert list(zip(lines.text, lines.place, lines.size)) == [(i, j, len(s)) for i, j, s in want]
        for k, (_, _, s) in enumerate(want):
            words = lines.words[lines.start[k] : lines.start[k] + lines.size[k]]
            assert sets.setdefault(s, (lines.names[k], sorted(words))) == (lines.names[k], sorted(words)) and len(set(words)) == len(s)
    assert len({n for n, _ in sets.values()}) == len(sets)
    rank = {w: r for r, w in enumerate(sorted(set(lines.words.tolist()), key=lambda w: (counts[w >> 46], w)))}
    for a, n in zip(lines.start, lines.size):
        assert (np.diff([rank[w] for w in lines.words[a : a + n].tolist()]) > 0).all()


def test_entries_of_dense_and_frequent_words_are_passed_on(spark):
    """The texts are not read a third time for them; and in a corpus so large that all places of the table of word counts
    lie above a tile, usual words still go by buckets."""
    rng = random.Random(8)
    lines = [" ".join([f"b{k}" for k in range(12)] + [f"u{i}"]) for i in range(40)] + near_copies(rng, n_bases=5, copies=4, words=20)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(2)
    rule = line_dedup.Similar()
    rows = line_dedup._rows(df, "doc_id", "text")
    often = line_dedup.read_lines(rows, rule)[1]
    many = np.where(often > 0, often + 5 * rule.tile, 5 * rule.tile).astype(np.int32)
    plain = line_dedup.lines_of(lines, many)
    line, _, at, _ = line_dedup.prefix(plain, rule)
    want = set(zip((plain.words[at] & np.uint64(0xFFFFFFFF)).tolist(), plain.names[line].tolist()))
    for table, usual in ((many, True), (np.where(often > 1, 10**6, 0).astype(np.int32), False)):
        chunks = line_dedup.word_chunks(rows, table, rule, 8)
        assert all((r.bucket >= 0) == usual for r in chunks.collect())
        found = line_dedup.shared_words(chunks, rule).filter("dense is not null").collect()
        got = {(r.dense & 0xFFFFFFFF, r.set) for r in found}
        assert len(found) == len(got) and (got < want if usual else got) and all(len(r.map) == 8 and r.size >> 1 > 3 for r in found)
