"""License scan, lexical search and centroid clustering against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from statera.llm import clusters, lexical, licenses
from statera.llm.license_rules import LEVELS, all_rules

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOWER_TO_UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").persist()


def words_of(text):
    return WORDS.findall((text or "").translate(UPPER))


# --- license scan -------------------------------------------------------------------------


def sample(pattern):
    """A text that a pattern fits: optional parts left out, first alternatives taken."""
    while "(" in pattern:
        pattern = re.sub(r"\(([^()]*)\)(\?|\{\d+,\d+\})?", lambda m: "" if m[2] == "?" or (m[2] or "").startswith("{0") else m[1].split("|")[0], pattern, count=1)
    pattern = re.sub(r".\?", "", pattern).replace("[cs]", "c").replace(r"\w+", "x").replace(r"\w*", "").replace(r"\w", "x").replace(r"\d", "1")
    return re.sub(r"\[(.)[^\]]*\]", r"\1", pattern)


def test_every_rule_fits_its_sample_and_passes_its_prefilter():
    rules = all_rules()
    scanner = licenses.Scanner(rules, licenses.BASE)
    assert len(rules) >= 200 and all(0 <= r.level < len(LEVELS) and r.needs for r in rules)
    for i, r in enumerate(rules):
        text = "// " + sample(r.pattern).translate(LOWER_TO_UPPER).replace(" ", "\n * ") + "."
        found = scanner.scan(text)[2]
        assert scanner.patterns[i].search(text.encode().lower()), r
        assert all(w.encode() in text.encode().lower() for w in r.needs), r
        assert found and found == scanner.scan(text, prefilter=False)[2], r
        assert not scanner.patterns[i].search(("x" + text[3:-1] + "x").encode().lower()), r


def plain_unsuppressed(found, level):
    def beats(g, f):
        inside = g.start <= f.start and f.end <= g.end and level[g.rule] <= level[f.rule]
        equal = (g.start, g.end) == (f.start, f.end) and level[g.rule] == level[f.rule]
        return inside and (g.rule < f.rule if equal else g != f)

    return sorted(f for f in found if not any(beats(g, f) for g in found))


def test_suppression_against_all_pairs():
    rng = random.Random(1)
    level = [0, 0, 1, 1, 2, 3]
    for _ in range(500):
        found = {licenses.Found(a, a + rng.randint(1, 9), rng.randrange(6)) for a in (rng.randrange(12) for _ in range(rng.randint(0, 14)))}
        assert licenses.unsuppressed(list(found), level) == plain_unsuppressed(found, level)


def test_scan_against_plain_counts(spark, docs, odd, none):
    for table in (docs, odd):
        want = Counter()
        for r in table.collect():
            w = words_of(r.text)
            at = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            first, last = (min(at)[0], max(at)[0]) if at else (None, None)
            want[(r.doc_id, len(w), len(at), first, last, ",".join(sorted({x for _, x in at})))] += 1
        rows = licenses.license_digest(licenses.license_scan(table)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
        for r in rows:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
            assert (r.score > 0) == bool(r.labels)
    assert licenses.license_digest(licenses.license_scan(none)).count() == 0


def test_overlapping_licenses(spark):
    texts = [
        "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the Apache License, Version 2.0.", "the GNU Lesser General Public License v2.1",
        "Licensed under CC BY-NC 4.0. All\trights\n-- reserved!", "no rights", "cc by" + " cc  by" * 3, "ACC BY cc bye", "x" * 5_000_000 + " mit license",
    ]
    frame = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, labels string, base string")
    got = {r.doc_id: r for r in licenses.license_digest(licenses.license_scan(frame)).collect()}
    assert [got[i].labels for i in range(8)] == ["gpl-2.0-or-later", "apache-2.0", "gpl,lgpl-2.1", "cc-by,cc-by-nc-4.0,reserved", "", "cc-by", "", "mit"]
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (4, 0, 6) and got[3].n_base == 2
    spans = licenses.license_scan(frame).filter("doc_id = 1").first().detections
    assert [texts[1].encode()[d.start : d.end] for d in spans] == [b"Licensed under the Apache License, Version 2.0"]


# --- ranked lexical search ----------------------------------------------------------------


def plain_search(docs, items, k=20):
    """Every document scored for every item, in plain integers."""
    words = [(i, Counter(words_of(t)), len(words_of(t))) for i, t in docs if t is not None]
    words = [w for w in words if w[2]]
    n, total = len(words), sum(w[2] for w in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = Counter()
    for id, text in set(items):
        if text is None:
            continue
        asked = Counter(words_of(text))
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in asked}
        scores = []
        for doc, c, length in words:
            m = 75 + 25 * length * n // total
            s = sum(times * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        out.update((id, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1))
    return out


def found_rows(docs, items, **kw):
    return Counter(tuple(r) for r in lexical.ranked_documents(docs, items, **kw).select("item_id", "rank", "doc_id", "score").collect())


def test_search_against_all_documents(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found_rows(docs, items) == want and sum(want.values()) > 100


def test_search_on_odd_rows(spark, odd, none):
    rows = [("a", "One fox, one dog"), ("a", "One fox, one dog"), ("a", "spam two"), (None, "words row"), ("e", ""), ("n", None), ("x", "unseen"), ("l", " ".join(f"w{i}x{i % 31} the" for i in range(0, 977, 2)))]
    items = spark.createDataFrame(rows, "item_id string, text string").withColumn("score", items_extra())
    want = plain_search([(r.doc_id, r.text) for r in odd.collect()], rows)
    assert found_rows(odd, items) == want and len({i for i, *_ in want}) == 3
    assert found_rows(odd, items, k=1) == plain_search([(r.doc_id, r.text) for r in odd.collect()], rows, 1)
    assert not found_rows(none, items) and not found_rows(odd, items.limit(0))


def items_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_search_in_small_blocks_and_several_passes(spark, sf, docs, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 900)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 2000)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 3)
    assert found_rows(docs, items, k=3) == want


def test_terms_of_slices(monkeypatch):
    monkeypatch.setattr(lexical, "_SLICE", 7)
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aB9é .-\n") for _ in range(rng.randint(0, 60)))
        assert [w.decode() for part in lexical.terms_of(text.encode()) for w in part] == words_of(text)


@pytest.mark.parametrize("n_terms", [1, 7, 64, 65, 200])
def test_masks(n_terms):
    bits = np.random.default_rng(n_terms).random((n_terms, 90)) < 0.02
    first, name = lexical.masks_of(bits)
    assert len(first) == len({c.tobytes() for c in bits.T}) and (bits[:, first][:, name] == bits).all()


# --- centroid clustering ------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            groups[j].append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(cents)]
    got = assign()
    per = Counter()
    for d, j in got:
        per[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, j, d, per[j], sum(per.values()), sha[j]) for (i, _), (d, j) in zip(kept, got))


def cluster_rows(df, **kw):
    return Counter(tuple(r) for r in clusters.clustered(df, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clusters_against_plain(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=64) * 0.2 + (i % 5)]) for i in range(120)]
    v = rows[7][1]
    rows += [(7, v), (7, v), (7, rows[9][1]), (None, v), (None, rows[3][1]), (300, None), (301, []), (302, v[:63]), (303, [None, *v[1:]]), (304, [math.nan, *v[1:]]), (305, [math.inf, *v[1:]]), (306, [-math.inf, *v[1:]])]
    frame = spark.createDataFrame([(i, x, "c", "d") for i, x in rows], "vec_id long, embedding array<double>, cluster string, q string").repartition(3)
    assert cluster_rows(frame) == plain_clusters(rows)
    assert cluster_rows(frame, k=3, rounds=2) == plain_clusters(rows, 3, 2)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert cluster_rows(few) == plain_clusters(rows[:3]) and clusters.clustered(frame.limit(0)).count() == 0


def test_too_large_components_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        clusters.clustered(frame)


@pytest.mark.parametrize("k", [1, 2, 3, 8, 60])
def test_tree_search_is_exact_with_ties(k):
    rng = np.random.default_rng(k)
    for spread in (2, 50, 1 << 26):
        centroids = rng.integers(-spread, spread, (k, 6))
        if k > 3:
            centroids[2] = centroids[1]
        x = np.concatenate([rng.integers(-spread, spread, (300, 6)), centroids])
        label, d = clusters.nearest(clusters.build_tree(centroids), x)
        want = ((x[:, None, :] - centroids[None]) ** 2).sum(-1)
        assert (d == want.min(1)).all() and (label == want.argmin(1)).all()


def test_tree_search_skips_far_leaves(monkeypatch):
    """With clustered centroids most distances are never computed."""
    rng = np.random.default_rng(5)
    centroids = (rng.integers(0, 1000, (8, 4)).repeat(32, axis=0) * 1000 + rng.integers(0, 50, (256, 4))).astype(np.int64)
    x = centroids[rng.integers(0, 256, 500)] + 3
    computed = 0
    real = np.einsum

    def counted(spec, a, b):
        nonlocal computed
        computed += len(a)
        return real(spec, a, b)

    tree = clusters.build_tree(centroids)
    monkeypatch.setattr(clusters.np, "einsum", counted)
    clusters.nearest(tree, x)
    assert computed < 0.5 * 256 * 500
