"""Scans within a row, match offsets, span resolution and keyword tries against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from statera.functions import arrays, text
from statera.operators import pii, sections, sentences


def test_scans(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-9, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 7, 8, 9, 64, 65, 1000])] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    for r in df.select("v", arrays.running_sums(F.col("v")).alias("s"), arrays.running_max(F.col("v")).alias("m")).collect():
        if r.v is None:
            assert r.s is None and r.m is None
            continue
        total, most, want = 0, -99, ([], [])
        for x in r.v:
            total, most = total + x, max(most, x)
            want[0].append(total), want[1].append(most)
        assert (r.s, r.m) == want


def test_matches_have_the_places_of_python(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab1 ü§9") for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(999, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    for r in df.select("t", arrays.matches(F.col("t"), "[0-9]+|§ ?a").alias("m")).collect():
        want = None if r.t is None else [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+|§ ?a", r.t)]
        assert (r.m if r.m is None else [tuple(m) for m in r.m]) == want


def plain_entities(t, recognizers):
    hits = [(r.score, m.end() - m.start(), -m.start(), r.entity, m.group()) for r in recognizers for m in re.finditer(r.pattern, t)]
    taken = []
    for score, n, minus, entity, found in sorted(hits, reverse=True):
        if all(-minus >= b or -minus + n <= a for a, b, *_ in taken):
            taken.append((-minus, -minus + n, entity, found, score))
    seen, out = {}, []
    for a, b, entity, found, score in sorted(taken):
        seen[entity] = seen.get(entity, 0) + 1
        out.append((entity, found, a, b, score, f"<{entity}_{seen[entity]}>"))
    return out


def test_overlaps_are_resolved_as_by_a_plain_greedy_choice(spark):
    rng = random.Random(3)
    own = (pii.Recognizer("A", "ab+", 0.8), pii.Recognizer("B", "b+c?", 0.8), pii.Recognizer("C", "[abc]c", 0.9), pii.Recognizer("D", "aab", 0.75))
    rows = [(i, "".join(rng.choice("aabbc ") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, t string")
    for r in df.select("t", pii.detect_pii(F.col("t"), own).alias("e"), pii.mask_text(F.col("t"), pii.detect_pii(F.col("t"), own)).alias("m")).collect():
        want = plain_entities(r.t, own)
        assert [tuple(e) for e in r.e] == want
        masked, at = "", 0
        for _, _, a, b, _, label in want:
            masked, at = masked + r.t[at:a] + label, b
        assert r.m == masked + r.t[at:]


def test_german_identifiers(spark):
    t = "Vertrag DE123456789, Az. 12 O 345/23; DE89 3704 0044 0532 0130 00 und V-Nr. A-7/2. Vertrag X1"
    d = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(pii.detect_pii(F.col("t")).alias("e")).collect()
    assert [tuple(e) for e in d[0].e] == plain_entities(t, pii.GERMAN_RECOGNIZERS)
    assert [e.placeholder for e in d[0].e] == ["<VAT_ID_1>", "<CASE_NUMBER_1>", "<IBAN_1>", "<CONTRACT_NUMBER_1>", "<CONTRACT_NUMBER_2>"]
    assert d[1].e is None and d[2].e == []


def test_twice_the_entities_take_about_twice_the_time(spark):
    def seconds(n):
        df = spark.createDataFrame([("a@b.de 12 " * n,)], "t string").withColumn("t", F.concat("t", F.lit("")))
        best = 1e9
        for _ in range(3):
            t0 = time.perf_counter()
            assert df.select(F.size(pii.detect_pii(F.col("t"), (pii.EMAIL,))).alias("n")).first().n == n
            best = min(best, time.perf_counter() - t0)
        return best

    seconds(100)
    assert seconds(10_000) < 4 * seconds(5_000) + 1


def test_parents_of_sections(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]) for i in range(60)]
    for r in spark.createDataFrame(rows, "i int, v array<int>").select("v", sections.section_parents(F.col("v")).alias("p")).collect():
        want = [max((j for j in range(i) if r.v[j] < lv), default=None) if lv else None for i, lv in enumerate(r.v)]
        assert r.p == want


def test_sentences_have_their_places(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice(["Ab", "c", " ", ". ", "! ", "?", "..  ", "\u00a0", "ü"]) for _ in range(rng.randint(0, 25))),) for _ in range(200)] + [(None,)]
    for r in spark.createDataFrame(rows, "t string").select("t", sentences.sentence_spans(F.col("t")).alias("s"), sentences.split_sentences(F.col("t")).alias("w")).collect():
        assert (r.s is None) == (r.t is None)
        at = 0
        for s, want in zip(r.s or [], r.w or [], strict=True):
            assert s.sentence == want == r.t[s.start : s.stop] and s.start == r.t.index(want, at)
            at = s.stop


@pytest.mark.parametrize("words", [["kann"], ["ab", "abc", "b", "a.c", "(x)", "ä§"], [f"w{i}" for i in range(0, 3000, 3)], ["a-b", "a]b", "^", "#", "a&&b"]])
def test_tries_match_what_the_words_do(spark, words):
    rng = random.Random(6)
    rows = [("".join(rng.choice(["a", "b", "c", ".", "(x)", "ä§", "w", "1", "kann", " ", "9", "-", "]", "^", "&&", "#"]) for _ in range(rng.randint(0, 14))),) for _ in range(300)] + [(None,)]
    df = spark.createDataFrame(rows, "t string").select("t", text.contains_any(F.col("t"), words).alias("any"), text.keyword_hits(F.col("t"), words).alias("hits"))
    longest = re.compile("|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w)))))
    for r in df.collect():
        if r.t is not None:
            assert r.any == any(w in r.t for w in words)
            assert [tuple(h) for h in r.hits] == [(m.start(), m.end(), m.group()) for m in longest.finditer(r.t)]
    with pytest.raises(ValueError):
        text.trie_pattern(["a", ""])


def test_a_thousand_keywords_cost_about_as_much_as_ten(spark):
    df = spark.range(4000).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("wort"), (i * 7919 + F.col("id")) % 9973))).alias("t")).persist()
    df.count()

    def seconds(n):
        best = 1e9
        for _ in range(3):
            t0 = time.perf_counter()
            df.select(text.contains_any(F.col("t"), [f"zahl{i}" for i in range(n)])).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        return best

    seconds(5)
    assert seconds(1000) < 3 * seconds(10) + 1
