"""Pattern-based personal data: detection, numbered placeholders, restoration, leak check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, matches, running_max, running_sums
from ..functions.rows import exploded, once
from ..functions.text import unicode_ws


@dataclass(frozen=True)
class Recognizer:
    entity: str
    pattern: str
    score: float


# Recognisers of German identifiers and their scores.
GERMAN_RECOGNIZERS = (
    Recognizer("CASE_NUMBER", r"(?:Az\.|Aktenzeichen)?\s*\d+\s+[A-Z][a-z]?\s+\d+/\d+", 0.85),
    Recognizer("IBAN", r"DE\d{2}\s?(\d{4}\s?){4}\d{2}", 0.9),
    Recognizer("VAT_ID", r"DE\d{9}", 0.85),
    Recognizer("CONTRACT_NUMBER", r"(?:Vertrag|Vertrags-Nr\.|V-Nr\.)\s*[A-Z0-9\-/]+", 0.75),
)
EMAIL = Recognizer("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1.0)
THRESHOLD = 0.7
def resolved(hits: Column) -> Column:
    """Hits (start, stop, score, ...) of which no two overlap: the higher score stays, then the longer one, then the
    first. A sweep over the running largest end cuts the hits into islands that do not touch; only within an
    island, most often one hit, are hits compared with each other."""

    def islands(sorted_: Column) -> Column:
        def cut(reach: Column) -> Column:
            fresh = lambda h, i: F.when((i == 0) | (h["start"] >= F.get(reach, i - 1)), i)
            heads = F.filter(F.transform(sorted_, fresh), lambda i: i.isNotNull())
            return let(
                heads,
                lambda at: F.transform(at, lambda s, k: F.slice(sorted_, s + 1, F.coalesce(F.get(at, k + 1), F.size(sorted_)) - s)),
            )

        return let(running_max(F.transform(sorted_, lambda h: h["stop"])), cut)

    def winners(island: Column) -> Column:
        rank = lambda h: F.struct(h["score"], h["stop"] - h["start"], -h["start"], h["entity"], h["text"])
        before = lambda a, b: F.when(rank(a) > rank(b), -1).when(rank(a) < rank(b), 1).otherwise(0)
        free = lambda taken, h: ~F.exists(taken, lambda t: (h["start"] < t["stop"]) & (h["stop"] > t["start"]))
        best = F.aggregate(
            F.array_sort(island, before), F.slice(island, 1, 0), lambda taken, h: F.when(free(taken, h), F.array_append(taken, h)).otherwise(taken)
        )
        return F.when(F.size(island) == 1, island).otherwise(best)

    return F.array_sort(F.flatten(F.transform(let(F.array_sort(hits), islands), winners)))


def numbered(found: Column, names: list[str]) -> Column:
    """Entities in reading order, each with a placeholder that counts those of its kind."""

    def count(name: str) -> Column:
        return running_sums(F.transform(found, lambda e: (e["entity"] == name).cast("int"))).alias(name)

    def place(counts: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            n = F.coalesce(*[F.when(e["entity"] == name, F.get(counts[name], i)) for name in names])
            label = F.concat(F.lit("<"), e["entity"], F.lit("_"), n, F.lit(">"))
            return F.struct(*[e[c].alias(c) for c in ("entity", "text", "start", "stop", "score")], label.alias("placeholder"))

        return F.transform(found, one)

    return let(F.struct(*[count(name) for name in names]), place)


def detect_pii(c: Column, recognizers=GERMAN_RECOGNIZERS, threshold: float = THRESHOLD) -> Column:
    """array of entities with offsets and numbered placeholders, in reading order, none overlapping another."""

    def hits(r: Recognizer) -> Column:
        one = lambda m: F.struct(
            m["start"].alias("start"), m["stop"].alias("stop"), F.lit(float(r.score)).alias("score"), F.lit(r.entity).alias("entity"), m["text"].alias("text")
        )
        return F.transform(matches(c, unicode_ws(r.pattern)), one)

    used = [r for r in recognizers if r.score >= threshold]
    if not used:
        kind = "array<struct<entity:string,text:string,start:int,stop:int,score:double,placeholder:string>>"
        return F.when(c.isNotNull(), F.array().cast(kind))
    names = list(dict.fromkeys(r.entity for r in used))
    return let(resolved(F.concat(*[hits(r) for r in used])), lambda found: numbered(found, names))


def mask_text(c: Column, entities: Column) -> Column:
    """Text with every entity replaced by its placeholder, from the ordered entity spans."""

    def masked(found: Column) -> Column:
        end_of = lambda i: F.coalesce(F.get(found, i)["stop"], F.lit(0))
        part = lambda e, i: F.concat(F.substring(c, end_of(i - 1) + 1, e["start"] - end_of(i - 1)), e["placeholder"])
        return F.concat(F.array_join(F.transform(found, part), ""), F.substring(c, end_of(F.size(found) - 1) + 1, F.length(c)))

    return let(entities, masked)


def mask_pii(df: DataFrame, request_id: str, text: str, recognizers=GERMAN_RECOGNIZERS,
             threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Masked rows, and the mapping table ``request_id, placeholder, original``."""
    staged = df.withColumn("_e", once(detect_pii(F.col(text), recognizers, threshold)))
    masked = staged.withColumn("masked", mask_text(F.col(text), F.col("_e"))).withColumn("entities", F.size("_e")).drop("_e")
    mapping = exploded(staged, [request_id], F.col("_e"), "n", "e").select(
        request_id, F.col("e.placeholder").alias("placeholder"), F.col("e.text").alias("original")
    )
    return masked, mapping


def pii_free(c: Column, recognizers=GERMAN_RECOGNIZERS, threshold: float = THRESHOLD) -> Column:
    """True when no recogniser matches; only existence matters, so the JVM regex suffices."""
    pattern = "|".join(f"(?:{unicode_ws(r.pattern)})" for r in recognizers if r.score >= threshold)
    return ~c.rlike(pattern) if pattern else F.lit(True)


def restore_pii(answers: DataFrame, mapping: DataFrame, request_id: str, text: str) -> DataFrame:
    """Placeholders back to originals, longest placeholder first. A request's mapping is bounded by its text."""
    entries = mapping.groupBy(request_id).agg(
        F.sort_array(
            F.collect_list(F.struct(F.length("placeholder").alias("n"), "placeholder", "original")), asc=False
        ).alias("_m")
    )
    joined = answers.join(entries, request_id, "left")
    restored = F.aggregate(
        F.coalesce("_m", F.array().cast("array<struct<n:int,placeholder:string,original:string>>")),
        F.col(text),
        lambda acc, e: F.replace(acc, e["placeholder"], e["original"]),
    )
    return joined.withColumn("restored", restored).drop("_m")
