"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of its whole text is encoded, gated attention learned from document
labels alone weighs the passages, and the weighted passage representation is scored. Training takes a bounded
sample of labelled documents (``Training.sample``); scoring runs over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import bounded_batches
from .common import col, parts_of, stored

PASSAGE = 64

# Byte classes whose shares in a passage are features.
_GROUPS = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!", b"?", b":;", b"'\"`",
    b"()[]{}", b"-_/\\", b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"@=+~^", b"\n",
)
_CLASS = np.full(256, len(_GROUPS), np.uint8)
_CLASS[128:] = len(_GROUPS) + 1
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASSES = len(_GROUPS) + 2
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
FEATURES = _CLASSES + 7
_MIX = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
_SALT = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)


#: Bytes that are encoded at a time: measuring takes some forty times as much memory.
SLICE_BYTES = 1 << 20


def slices(data: bytes) -> list[bytes]:
    """A text in pieces of whole passages, of about ``SLICE_BYTES`` (a single longer passage is not cut)."""
    if len(data) <= SLICE_BYTES:
        return [data]
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    first = np.flatnonzero(~blank & np.append(True, blank[:-1]))[::PASSAGE]
    if not len(first):
        return [data[:1]]  # without words a text is one empty passage
    cuts = first[np.unique(np.searchsorted(first, np.arange(SLICE_BYTES, len(data), SLICE_BYTES)).clip(0, len(first) - 1))]
    cuts = [0, *(int(c) for c in cuts if c > first[0]), len(data)]
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages of the texts, and the first passage of each text. Texts are measured in groups and a
    long one in slices of bounded size; the result is the same."""
    found, bag, n = [], [], 0
    group: list[bytes] = []

    def measure() -> None:
        nonlocal n
        if group:
            x, starts = _encoded(group)
            found.append(x)
            bag.extend(starts + n)
            n += len(x)
            group.clear()

    size = 0
    for t in texts:
        data = t.encode()
        if size + len(data) > SLICE_BYTES:
            measure()
            size = 0
        if len(data) > SLICE_BYTES:
            bag.append(n)
            for piece in slices(data):
                x, _ = _encoded([piece])
                found.append(x)
                n += len(x)
        else:
            group.append(data)
            size += len(data)
    measure()
    return np.concatenate([np.zeros((0, FEATURES), np.float32), *found]), np.array(bag, np.int64)


def _encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages of the texts, and the first passage of each text.

    A passage is 64 words in a row, the last one of a text may be shorter; a text without words is one passage of
    zeros. All passages of the batch are measured at once over its bytes.
    """
    data = [t + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum([len(x) for x in data])
    starts = ends - [len(x) for x in data]
    blank = _BLANK[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    begin = np.flatnonzero(first)  # a word never runs over a text's end: each ends with a blank
    words_before = np.searchsorted(begin, starts)
    n_words = np.append(words_before[1:], len(begin)) - words_before
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    bag = np.cumsum(n_passages) - n_passages
    out = np.zeros((int(n_passages.sum()), FEATURES), np.float32)
    if not len(begin):
        return out, bag
    text_of = np.repeat(np.arange(len(texts)), n_words)
    rank = np.arange(len(begin)) - words_before[text_of]
    passage = bag[text_of] + rank // PASSAGE
    edge = np.flatnonzero(np.diff(passage, prepend=-1))
    which = passage[edge]
    count = np.diff(np.append(edge, len(begin)))
    stop = np.flatnonzero(blank & ~np.append(True, blank[:-1]))
    if len(stop) < len(begin):
        stop = np.append(stop, len(raw))
    length = (stop - begin).astype(np.float64)
    # Bytes of a passage run from its first word to the next passage's; the blanks that end a text and those
    # before its first word (all of a text without words) are no passage's.
    low = begin[edge]
    first_word = np.where(n_words > 0, begin[np.minimum(words_before, len(begin) - 1)], ends)
    outer = np.zeros(len(raw) + 1, np.int32)
    np.add.at(outer, starts, 1)
    np.add.at(outer, first_word, -1)
    kinds = np.where(np.cumsum(outer[:-1]) > 0, np.uint8(255), _CLASS[raw])
    kinds[ends - 1] = 255
    size = np.maximum(1, np.add.reduceat(kinds != 255, low, dtype=np.int64))
    for k in range(_CLASSES):
        sums = np.add.reduceat(kinds == k, low, dtype=np.int64)
        out[which, k] = sums / size
    # Words by hash: a salted value of each byte times its place in the word, summed.
    inside = np.flatnonzero(~blank)
    place = np.arange(len(raw))[inside] - np.repeat(begin, length.astype(np.int64))
    codes = np.zeros(len(raw), np.uint64)
    codes[inside] = _SALT[raw[inside]] * _MIX[place & 63]
    word = np.add.reduceat(codes, begin)
    same = np.append(False, word[1:] == word[:-1]) & (rank % PASSAGE != 0)
    order = np.lexsort((word, passage))
    fresh = np.append(True, (word[order][1:] != word[order][:-1]) | (passage[order][1:] != passage[order][:-1]))
    distinct = np.add.reduceat(fresh, edge, dtype=np.int64)  # passages keep their places in the order
    capital = (raw[begin] >= 65) & (raw[begin] <= 90)
    mean = np.add.reduceat(length, edge) / count
    at = _CLASSES
    out[which, at] = np.log1p(count) / 4
    out[which, at + 1] = mean / 10
    out[which, at + 2] = np.sqrt(np.maximum(0, np.add.reduceat(length**2, edge) / count - mean**2)) / 10
    out[which, at + 3] = distinct / count
    out[which, at + 4] = np.add.reduceat(same, edge, dtype=np.int64) / count
    out[which, at + 5] = np.add.reduceat(capital, edge, dtype=np.int64) / count
    out[which, at + 6] = 1
    return out, bag


@dataclass(frozen=True)
class Training:
    """``sample``: most labelled documents that training reads, those with the smallest hash of their id. ``bytes``:
    most bytes of a training text (a longer one is left out of the sample, never cut), so that the driver holds 210 MB of
    passages at most."""

    sample: int = 6000
    bytes: int = 1 << 17
    hidden: int = 24
    gate: int = 12
    steps: int = 400
    batch: int = 256
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["a"]
        n = np.diff(np.append(bag, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bag), n))
        att = e / np.repeat(np.add.reduceat(e, bag), n)
        z = np.add.reduceat(att[:, None] * h, bag)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return {"h": h, "t": t, "s": s, "att": att, "z": z, "p": p, "n": n}

    def score(self, texts: list[str]) -> np.ndarray:
        x, bag = passages(texts)
        return self.forward((x - self.mean) / self.scale, bag)["p"].astype(np.float64)


def gradients(w: dict[str, np.ndarray], f: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, err: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the loss whose derivative by each bag's logit is ``err``."""
    h, t, s, att = f["h"], f["t"], f["s"], f["att"]
    dz = np.repeat(err[:, None] * w["c"][None, :], f["n"], axis=0)
    datt = (dz * h).sum(1)
    mean = np.repeat(np.add.reduceat(att * datt, bag), f["n"])
    de = att * (datt - mean)
    dts = de[:, None] * w["a"][None, :]
    dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
    dh = att[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T
    dpre = dh * (1 - h**2)
    return {
        "W": x.T @ dpre, "b": dpre.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": ((t * s) * de[:, None]).sum(0),
        "c": f["z"].T @ err, "d": np.array([err.sum()]),
    }


def train(bags: list[np.ndarray], labels: np.ndarray, options: Training = Training()) -> Model:
    """Fit encoder, attention and scorer together by Adam, both labels weighing the same. Without both labels the
    model scores every text with the share of label 1 (one half if there are none)."""
    rng = np.random.default_rng(options.seed)
    d, k, g = FEATURES, options.hidden, options.gate
    shape = {"W": (d, k), "b": (k,), "V": (k, g), "U": (k, g), "a": (g,), "c": (k,), "d": (1,)}
    w = {n: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or n in "ac" else np.zeros(s)).astype(np.float32) for n, s in shape.items()}
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        w["c"][:] = 0
        w["d"][:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return Model(np.zeros(d, np.float32), np.ones(d, np.float32), w)
    every = np.concatenate(bags)
    model = Model(every.mean(0), np.maximum(every.std(0), 1e-2).astype(np.float32), w)
    bags = [(x - model.mean) / model.scale for x in bags]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m = {n: np.zeros_like(v) for n, v in w.items()}
    v = {n: np.zeros_like(x) for n, x in w.items()}
    for step in range(1, options.steps + 1):
        some = rng.choice(len(bags), min(options.batch, len(bags)), replace=False)
        x = np.concatenate([bags[i] for i in some])
        n = np.array([len(bags[i]) for i in some])
        bag = np.cumsum(n) - n
        f = model.forward(x, bag)
        err = ((f["p"] - y[some]) * weight[some] / len(some)).astype(np.float32)
        rate = options.rate * (1 - 0.9 * step / options.steps)
        for name, grad in gradients(w, f, x, bag, err).items():
            m[name] = 0.9 * m[name] + 0.1 * grad
            v[name] = 0.999 * v[name] + 0.001 * grad**2
            move = m[name] / (1 - 0.9**step) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
            w[name] -= (rate * (move + options.decay * w[name])).astype(np.float32)
    return model


def held_out(id: str):
    """Whether a row's label is never learned: crc32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(col(id).cast("string")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", options: Training = Training()) -> Model:
    """Train on a bounded sample of labelled rows that are not held out. Rows with a null id or label do not count;
    an id with several labels counts with its least one."""
    marks = labels.filter(col(id).isNotNull() & col(label).isNotNull() & ~held_out(id))
    marks = marks.groupBy(col(id).alias("_id")).agg(F.min(label).cast("int").alias("_y"))
    rows = df.select(col(id).alias("_id"), col(text).alias("_text"))
    rows = rows.filter(F.coalesce(F.octet_length("_text"), F.lit(0)) <= options.bytes)
    # A stored table, as so many ids in an expression take several times as much memory in every plan of the driver.
    few = stored(rows.join(marks, "_id").select("_id", "_y").distinct().orderBy(F.xxhash64("_id"), "_id").limit(options.sample))
    rows = rows.join(F.broadcast(few), "_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts_of(b.column(1)):
                x, bag = passages([t for _, t in part])
                cut = np.append(bag, len(x))
                made = [x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]
                at = [i for i, _ in part]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), pa.array(made, pa.binary())], names=["_id", "_y", "x"])

    kind = dict(df.dtypes)[id]
    made = bounded_batches(rows.select("_id", "_text", "_y")).mapInArrow(encode, f"_id {kind}, _y int, x binary").toArrow()
    one: dict = {}
    for i, y, x in sorted(zip(*(c.to_pylist() for c in made.columns))):
        one.setdefault(i, (x, y))
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x, _ in one.values()]
    return train(bags, np.array([y for _, y in one.values()]), options)


def quality_scores(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1) and predicted (1 from a score of 0.5 on).

    A null or empty text is a bag of one empty passage and gets a score like any other. A null id is not held
    out. Only the text is an input of a score, so equal texts score the same. Repeated rows pass through; other
    columns are not read; an empty table gives an empty result.
    """
    rows = df.select(col(id).alias("doc_id"), held_out(id).alias("held_out"), col(text).alias("text"))
    kind = dict(df.dtypes)[id]
    fitted = df.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [fitted.value.score([t for _, t in part]) for part in parts_of(b.column(2))]
            p = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return bounded_batches(rows).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def good_documents(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text scores 0.5 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [fitted.value.score([t for _, t in part]) for part in parts_of(b.column(b.schema.get_field_index(text)))]
            yield b.filter(pa.array(np.concatenate(score) >= 0.5)) if score else b

    fitted = df.sparkSession.sparkContext.broadcast(model)
    return bounded_batches(df).mapInArrow(run, df.schema)
