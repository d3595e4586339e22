"""Transcript parsing: a hidden Markov model over speaker markers and line features, decoded by Viterbi.

Every line of a transcript is in one of six states, the begin or the inside of a turn of one of three roles. What is
seen of a line is its marker ("Human:", "AI>", none, ...), its length, whether a blank line stands before it and
whether it asks. Start, transition and emission chances are counted from transcripts whose roles are known.
The most likely states give the turns, which are rendered in one canonical form.

A long conversation is read in pieces of ``PART_TURNS`` turns, but decoded as one: each piece gives the best scores
from any state before it to any last state, these matrices are composed block by block, and the best path through
them gives every piece the state before it and its last state, between which its own lines are decoded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, join_stored, stored

ROLES = ("user", "assistant", "system")
STATES = 2 * len(ROLES)  # begin of role r: 2r, inside: 2r + 1
#: Turns of a piece, and pieces (or blocks of them) whose matrices are composed at a time.
PART_TURNS = 64
FAN = 64

_NAMES = (
    r"user|human|you|question|q|customer|client|prompt",
    r"assistant|ai|bot|answer|a|model|agent|response",
    r"system|sys|instructions?|context|setup",
)
_MARKS = tuple(re.compile(rf"^[\W_]{{0,4}}(?:{names})[\W_]{{0,3}}(?:[:>|]|\s-)[*_]{{0,2}}\s*", re.I) for names in _NAMES)
_OTHER = re.compile(r"^[\W_]{0,4}\w{1,16}[\W_]{0,3}[:>|]\s")
SYMBOLS = 5 * 3 * 2 * 2
#: What Python strips as white space, in a class of Java's regular expressions.
SPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def marker(line: str) -> tuple[int, int]:
    """Class of the line's marker (0 none, 1 to 3 a role's, 4 another's) and where the text begins."""
    for r, mark in enumerate(_MARKS):
        if found := mark.match(line):
            return r + 1, found.end()
    return (4, 0) if _OTHER.match(line) else (0, 0)


def symbol(line: str, blank_before: bool) -> int:
    length = 0 if len(line) < 60 else 1 if len(line) < 240 else 2
    return ((marker(line)[0] * 3 + length) * 2 + blank_before) * 2 + line.rstrip().endswith("?")


def spoken_lines(text: str | None, blank: bool = True) -> tuple[list[str], list[int], list[list[str]]]:
    """Lines that are not blank, their symbols, and the blank lines before each. ``blank``: whether a blank line stands
    before the text, as it does before the first line of a transcript."""
    lines, symbols, gaps = [], [], []
    gap: list[str] = []
    for line in (text or "").split("\n"):
        if line.strip():
            lines.append(line)
            symbols.append(symbol(line, bool(gap) or (blank and len(lines) == 1)))
            gaps.append(gap)
            gap = []
        else:
            gap.append(line)
    return lines, symbols, gaps


@dataclass
class Roles:
    """Log chances of the first state, of the next one, and of a symbol."""

    start: np.ndarray
    move: np.ndarray
    show: np.ndarray


def model_of(starts: Counter, moves: Counter, shows: Counter) -> Roles:
    """Chances from counts, one added to each. Inside states do not begin a transcript or follow another role."""
    start, move, show = np.ones(STATES), np.ones((STATES, STATES)), np.ones((STATES, SYMBOLS))
    for s, n in starts.items():
        start[s] += n
    for (s, t), n in moves.items():
        move[s, t] += n
    for (s, o), n in shows.items():
        show[s, o] += n
    inside = np.arange(STATES) % 2 == 1
    role = np.arange(STATES) // 2
    start[inside] = 0
    move[:, inside] *= role[:, None] == role[None, inside]
    with np.errstate(divide="ignore"):
        return Roles(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(show / show.sum(1, keepdims=True)))


def viterbi(symbols: list[int], model: Roles, first: int | None = None, last: int | None = None) -> list[int]:
    """Most likely states; of equal ones the lower state. ``first`` is the state before the symbols, ``last`` their last
    state, where these are known."""
    if not symbols:
        return []
    best = (model.start if first is None else model.move[first]) + model.show[:, symbols[0]]
    back = np.zeros((len(symbols), STATES), np.int8)
    for i, o in enumerate(symbols[1:], 1):
        ways = best[:, None] + model.move
        back[i] = ways.argmax(0)
        best = ways.max(0) + model.show[:, o]
    states = [int(best.argmax()) if last is None else last]
    for i in range(len(symbols) - 1, 0, -1):
        states.append(int(back[i, states[-1]]))
    return states[::-1]


def piece_scores(symbols: list[int], model: Roles, begins: bool) -> np.ndarray:
    """Best scores from each state before the piece (rows, all alike if it begins the transcript) to each last state."""
    best = np.tile(model.start, (STATES, 1)) if begins else model.move
    best = best + model.show[:, symbols[0]]
    for o in symbols[1:]:
        best = (best[:, :, None] + model.move).max(1) + model.show[:, o]
    return best


def best_ends(scores: list[np.ndarray], first: int | None, last: int | None) -> list[tuple[int, int]]:
    """The state before each piece and its last state, on the best path through all pieces."""
    best = np.zeros(STATES) if first is None else np.where(np.arange(STATES) == first, 0, -np.inf)
    back = []
    for m in scores:
        ways = best[:, None] + m
        back.append(ways.argmax(0))
        best = ways.max(0)
    out = []
    last = int(best.argmax()) if last is None else last
    for b in back[::-1]:
        out.append((int(b[last]), last))
        last = out[-1][0]
    return out[::-1]


def turns_of(
    text: str | None, model: Roles, first: int | None = None, last: int | None = None, blank: bool = True
) -> list[tuple[str, str]]:
    """Role and text of the turns of a transcript, markers taken off; blank lines stay within a turn. Of a piece (its
    ends known) whose first line is inside a turn, the first text continues the last one of the piece before."""
    lines, symbols, gaps = spoken_lines(text, blank)
    turns: list[tuple[str, list[str]]] = []
    for line, gap, s in zip(lines, gaps, viterbi(symbols, model, first, last)):
        kind, at = marker(line)
        said = line[at:] if s % 2 == 0 and kind == s // 2 + 1 else line
        if s % 2 == 0 or not turns:
            turns.append((ROLES[s // 2], []))
        else:
            turns[-1][1].extend(gap)
        turns[-1][1].append(said)
    return [(r, "\n".join(x).strip()) for r, x in turns]


def rendered(turns: list[tuple[str, str]], continued: bool = False, blank: bool = False) -> str:
    """Canonical form; that of a continued turn goes on where the piece before ended, so that the pieces' forms, one after
    the other, are the form of the whole."""
    heads = [f"<|{role}|>\n" for role, _ in turns]
    if continued:
        heads[0] = "\n" if blank else ""
    return "".join(f"{head}{text}\n" for head, (_, text) in zip(heads, turns))


def fit_roles(transcripts: DataFrame, text: str = "transcript", states: str = "states") -> Roles:
    """Count the chances from transcripts with known states of their lines that are not blank. Tasks add up their
    own counts; at most a few hundred sums reach the driver. Transcripts with null or other than as many states do
    not count; without any transcript all chances are even. ``before`` and ``blank``, if there, are the state before a
    piece (null if it begins a transcript) and whether a blank line stands before it."""
    before = F.col("before") if "before" in transcripts.columns else F.lit(None).cast("int")
    blank = F.col("blank") if "blank" in transcripts.columns else F.lit(True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t, known, ahead, gap in zip(*b.columns):
                symbols, known, ahead = spoken_lines(t.as_py(), gap.as_py())[1], known.as_py() or [], ahead.as_py()
                if not known or len(known) != len(symbols):
                    continue
                seen[("start", known[0], 0) if ahead is None else ("move", ahead, known[0])] += 1
                seen.update(("move", s, t) for s, t in zip(known, known[1:]))
                seen.update(("show", s, o) for s, o in zip(known, symbols))
        keys = list(seen)
        yield pa.RecordBatch.from_pydict({
            "what": pa.array([k[0] for k in keys], pa.string()), "a": pa.array([k[1] for k in keys], pa.int32()),
            "b": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array([seen[k] for k in keys], pa.int64()),
        })

    sums = transcripts.select(col(text), col(states), before, blank).mapInArrow(count, "what string, a int, b int, n long")
    got = sums.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    return model_of(
        Counter({r["a"]: r["n"] for r in got if r["what"] == "start"}),
        Counter({(r["a"], r["b"]): r["n"] for r in got if r["what"] == "move"}),
        Counter({(r["a"], r["b"]): r["n"] for r in got if r["what"] == "show"}),
    )


def parsed_transcripts(df: DataFrame, model: Roles, keys: list[str], text: str = "transcript", pieces: bool = False) -> DataFrame:
    """One row per input row: the keys, n_lines (not blank), n_turns, roles (of the turns), texts and rendered (the
    canonical form).

    No shuffle: a transcript is parsed by itself. A null, empty or blank transcript has no turns and renders as
    the empty text. Repeated rows pass through; other columns are not read; an empty table gives an empty result.
    With ``pieces``, rows have first, last (the states of ``piece_ends``) and blank as well; continued then says whether
    the first text goes on with the last turn of the piece before. n_turns counts the turns that begin in the row.
    """
    fitted = df.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    n = len(keys)

    def parsed(text: str | None, first: int | None, last: int | None, blank: bool):
        lines, symbols, gaps = spoken_lines(text, blank)
        goes_on = first is not None and bool(symbols) and viterbi(symbols, fitted.value, first, last)[0] % 2 == 1
        turns = turns_of(text, fitted.value, first, last, blank)
        gap = goes_on and (blank or bool(gaps[0]))
        return len(lines), len(turns) - goes_on, [r for r, _ in turns], [x for _, x in turns], rendered(turns, goes_on, gap), goes_on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parsed(*(x.as_py() for x in row)) for row in zip(*b.columns[n:])]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.bool_())
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], *made], names=[*keys, "n_lines", "n_turns", "roles", "texts", "rendered", "continued"]
            )

    none = F.lit(None).cast("int")
    ends = (F.col("first"), F.col("last"), F.col("blank")) if pieces else (none, none, F.lit(True))
    kinds = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    out = df.select(*map(col, keys), col(text), *ends).mapInArrow(
        run, f"{kinds}, n_lines long, n_turns long, roles array<string>, texts array<string>, rendered string, continued boolean"
    )
    return out if pieces else out.drop("continued")


def piece_ends(pieces: DataFrame, model: Roles) -> DataFrame:
    """(conv_id, part, first, last): the state before each piece of a long conversation and its last state, on the best
    path through the whole. ``pieces`` has the rows of such conversations.

    Matrices of up to ``FAN`` pieces are composed at a time, then those of as many blocks, until one block is a whole
    conversation; the way back gives the ends of the blocks, then of their pieces. No group is larger than ``FAN``.
    """
    fitted = pieces.sparkSession.sparkContext.broadcast(model)
    kind = dict(pieces.dtypes)["conv_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                piece_scores(spoken_lines(t.as_py(), gap.as_py())[1], fitted.value, k.as_py() == 0).ravel()
                for k, t, gap in zip(b.column(1), b.column(2), b.column(3))
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(found, pa.list_(pa.float64()))], names=["conv_id", "part", "m"]
            )

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ms in b.column(2):
                ms = [np.reshape(m, (STATES, STATES)) for m in ms.as_py()]
                all_ = ms[0]
                for m in ms[1:]:
                    all_ = (all_[:, :, None] + m).max(1)
                out.append(all_.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], names=["conv_id", "part", "m"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = []
            for ms, first, last in zip(b.column(2), b.column(4), b.column(5)):
                ms = [np.reshape(m, (STATES, STATES)) for m in ms.as_py()]
                ends.append([{"first": x, "last": y} for x, y in best_ends(ms, first.as_py(), last.as_py())])
            pair = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(ends, pair)], names=["conv_id", "parts", "ends"])

    def blocks_of(level: DataFrame) -> DataFrame:
        one = F.array_sort(F.collect_list(F.struct("part", "m")))
        made = level.groupBy("conv_id", F.floor(F.col("part") / FAN).alias("block")).agg(one.alias("t"))
        return stored(made.select("conv_id", F.col("block").alias("part"), F.col("t.m").alias("ms"), F.col("t.part").alias("parts")))

    level = pieces.select("conv_id", "part", "transcript", "blank").mapInArrow(score, f"conv_id {kind}, part long, m array<double>")
    levels = [blocks_of(level)]
    while not levels[-1].filter("part > 0").isEmpty():
        levels.append(blocks_of(levels[-1].select("conv_id", "part", "ms").mapInArrow(compose, f"conv_id {kind}, part long, m array<double>")))
    ends = None
    for blocks in levels[::-1]:
        if ends is None:
            known = blocks.withColumns({"first": F.lit(None).cast("int"), "last": F.lit(None).cast("int")})
        else:
            known = join_stored(blocks, ends, ["conv_id", "part"])
        found = known.select("conv_id", "part", "ms", "parts", "first", "last").mapInArrow(
            trace, f"conv_id {kind}, parts array<long>, ends array<struct<first:int,last:int>>"
        )
        found = found.select("conv_id", F.explode(F.arrays_zip("parts", "ends")).alias("e"))
        ends = stored(found.select("conv_id", F.col("e.parts").alias("part"), F.col("e.ends.first").alias("first"), F.col("e.ends.last").alias("last")))
    return ends


def _pick(h: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(h, F.lit(len(names))) + 1).cast("int"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the number of a row within its conversation by turn and ``order``, from 0. ``order`` tells the
    rows of a turn apart.

    One range shuffle by all of the order, so that a long conversation lies in many tasks; a task counts the rows of
    its conversations, and the counts of the tasks before are added where a conversation lies in several.
    """
    keys = ["conv_id", "turn", *order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("task", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for b in batches:
            out = np.empty(b.num_rows, np.int64)
            for i, c in enumerate(b.column("conv_id").to_pylist()):
                now, at = c, at + 1 if c == now else 1
                out[i] = at - 1
            yield b.append_column("at", pa.array(out))

    kinds = ", ".join(f"`{c}` {k}" for c, k in sorted_.dtypes)
    local = stored(sorted_.mapInArrow(count, f"{kinds}, at long"))
    counts = local.groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("conv_id", "task", F.sum("n").over(earlier).alias("offset")).filter("offset > 0"))
    return join_stored(local, offsets, ["conv_id", "task"]).withColumn("at", F.col("at") + F.coalesce("offset", F.lit(0))).drop("task", "offset")


def raw_transcripts(turns: DataFrame) -> DataFrame:
    """Flat transcripts of known turns (conv_id, turn, role, text), as logs hold them: markers of many forms, none
    before every fifth turn, blank lines between most. Returns conv_id, part, alone, transcript, states (of the lines
    that are not blank), known (the roles of the turns with a text), before (the last state of the part before, else
    null) and blank (whether a blank line stands before the part).

    A conversation is cut into parts of 64 rows by turn, numbered from 0, however many rows a turn has; one of up to 64
    is a single part. Rows without conversation or turn stand alone, each a transcript of its own with its hash as
    part. Repeated rows count once. Turns without text, or of white space, leave no line; blank lines within a text
    stay. A role that is null or unknown reads as the user's.
    """
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("alone", F.col("conv_id").isNull() | F.col("turn").isNull())
    h = F.xxhash64("conv_id", "turn")
    role = F.when(F.col("role").isin(list(ROLES)), F.col("role")).otherwise(F.lit(ROLES[0]))
    label = F.when(role == "user", _pick(h, ("User", "Human", "USER", "Q", "**You")))
    label = label.when(role == "assistant", _pick(h, ("Assistant", "AI", "ASSISTANT", "A", "**Bot")))
    label = label.otherwise(_pick(h, ("System", "SYSTEM", "### Instructions")))
    mark = F.when(F.pmod(F.shiftright(h, 8), F.lit(5)) == 0, F.lit("")).otherwise(F.concat(label, _pick(F.shiftright(h, 16), (": ", "> ", " - ", ": "))))
    # Blank lines at the ends of a text are not told from those between turns.
    inner = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), rf"\A[{SPACE}]*\n", ""), rf"\n[{SPACE}]*+\z", "")
    code = sum((F.when(role == r, i).otherwise(0) for i, r in enumerate(ROLES)), F.lit(0)) * 2
    spoken = F.size(F.filter(F.split("inner", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    gap = F.when(F.pmod(F.shiftright(F.col("h"), 24), F.lit(8)) == 0, F.lit("\n")).otherwise(F.lit("\n\n"))
    states = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (F.col("code") + F.when(i > 0, 1).otherwise(0)).cast("int"))
    rows = rows.select(
        "conv_id", "turn", "alone", F.xxhash64("turn", "role", "text").alias("hash"), role.alias("role"),
        mark.alias("mark"), inner.alias("inner"), code.alias("code"), h.alias("h"),
    ).withColumn("n", spoken).filter("n > 0")
    kept = rows.select("conv_id", "turn", "alone", "hash", "role", F.concat("mark", "inner").alias("said"), gap.alias("gap"), states.alias("states"))
    single = kept.filter("alone").withColumns({"part": F.col("hash"), "at": F.lit(0).cast("long"), "lead": F.lit(False)})
    many = numbered(kept.filter(~F.col("alone")), ["hash", "role", "said"])
    # The last row of a part goes to the next part as well, which needs its state and gap.
    part = F.floor(F.col("at") / PART_TURNS)
    places = F.array(F.struct(part.alias("part"), F.lit(False).alias("lead")), F.struct((part + 1).alias("part"), F.lit(True).alias("lead")))
    places = F.when(F.col("at") % PART_TURNS == PART_TURNS - 1, places).otherwise(F.slice(places, 1, 1))
    many = many.withColumn("p", F.explode(places)).withColumns({"part": F.col("p.part"), "lead": F.col("p.lead")})
    names = ["conv_id", "alone", "part", "lead", "at", "said", "gap", "states", "role"]
    both = many.select(names).unionAll(single.select(names))
    own = F.when(~F.col("lead"), F.struct("at", F.concat("said", "gap").alias("said"), "states", "role"))
    ahead = F.when(F.col("lead"), F.struct(F.element_at("states", -1).alias("before"), (F.col("gap") == "\n\n").alias("blank")))
    made = both.groupBy("conv_id", "alone", "part").agg(F.array_sort(F.collect_list(own)).alias("t"), F.first(ahead, True).alias("ahead"))
    return made.filter(F.size("t") > 0).select(
        "conv_id", "part", "alone", F.array_join(F.col("t.said"), "").alias("transcript"), F.flatten(F.col("t.states")).alias("states"),
        F.col("t.role").alias("known"), F.col("ahead.before").alias("before"), F.coalesce("ahead.blank", F.lit(True)).alias("blank"),
    )


def parsed_conversations(turns: DataFrame) -> DataFrame:
    """Transcripts of the conversations, parsed by a model counted on those that are not held out (crc32 of the
    conversation's id as text leaves 1 on division by 3).

    A conversation of up to 64 turns is one row; a longer one is as many rows, ordered by part, of one decoding."""
    raw = stored(raw_transcripts(turns))
    held = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit_roles(raw.filter(~held))
    keys = ["conv_id", "part", "known", "held_out"]
    raw = raw.withColumn("held_out", held)
    long = stored(raw.filter("part > 0 and not alone").select("conv_id").distinct())
    ends = piece_ends(join_stored(raw.filter("not alone"), long, ["conv_id"], "left_semi"), model)
    ends = ends.withColumns({"alone": F.lit(False), "first": F.when(F.col("part") > 0, F.col("first"))})
    return parsed_transcripts(join_stored(raw, ends, ["conv_id", "part", "alone"]), model, keys, pieces=True)
