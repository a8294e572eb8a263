"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines, then turns are rendered alike.

Hidden states are role x (begins a turn, goes on).  A line is seen as its speaker marker's class, whether a blank line or
the transcript's start precedes it, and its length class.  Probabilities are counted with add-one smoothing from a bounded
sample of transcripts whose roles are known; the Viterbi path is exact.  Transcripts are sorted into range partitions by
(conversation, turn), so a conversation of any length is spread over tasks: a piece that touches a partition's edge is
first reduced to its max-plus matrix, the pieces' ends are settled from those (two small rows a partition), and each
piece is then decoded between known states.  Inside a task long pieces are cut into blocks in the same way, so that many
sequences of bounded length are decoded at once, a step at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hash_share, partitions
from .training import first_rows

ROLES = ("system", "user", "assistant")
#: Turns that the model's counts are taken from at most, and the bytes of text after which no further one is taken.
SAMPLE_TURNS, SAMPLE_BYTES = 10_000, 8 << 20
#: One in so many conversations (by a hash of the id) is never counted, so that accuracy can be measured on them.
HELD_OUT = 5
#: Lines of a block, and text bytes that a range partition should hold.
BLOCK, PARTITION_BYTES = 256, 32 << 20
# Speaker markers by role, one of each style.
MARKERS = {
    "system": ("System:", "Instructions:", "### System", "Context:"),
    "user": ("User:", "Human:", "### User", "Q:"),
    "assistant": ("Assistant:", "AI:", "### Assistant", "A:"),
}
_CLASS = {m.lower().rstrip(":"): 1 + ROLES.index(role) for role, own in MARKERS.items() for m in own}
_MARKER = re.compile(r"\s*(" + "|".join(sorted(map(re.escape, _CLASS), key=len, reverse=True)) + r")\s*(?::|$)\s*", re.IGNORECASE)
_LENGTHS = (1, 60, 160)
OBSERVATIONS = 4 * 2 * (len(_LENGTHS) + 1)


def transcript(turns: DataFrame, unmarked: int = 5) -> DataFrame:
    """(conv_id, turn, role, raw): recorded turns as a plain transcript, in one marker style per conversation.

    A turn is preceded by a blank line; one in ``unmarked`` (by a hash) lacks its marker, as in careless transcripts."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int") + 1
    marker = F.lit("")
    for role, own in MARKERS.items():
        marker = F.when(F.col("role") == role, F.element_at(F.array(*map(F.lit, own)), style)).otherwise(marker)
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit(1)), F.lit(unmarked)) == 0
    sep = F.when(marker.startswith("#"), F.lit("\n")).otherwise(F.lit(" "))
    text = F.coalesce("text", F.lit(""))
    raw = F.when(bare | (marker == ""), text).otherwise(F.concat(marker, sep, text))
    return turns.select("conv_id", "turn", "role", F.concat(F.lit("\n"), raw).alias("raw"))


def observe(lines: list[str], opens: bool | np.ndarray) -> np.ndarray:
    """Codes of lines.  ``opens``: a blank line, or nothing, is before the first; or an array that tells for each line
    1 or 0, and -1 where the line before it tells."""
    kind = np.fromiter((_CLASS[m.group(1).lower()] if (m := _MARKER.match(line)) else 0 for line in lines), dtype=np.int64, count=len(lines))
    size = np.fromiter((len(line.strip()) for line in lines), dtype=np.int64, count=len(lines))
    after = np.concatenate([[0], size[:-1] == 0]).astype(np.int64)
    if isinstance(opens, np.ndarray):
        after = np.where(opens < 0, after, opens)
    elif len(lines):
        after[0] = opens
    return (kind * 2 + after) * (len(_LENGTHS) + 1) + np.searchsorted(_LENGTHS, size, "right")


def held_out(column: str = "conv_id") -> Column:
    return F.pmod(F.xxhash64(F.lit(HELD_OUT), column), F.lit(HELD_OUT)) == 0


class _Steps:
    """Sequences put end to end, walked a step at a time: the longest first, so that those still running are a prefix."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        self.order = np.argsort(-sizes, kind="stable")
        self.first = (np.cumsum(sizes) - sizes)[self.order]
        self.running = np.searchsorted(-sizes[self.order], -np.arange(int(sizes.max(initial=0))), side="left")


class Model:
    """Logarithms of start, transition and emission probabilities; state = 2 * role + (0 begins, 1 goes on)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), np.log(emit / emit.sum(axis=1, keepdims=True))

    def transfers(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best scores of each sequence from the state before it (rows; the last row is a transcript's start) to its end."""
        steps, emit = _Steps(sizes), self.emit.T
        score = np.concatenate([self.move, self.start[None]])[None] + emit[codes[steps.first]][:, None, :]
        for t, n in enumerate(steps.running[1:], 1):
            score[:n] = (score[:n, :, :, None] + self.move).max(axis=2) + emit[codes[steps.first[:n] + t]][:, None, :]
        out = np.empty_like(score)
        out[steps.order] = score
        return out

    def transfer(self, codes: list[int]) -> np.ndarray:
        return self.transfers(np.asarray(codes), np.array([len(codes)]))[0]

    def paths(self, codes: np.ndarray, sizes: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The Viterbi paths of all sequences, end to end: each after the state ``before`` (-1: a start) and up to the state
        ``last`` (-1: any).  Ties: the lower state.  Sequences of more than ``BLOCK`` lines are cut."""
        blocks = -(-sizes // BLOCK)
        if blocks.max(initial=0) > 1:
            starts, own = np.cumsum(blocks) - blocks, np.repeat(np.arange(len(sizes)), blocks)
            inner = np.arange(len(own)) - starts[own]
            cut = np.minimum(BLOCK, sizes[own] - inner * BLOCK)
            enters, ends = np.full(len(own), -1), np.full(len(own), -1)
            enters[starts], ends[starts + blocks - 1] = before, last
            long = np.flatnonzero(blocks[own] > 1)
            wanted = np.repeat(blocks > 1, sizes)
            matrices = dict(zip(long.tolist(), self.transfers(codes[wanted], cut[long])))
            for k in np.flatnonzero(blocks > 1).tolist():
                run = range(starts[k], starts[k] + blocks[k])
                for at, (a, b) in zip(run, settle([matrices[j] for j in run], before[k], last[k])):
                    enters[at], ends[at] = a, b
            sizes, before, last = cut, enters, ends
        steps, emit = _Steps(sizes), self.emit.T
        own, back = before[steps.order], []
        score = np.where((own < 0)[:, None], self.start, self.move[own]) + emit[codes[steps.first]]
        for t, n in enumerate(steps.running[1:], 1):
            step = score[:n, :, None] + self.move
            back.append(step.argmax(axis=1).astype(np.int8))
            score[:n] = step.max(axis=1) + emit[codes[steps.first[:n] + t]]
        state = np.where(last[steps.order] < 0, score.argmax(axis=1), last[steps.order])
        path = np.empty(len(codes), dtype=np.int8)
        for t in reversed(range(len(steps.running))):
            n = steps.running[t]
            path[steps.first[:n] + t] = state[:n]
            if t:
                state[:n] = back[t - 1][np.arange(n), state[:n]]
        return path

    def decode(self, codes: list[int], before: int | None = None, last: int | None = None) -> list[int]:
        """The path of one sequence."""
        return self.paths(np.asarray(codes), np.array([len(codes)]), np.array([-1 if before is None else before]), np.array([-1 if last is None else last])).tolist()


def settle(matrices: list[np.ndarray], before: int = -1, last: int = -1) -> list[tuple[int, int]]:
    """(state before, last state) of each piece of one sequence, from the pieces' transfer matrices."""
    scores = [matrices[0][before]]  # -1 is a start's row
    for m in matrices[1:]:
        scores.append((scores[-1][:, None] + m[:-1]).max(axis=0))
    state, out = int(scores[-1].argmax()) if last < 0 else int(last), []
    for k in reversed(range(len(matrices))):
        enters = int((scores[k - 1] + matrices[k][:-1, state]).argmax()) if k else int(before)
        out.append((enters, state))
        state = enters
    return out[::-1]


def count(rows: list) -> Model:
    """Counts over turns (conv_id, role, raw) in order, conversation by conversation."""
    n = 2 * len(ROLES)
    start, move, emit = np.ones(n), np.ones((n, n)), np.ones((n, OBSERVATIONS))
    conversation, before, blank = None, None, True
    for r in rows:
        if r["conv_id"] != conversation:
            conversation, before, blank = r["conv_id"], None, True
        lines, begun = r["raw"].split("\n"), False
        for line, code in zip(lines, observe(lines, blank).tolist()):
            role = ROLES.index(r["role"])
            if not line.strip() and not begun:  # the blank line before a turn belongs to the turn before it
                state = before // 2 * 2 + 1 if before is not None else 2 * role + 1
            else:
                state, begun = 2 * role + begun, True
            if before is None:
                start[state] += 1
            else:
                move[before, state] += 1
            emit[state, code] += 1
            before, blank = state, not line.strip()
    return Model(start, move, emit)


def train(known: DataFrame) -> Model:
    """Counts over at most ``SAMPLE_TURNS`` turns (conv_id, turn, role, raw), by a hash of the conversation's id.

    Conversations are whole but for the one at the bound.  Those that ``held_out`` names, null ids and other roles are left
    out; without turns every probability is even."""
    rows = known.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & F.col("raw").isNotNull() & ~held_out())
    rows = hash_share(rows.select("conv_id", "turn", "role", "raw"), ["conv_id"], 3 * SAMPLE_TURNS, rows.count())
    return count(first_rows(rows, [F.xxhash64("conv_id"), "conv_id", "turn", "raw", "role"], SAMPLE_TURNS, SAMPLE_BYTES, "raw"))


def render(lines: list[str], states: list[int], roles: list[str]) -> str:
    """Lines with ``<|role|>`` before each that begins a turn; markers and blank lines around turns go."""
    out: list[str] = []
    for line, s in zip(lines, states):
        if s % 2 == 0:
            roles.append(ROLES[s // 2])
            out.append(f"<|{ROLES[s // 2]}|>")
            line = _MARKER.sub("", line, count=1) if _MARKER.match(line) else line
        out.append(line)
    return "\n".join(out).strip("\n")


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows, cut so that no conversation of the partition is in two frames."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        key = frame["key"].to_numpy()
        edges = np.flatnonzero(key[1:] != key[:-1])
        cut = int(edges[-1]) + 1 if len(edges) else 0
        if cut == 0 and held and held[-1]["key"].iloc[-1] == key[0]:
            held.append(frame)
            continue
        if held or cut:
            yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
        held = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


class _Lines:
    """The lines of a frame of whole pieces: of each row ``n_lines``, and of each piece its first row and its size in lines."""

    def __init__(self, frame: pd.DataFrame):
        own = [raw.split("\n") for raw in frame["raw"]]
        self.n_lines = np.array([len(x) for x in own], dtype=np.int64)
        self.lines = [line for x in own for line in x]
        key = frame["key"].to_numpy()
        self.piece = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.concatenate([[0], np.cumsum(self.n_lines)])
        self.bounds = ends[np.append(self.piece, len(frame))]
        self.sizes = np.diff(self.bounds)

    def codes(self, opens: np.ndarray) -> np.ndarray:
        """``opens``: for each piece, whether a blank line or nothing is before it."""
        mark = np.full(len(self.lines), -1)
        mark[self.bounds[:-1]] = opens
        return observe(self.lines, mark)


def format_chats(transcripts: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn, n_lines, roles, rendered) for every row of ``transcripts`` (conv_id, turn, raw), in any order.

    A conversation's rows by (turn, raw) are one transcript.  roles: those of the turns that begin in the row, by comma.
    Null raw counts as an empty line; null conversation ids form one transcript, null turns come first; rows that repeat
    a turn are all kept.  Extra columns are not read.  An empty table gives an empty result.  A conversation of any length
    is spread over range partitions of about ``PARTITION_BYTES``, repeated rows included; a task holds one partition's
    part of a conversation at most."""
    spark = transcripts.sparkSession
    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("raw", F.lit("")).alias("raw"))
    size = rows.agg(F.sum(F.octet_length("raw") + 32)).head()[0] or 0
    # the last column only parts rows that are equal in all others
    rows = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("copy", F.monotonically_increasing_id())
    order = ["key", F.col("turn").asc_nulls_first(), F.xxhash64("raw"), "raw", "copy"]
    dealt = rows.repartitionByRange(max(partitions(rows), -(-size // PARTITION_BYTES)), "key", F.col("turn").asc_nulls_first(), F.xxhash64("raw"), "copy")
    rows = checkpoint(dealt.sortWithinPartitions(*order).drop("copy")).withColumn("part", F.spark_partition_id())
    n = len(model.start)

    def edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for frame in _whole(frames):
            own = _Lines(frame)
            for k in sorted({0, len(own.sizes) - 1}):  # of all frames' pieces the first and the last are kept
                lines = own.lines[own.bounds[k] : own.bounds[k + 1]]
                on, fresh = (model.transfer(observe(lines, after)) for after in (False, True))  # what is before decides one code
                found = [*found[:1], (int(frame["part"].iloc[0]), frame["key"].iloc[own.piece[k]], not lines[-1].strip(), np.concatenate([on[:-1], fresh]))]
        for place, (part, key, blank, m) in enumerate(found):
            yield pd.DataFrame({"part": [part], "place": [place], "key": [key], "blank": [blank], "m": [m.ravel().tolist()]})

    pieces = sorted(rows.mapInPandas(edges, "part int, place int, key string, blank boolean, m array<double>").collect(), key=lambda r: (r["part"], r["place"]))
    settled: dict[tuple[int, str], tuple[int, int, bool]] = {}
    chain: list = []
    for r in [*pieces, None]:
        if chain and (r is None or chain[-1]["key"] != r["key"] or chain[-1]["part"] == r["part"]):
            opens = [True] + [c["blank"] for c in chain[:-1]]
            matrices = [np.array(c["m"]).reshape(2 * n + 1, n)[n * after : n * after + n + 1] for c, after in zip(chain, opens)]
            settled |= {(c["part"], c["key"]): (*states, after) for c, states, after in zip(chain, settle(matrices), opens)}
            chain = []
        chain.append(r)
    ends = spark.sparkContext.broadcast(settled)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole(frames):
            own, keys, part = _Lines(frame), frame["key"].to_numpy(), int(frame["part"].iloc[0])
            before, last, opens = (np.array(x, dtype=np.int64) for x in zip(*(ends.value.get((part, keys[k]), (-1, -1, True)) for k in own.piece)))
            states = model.paths(own.codes(opens), own.sizes, before, last).tolist()
            at, roles, out = 0, [], []
            for size in own.n_lines.tolist():
                found: list[str] = []
                out.append(render(own.lines[at : at + size], states[at : at + size], found))
                roles.append(",".join(found))
                at += size
            yield frame[["conv_id", "turn"]].assign(n_lines=own.n_lines, roles=roles, rendered=out)

    return rows.mapInPandas(decode, "conv_id long, turn long, n_lines long, roles string, rendered string")


def report(conversations: DataFrame) -> DataFrame:
    """Recorded conversations as plain transcripts, formatted again; the model is counted from a sample of them.

    Every row of ``conversations`` (conv_id, turn, role, text) gives one row; a null text is an empty one, a role that is
    not known has no marker.  See ``format_chats`` for nulls, ties, repeated rows, long conversations and empty tables."""
    raw = transcript(conversations)
    return format_chats(raw, train(raw))
