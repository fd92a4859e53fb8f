"""Chat formatting by columnar byte assembly.

Turns are dealt by conversation and sorted by turn. For each slice of rows the
lengths of all segments (header, content, tail) are known from Arrow's own
offsets; their cumulative sums say where each lands, and numpy scatters headers,
contents and tails into one preallocated buffer that becomes the Arrow column.

Template of a turn, both strings being control strings:

    ### <role>:\n<text></turn>\n

In texts and roles a backslash is doubled and each control string ("### ",
"</turn>", in roles also ":") gets a backslash before it, so no text holds an
unescaped control string, and dropping one backslash of each pair reads it back.

A conversation's output is cut into parts at slice ends, so neither a very long
conversation nor a very long text has to lie in memory whole beside others; the
reader takes the parts in order and keeps running digests only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import text_or_empty

HEAD, COLON, TAIL = "### ", ":\n", "</turn>\n"
LOSS_ROLE = "assistant"
#: Rows and bytes of text that are assembled at once.
SLICE_ROWS, SLICE_BYTES = 4096, 1 << 21

PARTS_SCHEMA = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("### ", "\\### ").replace("</turn>", "\\</turn>")


def escape_role(s: str) -> str:
    return escape(s).replace(":", "\\:")


def unescape(s: str) -> str:
    return re.sub(r"\\([\\#<:])", r"\1", s) if "\\" in s else s


def _buffers(column: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a list of strings, and their 64-bit offsets."""
    arr = pa.array(column, pa.large_string())
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64, len(arr) + 1)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy the strings of a column to the places `at` of out, by one index array."""
    lengths = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], lengths) + np.arange(offsets[0], offsets[-1])] = data[offsets[0] : offsets[-1]]


def assemble(roles: list[str], texts: list[str], starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted string of each run of turns, and each turn's content as bytes [start, end) in its run's string.

    starts: the first row of each run.
    """
    heads = _buffers([f"{HEAD}{escape_role(r)}{COLON}" for r in roles])
    bodies = _buffers([escape(t) for t in texts])
    tails = _buffers([TAIL] * len(texts))
    lengths = [np.diff(x[1]) for x in (heads, bodies, tails)]
    ends = np.cumsum(sum(lengths))
    begin = ends - sum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    place = begin.copy()
    for (data, offsets), length in zip((heads, bodies, tails), lengths, strict=True):
        _scatter(out, place, data, offsets)
        place = place + length
    bounds = np.append(begin[starts], len(out)).astype(np.int64)
    runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(out))
    base = np.repeat(begin[starts], np.diff(np.append(starts, len(texts))))
    inner = begin + lengths[0] - base
    return runs, inner, inner + lengths[1]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :])
        lo = 0
        total = np.cumsum(sizes)
        while lo < len(texts):
            base = total[lo - 1] if lo else 0
            hi = min(lo + SLICE_ROWS, max(lo + 1, int(np.searchsorted(total, base + SLICE_BYTES, "right"))))
            part = batch.slice(lo, hi - lo)
            yield part.column("conv_id").to_pylist(), part.column("role").to_pylist(), part.column("text").to_pylist()
            lo = hi


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before: object = ()
    part = 0
    for convs, roles, texts in _slices(batches):
        starts = np.array([i for i, c in enumerate(convs) if not i or c != convs[i - 1]], np.int64)
        runs, begins, ends = assemble(roles, texts, starts)
        parts, masks, counts = [], [], []
        for lo, hi in zip(starts, [*starts[1:], len(convs)], strict=True):
            part = part + 1 if convs[lo] == before and lo == 0 else 0
            parts.append(part)
            masks.append([{"start": int(begins[i]), "end": int(ends[i])} for i in range(lo, hi) if roles[i] == LOSS_ROLE])
            counts.append(int(hi - lo))
        before = convs[-1]
        mask = pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array([convs[i] for i in starts], pa.int64()), pa.array(parts, pa.int64()), pa.array(counts, pa.int64()), runs.cast(pa.string()), mask], ["conv_id", "part", "n_turns", "formatted", "loss"])


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted conversations in parts: conv_id, part, n_turns, formatted, loss.

    loss holds the byte ranges, within the part's UTF-8, of what assistants
    say, still escaped. Rows lie by turn (null first), then role and text, so
    repeated and tied rows have one order. Null text and null role are empty;
    null conv_id is a conversation of its own; an empty table gives no rows.
    Rows come sorted by (conv_id, part) within each partition, and all parts
    of a conversation lie in one, because its digest has to run over them in
    order; the task streams, so its memory does not grow with a conversation.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), text_or_empty(text_col).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(_format, PARTS_SCHEMA)



def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn begins at {at}")
        colon = _unescaped(formatted, COLON, at + len(HEAD))
        end = _unescaped(formatted, TAIL, colon + len(COLON))
        out.append((unescape(formatted[at + len(HEAD) : colon]), unescape(formatted[colon + len(COLON) : end])))
        at = end + len(TAIL)
    return out


def _unescaped(s: str, what: str, at: int) -> int:
    """Where `what` next stands with an even number of backslashes before it, counted from `at`."""
    look = at
    while True:
        found = s.index(what, look)
        back = found
        while back > at and s[back - 1] == "\\":
            back -= 1
        if (found - back) % 2 == 0:
            return found
        look = found + 1


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    now: object = ()
    turns = chars = masked = 0
    everything, loss = hashlib.sha256(), hashlib.sha256()
    done: list[tuple] = []

    def row() -> tuple:
        return (now, turns, everything.hexdigest(), masked, loss.hexdigest(), chars)

    def out() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    for batch in batches:
        for i in range(batch.num_rows):
            conv, part = batch.column("conv_id")[i].as_py(), batch.column("part")[i].as_py()
            if part == 0:
                if now != ():
                    done.append(row())
                now, turns, chars, masked = conv, 0, 0, 0
                everything, loss = hashlib.sha256(), hashlib.sha256()
            text = batch.column("formatted")[i].as_py()
            chars += len(text)
            for role, said in parse(text):
                turns += 1
                everything.update(f"{role}\n{said}\n".encode())
            raw = text.encode()
            for span in batch.column("loss")[i].as_py():
                said = unescape(raw[span["start"] : span["end"]].decode())
                masked += len(said)
                loss.update(said.encode())
        if len(done) >= 1000:
            yield out()
            done = []
    if now != ():
        done.append(row())
    if done:
        yield out()


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of what format_chat wrote, parsed back from its output.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn),
    loss_chars and loss_sha256 (all text under the loss mask, unescaped),
    formatted_chars. Parts may have been stored and may lie in any order: they
    are dealt by conversation and sorted by part, and the task streams. An
    empty table gives no rows.
    """
    laid = parts.select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return laid.mapInArrow(_read_back, DIGEST_SCHEMA)
