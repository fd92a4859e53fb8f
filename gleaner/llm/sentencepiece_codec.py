"""SentencePiece encoding and decoding by an Aho-Corasick automaton.

The automaton over all pieces reads a segment once; at each position its output
links name every piece that ends there, and each relaxes that position.

* For a unigram model the best sum of scores wins (Viterbi).
* For a BPE model the scores are ranks of merges, and their best sum is not the
  model's encoding. There each position keeps the one piece that ends the
  canonical encoding of the text before it. A sequence of pieces is canonical
  exactly if every two neighbours are (merging their joined characters gives
  the same two back), so the piece that follows a valid neighbour is the one to
  keep. Ids equal those of the sentencepiece library.

No piece has a space mark after another character, so a text falls into
segments at its spaces that are encoded alone; frequent ones are encoded once
per worker and looked up after that. What a worker remembers is bounded (some
45 MB).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.pieces import SPACE, Vocabulary
from gleaner.llm.shared import text_or_empty

#: Segments that a worker remembers in each of two generations, the longest it does, in characters, and pairs of pieces.
REMEMBERED, LONGEST, PAIRS = 150_000, 48, 300_000
#: Segments of a text with runs of spaces; new lines are in no piece of most models.
_SEGMENT = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


class Codec(dict):
    """Encodes and decodes texts; as a dict, the ids (int32 bytes) of segments seen.

    A key is the text between two spaces, or begins with the new line before it.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece in vocabulary.ids:
            self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.alphabet = frozenset("".join(vocabulary.ids))
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.by_newline = not any("\n" in piece for piece in vocabulary.ids)
        self.crosses = any(SPACE in piece.lstrip(SPACE) for piece in vocabulary.ids)
        table = {i: piece.replace(SPACE, " ").encode() for piece, i in vocabulary.ids.items()}
        table |= {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        table.setdefault(vocabulary.unknown, b" \xe2\x81\x87 ")
        top = max(table) + 1
        self.lengths = np.array([len(table.get(i, b"")) for i in range(top)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(table.get(i, b"") for i in range(top)), np.uint8)

    def merged(self, s: str) -> list[str]:
        """The pieces of s by merging neighbours, best score first, leftmost of equals."""
        parts, scores = list(s), self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def valid(self, left: str, right: str) -> bool:
        """Whether left and right are canonical neighbours (left empty: right is canonical alone)."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def split(self, s: str) -> list[str]:
        """The pieces of one segment; characters in no piece stay alone."""
        n = len(s)
        last: list[str | None] = [None] * (n + 1)
        # Matches come by their end, longest first. Characters in no piece are taken alone.
        matches = self.automaton.iter(s) if self.alphabet.issuperset(s) else self._with_unknown(s)
        if self.v.by_merge:
            last[0] = ""
            pairs = self.pairs
            for end, (piece, length) in matches:
                if last[end + 1] is None and (before := last[end + 1 - length]) is not None:
                    fits = pairs.get((before, piece))
                    if fits or fits is None and self.valid(before, piece):
                        last[end + 1] = piece
        else:
            least = min(self.v.scores.values(), default=0.0) - 10.0  # an unknown character's
            best = [0.0] + [-np.inf] * n
            for end, (piece, length) in matches:
                score = best[end + 1 - length] + self.v.scores.get(piece, least)
                if score > best[end + 1]:
                    best[end + 1], last[end + 1] = score, piece
        if last[n] is None:  # equal scores of merges can leave no valid chain: merge as the model says
            return self.merged(s)
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def _with_unknown(self, s: str) -> Iterator[tuple[int, tuple[str, int]]]:
        at = 0
        for run in re.split("([^" + "".join(map(re.escape, sorted(self.alphabet & set(s)))) + "])", s) if self.alphabet & set(s) else s:
            if len(run) == 1 and run not in self.alphabet:
                yield at, (run, 1)
            else:
                for end, match in self.automaton.iter(run):
                    yield at + end, match
            at += len(run)

    def segment(self, s: str) -> bytes:
        ids = array("i")
        known = self.v.ids
        # Equal scores are only those of runs of spaces, whose merges go from the left.
        for piece in self.merged(s) if self.v.by_merge and s.startswith(SPACE * 2) and len(s) <= 64 else self.split(s):
            i = known.get(piece)
            if i is not None:
                ids.append(i)
            elif self.v.byte_ids:
                ids.extend(self.v.byte_ids[b] for b in piece.encode())
            else:
                ids.append(self.v.unknown)
        return ids.tobytes()

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self.segment("\n") + (self.segment(key[1:]) if len(key) > 1 else b"") if key[0] == "\n" else self.segment(SPACE + key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; none for an empty one."""
        if not text:
            return np.zeros(0, "<i4")
        if self.crosses:
            return np.frombuffer(self.segment(SPACE + text.replace(" ", SPACE)), "<i4")
        if self.by_newline and SPACE not in text:
            keys = text.replace("\n", " \n").split(" ")
            if "" not in keys:
                return np.frombuffer(b"".join([self[k] for k in keys]), "<i4")
        marked = SPACE + text.replace(" ", SPACE)
        segments = _SEGMENT.findall(marked) if self.by_newline else re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked)
        return np.frombuffer(b"".join([self.segment(s) if s[0] != SPACE or s[1:2] in ("", SPACE) else self[s[1:]] for s in segments]), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, as UTF-8, without the space that encoding puts first."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        # scatter: byte k of piece i comes from the table at offsets[i] + k
        index = np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        index += np.arange(ends[-1])
        return self.bytes[index].tobytes()[1:]


_codecs: dict[tuple, Codec] = {}


def _codec(shared) -> Codec:
    """This worker's codec for a broadcast vocabulary."""
    key = shared.value.unknown, len(shared.value.ids), hash(frozenset(shared.value.scores.items()))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int). Null and empty texts have none.

    Repeated rows give repeated results, an empty table none; other columns,
    whatever their names, are ignored. A text is encoded whole, segment by
    segment, however long it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [codec.encode(t.as_py() or "") for t in part.column("text")]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """From rows (doc_id, ids): doc_id, text. Bytes that are no UTF-8 become U+FFFD; null ids give empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = [codec.decode(np.array(x.as_py() or [], np.int64)).decode(errors="replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_check(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, n_tokens, n_byte_tokens, ids_sha256, round_trip.

    ids_sha256 is over the ids as little-endian int32; round_trip says that
    decoding them gave the text back (a space mark counts as a space). Null
    text is empty text; repeated rows give repeated results, an empty table
    none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "doc_id long, n_chars long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        is_byte = np.zeros(len(codec.lengths), np.bool_)
        is_byte[list(shared.value.byte_ids)] = True
        for batch in batches:
            out = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                ids = codec.encode(text)
                back = codec.decode(ids)
                out.append((len(text), len(ids), int(is_byte[ids].sum()), hashlib.sha256(ids.tobytes()).hexdigest(), back == text.replace(SPACE, " ").encode()))
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            arrays = [pa.array(c, k) for c, k in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_chars", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
