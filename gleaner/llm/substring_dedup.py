"""Substring dedup by De Bruijn compaction.

A window of K words is an edge between the two runs of K - 1 words in it. Runs
of consecutive edges that share a minimizer (the least hash among the word
runs of MINIMIZER words inside the window) are nonbranching pieces of a path:
equal text is cut into equal pieces wherever it stands. So

1. each text is cut into pieces (a fifth of the windows), and a shuffle on the
   minimizer, which tells no more than whether another document has it, leaves
   those that may repeat;
2. a shuffle on the digest of a piece's whole path finds the pieces that repeat
   whole, and with them their source coordinate, the place in the document of
   least id that has the path. Those links cover all edges of the piece;
3. what is left are first occurrences. Where their minimizer has other paths
   too, the graph branches there: their edges are joined one by one, on a
   digest of the edge's own bytes;
4. pieces and edges that lie behind one another both in the document and in
   its source are compacted into spans, and the words under them go;
5. spans are verified: for SEGMENT words at a time 128 bits of the SHA-256 of
   the words are taken at the document's coordinates and at the source's, and
   meet under the source's. Should any differ, two paths shared a digest, and
   the search is done again with another seed.

Before each shuffle a slice of texts is combined: of rows with one key only
those of the slice's least document are sent, the others are linked to it on
the spot. So a passage that a third of all documents share costs a row per
slice, and nothing collects the occurrences of an edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import text_or_empty, written

K = 13
MINIMIZER = 5
#: Words, at most, that are compared at once; seeds that are tried at most.
SEGMENT, TRIES = 64, 4
#: Bytes of text, at least, that are cut at once.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(20240101).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so invertible modulo 2^64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of a number modulo 2^64, and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            if n > 4 * SLICE_BYTES:  # of one very long text; not kept
                return _powers(self.base, n), _powers(self.inverse, n)
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_P), _Powers(_Q)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n values."""
    up, down = _word_powers(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return _mix((sums[n:] - sums[:-n]) * down[: len(values) - n + 1])


class Cut:
    """The words and pieces of several texts.

    starts, ends: bytes of each word in data; first: each text's first word,
    with the number of words at the end. For each piece: text, its first
    window (counted in its text), its windows, its minimizer's hash.
    """

    def __init__(self, texts: list[bytes], k: int = K, minimizer: int = MINIMIZER):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        at = np.concatenate([[0], np.cumsum(lengths)])
        self.data = data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        self.starts, self.ends = starts, ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(starts, at)
        n = len(starts)
        self.text = self.window = self.windows = np.zeros(0, np.int64)
        self.minimizer = np.zeros(0, np.uint64)
        if n < k:
            return
        up, down = _byte_powers(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up, dtype=np.uint64)])
        words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        grams = _grams(words, minimizer)
        width, total = k - minimizer + 1, n - k + 1
        # the leftmost least gram of each window, by doubling
        best, place, have = grams, np.arange(len(grams)), 1
        while have < width:
            step = min(have, width - have)
            left, right = best[:-step], best[step:]
            take = right < left
            best, place, have = np.where(take, right, left), np.where(take, place[step:], place[:-step]), have + step
        text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        whole = text[:total] == text[k - 1 :]
        begins = whole & np.concatenate([[True], ~whole[:-1] | (place[1:total] != place[: total - 1])])
        begin = np.flatnonzero(begins)
        stops = ~whole | begins
        after = np.append(np.flatnonzero(stops), total)
        end = after[np.searchsorted(after, begin, "right")]
        self.text, self.windows = text[begin], end - begin
        self.window = begin - self.first[self.text]
        self.minimizer = best[begin]


def _slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column(column).cast(pa.large_binary())]
        lo = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= SLICE_BYTES or i == len(texts) - 1:
                yield batch.slice(lo, i + 1 - lo), texts[lo : i + 1]
                lo, size = i + 1, 0


#: Minimizers keep so many bits; they only choose what is looked at, and do not decide.
_M = np.uint64((1 << 48) - 1)
#: Marks a row that is settled within its slice.
_SETTLED = np.int64(-(1 << 63))


def _places(batch: pa.RecordBatch, text: np.ndarray, window: np.ndarray) -> np.ndarray:
    """tag << 32 | window: where a piece starts, and in which of the rows with its id."""
    return batch.column("tag").to_numpy().astype(np.int64)[text] << 32 | window


def _spread(ids: np.ndarray) -> np.ndarray:
    return (_mix(ids.view(np.uint64)) & _M).view(np.int64)


def _least(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group (increasing numbers) the index of the row of least id in each row's group, and that id."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    number = np.cumsum(np.append(True, group[1:] != group[:-1]))[: len(group)] - 1
    order = np.lexsort((ids, number))
    first = order[starts] if len(group) else starts
    return first[number], ids[first][number]


def _pieces(k: int, minimizer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches):
            cut = Cut(texts, k, minimizer)
            key = cut.minimizer & _M
            order = np.lexsort((cut.text, key))
            fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (cut.text[order][1:] != cut.text[order][:-1]))[: len(order)]
            at = order[fresh]  # the first piece of each minimizer and text
            m, ids = key[at].view(np.int64), batch.column("doc_id").to_numpy()[cut.text[at]]
            place = _places(batch, cut.text[at], cut.window[at])
            first, low = _least(m, ids)
            again = np.zeros(len(at), np.bool_)
            again[first[ids > low]] = True
            shared = again[first]  # by two documents of this slice
            send = ~shared | (first == np.arange(len(at)))
            columns = (np.concatenate([m[send], _spread(ids[shared])]), np.concatenate([ids[send], ids[shared]]), np.concatenate([place[send], place[shared] | _SETTLED]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["deal", "doc_id", "place"])

    return run


def _joined(cut: Cut) -> tuple[bytes, list[int], list[int]]:
    """The words one space apart, so that an edge's bytes do not depend on the white space between, and where each starts and ends."""
    lengths = cut.ends - cut.starts
    ends = np.cumsum(lengths + 1) - 1
    solid = ~_SPACE[cut.data]
    flat = np.where(solid, cut.data, 32)[solid | np.concatenate([[False], solid[:-1]])].tobytes()
    return flat, ends - lengths, ends


_LINKS = "deal long, m long, doc_id long, place long, windows long, source_id long, source_place long"


def _combined(batch: pa.RecordBatch, digest: np.ndarray, m: np.ndarray, text: np.ndarray, window: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """Rows to be joined on (deal, m), or settled with a source in this slice."""
    order = np.lexsort((m, digest))
    digest, m, text, window, windows = (x[order] for x in (digest, m, text, window, windows))
    ids = batch.column("doc_id").to_numpy()[text]
    group = np.cumsum(np.append(True, (digest[1:] != digest[:-1]) | (m[1:] != m[:-1]))[: len(order)])
    first, low = _least(group, ids)
    settled = ids > low
    place = np.where(settled, _places(batch, text, window) | _SETTLED, _places(batch, text, window))
    deal = np.where(settled, _spread(ids), digest.view(np.int64))
    m = np.where(settled, 0, m.view(np.int64))
    columns = [pa.array(x) for x in (deal, m, ids, place, windows)]
    source = _places(batch, text, window)[first]
    return pa.RecordBatch.from_arrays([*columns, pa.array(low, mask=~settled), pa.array(source, mask=~settled)], [x.split()[0] for x in _LINKS.split(", ")])


def _look(k: int, minimizer: int, single: bool, seed: int, bits: int):
    """Digests of the asked pieces' paths, or of each of their edges.

    asked holds a window of each minimizer that is asked for in a text, or,
    for edges, the first window of each asked piece.
    """
    digest, mask = xxhash.xxh3_64_intdigest, (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches):
            cut = Cut(texts, k, minimizer)
            bounds = np.searchsorted(cut.text, np.arange(len(texts) + 1))
            chosen = []
            for i, asked in enumerate(batch.column("asked")):
                lo, hi = bounds[i], bounds[i + 1]
                hit = np.isin(cut.window[lo:hi], asked.values.to_numpy())
                if not single:
                    hit = np.isin(cut.minimizer[lo:hi], cut.minimizer[lo:hi][hit])
                chosen.append(lo + np.flatnonzero(hit))
            at = np.concatenate(chosen)
            flat, starts, ends = _joined(cut)
            windows = cut.windows[at]
            if single:
                ahead = np.cumsum(windows) - windows
                window = np.repeat(cut.window[at] - ahead, windows) + np.arange(windows.sum())
                at, windows = np.repeat(at, windows), np.ones(len(window), np.int64)
            else:
                window = cut.window[at]
            word = cut.first[cut.text[at]] + window
            found = [digest(flat[a:b], seed) & mask for a, b in zip(starts[word].tolist(), ends[word + windows + k - 2].tolist(), strict=True)]
            yield _combined(batch, np.array(found, np.uint64), cut.minimizer[at] & _M, cut.text[at], window, windows)

    return run


_FINISHED = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long, longest_span long, kept string, tag int, start long, n long, d0 long, d1 long"


def _finish(k: int, keep_text: bool):
    """Rows (doc_id, tag, text, spans, segments): a row for each, and one (with n) for the digest of each segment, under its source's coordinates."""
    names = [x.split()[0] for x in _FINISHED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def rows(size: int, **columns) -> pa.RecordBatch:
        found = [columns[c] if c in columns else pa.nulls(size, t) for c, t in zip(names, types, strict=True)]
        return pa.RecordBatch.from_arrays([x.cast(pa.string()) if c == "kept" else x for c, x in zip(names, found, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches):
            out, asked, digests = [], [], []
            for text, spans, segments in zip(texts, batch.column("spans"), batch.column("segments"), strict=True):
                words = text.split()
                kept, n_spans, longest = words, 0, 0
                if spans.is_valid:
                    start, windows = (spans.values.field(i).to_numpy() for i in range(2))
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + windows + k - 1, -1)
                    stays = np.cumsum(gone)[:-1] == 0
                    kept = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                    edge = np.flatnonzero(np.diff(np.concatenate([[True], stays, [True]]).view(np.int8)))
                    n_spans, longest = len(edge) // 2, int((edge[1::2] - edge[0::2]).max())
                if segments.is_valid:
                    asked.append(segments.values)
                    at, n = (segments.values.field(i).to_pylist() for i in range(2))
                    digests += [hashlib.sha256(b" ".join(words[a : a + b])).digest()[:16] for a, b in zip(at, n, strict=True)]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), n_spans, longest, joined if keep_text else None))
            columns = {c: pa.array(x, t) for c, t, x in zip(names[1:7], types[1:7], zip(*out, strict=True), strict=True)}
            yield rows(len(out), doc_id=batch.column("doc_id"), **columns)
            if digests:
                told = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                _, n, source, tag, start = (np.concatenate([x.field(i).to_numpy() for x in asked]) for i in range(5))
                yield rows(len(n), **{c: pa.array(x) for c, x in (("doc_id", source), ("tag", tag), ("start", start), ("n", n), ("d0", told[:, 0]), ("d1", told[:, 1]))})

    return run


_ROW = ["doc_id", "tag"]


def _asked(places: DataFrame) -> DataFrame:
    """asked: the windows of each row, from rows (doc_id, place)."""
    unpacked = places.select("doc_id", _tag("place").alias("tag"), _start("place").cast("int").alias("w"))
    return unpacked.groupBy(*_ROW).agg(F.collect_list("w").alias("asked")).hint("shuffle_hash")


def _sourced(found: DataFrame) -> DataFrame:
    """found with the first place, by document, of its (deal, m) as source where none is set."""
    line = Window.partitionBy("deal", "m").orderBy("doc_id", "place").rowsBetween(Window.unboundedPreceding, 0)
    settled = F.col("source_id").isNotNull()
    with_first = found.repartition("deal").withColumns({"first_id": F.first("doc_id").over(line), "first_place": F.first("place").over(line)})
    return with_first.select(
        "deal", "m", "doc_id", "place", "windows", settled.alias("settled"), F.coalesce("source_id", "first_id").alias("source_id"), F.coalesce("source_place", "first_place").alias("source_place"),
    )


def _tag(place: str) -> Column:
    return F.shiftright(F.col(place).bitwiseAND(F.lit((1 << 63) - 1)), 32).cast("int")


def _start(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit((1 << 32) - 1))


def repeated_spans(rows: DataFrame, dealt: DataFrame, k: int = K, minimizer: int = MINIMIZER, seed: int = 0, bits: int = 64) -> DataFrame:
    """From rows (doc_id, tag, text): spans of windows that also start in a document of smaller id.

    dealt: the same rows, partitioned by doc_id and tag. Gives doc_id, tag,
    source_id, source_tag, start, windows, source_start.
    """
    there = F.col("doc_id").isNotNull()
    pieces = rows.filter(there).mapInArrow(_pieces(k, minimizer), "deal long, doc_id long, place long").repartition("deal")
    line = Window.partitionBy("deal").orderBy("doc_id", "place")
    near = pieces.withColumns({"before": F.lag("doc_id").over(line), "after": F.lead("doc_id").over(line)})
    again = near.filter((F.col("place") < 0) | F.col("before").isNotNull() | F.col("after").isNotNull())
    paths = dealt.join(_asked(again), _ROW).mapInArrow(_look(k, minimizer, False, seed, bits), _LINKS)
    found = written(_sourced(paths), "paths")
    # First occurrences whose minimizer has other paths too: there the graph branches.
    firsts = found.filter("NOT settled AND doc_id = source_id").select("deal", "m", "doc_id", "place")
    branching = written(firsts.groupBy("m").agg(F.min("deal").alias("lo"), F.max("deal").alias("hi")).filter("lo <> hi").select("m"), "branching")
    edges = dealt.join(_asked(firsts.join(branching, "m")), _ROW).mapInArrow(_look(k, minimizer, True, seed, bits), _LINKS)
    whole = ["doc_id", "place", "windows", "source_id", "source_place"]
    links = found.filter("doc_id > source_id").select(*whole).unionByName(_sourced(edges).filter("doc_id > source_id").select(*whole))
    unpacked = links.select(
        "doc_id", _tag("place").alias("tag"), _start("place").alias("start"), "windows", "source_id", _tag("source_place").alias("source_tag"), _start("source_place").alias("source_start"),
    ).repartition(*_ROW).withColumn("shift", F.col("source_start") - F.col("start"))
    # Compaction: what follows its neighbour in document and source alike continues its path.
    of = [*_ROW, "source_id", "source_tag", "shift"]
    line = Window.partitionBy(*of).orderBy("start")
    end = F.col("start") + F.col("windows")
    heads = unpacked.withColumn("head", F.when(F.lag(end).over(line) >= F.col("start"), 0).otherwise(1))
    path = heads.withColumn("path", F.sum("head").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = path.groupBy(*of, "path").agg(F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("windows"), F.min("source_start").alias("source_start"))
    return spans.drop("shift", "path")


def _segments(spans: DataFrame, k: int, segment: int = SEGMENT) -> DataFrame:
    """Spans, which may be long, as runs of at most `segment` words that begin at multiples of it in the source.

    So the runs that are asked of a source are bounded by its length, however
    many documents repeat it.
    """
    end = F.col("source_start") + F.col("windows") + (k - 1)
    numbers = F.sequence(F.floor(F.col("source_start") / segment), F.floor((end - 1) / segment))
    cut = spans.select("*", end.alias("end"), F.explode(numbers).alias("number"))
    lo, hi = F.greatest(F.col("source_start"), F.col("number") * segment), F.least(F.col("end"), (F.col("number") + 1) * segment)
    cut = cut.withColumns({"lo": lo, "n": hi - lo})
    return cut.select(*_ROW, (F.col("start") + F.col("lo") - F.col("source_start")).alias("at"), "n", "source_id", "source_tag", F.col("lo").alias("source_at"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, minimizer: int = MINIMIZER, keep_text: bool = False, first_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, n_spans, longest_span, kept.

    A word goes if a window of k words over it also starts in a document of
    smaller id; windows are judged on the input. n_spans and longest_span are
    the runs of words that went and the longest of them. kept (null unless
    keep_text) is the words that stay, one space apart. Null text has no
    words, and a text of fewer than k words keeps them all. Rows with a null
    id neither lose words nor are a source. Rows that repeat an id are judged
    each on its own text (told apart by 24 bits of its hash). An empty table
    gives no rows; other columns are ignored.

    The result is written, so that its spans can be verified before it is
    given. first_bits: bits of the digests of the first try (tests lower it).
    """
    whole = text_or_empty(text_col)
    tag = F.xxhash64(whole).bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tag.alias("tag"), whole.alias("text"))
    dealt = rows.repartition(*_ROW)
    for seed in range(TRIES):
        spans = written(repeated_spans(rows, dealt, k, minimizer, seed, first_bits if not seed else 64), "spans")
        segments = _segments(spans, k)
        source = ("source_id", "source_tag", "source_at", "n")
        theirs = segments.select(*source).distinct()  # bounded by the source's length
        of_source = theirs.select(F.col("source_id").alias("doc_id"), F.col("source_tag").alias("tag"), F.col("source_at").alias("at"), *source)
        both = segments.unionByName(of_source)
        per_row = [spans.groupBy(*_ROW).agg(F.collect_list(F.struct("start", "windows")).alias("spans")), both.groupBy(*_ROW).agg(F.collect_list(F.struct("at", "n", "source_id", "source_tag", "source_at")).alias("segments"))]
        work = per_row[0].join(per_row[1], _ROW, "full")
        finished = written(dealt.join(work.hint("shuffle_hash"), _ROW, "left").mapInArrow(_finish(k, keep_text), _FINISHED), "finished")
        told = finished.filter("n IS NOT NULL").groupBy(*_ROW, "start", "n").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("d0", "d1")])
        unlike = told.filter("min_d0 <> max_d0 OR min_d1 <> max_d1")
        if unlike.isEmpty():
            return finished.filter("n IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans", "longest_span", "kept")
    raise RuntimeError(f"paths of different words shared their digests under {TRIES} seeds")
