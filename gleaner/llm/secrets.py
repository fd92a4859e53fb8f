"""Secret scans: fixed patterns, and zstandard novelty of other strings in sensitive places.

Three patterns (assign, access, hex) give the base spans. Besides, a string of
key-like characters that follows a sensitive word is a candidate: the text
around it and a dictionary of common identifiers prime a zstandard
compressor, and the bytes that the candidate adds to what the context alone
takes are its marginal cost. Identifiers, words and repeats cost little; a
string that costs nearly its full length is reported with kind "novel".
Candidates have 16 characters or more, a letter and a digit: a long word that
the context lacks does not compress either, so without that gate plain words
would be reported (figures in the README).
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import text_or_empty

#: Fixed patterns. Letters of "assign" match in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What "assign" needs somewhere in the lower-cased text.
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: A candidate is a string after one of these words, within 40 characters.
SENSITIVE = re.compile(r"(?:passw(?:or)?d|passphrase|secret|token|credential|private|auth|bearer|api_?key|access_?key|signature|license_?key|\bpwd|\bkey)", re.I | re.A)
SENSITIVE_WORDS = (b"passw", b"passphrase", b"secret", b"token", b"credential", b"private", b"auth", b"bearer", b"key", b"signature", b"pwd")
RUN = re.compile(r"[A-Za-z0-9+/_=.~!@#$%^&*-]+", re.A)
LEAST, REACH, AROUND = 16, 40, 256
#: Marginal bytes for each character, at least, of a reported candidate.
NOVELTY = 0.7
LEVEL = 3
KINDS = ("assign", "access", "hex", "novel")

#: Identifiers common in code and configuration.
IDENTIFIERS = """
password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret
authorization bearer basic credential credentials username user_name email host hostname port database schema
connection connection_string endpoint region bucket account session session_id cookie csrf nonce signature digest
certificate fingerprint license_key encryption_key signing_key refresh_token access_token id_token auth_token
config configuration settings environment variable default required optional enabled disabled true false null none
string integer boolean object array function return import export class public private static const let var self
this request response header headers content_type application json text html utf-8 http https localhost example
get set post put delete update create insert select from where value values name type path file version build
production staging development test testing debug info warning error exception message status code result data
""".strip()


def assign_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]


def access_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]


def hex_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in HEX.finditer(text)]


class Novelty:
    """Marginal compressed bytes of a string, given the text around it and the identifiers."""

    def __init__(self) -> None:
        self.known = IDENTIFIERS.encode()

    def cost(self, before: str, candidate: str, after: str) -> int:
        primed = zstandard.ZstdCompressionDict(self.known + b"\n" + after.encode() + b"\n" + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = lambda x: len(zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x.encode()))
        return size(candidate) - size("")

    def spans(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Candidates in sensitive places that cost enough and touch no base span. One pass over the text's runs."""
        found: list[tuple[int, int]] = []
        merged = _merged(taken)
        runs = RUN.finditer(text)
        run = next(runs, None)
        seen = 0
        for m in SENSITIVE.finditer(text):
            at, stop = max(m.end(), seen), m.end() + REACH
            while run is not None and (lo := max(at, run.start())) < stop:
                hi = run.end()
                if hi <= at:
                    run = next(runs, None)
                    continue
                if hi - lo < LEAST:
                    if hi >= stop:
                        break
                    at = hi
                    continue
                at = seen = hi
                k = bisect.bisect_right(merged, (lo, math.inf))
                if (k and merged[k - 1][1] > lo) or (k < len(merged) and merged[k][0] < hi):
                    continue
                c = text[lo:hi]
                if not (any(ch.isdigit() for ch in c) and any(ch.isalpha() for ch in c)):
                    continue
                if self.cost(text[max(0, lo - AROUND) : lo], c, text[hi : hi + AROUND]) >= NOVELTY * (hi - lo):
                    found.append((lo, hi))
        return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint intervals that cover the same."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans_of(text: str, novelty: Novelty) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed; code points, end exclusive."""
    low = text.encode().lower()
    out = [("assign", *s) for s in assign_spans(text)] if any(w in low for w in ASSIGN_WORDS) else []
    if "AKIA" in text:
        out += [("access", *s) for s in access_spans(text)]
    out += [("hex", *s) for s in hex_spans(text)]
    if any(w in low for w in SENSITIVE_WORDS):
        out += [("novel", *s) for s in novelty.spans(text, [s[1:] for s in out])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t.as_py() or "", novelty)] for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], ["doc_id", "found"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, found (array of kind, start, end; code points, end exclusive).

    Null text is empty text. Rows are scanned where they lie, without a
    shuffle; repeated rows give repeated results, an empty table none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel from find_secrets' rows."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(F.concat_ws(",", F.transform(base, said)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("found", said)).alias("spans"), n("novel"),
    )

