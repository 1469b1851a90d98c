"""Secrets in text: fixed patterns, and strings that a primed compressor cannot explain.

Fixed patterns report assignments, access keys and long hexadecimal runs. Beyond them every
long run of mixed letters and digits that follows a sensitive word is a candidate. zstandard
is primed with a dictionary of identifiers and the text around the candidate; the bytes the
candidate adds, for each of its characters, are its novelty. Names, placeholders and copies
of nearby code add few bytes; keys add almost all of theirs and are reported.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import slices

LEAST_NOVELTY = 0.6
AROUND = 2_048
CONTEXT = 48
PLACEHOLDER = "[redacted]"
KINDS = ("assign", "access", "hex", "novel")

# Identifiers and fillers that code and documentation are full of.
IDENTIFIERS = (
    "access_token api_key apikey application authentication authorization auth_token base64 bearer "
    "changeme client_id client_secret configuration connection_string credentials default "
    "description development dummy encryption_key endpoint environment example example_key "
    "expires_in fingerprint identifier integrity localhost password passphrase placeholder "
    "private_key production public_key refresh_token request response sample secret secret_key "
    "session_id signature signing_key staging string test testing token undefined username uuid "
    "your_api_key_here xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 0000000000000000000000000000000000 "
    "1234567890 0123456789abcdef abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "sha256- sha512- https:// http:// www. .example.com 2024-01-01T00:00:00Z")

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")
SENSITIVE = re.compile(r"(?ai:(?<![a-z])(?:api|access|private|client|auth|signing|session|encryption)?[ _-]?"
                       r"(?:key|secret|token|pass(?:word|wd|phrase)|pwd|credentials?|bearer|signature|auth)(?![a-z]))")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SPANS = "array<struct<kind: string, start: int, stop: int, value: int, novelty: double>>"


class Novelty:
    """Bytes that a string adds to its surroundings under a primed compressor."""

    def __init__(self, identifiers: str, level: int = 9):
        self.primer = identifiers.encode()
        self.level = level

    def __call__(self, text: str, start: int, stop: int) -> float:
        """Added bytes per character of text[start:stop]."""
        import zstandard
        near = text[max(0, start - AROUND):start] + text[stop:stop + AROUND]
        primed = zstandard.ZstdCompressor(
            level=self.level, write_content_size=False, write_checksum=False,
            dict_data=zstandard.ZstdCompressionDict(self.primer + near.encode(),
                                                    dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        lead = text[max(0, start - CONTEXT):start].encode()
        added = (len(primed.compress(lead + text[start:stop].encode())) - len(primed.compress(lead)))
        return added / (stop - start)


def find_spans(text: str, novelty: Novelty, least: float) -> list[tuple]:
    """(kind, start, stop, start of the value, novelty) by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end(), m.start(2), None)
                for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    runs = [(m.start(), m.end()) for m in RUN.finditer(text)]
    for a, b in runs:
        out += [("access", m.start(), m.end(), m.start(), None)
                for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        out += [("hex", m.start(), m.end(), m.start(), None) for m in HEX.finditer(text, a, b)]
    if runs:
        base = list(out)
        for a, b in runs:
            if (MIXED.match(text[a:b]) and SENSITIVE.search(text, max(0, a - CONTEXT), a)
                    and not any(s < b and a < e for _, s, e, _, _ in base)
                    and (n := novelty(text, a, b)) >= least):
                out.append(("novel", a, b, a, n))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _batches(batches, text: str, identifiers: str, least_novelty: float):
    """Each slice with its texts and the spans in them."""
    novelty = Novelty(identifiers)
    for batch in slices(batches, text):
        texts = pc.fill_null(batch.column(text), "").to_pylist()
        yield batch, texts, [find_spans(t, novelty, least_novelty) for t in texts]


def scan(docs: DataFrame, text: str = "text", into: str = "secrets",
         least_novelty: float = LEAST_NOVELTY, identifiers: str = IDENTIFIERS) -> DataFrame:
    """docs with an array `into` of (kind, start, stop, value, novelty) in code points, end exclusive.

    `value` is where the secret itself starts: behind the name in an assignment. A null or
    empty text has none. Repeated rows stay; an input column named like `into` is replaced.
    """
    docs = docs.drop(into)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
                               ("value", pa.int32()), ("novelty", pa.float64())]))

    def run(batches):
        for batch, _, spans in _batches(batches, text, identifiers, least_novelty):
            found = [[dict(zip(("kind", "start", "stop", "value", "novelty"), s, strict=True)) for s in ss]
                     for ss in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)],
                                             names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([
        *docs.schema.fields, T.StructField(into, T._parse_datatype_string(SPANS))]))


def without(text: str, spans: list[tuple], placeholder: str) -> str:
    """The text with the value of each span replaced; overlapping spans are replaced once."""
    kept, at, end = [], 0, -1
    for a, b in sorted((s[3], s[2]) for s in spans):
        if a >= end:
            kept += [text[at:a], placeholder]
        at = end = max(end, b)
    return "".join(kept) + text[at:]


def redact(docs: DataFrame, text: str = "text", least_novelty: float = LEAST_NOVELTY,
           identifiers: str = IDENTIFIERS, placeholder: str = PLACEHOLDER) -> DataFrame:
    """docs with every secret replaced by a placeholder; names of assignments and nulls stay."""
    position = docs.columns.index(text)

    def run(batches):
        for batch, texts, spans in _batches(batches, text, identifiers, least_novelty):
            if any(spans):
                null = batch.column(position).is_null().to_pylist()
                column = [None if n else without(t, ss, placeholder) if ss else t
                          for t, ss, n in zip(texts, spans, null, strict=True)]
                batch = batch.set_column(position, batch.schema.field(position),
                                         pa.array(column, batch.schema.field(position).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame, into: str = "secrets") -> DataFrame:
    """Counts and texts of the spans: n_assign, n_access, n_hex, base_sha256, spans."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter(into, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(into, lambda s: s["kind"] != "novel")
    counts = {f"n_{k}": number(k) for k in KINDS[:3]}
    return found.withColumns(counts | {"base_sha256": F.sha2(joined(base), 256),
                                       "spans": joined(F.col(into))})
