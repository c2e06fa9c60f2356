"""SentencePiece encoding with byte offsets, and decoding.

Normalisation is longest-prefix replacement through the model's compiled character map (a double-array trie), each
normalised byte remembering the original byte it came from; symbols that a model leaves whole are passed by, and models
that remove extra white space lose leading, trailing and repeated spaces. White space is escaped and the dummy prefix
added where the model has one; the installed library merges the normalised text; walking the pieces over the alignment projects
each to its original bytes [begin, end). The library's encoding of the original text is only compared with the result.

Defined cases: null counts as empty and has no pieces; a run of characters that the model doesn't know is one piece over all
its bytes, or byte pieces where the model has them; what normalisation removes belongs to the piece before it, at the start to
the first piece; equal rows give equal results; long texts are encoded whole; columns beside the id and the text are not
read. Models that don't escape white space or put it after words are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat
from operator import eq

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

ESCAPE = "▁"
_ESCAPE = ESCAPE.encode()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one protobuf message."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes, and the NUL-ended replacements its leaves point to."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.replacements = blob[4 + size :] if size else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes used, replacement) of the longest key that ``data`` has at ``at``."""
        units, best = self.units, None
        node = units[0] >> 10 << ((units[0] & 1 << 9) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= unit >> 10 << ((unit & 1 << 9) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)]
        return best

    def apply(self, text: str, whole: re.Pattern[bytes] | None = None, strip: bool = False) -> tuple[str, list[int] | None]:
        """Normalised text, and for each of its UTF-8 bytes plus the end the original byte offset (None: the same).

        ``whole``: symbols to pass by. ``strip``: remove leading, trailing and repeated spaces.
        """
        if not self.units and not strip:
            return text, None
        data, out, align, i = text.encode(), bytearray(), [], 0
        while i < len(data):
            kept = whole.match(data, i) if whole else None
            hit = None if kept or not self.units else self.longest(data, i)
            used, new = hit or (len(kept[0]) if kept else (1, 2, 3, 4)[(data[i] >= 0xC0) + (data[i] >= 0xE0) + (data[i] >= 0xF0)], None)
            new = data[i : i + used] if new is None else new
            while strip and new.startswith(b" ") and (not out or out.endswith(b" ")):
                new = new[1:]
            align += [i] * len(new)
            out += new
            i += used
        last = len(data)
        while strip and out.endswith((b" ", _ESCAPE)):  # at the end an escape in the text counts as a space too
            size = 1 if out.endswith(b" ") else len(_ESCAPE)
            last = align[-size]
            del out[-size:], align[-size:]
        return out.decode(), [*align, last]


def _without_map(model: bytes) -> bytes:
    """The model with an empty character map, keeping white space, and no samples that depend on it: it merges texts as they are."""

    def number(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def field(n: int, value: int | bytes) -> bytes:
        return number(n << 3) + number(value) if isinstance(value, int) else number(n << 3 | 2) + number(len(value)) + value

    out = []
    for n, value in _fields(model):
        if n == 3:
            value = b"".join(field(m, v) for m, v in _fields(value) if m not in (2, 4)) + field(4, 0)
        if n != 4:
            out.append(field(n, value))
    return b"".join(out)


@dataclass(frozen=True)
class Aligned:
    """The encoding of one text: identifiers, original bytes [begin, end) of each, and whether all checks hold."""

    ids: list[int]
    begin: np.ndarray
    end: np.ndarray
    exact: bool


@dataclass(frozen=True)
class Piece:
    """A piece of a text and the original bytes [begin, end) it covers."""

    id: int
    piece: str
    begin: int
    end: int


class Encoder:
    """One model. Made once per Python worker from the file's bytes."""

    def __init__(self, model: bytes) -> None:
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        parts = {n: dict(_fields(v)) for n, v in _fields(model) if n in (2, 3)}
        spec, trained = parts.get(3, {}), parts.get(2, {})
        self.map = CharacterMap(spec.get(2, b""))
        # defaults of the format: add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5 are all true
        if not spec.get(5, 1) or trained.get(24, 0):
            raise ValueError("supported are models that escape white space and put it before words")
        self.lead, self.strip = int(spec.get(3, 1)), bool(spec.get(4, 1))
        changed = bool(self.map.units) or self.strip
        self.merge = sentencepiece.SentencePieceProcessor(model_proto=_without_map(model)) if changed else self.lib
        self.pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.unknown = self.lib.unk_id()
        self.raw = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else p.replace(ESCAPE, " ").encode() for i, p in enumerate(self.pieces)]
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        kinds = [dict(_fields(v)) for n, v in _fields(model) if n == 1] if changed else []
        own = sorted((k[1] for k in kinds if k.get(3, 1) == 4), key=len, reverse=True)
        self.whole = re.compile(b"|".join(map(re.escape, own))) if own else None

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The library's own encoding."""
        return self.lib.encode([t or "" for t in texts], num_threads=1)

    def aligned(self, texts: list[str | None]) -> Iterator[Aligned]:
        """Each text normalised by the map, merged, and projected to its original bytes."""
        texts = [t or "" for t in texts]
        mapped = [self.map.apply(t, self.whole, self.strip) for t in texts]
        # a text of which nothing is left may still get the dummy prefix, which the library adds to texts that aren't empty
        found = self.merge.encode([n for n, _ in mapped], num_threads=1)
        found = [ids if n or not t else self.lib.encode(t) for t, (n, _), ids in zip(texts, mapped, found)]
        # without a map, merging has read the text itself
        same = repeat(True) if self.merge is self.lib else map(eq, found, self.encode(texts))
        for text, (normal, align), ids, agrees in zip(texts, mapped, found, same):
            raw = normal.encode()
            names = self.merge.encode(normal, out_type=str) if self.unknown in ids else None  # an unknown piece is named by its text
            bounds = self._bounds(ids, raw, names)
            parts = map(self.raw.__getitem__, ids) if names is None else (self.raw[i] if self.lib.is_byte(i) else p.replace(ESCAPE, " ").encode() for i, p in zip(ids, names))
            spelled = b"".join(parts) == ((b" " * self.lead + raw).replace(_ESCAPE, b" ") if ids else b"")
            tiled = int(bounds[-1]) == len(raw)
            if align is not None:
                bounds = np.array(align, np.int64)[np.minimum(bounds, len(raw))]
                bounds[0] = 0  # the first piece takes what the map removes before it, the last what is removed after it
                if len(ids):
                    bounds[-1] = len(text.encode())
            yield Aligned(ids, bounds[:-1], bounds[1:], bool(agrees and spelled and tiled))

    def _bounds(self, ids: list[int], raw: bytes, names: list[str] | None) -> np.ndarray:
        """Ends of the pieces in the normalised bytes, after the first one's begin; a dummy prefix is before byte 0."""
        if names is None and _ESCAPE not in raw:  # every escape is one space
            ends = np.cumsum(self.sizes[np.array(ids, np.int64)]) - self.lead
            return np.maximum(np.concatenate([[0], ends]), 0)
        out, at = [0], -self.lead
        for i, name in zip(ids, names or map(self.pieces.__getitem__, ids)):
            if self.lib.is_byte(i):
                at += 1
            else:
                for c in name:
                    at += 1 if c == ESCAPE and (at < 0 or raw[at : at + 1] == b" ") else len(c.encode())
            out.append(max(at, 0))
        return np.array(out, np.int64)

    def spans(self, text: str | None) -> list[Piece]:
        """The pieces of one text with their original byte spans; byte pieces cover one byte of their character."""
        found = next(self.aligned([text]))
        return [Piece(i, self.pieces[i], b, e) for i, b, e in zip(found.ids, found.begin.tolist(), found.end.tolist())]


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def model_bytes(path: str) -> bytes:
    """The model file, read on the driver; half a megabyte, sent with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode_digests(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, exact), a row for each row of ``docs``.

    The digests are of what ``encode_pieces`` returns; that of the spans is over begin and end of each piece as 64-bit
    little-endian numbers. ``exact``: the library encodes the original text alike, the pieces spell the normalised text, and the spans tile the text.
    """
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared.value)
        digits = [str(i) for i in range(len(coder.pieces))].__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, sha, back, spans, exact = [], [], [], [], []
                for found in coder.aligned(part.column(1).to_pylist()):
                    ids = found.ids
                    n.append(len(ids))
                    sha.append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(coder.lib.decode(ids).encode() if ids else b"").hexdigest())
                    spans.append(hashlib.sha256(np.column_stack([found.begin, found.end]).astype("<i8").tobytes()).hexdigest())
                    exact.append(found.exact)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back), pa.array(spans), pa.array(exact)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "exact"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, exact boolean")


def encode_pieces(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pieces array<struct<id, piece, begin, end>>): the encoding with original byte spans."""
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("id", pa.int32()), ("piece", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = [[vars(p) for p in coder.spans(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(item))], ["doc_id", "pieces"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, pieces array<struct<id:int,piece:string,begin:bigint,end:bigint>>")


def decode_ids(rows: DataFrame, model: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the library's decoding of each row's array of identifiers; null or empty gives an empty text."""
    kind = rows.schema[key].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = _encoder(shared.value).lib
        for batch in batches:
            text = [lib.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], [key, "text"])

    return rows.select(key, F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
