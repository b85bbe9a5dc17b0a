"""SentencePiece encoding that keeps offsets, and decoding.

The text is normalised by the model's compiled character map (a double-array trie, longest prefix
first); every normalised byte keeps the source byte it came from, and each piece is projected back
to a span of source bytes.  Pieces come from the sentencepiece library, so ids are exactly its own.

Defined results: null is an empty text; an empty text has no ids and decodes to ""; repeated rows
are encoded one by one; very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from lodestrata.llm.common import map_text

SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """field number, value of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class CharacterMap:
    """The model's compiled map: a double-array trie of 32-bit units, then the replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.text = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.text = blob[4 + n :]
        self.first = {b for b in range(256) if self.units and self._step(self._base(0), b) is not None}

    def _base(self, at: int) -> int:
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        to = base ^ byte
        return to if to < len(self.units) and (self.units[to] & 0x800000FF) == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix at `at`."""
        if not self.units or data[at] not in self.first:
            return None
        found, node, i = None, 0, at
        while i < len(data):
            to = self._step(self._base(node), data[i])
            if to is None:
                break
            node, i = to, i + 1
            if (self.units[node] >> 8) & 1:
                value = self.units[self._base(node)] & 0x7FFFFFFF
                found = i - at, self.text[value : self.text.index(b"\0", value)]
        return found


class Codec:
    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        with open(model_path, "rb") as f:
            spec = {k: v for number, body in _fields(f.read()) if number == 3 for k, v in _fields(body)}
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.trim, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        n = self.sp.get_piece_size()
        #: Normalised bytes of each piece; 0 marks the unknown piece, whose length varies.
        self.length = np.array([0 if self.sp.is_unknown(i) else 1 if self.sp.is_byte(i) else len(self.sp.id_to_piece(i).encode()) for i in range(n)], np.int64)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the source byte it came from."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.map.units:
            parts, origin, at = [], [], 0
            while at < len(data):
                hit = self.map.longest(data, at)
                if hit is None:
                    n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                    hit = n, data[at : at + n]
                parts.append(hit[1])
                origin += [at] * len(hit[1])
                at += hit[0]
            out, source = b"".join(parts), np.array(origin, np.int64)
        else:
            out, source = data, np.arange(len(data))
        if self.trim:
            codes = np.frombuffer(out, np.uint8)
            blank = codes == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            if keep.any() and blank[np.flatnonzero(keep)[-1]]:
                keep[np.flatnonzero(keep)[-1]] = False
            out, source = codes[keep].tobytes(), source[keep]
        if self.dummy and out:
            out, source = b" " + out, np.concatenate([source[:1], source])
        if self.escape:
            wide = np.frombuffer(out, np.uint8) == 32
            out, source = out.replace(b" ", SPACE.encode()), np.repeat(source, np.where(wide, 3, 1))
        return out, np.append(source, len(data))

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """ids, and the source byte at which each piece starts, with the end of the last behind."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        ids = np.asarray(self.sp.encode(text), np.int64)
        normal, source = self.normalise(text)
        sizes = self.length[ids]
        if not sizes.all() or sizes.sum() != len(normal):  # unknown pieces: ask the library
            sizes = np.array([len(p.surface.encode()) if self.sp.is_unknown(p.id) else s for p, s in zip(self.sp.encode(text, out_type="immutable_proto").pieces, sizes.tolist())], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if ends[-1] != len(normal):
            raise ValueError(f"pieces of {ends[-1]} bytes for a normalised text of {len(normal)}")
        return ids, source[ends]

    def decode(self, ids) -> str:
        return self.sp.decode(ids.tolist() if isinstance(ids, np.ndarray) else list(ids))


@lru_cache(maxsize=4)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, starts: source byte offset of each piece, plus the end of the last."""

    def factory():
        c = codec(model_path)

        def work(text):
            ids, starts = c.encode(text)
            return ids, starts

        return work

    return map_text(docs, [id_col], text_col, factory, "ids array<int>, starts array<bigint>")


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, starts, decoded."""

    def factory():
        c = codec(model_path)

        def work(text):
            ids, starts = c.encode(text)
            return ids, starts, c.decode(ids)

        return work

    return map_text(docs, [id_col], text_col, factory, "ids array<int>, starts array<int>, decoded string")


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the library's decoding of each row's ids; null ids give an empty text."""
    import pyarrow as pa

    source = encoded.select(id_col, ids_col)

    def run(batches):
        c = codec(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=[id_col, "text"])

    from pyspark.sql import types as T

    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("text", T.StringType())]))


def codec_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, digests of the ids and of the decoded text, and of the piece spans."""

    def factory():
        c = codec(model_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        said = [str(i) for i in range(c.sp.get_piece_size())]

        def work(text):
            ids, starts = c.encode(text)
            listed = ids.tolist()
            return len(listed), sha(",".join(map(said.__getitem__, listed))), sha(c.sp.decode(listed)), zlib.crc32(starts.astype("<i8").tobytes())

        return work

    return map_text(docs, [id_col], text_col, factory, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint")
