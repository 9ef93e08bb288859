"""SentencePiece encoding and decoding that keeps offsets.

The text is normalised here: at each place the longest of the model's own symbols (user-defined pieces) passes as it is, else
the longest key of its compiled character map that starts there is replaced (a Darts double array in the model file), other
characters pass; then come white-space rules and the dummy prefix. Where a model has neither symbols, map nor rules that
remove white space, as the query's has not, no prefix can match anywhere and only spaces are marked. Each normalised byte remembers the original byte that it came from, so every piece is projected back to a byte
span of the text. The normalised text is cut where no piece can lie across, each distinct segment is split into pieces
by the sentencepiece library (with a copy of the model whose own normalisation is switched off), and the pieces of
segments seen before come from a bounded cache. Decoding joins the pieces' surfaces as the library's decode(ids) does.

Defined cases: null text is empty text (begin and end ids only); the longest texts are encoded whole, by the task that reads
them; of two keys or symbols that start at a place the longer is taken; repeated rows are encoded each; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import arrow_map, texts

MARK = "▁"
#: A piece's type in the model file.
USER_DEFINED = 4


def fields(message: bytes) -> Iterator[tuple[int, int, bytes | int, int, int]]:
    """(number, wire type, value, begin, end) of a protobuf message's fields."""
    at, n = 0, len(message)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    while at < n:
        begin = at
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = message[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = message[at : at + size], at + size
        yield tag >> 3, kind, value, begin, at


def encoded_field(number: int, value: bytes | int) -> bytes:
    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


class CharMap:
    """A compiled character map: a Darts double array, then replacement strings that end in a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(length of the longest key that starts at `at`, its replacement)."""
        units, best = self.units, None
        if not units:
            return None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != text[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return best


class PieceCodec:
    def __init__(self, model: bytes, cache_size: int = 300_000) -> None:
        self.full = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec: dict[int, bytes | int] = {}
        bare, own = bytearray(), []
        for number, _, value, begin, end in fields(model):
            if number == 3:
                spec = {k: v for k, _, v, _, _ in fields(value)}
                continue
            if number == 1 and (piece := {k: v for k, _, v, _, _ in fields(value)}).get(3) == USER_DEFINED:
                own.append(piece[1])
            bare += model[begin:end]
        #: Symbols that pass before the map is asked; what a space in one becomes, a space elsewhere becomes too.
        self.own = re.compile(b"|".join(map(re.escape, sorted(own, key=len, reverse=True)))) if own else None
        bare += encoded_field(3, encoded_field(1, b"identity") + encoded_field(3, 0) + encoded_field(4, 0) + encoded_field(5, 1))
        self.map = CharMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.plain = not self.map.units and not self.squeeze and self.escape
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=bytes(bare))
        sp = self.full
        n = sp.get_piece_size()
        self.begin_id, self.end_id, self.unk_id = sp.bos_id(), sp.eos_id(), sp.unk_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [p for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        # Segments may end before a mark that follows another character, and around line ends, if no piece lies across.
        inner = any(MARK in p.lstrip(MARK) for p in normal)
        lines = any("\n" in p and len(p) > 1 for p in normal)
        self.segment = None if inner else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if lines else re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self.widths = np.array([0 if sp.is_control(i) else 1 if sp.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], dtype=np.int64)
        self.surfaces = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.marked = [p.startswith(MARK) and not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)) for i, p in enumerate(pieces)]
        self.bytes_fall_back = any(sp.is_byte(i) for i in range(n))
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size

    # Normalisation

    def normalise(self, text: bytes) -> tuple[str, np.ndarray | None]:
        """The normalised text, and for each of its bytes (and its end) the original byte; None where normalisation only marks spaces."""
        if self.plain:
            body = text.decode("utf-8", "replace").replace(" ", MARK)
            return (MARK + body if body and self.prefix else body), None
        out, source = bytearray(), []
        mark = MARK.encode() if self.escape else b" "
        at, n = 0, len(text)
        while self.squeeze and at < n and (first := self.prefix_at(text, at))[1] == b" ":
            at += first[0]
        if at == n:
            return "", np.array([n], dtype=np.int64)
        if self.prefix:
            out += mark
            source += [at] * len(mark)
        after_space = self.squeeze
        while at < n:
            size, piece = self.prefix_at(text, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                after_space = self.squeeze and piece.endswith(b" ")
                piece = piece.replace(b" ", mark)
                out += piece
                source += [at] * len(piece)
            at += size
        end = n
        while self.squeeze and out.endswith(mark):
            del out[len(out) - len(mark) :]
            end = source[len(out)]
            del source[len(out) :]
        return bytes(out).decode("utf-8", "replace"), np.array([*source, end], dtype=np.int64)

    def prefix_at(self, text: bytes, at: int) -> tuple[int, bytes]:
        """(bytes taken at a place, what they become)."""
        if self.own is not None and (symbol := self.own.match(text, at)):
            return symbol.end() - at, symbol.group()
        if hit := self.map.longest(text, at):
            return hit
        lead = text[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, text[at : at + size]

    def plain_alignment(self, text: bytes) -> np.ndarray:
        """The alignment where each space became a mark of three bytes."""
        raw = np.frombuffer(text, dtype=np.uint8)
        width = np.where(raw == 32, 3, 1)
        source = np.repeat(np.arange(len(raw), dtype=np.int64), width)
        return np.concatenate([np.zeros(3 if self.prefix and len(raw) else 0, dtype=np.int64), source, [len(raw)]])

    # Pieces

    def packed(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """The ids without begin and end, as little-endian unsigned 32-bit integers, and the alignment as in normalise()."""
        norm, source = self.normalise(text)
        if not norm:
            return b"", source
        cuts = self.segment.findall(norm) if self.segment else [norm]
        cache = self.cache
        try:
            return b"".join([cache[s] for s in cuts]), source
        except KeyError:
            pass
        if len(cache) > self.cache_size:
            cache.clear()
        new = [s for s in dict.fromkeys(cuts) if s not in cache]
        long = {s: np.array(x, dtype="<u4").tobytes() for s, x in zip(new, self.bare.encode(new, num_threads=1), strict=True)}
        cache.update((s, x) for s, x in long.items() if len(s) < 64)
        get = cache.get
        return b"".join([long[s] if (x := get(s)) is None else x for s in cuts]), source

    def encode(self, text: bytes, ends: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the begin and end of each id's span in the bytes of the text. A byte piece has its character's span."""
        body, source = self.packed(text)
        ids = np.frombuffer(body, dtype="<u4")
        if source is None:
            source = self.plain_alignment(text)
        norm_size = len(source) - 1
        if self.bytes_fall_back or not (ids == self.unk_id).any():
            stops = np.cumsum(self.widths[ids])
        else:
            stops = self.unknown_stops(text, ids)
        starts = np.concatenate([[0], stops[:-1]]) if len(ids) else stops
        begins, finish = source[starts], source[np.minimum(stops, norm_size)]
        same = finish <= begins
        if same.any():  # ends inside what one original character became
            later = np.searchsorted(source, begins, side="right")
            finish = np.where(same, source[np.minimum(later, norm_size)], finish)
        finish = np.where(np.concatenate([starts[1:], [norm_size]])[: len(ids)] >= norm_size, len(text), finish) if len(ids) else finish
        finish = self.whole_characters(text, begins, finish)
        if ends:
            n = len(text)
            ids = np.concatenate([[self.begin_id], ids, [self.end_id]]).astype(np.int64)
            begins, finish = np.concatenate([[0], begins, [n]]), np.concatenate([[0], finish, [n]])
        return ids.astype(np.int64), begins, finish

    def whole_characters(self, text: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Spans grow to character borders, begins in place."""
        if not len(begins):
            return ends
        raw = np.concatenate([np.frombuffer(text, dtype=np.uint8), [0]])
        inside = (raw & 0xC0) == 0x80
        if inside.any():
            where = np.arange(len(raw))
            lead = np.maximum.accumulate(np.where(inside, 0, where))
            following = np.minimum.accumulate(np.where(inside, len(text), where)[::-1])[::-1]
            begins[:] = lead[begins]
            ends = following[ends]
        return ends

    def unknown_stops(self, text: bytes, ids: np.ndarray) -> np.ndarray:
        """Ends in normalised bytes where unknown pieces have no fixed width: taken from the library's pieces."""
        norm, _ = self.normalise(text)
        cuts = self.segment.findall(norm) if self.segment else [norm]
        return np.cumsum([len(p.encode()) for s in cuts for p in self.bare.encode(s, out_type=str)])

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids)."""
        ids = ids.tolist()
        parts = [self.surfaces[i] for i in ids]
        for at, i in enumerate(ids if self.prefix or self.squeeze else []):
            if self.marked[i]:  # a mark before any text is no space of it
                parts[at] = parts[at][1:]
                if parts[at] or not self.squeeze:
                    break
            elif parts[at]:
                break
        return b"".join(parts).decode("utf-8", "replace")


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """A codec for the model at a local path that every worker has (an installed package's file)."""
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = PieceCodec(f.read())
    return _codecs[path]


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text", out: tuple[str, str, str] = ("ids", "begins", "ends")) -> DataFrame:
    """docs with the ids of each text, begin and end ids included, and their byte spans."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = [codec(model_path).encode(t) for t in texts(batch, text_col)]
        return {name: pa.array([r[i] for r in rows], type=pa.list_(pa.int32())) for i, name in enumerate(out)}

    kind = T.ArrayType(T.IntegerType())
    df = docs.select(*[c for c in docs.columns if c not in out])
    return arrow_map(df, run, T.StructType([T.StructField(n, kind) for n in out]), df.columns)


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that the ids decode to; null ids decode to an empty text."""

    def run(batch: pa.RecordBatch) -> dict:
        return {out: [codec(model_path).decode(np.array(x or [], dtype=np.int64)) for x in batch.column(ids_col).to_pylist()]}

    df = df.select(*[c for c in df.columns if c != out])
    return arrow_map(df, run, T.StructType([T.StructField(out, T.StringType())]), df.columns)


def encode_digests(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """What encode_texts and decode_ids give, as digests, made where the ids are: n_tokens, ids_sha256, decoded_sha256, n_bytes_spanned."""
    from hashlib import sha256

    def run(batch: pa.RecordBatch) -> dict:
        tool = codec(model_path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "n_bytes_spanned": []}
        for text in texts(batch, text_col):
            ids, begins, ends = tool.encode(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha256(ids.astype("<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(sha256(tool.decode(ids).encode()).hexdigest())
            top = np.maximum.accumulate(ends)  # pieces of one character share its span
            out["n_bytes_spanned"].append(int(np.maximum(ends - np.maximum(begins, np.concatenate([[0], top[:-1]])), 0).sum()))
        return out

    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_bytes_spanned", T.LongType())])
    return arrow_map(docs, run, schema, keep)
