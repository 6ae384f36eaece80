"""SentencePiece ids that keep their place in the original text.

A text is normalised as the model's character map says: at every position the
longest prefix that the compiled map knows is replaced, else one character is
taken over, and each byte of the result remembers where in the original it
came from. The normalised text is cut where no piece of the vocabulary can
reach across (before a run of blanks, around characters that occur in no piece
such as line ends), so merges inside a stretch do not depend on its
neighbours. Stretches are encoded by the library once and remembered; each
piece is then projected through the alignment to its span of original bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tocsin.llm.arrow import Batches, raw, slices
from tocsin.llm.memo import Memo

BLANK = "▁".encode()  # the library's visible blank
CACHE_STRETCHES = 250_000
LONGEST_REMEMBERED = 64
ROWS = 500


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes and a pool of replacements.

    Layout of the blob: size of the trie in bytes (32 bits), the trie's units
    (32 bits each), then the replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix at a position, and what replaces it."""
        units, found = self.units, None
        node = _child(0, units[0])
        for n, byte in enumerate(text[at : at + 64], 1):
            unit = units[node := node ^ byte]
            if unit & 0x800000FF != byte:
                break
            node = _child(node, unit)
            if unit >> 8 & 1:
                found = n, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.pool[start : self.pool.index(b"\0", start)]


def _child(node: int, unit: int) -> int:
    return node ^ (unit >> 10 << ((unit & 0x200) >> 6))


def character_end(text: bytes, at: int) -> int:
    """Where the character that begins at a byte of valid UTF-8 ends."""
    lead = text[at]
    return at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)


class Normaliser:
    """Normalised text with one byte for a blank, and the original position of each of its bytes."""

    def __init__(self, spec, blank_last: bool = False):
        blob = spec.precompiled_charsmap
        self.map = CharacterMap(blob) if blob else None
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.blank_last = blank_last
        if not spec.escape_whitespaces:
            raise ValueError("models without visible blanks are not covered")

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """No alignment means that byte i + 1 of the result is byte i of the text."""
        if self.map is None and not self.squeeze and self.prefix and not self.blank_last and BLANK not in text:
            return (b" " + text if text else b""), None
        return self._aligned(text)

    def _prefix_at(self, text: bytes, at: int) -> tuple[int, bytes]:
        known = self.map.longest(text, at) if self.map else None
        if known:
            return at + known[0], known[1].replace(BLANK, b" ")
        end = character_end(text, at)
        own = text[at:end]
        return end, b" " if own == BLANK else own

    def _aligned(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, origin, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(text) and (step := self._prefix_at(text, at))[1] == b" ":
                at = step[0]
        if at == len(text):
            return b"", np.zeros(1, np.int64)
        if self.prefix and not self.blank_last:
            out += b" "
            origin.append(at)
        after_blank = self.squeeze
        while at < len(text):
            end, piece = self._prefix_at(text, at)
            if after_blank:
                piece = piece.lstrip(b" ")
            if piece:
                out += piece
                origin += [at] * len(piece)
                after_blank = self.squeeze and piece.endswith(b" ")
            at = end
        if self.squeeze:
            while out.endswith(b" "):
                at = origin.pop()
                out.pop()
        if self.prefix and self.blank_last:
            out += b" "
            origin.append(at)
        return bytes(out), np.array([*origin, at], np.int64)


class PieceEncoder:
    """Ids, spans and decoding of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kinds = model.SentencePiece
        if not model.trainer_spec.byte_fallback or any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("covered are models with byte pieces and without user-defined ones")
        self.normalise = Normaliser(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        normal = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
        visible = BLANK.decode()
        # What the cuts rely on: a blank only at the beginning of pieces, line ends in none.
        self.cuttable = (
            self.normalise.map is None
            and not self.normalise.squeeze
            and self.normalise.prefix
            and not self.normalise.blank_last
            and all(visible not in p.lstrip(visible) and "\n" not in p for p in normal)
        )
        self.stretch = re.compile(rb" +[^ \n]*|[^ \n]+|\n")
        self.surface: list[bytes] = []
        self.is_byte: list[bool] = []
        for p in model.pieces:
            byte = p.type == kinds.BYTE
            plain = p.piece.encode().replace(BLANK, b" ")
            hidden = p.type in (kinds.CONTROL, kinds.UNKNOWN)
            self.surface.append(bytes([int(p.piece[1:-1], 16)]) if byte else b"" if hidden else plain)
            self.is_byte.append(byte)
        self.unknown = self.library.unk_id()
        self.unknown_surface = model.trainer_spec.unk_surface.encode()
        self.length = np.array([len(s) for s in self.surface], np.int64)
        self.line_end = self._packed([self.library.piece_to_id("<0x0A>")])
        self.blank = self._packed([self.library.piece_to_id(visible)])
        self.known = Memo(self._stretch, CACHE_STRETCHES)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<i4").tobytes()

    def _stretch(self, part: bytes) -> bytes:
        """Ids of one stretch. The library puts a blank before what it encodes."""
        if part == b"\n":
            return self.line_end
        if part == b" ":
            return self.blank
        text = part.decode("utf-8", "replace")
        if text[0] == " ":
            return self._packed(self.library.encode(text[1:], num_threads=1))
        return self._packed(self.library.encode("\n" + text, num_threads=1)[2:])

    def encode(self, text: bytes) -> tuple[np.ndarray, bytes, np.ndarray | None]:
        """Ids, and the normalised text with its alignment."""
        plain, origin = self.normalise(text)
        if not plain:
            return np.empty(0, "<i4"), plain, origin
        if self.cuttable:
            parts = self.stretch.findall(plain)
            if max(map(len, parts)) <= LONGEST_REMEMBERED:
                packed = self.known.all(parts)
            else:
                packed = [self.known(p) if len(p) <= LONGEST_REMEMBERED else self._stretch(p) for p in parts]
            return np.frombuffer(b"".join(packed), "<i4"), plain, origin
        return np.array(self.library.encode(text.decode("utf-8", "replace"), num_threads=1), "<i4"), plain, origin

    def spans(self, ids: np.ndarray, plain: bytes, origin: np.ndarray | None) -> np.ndarray:
        """First byte and end of every piece in the original text; a blank that was put in front is empty."""
        ends = np.cumsum(self.length[ids])
        if len(ids) and ends[-1] != len(plain):
            raise ValueError("pieces do not cover the normalised text")
        bounds = np.append(0, ends)
        places = np.maximum(bounds - 1, 0) if origin is None else origin[bounds]
        return np.stack([places[:-1], places[1:]], axis=1)

    def decode(self, ids: list[int]) -> bytes:
        """Text of ids: blanks for visible blanks, the first one dropped, runs of byte pieces as UTF-8."""
        surface = self.surface
        if self.unknown in ids:
            surface = list(surface)
            surface[self.unknown] = self.unknown_surface
        text = b"".join([surface[i] for i in ids])
        try:
            text.decode()
        except UnicodeDecodeError:
            text = self._replaced(ids, surface)
        first = next((i for i in ids if surface[i]), self.unknown)
        plain = first != self.unknown and not self.is_byte[first] and surface[first][:1] == b" "
        return text[1:] if plain and (self.normalise.prefix or self.normalise.squeeze) else text

    def _replaced(self, ids: list[int], surface: list[bytes]) -> bytes:
        """Every byte of a run of byte pieces that begins no character becomes the replacement character."""
        out, run = bytearray(), bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += surface[i]
                continue
            at = 0
            while at < len(run):
                end = character_end(run, at)
                try:
                    bytes(run[at:end]).decode()
                except UnicodeDecodeError:
                    out += "�".encode()
                    at += 1
                else:
                    out += run[at:end]
                    at = end
            run.clear()
            if i is not None:
                out += surface[i]
        return bytes(out)


@cache
def piece_encoder(path: str) -> PieceEncoder:
    """One per Python worker."""
    return PieceEncoder(path)


def _encode(model: str):
    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model)
        for batch in batches:
            for part in slices(batch, ROWS):
                ids, spans, decoded = [], [], []
                for text in raw(part.column(1)):
                    own, plain, origin = encoder.encode(text)
                    ids.append(own)
                    spans.append(encoder.spans(own, plain, origin).astype("<u4").tobytes())
                    decoded.append(encoder.decode(own.tolist()))
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else [], pa.int32())),
                        pa.array(spans, pa.binary()),
                        pa.array(decoded, pa.binary()).cast(pa.string()),
                    ],
                    ["key", "ids", "spans", "decoded"],
                )

    return task


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the key, ``ids``, ``spans`` and ``decoded``.

    ``ids`` are the library's, without begin or end ids and without sampling.
    ``spans`` packs the first byte and the end of every piece in the original
    text as little-endian unsigned 32-bit integers. ``decoded`` is the text of
    the ids. A null text is empty and has no ids. Rows are encoded one by one,
    so repeated rows and null keys stay as they are; other columns are not
    read. An empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()
    done = docs.select(key, text).mapInArrow(_encode(model), f"key {kind}, ids array<int>, spans binary, decoded string")
    return done.withColumnRenamed("key", key)
