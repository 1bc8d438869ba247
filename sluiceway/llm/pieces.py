"""SentencePiece encoding with byte offsets, and decoding.

Normalising walks the text by the longest prefix in the model's compiled character map (a double array of prefixes and
their replacements) and records for every normalised character the source bytes it came from. A dummy prefix, escaped
spaces and removed extra spaces follow the model's settings. Pieces are then cut in the normalised text by the model,
and each piece is projected through that record to its span of source bytes.

No piece of a model like the default one has a space mark after another character, so its merges never cross from a
word into the next space and a text's pieces are those of its words one after another. `Encoder` checks that of the
model; if it holds, words are encoded once and remembered (a bounded number of them), else texts are encoded whole.

Defined cases: a null text reads as empty (no ids, empty decoded text); repeated or null ids get one result per row; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from sluiceway.llm.common import Columns, map_slices, texts

MARK = "▁"
REMEMBERED = 150_000
BYTE_PIECE = re.compile(r"<0x[0-9A-F]{2}>\Z")
CHUNK = re.compile(r" *[^ ]+| +\Z")


class CharacterMap:
    """The compiled character map: 4 bytes with the size of the prefix array, the array, the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = array("I", blob[4:4 + size])
        self.replacements = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of `data` from `at`."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1]:end]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Normalizer:
    """Normalised text with the source span of each of its characters. Spaces stay spaces here; the marks are the model's."""

    def __init__(self, charsmap: bytes, add_prefix: bool, trim: bool):
        self.map, self.add_prefix, self.trim = CharacterMap(charsmap), add_prefix, trim
        self.identity = not self.map.units

    def steps(self, data: bytes):
        at = 0
        while at < len(data):
            known = self.map.longest(data, at)
            if known and known[0]:
                size, new = known
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at:at + size]
            yield at, at + size, new.decode("utf-8", "replace")
            at += size

    def __call__(self, text: str) -> tuple[str, list[int], list[int]]:
        chars: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        data = text.encode("utf-8", "surrogatepass")
        for start, end, new in self.steps(data):
            for c in new:
                c = " " if c == MARK else c
                if self.trim and c == " " and (not chars or chars[-1] == " "):
                    continue
                chars.append(c)
                starts.append(start)
                ends.append(end)
        if self.trim:
            while chars and chars[-1] == " ":
                chars.pop(), starts.pop(), ends.pop()
        if self.add_prefix and chars:
            chars, starts, ends = [" ", *chars], [0, *starts], [0, *ends]
        return "".join(chars), starts, ends


class Chunk:
    """A word with the spaces before it: its ids, the normalised bytes of its pieces, and its decoded text."""

    __slots__ = ("count", "decoded", "ids", "lengths")

    def __init__(self, ids: list[int], lengths: list[int], decoded: str):
        self.ids, self.count = ",".join(map(str, ids)), len(ids)
        self.lengths, self.decoded = np.array(lengths, np.int32).tobytes(), decoded


class Encoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        inner = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        self.by_word = spec.add_dummy_prefix and spec.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix and not inner and self.normalizer.identity and not spec.remove_extra_whitespaces
        # Normalised bytes of each piece, a space counted as one.
        self.widths = [1 if BYTE_PIECE.match(p.piece) else len(p.piece.replace(MARK, " ").encode()) for p in proto.pieces]
        self.known: dict[str, Chunk] = {}
        self.mark_id = self.model.piece_to_id(MARK)

    def learn(self, chunks: list[str]) -> None:
        if len(self.known) + len(chunks) > REMEMBERED:
            self.known.clear()
        plain = [c for c in chunks if c != " "]
        coded = self.model.encode([c[1:] for c in plain], num_threads=1)
        for c, ids, decoded in zip(plain, coded, self.model.decode(coded, num_threads=1)):
            self.known[c] = Chunk(ids, self.lengths(c, ids), " " + decoded)
        if len(plain) < len(chunks):
            self.known[" "] = Chunk([self.mark_id], [1], " ")

    def lengths(self, normal: str, ids: list[int]) -> list[int]:
        """Normalised bytes of the pieces of a text."""
        found = [self.widths[i] for i in ids]
        if sum(found) != len(normal.encode("utf-8", "surrogatepass")):
            # An unknown piece stands for characters of any width; only a model without byte pieces has them.
            plain = normal[1:] if self.normalizer.add_prefix else normal
            found = [len(p.replace(MARK, " ").encode()) for p in self.model.encode(plain, out_type=str)]
        return found

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " ":
            return [" " + w for w in text.split(" ")]
        return CHUNK.findall(" " + text.replace(MARK, " "))

    def digest(self, listed: list[str]) -> list[tuple[int, str, str, str]]:
        """(ids, comma-joined ids, digest of the pieces' source ends, decoded text) of each text."""
        if not self.by_word:
            return [self.plain(t) for t in listed]
        cut = [self.chunks(t) for t in listed]
        missing = {c for c in set(chain.from_iterable(cut)) if c not in self.known}
        if missing:
            if len(missing) + len(self.known) > REMEMBERED:
                missing = set(chain.from_iterable(cut))
            self.learn(sorted(missing))
        out = []
        for text, parts in zip(listed, cut):
            known = [self.known[c] for c in parts]
            lengths = np.frombuffer(b"".join([k.lengths for k in known]), np.int32)
            ends = self.project(text, np.cumsum(lengths, dtype=np.int64))
            out.append((
                sum([k.count for k in known]), ",".join([k.ids for k in known]), hashlib.sha256(ends.astype("<i8").tobytes()).hexdigest(),
                "".join([k.decoded for k in known])[1:],
            ))
        return out

    def project(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Ends of pieces in source bytes, from their ends in normalised bytes."""
        if self.normalizer.identity and self.normalizer.add_prefix and MARK not in text:
            return ends - 1
        normal, starts, stops = self.normalizer(text)
        widths = [len(c.encode("utf-8", "surrogatepass")) for c in normal]
        source = np.zeros(sum(widths) + 1, np.int64)
        at = 0
        for c, width, start, stop in zip(normal, widths, starts, stops):
            for k in range(1, width + 1):
                source[at + k] = start + k if stop - start == width and k < width else stop
            at += width
        return source[ends]

    def plain(self, text: str) -> tuple[int, str, str, str]:
        ids = self.model.encode(text)
        normal = self.normalizer(text)[0]
        ends = self.project(text, np.cumsum(self.lengths(normal, ids), dtype=np.int64)) if ids else np.zeros(0, np.int64)
        return len(ids), ",".join(map(str, ids)), hashlib.sha256(ends.astype("<i8").tobytes()).hexdigest(), self.model.decode(ids)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each piece, in bytes of the source text. A mark for the dummy prefix has no bytes."""
        ids = self.model.encode(text)
        if not ids:
            return []
        ends = self.project(text, np.cumsum(self.lengths(self.normalizer(text)[0], ids), dtype=np.int64)).tolist()
        return list(zip(ids, [0, *ends[:-1]], ends))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of ids, digests of the ids, of the pieces' source ends and of the decoded text."""

    def start():
        encoder = Encoder(model_path)

        def sha(text: str) -> str:
            return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

        def work(rows: Columns) -> Columns:
            found = encoder.digest(rows["text"])
            return {
                "doc_id": rows["doc_id"], "n_tokens": [f[0] for f in found], "ids_sha256": [sha(f[1]) for f in found],
                "decoded_sha256": [sha(f[3]) for f in found], "ends_sha256": [f[2] for f in found],
            }

        return work

    return map_slices(texts(docs, id_col, text_col), start, "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string,ends_sha256 string")
