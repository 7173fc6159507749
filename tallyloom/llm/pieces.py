"""Encoding and decoding with a SentencePiece model, with the source bytes of every piece.

Normalisation: at each place the longest prefix that the model's compiled
character map holds is replaced, other characters stay.  Each normalised
character records the source byte at which its prefix began, so a piece,
which is a range of normalised characters, is projected to the range of
source bytes it came from.  A model without a map keeps all characters, and
the record is the places of the characters.

Pieces: a copy of the model without rules of normalisation joins normal text
into pieces; characters that are no piece become their bytes.

Spans: [start, end) bytes of the text.  Of the byte pieces of one character
the last has its bytes, the others are empty where it begins; the end id is
empty behind the text.  Otherwise spans follow each other without a gap.

Scale: a scan; texts are cut nowhere and shuffled never.  Memory follows the
longest text, some tens of bytes a token.

Defined results: null and empty texts give the end id alone; texts of any
length are encoded whole; repeated rows give equal rows; an empty table gives
an empty result.  Models with user-defined or unused pieces, without byte
pieces, or with blank marks as suffixes are refused.  Other columns are
dropped unless in ``keep``, and results take ``prefix`` before their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import carried, named, schema_of, ship, small_batches

#: What stands for a blank in pieces.
MARK = "▁"
#: Fixed values of the model file: kinds of pieces.
USER, UNUSED, BYTE = 4, 5, 6


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 bytes, then replacements that end in a zero byte."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes replaced) of the longest prefix of data from ``at`` on, or None."""
        units, found, node = self.units, None, self._down(0)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start = found[0]
        return self.strings[start : self.strings.index(b"\0", start)], found[1]

    def _down(self, node: int) -> int:
        return node ^ self._jump(self.units[node])

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Normaliser:
    """Texts to normalised characters and the source byte of each."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool):
        self.map = CharMap(charsmap) if charsmap else None
        self.dummy_prefix = dummy_prefix
        self.squeeze = squeeze

    def run(self, text: str) -> tuple[str, np.ndarray]:
        """(normal form with marks for blanks, source byte of each of its characters and of its end)."""
        raw = text.encode()
        if self.map is None and not self.squeeze:
            if not raw:
                return "", np.zeros(1, dtype=np.int64)
            places = np.arange(len(raw) + 1) if len(raw) == len(text) else np.append(np.flatnonzero((np.frombuffer(raw, dtype=np.int8) & -64) != -128), len(raw))
            if not self.dummy_prefix:
                return text.replace(" ", MARK), places
            return MARK + text.replace(" ", MARK), np.concatenate(([0], places))
        return self._mapped(raw)

    def _prefix(self, raw: bytes, at: int) -> tuple[str, int]:
        found = self.map.longest(raw, at) if self.map else None
        if found:
            return found[0].decode(), found[1]
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return raw[at : at + size].decode(), size

    def _mapped(self, raw: bytes) -> tuple[str, np.ndarray]:
        out: list[str] = []
        source: list[int] = []
        at, end = 0, len(raw)
        while self.squeeze and at < end:
            new, size = self._prefix(raw, at)
            if new != " ":
                break
            at += size
        if at == end:
            return "", np.zeros(1, dtype=np.int64)
        if self.dummy_prefix:
            out.append(MARK)
            source.append(at)
        blank = self.squeeze
        while at < end:
            new, size = self._prefix(raw, at)
            if blank:
                new = new.lstrip(" ")
            if new:
                out += new
                source += [at] * len(new)
                blank = self.squeeze and new[-1] == " "
            at += size
        while self.squeeze and out and out[-1] in (" ", MARK):
            out.pop()
            at = source.pop()
        return "".join(out).replace(" ", MARK), np.array([*source, at])


class PieceEncoder:
    """encode_batch(texts) gives ids, and the source bytes of each."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        if USER in kinds or UNUSED in kinds or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model has pieces or blank marks of a kind that is not read here")
        self.library = SentencePieceProcessor(model_file=path)
        self.end = self.library.eos_id()
        rule = model.normalizer_spec
        self.normaliser = Normaliser(rule.precompiled_charsmap, rule.add_dummy_prefix, rule.remove_extra_whitespaces)
        # Runs are normal already: the same model without rules of its own joins their pieces.
        rule.precompiled_charsmap, rule.normalization_rule_tsv = b"", ""
        rule.add_dummy_prefix, rule.remove_extra_whitespaces, rule.escape_whitespaces = False, False, True
        self.merger = SentencePieceProcessor()
        self.merger.LoadFromSerializedProto(model.SerializeToString())
        byte_ids = [i for _, i in sorted((int(p.piece[1:-1], 16), i) for i, p in enumerate(model.pieces) if p.type == BYTE)]
        #: Characters of each id's piece, and whether it is a byte, and one that goes on a character.
        self.length = np.array([len(p.piece) for p in model.pieces], dtype=np.int64)
        self.is_byte, self.goes_on = np.zeros((2, len(self.length)), dtype=bool)
        self.is_byte[byte_ids] = True
        self.goes_on[byte_ids[0x80:0xC0]] = True
        self.length[self.is_byte] = 0

    def encode_batch(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text, the end id last."""
        normal = [self.normaliser.run(t or "") for t in texts]
        joined = self.merger.encode([n for n, _ in normal], return_type="numpy", num_threads=1)
        out = []
        for text, ids, (_, source) in zip(texts, joined, normal):
            size = self.length[ids]
            is_byte = self.is_byte[ids]
            if is_byte.any():
                # Of a character's bytes the last has it: the one that no byte goes on.
                size[is_byte] = ~np.append(self.goes_on[ids[1:]], False)[is_byte]
            ends = np.cumsum(size)
            behind = len((text or "").encode())
            out.append((np.append(ids, self.end), np.append(source[ends - size], behind), np.append(source[ends], behind)))
        return out


_open: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process."""
    if path not in _open:
        _open[path] = PieceEncoder(path)
    return _open[path]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """(doc_id, ids, starts, ends, kept columns): pieces of each text with an end id, and their bytes in the text.

    model: the path of a SentencePiece model file that all executors can read.
    """
    ship(docs.sparkSession)
    own = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"), *carried(docs, keep))
    schema = schema_of(own, "ids array<int>, starts array<int>, ends array<int>", keep, prefix)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(model)
        for batch in small_batches(batches, 500, 1_000_000):
            rows = tokens.encode_batch(batch.column("text").to_pylist())
            lists = [_lists([r[k] for r in rows]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, *[batch.column(i) for i in range(2, batch.num_columns)]], names=names)

    return own.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text that the library's decode(ids) gives; null ids give null."""
    ship(rows.sparkSession)
    schema = rows.select("*").schema.add(out, "string")
    at = rows.columns.index(ids_col)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(model).library
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [None if ids is None else library.decode(ids.values.to_numpy()) for ids in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return rows.mapInArrow(run, schema)
