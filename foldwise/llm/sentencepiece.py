"""SentencePiece models on the tokenizers library: the protobuf is parsed and its parts rebuilt.

Normaliser (character map, extra and dummy white space), the metaspace marker, unigram scores or merges
in the order of BPE scores, and byte fallback. `op2_sentencepiece` compares every whole text's ids with the
SentencePiece library's.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, trimmed
from .words import Pieces, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters that the tokenizer gets in one call; a longer text goes whole, in a call of its own.
AT_ONCE = 1 << 16


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + n]
        at += n


class Model:
    """What a SentencePiece model file holds. Field numbers and defaults are those of its public schema."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.unigram, self.byte_fallback, self.whitespace_suffix = True, False, False
        self.charsmap, self.dummy_prefix, self.remove_extra, self.escape = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0])
                self.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields(value))
                kind = spec.get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("only unigram and BPE models")
                self.unigram = kind == 1
                self.byte_fallback = bool(spec.get(35, 0))
                self.whitespace_suffix = bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(fields(value))
                self.charsmap = spec.get(2, b"")
                self.dummy_prefix, self.remove_extra, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if self.whitespace_suffix or any(kind == USER for *_, kind in self.pieces):
            raise ValueError("white space as suffix and user-defined pieces are not supported")


class Codec:
    """Encodes and decodes texts as the model does."""

    def __init__(self, path: str, threads: int = 2) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        self.path = path
        with open(path, "rb") as f:
            self.model = m = Model(f.read())
        self.vocab = {p: i for i, (p, *_) in enumerate(m.pieces)}
        unknown = next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN)
        if m.unigram:
            # Pieces that text never yields stay in their places with a score that no path takes.
            low = min((s for _, s, k in m.pieces if k == NORMAL), default=0.0) - 1e6
            scored = [(p, s if k in (NORMAL, BYTE) else low) for p, s, k in m.pieces]
            core = models.Unigram(scored, unknown, m.byte_fallback)
        else:
            core = models.BPE(self.vocab, self._merges(), unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if m.escape:
            steps.append(normalizers.Replace(" ", MARK))
        self.tokenizer.normalizer = normalizers.Sequence(steps)
        # Where no piece has a marker after another character, texts part there; and runs of markers
        # longer than the longest piece part from the left, as equal scores merge.
        runs = max((len(p) for p, _, k in m.pieces if k == NORMAL and set(p) == {MARK}), default=1)
        self.parts = m.escape and not any(MARK in p.lstrip(MARK) for p, _, k in m.pieces if k == NORMAL)
        if self.parts:
            long_run = f"{MARK}{{{runs}}}(?={MARK})|" if not m.unigram else ""
            self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{long_run}{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
        self.dtype = np.dtype("<i4")
        self.simple = self.parts and m.dummy_prefix and not m.charsmap and not m.remove_extra
        self.starts = np.array([p.startswith(MARK) for p, *_ in m.pieces])
        self.pieces = Pieces(self._words)

    def _merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces whose joint is a piece: by the joint's score, then the parts. Runs of
        markers share one score and grow from the left: the longest joint goes first among them."""
        normal = {p: s for p, s, k in self.model.pieces if k == NORMAL}
        found = [(-s, -len(p) if set(p) == {MARK} else len(p), self.vocab[p[:k]], self.vocab[p[k:]], p[:k], p[k:]) for p, s in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        return [x[4:] for x in sorted(found)]

    def _batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, encoded AT_ONCE characters at a time: encodings take many times the room of their ids."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"  # read at each call; another operator may have run in this worker
        out: list[bytes] = []
        for lo, hi in slices(texts, AT_ONCE):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts[lo:hi], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with its marker: many in one text, which part where a piece has the marker."""
        out: list[bytes] = []
        for ids in self._batch([" ".join(words[lo : lo + 50]) for lo in range(0, len(words), 50)]):
            at = np.flatnonzero(self.starts[np.frombuffer(ids, self.dtype)]) * self.dtype.itemsize
            out += [ids[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ids)], strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Where the model parts at single spaces and does nothing else to a text, each
        distinct word is encoded once (every word gets the marker that stands for the space before it);
        other texts go to the tokenizer whole, in multithreaded batches."""
        plain = [k for k, t in enumerate(texts) if self.simple and t and t[0] != " " and t[-1] != " " and "  " not in t and MARK not in t]
        out: list[bytes] = [b""] * len(texts)
        for k, ids in zip(plain, self.pieces([texts[k].split(" ") for k in plain]), strict=True):
            out[k] = ids
        rest = sorted({*range(len(texts))} - {*plain})
        for k, ids in zip(rest, self._batch([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return [np.frombuffer(x, self.dtype) for x in out]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids: pieces joined, bytes of fallback pieces as UTF-8, markers as spaces, the dummy prefix gone."""
        if not hasattr(self, "bytes_of"):
            kinds = {CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
            self.bytes_of = [kinds.get(k, lambda p: p.replace(MARK, " ").encode())(p) for p, _, k in self.model.pieces]
        out = []
        for x in ids:
            text = b"".join(map(self.bytes_of.__getitem__, x.tolist())).decode("utf-8", "replace")
            out.append(text.removeprefix(" ") if self.model.dummy_prefix else text)
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def with_ids(docs: DataFrame, model: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """`docs` with the ids of each whole text (array of int). Null and empty texts have none; repeated rows get
    equal ids, an empty table none; a column of the name `ids` is replaced."""
    docs = docs.drop(ids)
    schema = T.StructType([*docs.schema, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    at = docs.columns.index(text)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for whole in batches:
            texts = [t or "" for t in whole.column(at).to_pylist()]
            for lo, hi in slices(texts):
                found = c.encode(texts[lo:hi])
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*whole.slice(lo, hi - lo).columns, lists], names=schema.names)

    return docs.mapInArrow(run, schema)


def verified(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, parity, round_trip) of every whole text: parity with the SentencePiece
    library's ids, and whether decoding gives the text again."""

    @trimmed
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from sentencepiece import SentencePieceProcessor

        c, theirs = codec(model), SentencePieceProcessor(model_file=model)
        for batch in batches:
            texts = batch.text.fillna("").tolist()
            for lo, hi in slices(texts):
                part = texts[lo:hi]
                found = c.encode(part)
                yield pd.DataFrame({
                    "id": batch.id.iloc[lo:hi].to_numpy(), "n_tokens": [len(x) for x in found], "ids_crc32": [zlib.crc32(x.tobytes()) for x in found],
                    "parity": [np.array_equal(x, y) for x, y in zip(found, theirs.encode(part, num_threads=1), strict=True)],
                    "round_trip": [x == y for x, y in zip(c.decode(found), part, strict=True)],
                })

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")


def model_path(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"), model_path(model)).withColumnRenamed("id", "doc_id")
