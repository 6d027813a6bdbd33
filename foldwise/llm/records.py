"""Token ids as length-delimited binary records, with an offset index beside each file.

A shard is a file of records, each framed as TFRecord frames them: the payload's length (8 bytes),
the masked CRC-32C of these bytes (4), the payload, its masked CRC-32C (4), all little-endian. A payload is
the document's ids as unsigned integers of 2 or 4 bytes, whichever the vocabulary needs. The index
`<shard>.idx` holds, per record, doc_id, a null flag, offset and number of ids as arrays of 8-byte
integers, so readers can go to records in any order.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table, trimmed, written
from .words import Pieces, slices, split_at

HEADER, FOOTER = 12, 4
_LANE = 64  # bytes of a lane in the checksum's parallel part


@cache
def _crc_tables() -> tuple[np.ndarray, list[int], list[list[int]]]:
    """CRC-32C by two bytes, by one as a list, and the effect of _LANE zero bytes on each byte of a checksum."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    state = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]).astype(np.uint32)
    for _ in range(_LANE):
        state = t[state & 0xFF] ^ (state >> 8)
    two = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(2):
        two = t[two & 0xFF] ^ (two >> 8)
    return two, t.tolist(), state.tolist()


def crc32c(data: bytes) -> int:
    """CRC-32C, byte by byte."""
    _, by, _ = _crc_tables()
    crc = 0xFFFFFFFF
    for b in data:
        crc = by[(crc ^ b) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def crc32c_many(blocks: list[bytes]) -> list[int]:
    """CRC-32C of many blocks at once. Each is padded in front to whole lanes, as zeros leave a zero
    state, its first four bytes inverted in place of the initial state; all lanes run side by side and
    those of a block are then joined by the zero-bytes operator."""
    t, _, (s0, s1, s2, s3) = _crc_tables()
    small = [len(b) < 4 for b in blocks]
    pads = [-len(b) % _LANE for b in blocks]
    data = np.frombuffer(b"".join(x for b, pad in zip(blocks, pads, strict=True) for x in (bytes(pad), b)), np.uint8).copy()
    lanes = [(len(b) + pad) // _LANE for b, pad in zip(blocks, pads, strict=True)]
    ends = np.cumsum(lanes, dtype=np.int64) * _LANE
    at = np.array([e - len(b) for e, b, few in zip(ends.tolist(), blocks, small, strict=True) if not few], np.int64)
    if len(at):
        data[at[:, None] + np.arange(4)] ^= 255
    state = np.zeros(len(data) // _LANE, np.uint32)
    for row in data.view("<u2").reshape(-1, _LANE // 2).T.copy():
        state = t[(state ^ row) & 0xFFFF] ^ (state >> 16)
    states, out, lo = state.tolist(), [], 0
    for block, n, few in zip(blocks, lanes, small, strict=True):
        crc = 0
        for x in states[lo : lo + n]:
            crc = s0[crc & 255] ^ s1[crc >> 8 & 255] ^ s2[crc >> 16 & 255] ^ s3[crc >> 24] ^ x
        lo += n
        out.append(crc32c(block) if few else crc ^ 0xFFFFFFFF)
    return out


def _mask(c: int) -> int:
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


@lru_cache(1 << 16)
def _header(n: int) -> bytes:
    """A record's length and its masked checksum."""
    return (head := struct.pack("<Q", n)) + struct.pack("<I", _mask(crc32c(head)))


def framed(payloads: list[bytes]) -> list[bytes]:
    return [b"".join((_header(len(p)), p, struct.pack("<I", _mask(c)))) for p, c in zip(payloads, crc32c_many(payloads), strict=True)]


def unframed(data: bytes | memoryview, offsets: list[int]) -> list[bytes]:
    """The payloads of the records at the offsets; ValueError where a length or checksum is wrong."""
    out, sums = [], []
    for at in offsets:
        (n,) = struct.unpack("<Q", data[at : at + 8])
        end = at + HEADER + n
        if bytes(data[at : at + HEADER]) != _header(n) or end + FOOTER > len(data):
            raise ValueError(f"the length at {at} is damaged")
        out.append(bytes(data[at + HEADER : end]))
        sums.append(struct.unpack("<I", data[end : end + FOOTER])[0])
    for at, wrong in zip(offsets, (_mask(c) != s for c, s in zip(crc32c_many(out), sums, strict=True)), strict=True):
        if wrong:
            raise ValueError(f"the record at {at} is damaged")
    return out


def store(path: str):
    """The file system of a path and the path in it; a store that pyarrow knows, shared by all."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))


# The pre-tokenizer's pattern that fast texts are split by here, in lower-cased Latin-1, where
# the library's Unicode classes come to these.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PARTS = re.compile(rf"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_NUMBERS}]+")
#: What keeps a text from that: characters beyond Latin-1's printable ones (in these, NFC changes nothing
#: and lower case is one character), and what may begin a special token.
_OTHER = re.compile("[^\t\n\x0b\x0c\r -~\xa1-\xff]|<\\|")
_PROBE = "It's WE'LL, \xc9t\xe9 (1\xb2)!? a_b\xa1x''s"


class WordEncoder:
    """Ids of whole texts by a tokenizer whose pre-tokenizer never joins across U+0020.

    Texts of Latin-1 characters are split as the pre-tokenizer splits them, and each new part is encoded
    once by the tokenizer's own model, many in one text, told apart by the ends of words that the model
    marks. Other texts, and all texts of tokenizers that don't split so, are parted at spaces; their new
    words are encoded whole, many in one text, kept apart by a special token, which the tokenizer splits off
    first; words that hold that token go alone.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark = next(((i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.normalized)), None)
        self.words = Pieces(self._encode_words)
        self.parts = None
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            self.core = Tokenizer(self.tokenizer.model)
            self.core.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.size, bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
            self.parts = Pieces(self._encode_parts, 250_000, 150_000)
            if self.parts([_PARTS.findall(_PROBE.lower())]) != [self._ids(_PROBE).tobytes()]:
                self.parts = None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(parts), 50):
            ids = np.array(self.core.encode_batch_fast([" ".join(parts[lo : lo + 50])], add_special_tokens=False)[0].ids, self.dtype)
            data, at = ids.tobytes(), 0
            for end in ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist():
                out.append(data[at:end])
                at = end
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        mark = self.mark and self.mark[1]
        found = {w: self._ids(w).tobytes() for w in words if not mark or mark in w}
        rest = [w for w in words if w not in found]
        for lo in range(0, len(rest), 50):
            part = rest[lo : lo + 50]
            ids = split_at(np.array(self.tokenizer.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, self.dtype), self.mark[0])
            found.update(zip(part, ids if len(ids) == len(part) else [self._ids(w).tobytes() for w in part], strict=True))
        return [found[w] for w in words]

    def __call__(self, texts: list[str]) -> list[bytes]:
        fast = [k for k, t in enumerate(texts) if self.parts and not _OTHER.search(t)]
        out = dict(zip(fast, self.parts([_PARTS.findall(texts[k].lower()) for k in fast]) if fast else [], strict=True))
        slow = [k for k in range(len(texts)) if k not in out]
        out.update(zip(slow, self.words([texts[k].split(" ") for k in slow]) if slow else [], strict=True))
        return [out[k] for k in range(len(texts))]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


MANIFEST = "shard string, width int, low long, high long, records long, ids long"


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every whole text and writes it in ascending order of ids; returns the manifest.

    Each range of ids is a shard. A shard's name is new for each attempt and only attempts that
    succeeded are in the manifest (a written table), so tries of lost executors are never read. The
    manifest has per shard its path, bytes of an id, least and greatest doc_id, numbers of records and ids.
    Null texts are empty, null doc_ids come first, repeated rows are all written; no rows write nothing.
    """

    @trimmed
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        path, out, index, at = f"{folder}/{uuid.uuid4().hex}.rec", None, [], 0
        for batch in batches:
            texts = batch.text.fillna("").tolist()
            ids, known = batch.id.tolist(), batch.known.tolist()
            for lo, hi in slices(texts):
                records = framed([payload + end for payload in encode(texts[lo:hi])])
                for k, record in zip(range(lo, hi), records, strict=True):
                    if out is None:
                        fs, inner = store(path)
                        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                        out = fs.open_output_stream(inner)
                    out.write(record)
                    index.append((ids[k], int(not known[k]), at, (len(record) - HEADER - FOOTER) // encode.dtype.itemsize))
                    at += len(record)
        if out is not None:
            out.close()
            columns = np.array(index, "<i8").T.copy()
            with fs.open_output_stream(inner + ".idx") as f:
                f.write(columns.tobytes())
            seen = columns[0][columns[1] == 0]
            yield pd.DataFrame({"shard": [path], "width": [encode.dtype.itemsize], "low": pd.array([seen.min() if len(seen) else pd.NA], "Int64"), "high": pd.array([seen.max() if len(seen) else pd.NA], "Int64"), "records": [len(index)], "ids": [columns[3].sum()]})

    # Whether an id is null goes beside it, for pandas would make integers with nulls floating.
    own = F.col(id_col).cast("long")
    rows = docs.select(own.isNotNull().alias("known"), F.coalesce(own, F.lit(0)).alias("id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("known", "id").sortWithinPartitions("known", "id", "text")
    return written(ordered.mapInPandas(write, MANIFEST), "manifest")


def read_index(shard: str) -> np.ndarray:
    """Rows doc_id, null flag, offset, number of ids."""
    fs, path = store(shard)
    with fs.open_input_stream(path + ".idx") as f:
        return np.frombuffer(f.read(), "<i8").reshape(4, -1)


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the shards, checksums verified.

    start counts the ids of all records before. Shards are read by as many tasks, in blocks.
    """
    before = Window.orderBy(F.col("low").asc_nulls_first(), F.col("high").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))  # a row per shard

    @trimmed
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, width, base in zip(batch.shard, batch.width, batch.base, strict=True):
                doc_id, null, offset, n = read_index(shard)
                fs, path = store(shard)
                start = base + np.r_[0, np.cumsum(n)[:-1]]
                ends = np.r_[offset[1:], offset[-1] + HEADER + n[-1] * width + FOOTER]
                with fs.open_input_file(path) as f:
                    lo = 0
                    while lo < len(n):
                        hi = max(lo + 1, int(np.searchsorted(ends, offset[lo] + (8 << 20), "right")))
                        f.seek(int(offset[lo]))
                        block = memoryview(f.read(int(ends[hi - 1] - offset[lo])))
                        payloads = unframed(block, (offset[lo:hi] - offset[lo]).tolist())
                        crc = [zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()) for p in payloads]
                        yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(doc_id[lo:hi].copy(), null[lo:hi] != 0), "start": start[lo:hi], "n_tokens": n[lo:hi], "ids_crc32": crc})
                        lo = hi

    parts = max(1, manifest.count())
    return based.repartition(parts, "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_records(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_records(write_records(docs, scratch(spark, "records"), tokenizer or public_tokenizers.path("word_bpe_49k.json")))
