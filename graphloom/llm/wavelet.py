"""Token ids as wavelet matrices: one compressed file per shard with access, counting and occurrence lookup.

A shard holds the ids of whole documents in document order.  Level by level, from the most significant
bit, the sequence is split stably by that bit; the bits of each level are kept in blocks, each its own
zstandard frame, and a directory has each block's place and the number of ones before it.  So rank and
select read one block per level and the directory only.

    magic | blocks of level 0 | blocks of level 1 | ... | directory (zstd) | its length (8 bytes) | magic
"""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, open_fs, put_file, scratch, stored, text_rows, width

MAGIC = b"GLWM0001"
BLOCK_BITS = 1 << 18


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of a shard: ids of all its documents in order, and each document's number of ids."""
    ids = np.asarray(ids, np.uint32)
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    s = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    pack, out, place = zstandard.ZstdCompressor(level=1), [MAGIC], len(MAGIC)
    zeros, sizes, ones = [], [], []
    for level in range(levels - 1, -1, -1):
        m = (s & s.dtype.type(1 << level)) != 0
        for k in range(0, len(m), BLOCK_BITS):
            part = m[k : k + BLOCK_BITS]
            out.append(frame := pack.compress(np.packbits(part).tobytes()))
            sizes.append(len(frame))
            ones.append(int(np.count_nonzero(part)))
        ones_here = np.compress(m, s)
        zeros.append(len(s) - len(ones_here))
        s[: zeros[-1]] = np.compress(~m, s)
        s[zeros[-1] :] = ones_here
    head = io.BytesIO()
    np.savez(
        head,
        shape=np.array([len(ids), levels, BLOCK_BITS], np.int64),
        zeros=np.array(zeros, np.int64),
        sizes=np.array(sizes, np.int64),
        ones=np.array(ones, np.int64),
        doc_ids=np.array([x or 0 for x in doc_ids], np.int64),
        no_id=np.array([x is None for x in doc_ids], bool),
        lengths=np.array(lengths, np.int64),
    )
    out.append(frame := pack.compress(head.getvalue()))
    return b"".join([*out, struct.pack("<Q", len(frame)), MAGIC])


class Shard:
    """Reads a shard's file; queries touch the directory and one block per level."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self._file = fs.open_input_file(path)
        end = self._file.size()
        size, magic = struct.unpack("<Q8s", self._file.read_at(16, end - 16))
        if magic != MAGIC or self._file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no token file, or only part of one")
        head = np.load(io.BytesIO(zstandard.decompress(self._file.read_at(size, end - 16 - size))))
        self.n, self.levels, self.block = map(int, head["shape"])
        self.zeros, self.lengths = head["zeros"], head["lengths"]
        self.doc_ids = [None if no else int(x) for x, no in zip(head["doc_ids"], head["no_id"], strict=True)]
        per = -(-self.n // self.block)
        self._places = (len(MAGIC) + np.concatenate(([0], np.cumsum(head["sizes"])))).astype(np.int64)
        self._per = per
        ones = head["ones"].reshape(self.levels, per) if self.n else np.zeros((self.levels, 0), np.int64)
        self._before = np.concatenate((np.zeros((self.levels, 1), np.int64), np.cumsum(ones, axis=1)), axis=1)
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    def _bits(self, level: int, b: int, keep: bool = True) -> np.ndarray:
        if (got := self._kept.get((level, b))) is None:
            k = level * self._per + b
            raw = zstandard.decompress(self._file.read_at(int(self._places[k + 1] - self._places[k]), int(self._places[k])))
            got = np.unpackbits(np.frombuffer(raw, np.uint8), count=min(self.block, self.n - b * self.block))
            if keep:
                if len(self._kept) >= 64:
                    self._kept.pop(next(iter(self._kept)))
                self._kept[level, b] = got
        return got

    def _rank1(self, level: int, i: int) -> int:
        b, rest = divmod(i, self.block)
        return int(self._before[level, b]) + (int(np.count_nonzero(self._bits(level, b)[:rest])) if rest else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of the level."""
        before = self._before[level] if bit else np.minimum(np.arange(self._per + 1) * self.block, self.n) - self._before[level]
        b = int(np.searchsorted(before, k, "right")) - 1
        return b * self.block + int(np.flatnonzero(self._bits(level, b) == bit)[k - int(before[b])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        got = 0
        for level in range(self.levels):
            bit = int(self._bits(level, i // self.block)[i % self.block])
            ones = self._rank1(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            got = got << 1 | bit
        return got

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the id occurs at places lo to hi - 1."""
        hi = self.n if hi is None else min(hi, self.n)
        a, b = self._range(token, min(max(lo, 0), hi), hi) if hi > 0 else (0, 0)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """The place of its k-th occurrence, from 0."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order: the splits are undone from the last level up."""
        s = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            m = np.concatenate([self._bits(level, b, False) for b in range(self._per)]).astype(bool) if self.n else np.zeros(0, bool)
            up = np.empty_like(s)
            zeros = int(self.zeros[level])
            up[np.flatnonzero(~m)] = s[:zeros]
            up[np.flatnonzero(m)] = s[zeros:] | s.dtype.type(1 << (self.levels - 1 - level))
            s = up
        return s.astype(np.uint32)

    def close(self) -> None:
        self._file.close()


class _Chunks(dict):
    """Ids of the chunks between spaces and line ends, as the tokenizer gives them, two generations deep.

    The tokenizer's normalizer composes, folds white space and lower-cases letter by letter and its
    pre-tokenizer drops white space, so a chunk's ids don't depend on what stands around it.  Where letters
    are a token of their own, points after them are looked up apart, and words of Latin letters, which
    composing leaves as they are, go to the tokenizer's model at once.
    """

    def __init__(self, path: str, most: int):
        super().__init__()
        from tokenizers import Tokenizer

        self._tok, self._most, self._old = Tokenizer.from_file(path), most, {}
        said = json.loads(self._tok.to_str())
        steps = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        letters = len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and steps[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        lower = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.plain = letters and lower and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and said["model"]["type"] == "BPE"
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE shows as themselves
        rest = [x for x in range(256) if x not in shown]
        self._bytes = {x: chr(256 + k) for k, x in enumerate(rest)}

    def __missing__(self, chunk: str) -> bytes:
        if (got := self._old.get(chunk)) is None:
            got = self._ids(chunk) if chunk else b""
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        self[chunk] = got
        return got

    def _ids(self, chunk: str) -> bytes:
        if self.plain:
            core = chunk.rstrip(".,")
            key = core.lower()
            if key.isalpha() and max(key) < "\u0250" and max(core) < "\u0250":
                if key != chunk:
                    return self[key] + self[chunk[len(core) :]]
                shown = key if key.isascii() else key.encode().decode("latin-1").translate(self._bytes)
                return array("I", [x.id for x in self._tok.model.tokenize(shown)]).tobytes()
        return array("I", self._tok.encode(chunk, add_special_tokens=False).ids).tobytes()


_chunks: dict[tuple[str, int], _Chunks] = {}


def chunks_of(path: str, most: int) -> _Chunks:
    """A worker keeps what it has learnt from one task to the next."""
    if (path, most) not in _chunks:
        _chunks.clear()
        _chunks[path, most] = _Chunks(path, most)
    return _chunks[path, most]


# Latin-1: points and commas; letters, numbers and spaces; all others, which would be one token with a point behind
_CLASSES = bytes(ord("." if c in ".," else "a" if c.isalnum() or c in " \t\n\x0b\x0c\r\x85\xa0" else "!") for c in map(chr, range(256)))


def _plain(text: str) -> bool:
    """Whether points and commas of a text in Latin-1 follow letters, numbers or spaces only."""
    try:
        kinds = text.encode("latin-1").translate(_CLASSES)
    except UnicodeEncodeError:
        return False
    return b"!." not in kinds and b".." not in kinds and "<|" not in text


def tokens_of(texts: Iterable[str], chunks: _Chunks, end: int) -> Iterator[bytes]:
    """Little-endian unsigned 32-bit ids of each text, with the end id."""
    last, of = struct.pack("<I", end), chunks.__getitem__
    for x in texts:
        x = x.replace("\n", " ")
        if chunks.plain and _plain(x):
            # lower-cased as a whole, and points and commas as chunks of their own, so fewer chunks differ
            x = x.lower().replace(", ", " , ").replace(". ", " . ")
        yield b"".join(map(of, x.split(" "))) + last


def encode_shards(docs: DataFrame, tokenizer: str, out_dir: str | None = None, end: int = 1, shard_tokens: int = 8_000_000, cache: int = 500_000) -> DataFrame:
    """Encode every whole text and write wavelet shards in ascending doc_id order; returns the manifest.

    tokenizer: a file of the tokenizers library.  shard_tokens bounds a shard (one longer document makes a
    shard of its own), cache the chunks whose ids a worker remembers.  Manifest: part, k (order of the
    shards), uri, n_docs, n_tokens, start (ids of all shards before).  Null text: empty, only the end id.
    Null doc_id: first.  Repeated rows stay, ordered by text.  No rows: no shard.  Other columns are ignored.
    """
    spark = docs.sparkSession
    out = out_dir or scratch(spark, "tokens")

    def write(it):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, chunks, k = TaskContext.get().partitionId(), chunks_of(tokenizer, cache), 0
        got: list[bytes] = []
        of: list[int | None] = []
        total = 0

        def flush():
            nonlocal k, total
            uri = f"{out}/part-{part:06d}-{k:05d}.wm"
            put_file(uri, build(np.frombuffer(b"".join(got), "<u4"), of, [len(x) // 4 for x in got]))
            row = pa.RecordBatch.from_pydict({"part": [part], "k": [k], "uri": [uri], "n_docs": [len(of)], "n_tokens": [total]}, schema=schema)
            k, total = k + 1, 0
            got.clear()
            of.clear()
            return row

        schema = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        for b in batches(it, 500):
            for doc, ids in zip(b.column("doc_id").to_pylist(), tokens_of(b.column("text").to_pylist(), chunks, end), strict=True):
                if got and total + len(ids) // 4 > shard_tokens:
                    yield flush()
                got.append(ids)
                of.append(doc)
                total += len(ids) // 4
        if got:
            yield flush()

    rows = text_rows(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stored(rows.mapInArrow(write, "part int, k int, uri string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Read every document's ids back from the shards: doc_id, start, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids)."""

    def read(it):
        for b in it:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard = Shard(uri)
                raw = shard.ids().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                shard.close()
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(start + starts, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("uri", "start").repartition(width(manifest.sparkSession))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
