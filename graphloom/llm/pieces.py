"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A block's distinct words, marked with the space before them, are sorted; so neighbours share prefixes, and
going through them in order, with a stack of forward states, is a depth-first walk of their trie in which
the states of a common prefix are made once.

For a unigram model a prefix's state is its best score and the start of its last piece.  For a BPE model the
best path is the one that merging gives, and it too is fixed prefix by prefix: the last piece of a prefix is
the one whose predecessor path exists and which merging would not join or cut differently with the piece
before.  So the same walk returns exactly the ids of the library for BPE models; for unigram models, scores
are added up word by word in double precision, where the library adds up single floats over a whole text, so
paths of equal or nearly equal score can differ.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, text_rows

MARK = "▁"


class Codec:
    """Encodes and decodes with a SentencePiece model file whose normalization is the identity, with a space put first."""

    def __init__(self, path: str, most: int = 500_000):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        rules, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalization with a space put first is known")
        self.bpe = proto.trainer_spec.model_type == 2
        if not self.bpe and proto.trainer_spec.model_type != 1:
            raise ValueError("neither a unigram nor a BPE model")
        self.names = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.bytes_ = [i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE]
        self.longest = max(map(len, self.ids), default=1)
        self._floor = min(self.scores.values(), default=0.0) - 10
        self._chars = {c for c in self.ids if len(c) == 1}
        inside = [x for x in self.ids if MARK in x.lstrip(MARK)]
        if inside:
            raise ValueError("pieces reach over spaces")
        self._joins: dict[int, bool] = {}
        # by a text's last four letters, or fewer at its start, the lengths of pieces it can end with, longest first
        self._ends: dict[str, tuple[int, ...]] = {}
        tails: dict[str, set[int]] = {}
        for x in self.ids:
            for n in range(1, min(4, len(x)) + 1):
                tails.setdefault(x[-n:], set()).add(len(x))
        self._tails = tails
        shown = {x: self.names[x].replace(MARK, " ") for x in self.ids.values()}
        self._shown = [shown.get(i) for i in range(len(self.names))]
        self._words: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._most = most
        self.states = 0  # made so far, for tests of the sharing

    def _merge(self, text: str) -> list[str]:
        """Pieces by merging neighbours, the best score first, of equal ones the leftmost."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = self.scores.get(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def _follows(self, a: int, b: int) -> bool:
        """Whether merging leaves piece b, after piece a or (-1) at the start, as it is."""
        if len(self._joins) > 1_500_000:
            self._joins.clear()
        name = self.names[b]
        if a < 0:
            ok = len(name) == 1 or self._merge(name) == [name]
        else:
            ok = self._merge(self.names[a] + name) == [self.names[a], name]
        self._joins[a << 20 | b] = ok
        return ok

    def _lengths(self, tail: str) -> tuple[int, ...]:
        whole = {len(tail[k:]) for k in range(len(tail)) if tail[k:] in self.ids}
        longer = {n for n in self._tails.get(tail, ()) if n > len(tail)} if len(tail) == 4 else set()
        if len(self._ends) > 500_000:
            self._ends.clear()
        self._ends[tail] = got = tuple(sorted(whole | longer, reverse=True))
        return got

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes_[x] for x in char.encode()] if self.bytes_ else [self.unknown]

    def walk(self, words: Iterable[str]) -> Iterable[tuple[str, bytes]]:
        """words: sorted; yields each with its ids (little-endian 32 bits)."""
        return self._walk_bpe(words) if self.bpe else self._walk_unigram(words)

    def _walk_bpe(self, words: Iterable[str]) -> Iterable[tuple[str, bytes]]:
        get, joins, ends = self.ids.get, self._joins, self._ends
        # by length of the prefix: its last piece's id (-1: none yet, -2: no path ends here) and where that starts
        last, start, before = [-1], [0], ""
        for word in words:
            size = len(word)
            if word[0] not in self._chars:  # nothing of it is in the model
                yield word, array("I", [b for x in word for b in self._fallback(x)]).tobytes()
                continue
            n = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                n += 1
            del last[n + 1 :], start[n + 1 :]
            self.states += size - n
            for i in range(n + 1, size + 1):
                tail = word[i - 4 if i > 4 else 0 : i]
                if (lengths := ends.get(tail)) is None:
                    lengths = self._lengths(tail)
                for length in lengths:
                    j = i - length
                    if j < 0 or (p := get(word[j:i])) is None or (q := last[j]) == -2:
                        continue
                    ok = joins.get(q << 20 | p)
                    if ok is None:
                        ok = self._follows(q, p)
                    if ok:
                        last.append(p)
                        start.append(j)
                        break
                else:
                    last.append(-2)
                    start.append(i)
            out, i = [], size
            while i > 0:
                if last[i] == -2:
                    raise AssertionError(f"no path through {word!r}")
                out.append(last[i])
                i = start[i]
            out.reverse()
            before = word
            yield word, array("I", out).tobytes()

    def _walk_unigram(self, words: Iterable[str]) -> Iterable[tuple[str, bytes]]:
        ids, scores, before = self.ids, self.scores, ""
        # by length of the prefix: its score, the start of its last piece, that piece (None: not in the model)
        stack: list[tuple[float, int, str | None]] = [(0.0, 0, None)]
        for word in words:
            n = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                n += 1
            del stack[n + 1 :]
            self.states += len(word) - n
            for i in range(n + 1, len(word) + 1):
                state = None
                for j in range(max(0, i - self.longest), i):
                    piece = word[j:i]
                    if piece in ids and (state is None or stack[j][0] + scores[piece] > state[0]):
                        state = (stack[j][0] + scores[piece], j, piece)
                if word[i - 1] not in self._chars and (state is None or stack[i - 1][0] + self._floor > state[0]):
                    state = (stack[i - 1][0] + self._floor, i - 1, None)
                stack.append(state)
            out: list[list[int]] = []
            i = len(word)
            while i > 0:
                _, j, piece = stack[i]
                out.append(self._fallback(word[j:i]) if piece is None else [ids[piece]])
                i = j
            before = word
            yield word, array("I", [x for part in reversed(out) for x in part]).tobytes()

    def split(self, text: str) -> list[str]:
        """Marked words; letters the model has no piece for stand apart, as merging never reaches over them."""
        if not text:
            return []
        return [x for x in _words(self._chars).split(MARK + text.replace(" ", MARK)) if x]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts (little-endian 32 bits); words of all texts go through one walk."""
        split = [self.split(t) for t in texts]
        known = self._words
        new = {w for words in split for w in words if w not in known}
        for w in new & self._old.keys():
            known[w] = self._old[w]
            new.discard(w)
        known.update(self.walk(sorted(new)))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        if len(known) > self._most:
            self._old, self._words = known, {}
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 give U+FFFD."""
        try:  # no bytes, no special pieces
            text = "".join(map(self._shown.__getitem__, array("I", ids)))
            return text[1:] if text.startswith(" ") else text
        except TypeError:
            pass
        out, raw = [], bytearray()
        first = {x: k for k, x in enumerate(self.bytes_)}
        for x in array("I", ids):
            if x in first:
                raw.append(first[x])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.names[x] if self.kinds[x] in (1, 4) else " ⁇ " if x == self.unknown else "")
        if raw:
            out.append(raw.decode(errors="replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_patterns: dict[int, re.Pattern] = {}


def _words(chars: set[str]) -> re.Pattern:
    if id(chars) not in _patterns:
        rest = "".join(map(re.escape, sorted(chars - {MARK})))
        _patterns[id(chars)] = re.compile(f"({MARK}*[{rest}]+|{MARK}+)")
    return _patterns[id(chars)]


_codecs: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids (little-endian unsigned 32 bits), ids_crc32, round_trip (decoding gives the text) of every row.

    Null and empty text: no pieces.  A text with U+2581 decodes to spaces, so doesn't round-trip.  Null
    doc_id, ties and repeated rows: encoded like any other.  Empty table: no rows; other columns are ignored.
    """

    def run(it):
        codec = codec_of(model)
        for b in batches(it, 2000):
            texts = b.column("text").to_pylist()
            got = codec.encode(texts)
            back = [codec.decode(x) == t for x, t in zip(got, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array(got, pa.binary()), pa.array([zlib.crc32(x) for x in got], pa.int64()), pa.array(back, pa.bool_())], names=["doc_id", "n_pieces", "ids", "ids_crc32", "round_trip"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_pieces long, ids binary, ids_crc32 long, round_trip boolean").select("doc_id", F.col("n_pieces"), "ids", "ids_crc32", "round_trip")
