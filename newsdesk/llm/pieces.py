"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass per segment.

At each position the automaton's output links name the pieces that end there, longest first. In a unigram model the
pass relaxes the best score of the position over them (Viterbi). In a BPE model the pieces' scores are merge ranks,
whose sum means nothing; there a piece is reached where it follows the piece before it as merging alone would
leave the two, which holds for exactly one. Either way ids equal those of the SentencePiece library.

No piece of a supported model goes on past a word into a blank, so texts are cut before blanks and each distinct
segment is encoded once per Python worker; segments are told apart by a 64-bit hash. Characters without a piece
become bytes where the model has them, and the unknown piece else.

Results for odd input: a null or empty text has no ids and decodes to an empty text; rows with a null or repeated
``doc_id`` are encoded like any others; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from newsdesk.llm import arrays
from newsdesk.llm.storage import documents
from newsdesk.llm.word_tokens import Arena

BLANK = "▁"
MOST_SEGMENTS, MOST_PAIRS = 1_000_000, 500_000
"""Entries kept by one Python worker (some 200 MB); a store is emptied beyond."""
SEGMENT = regex.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
ONLY_BLANK = np.zeros(256, bool)
ONLY_BLANK[0x20] = True


class Pieces:
    """A SentencePiece model: a file of ``public_tokenizers`` or a path. Unigram and BPE, identity normal form."""

    def __init__(self, name: str):
        import public_tokenizers

        with open(name if "/" in name else public_tokenizers.path(name), "rb") as file:
            self._load(file.read())

    @classmethod
    @cache
    def of(cls, name: str) -> Pieces:
        """One store for all tasks of a Python worker."""
        return cls(name)

    @classmethod
    def parsed(cls, model: bytes) -> Pieces:
        out = cls.__new__(cls)
        out._load(model)
        return out

    def _load(self, model: bytes) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.bpe = proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only the identity normal form is supported")
        self.prefix = BLANK if spec.add_dummy_prefix else ""
        self.ids, self.scores, self.bytes = {}, [p.score for p in proto.pieces], {}
        self.decoded = [b""] * len(proto.pieces)
        automaton = ahocorasick.Automaton()
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                if BLANK in p.piece.lstrip(BLANK):
                    raise ValueError(f"a piece goes past a word: {p.piece!r}")
                self.ids[p.piece] = i
                automaton.add_word(p.piece, (len(p.piece), i))
                self.decoded[i] = p.piece.replace(BLANK, " ").encode()
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:-1], 16)] = i
                self.decoded[i] = bytes([int(p.piece[3:-1], 16)])
            elif p.type == kinds.UNKNOWN:
                self.unknown = i
                self.decoded[i] = (proto.trainer_spec.unk_surface or " ⁇ ").encode()
            elif p.type == kinds.USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
        automaton.make_automaton()
        self.automaton = automaton
        self.text = {i: p for p, i in self.ids.items()}
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.pairs: dict[int, bool] = {}
        self.keys, self.places, self.store = np.zeros(0, np.uint64), np.zeros(0, np.int64), Arena()

    def _merged(self, symbols: list[str]) -> list[str]:
        """Merge the best-scored neighbours, the leftmost of equals, while their join is a piece."""
        while True:
            best, at = -np.inf, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _follows(self, a: int, b: int) -> bool:
        """Whether merging leaves the two pieces as they are, side by side."""
        pair = a << 32 | b
        known = self.pairs.get(pair)
        if known is None:
            x, y = self.text[a], self.text[b]
            known = self._merged([*x, *y]) == [x, y]
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[pair] = known
        return known

    def segment(self, text: str) -> list[int]:
        """Ids of one segment in one pass of the automaton."""
        n = len(text)
        last, start = [-1] * (n + 1), [-1] * (n + 1)
        score = [-np.inf] * (n + 1)
        score[0], start[0], done = 0.0, 0, 0

        def alone(upto: int) -> None:
            """Positions that no piece reaches: a character of its own."""
            nonlocal done
            while done < upto:
                done += 1
                if self.bpe and start[done] < 0 or not self.bpe and text[done - 1] not in self.ids and score[done - 1] + self.unknown_score > score[done]:
                    score[done], start[done], last[done] = score[done - 1] + self.unknown_score, done - 1, -1

        for end, (size, piece) in self.automaton.iter(text):
            end += 1
            begin = end - size
            alone(end - 1)
            if self.bpe:
                if start[end] < 0 and (last[begin] < 0 or self._follows(last[begin], piece)):
                    start[end], last[end] = begin, piece
            elif score[begin] + self.scores[piece] > score[end]:
                score[end], start[end], last[end] = score[begin] + self.scores[piece], begin, piece
        alone(n)
        out: list[int] = []
        while n:
            piece, begin = last[n], start[n]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[begin:n].encode())]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            n = begin
        return out[::-1]

    def encode_text(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for s in SEGMENT.findall(self.prefix + text.replace(" ", BLANK)) for i in self.segment(s)]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all rows, and the rows' bounds among them."""
        raw, off = arrays.byte_view(text)
        words = arrays.Words(raw, off, False, ONLY_BLANK)
        count, size = np.diff(words.bounds), np.diff(off)
        blanks = np.concatenate([[0], np.cumsum(raw == 0x20)])
        plain = (np.diff(blanks[off]) == count - 1) & bool(self.prefix)
        keys = words.hashes()
        _, known = self._find(keys)
        wanted = ~known & plain[words.row]
        if wanted.any():
            new, first = np.unique(keys[wanted], return_index=True)
            if len(self.keys) + len(new) > MOST_SEGMENTS:
                self.keys, self.places, self.store = np.zeros(0, np.uint64), np.zeros(0, np.int64), Arena()
                new, first = np.unique(keys[plain[words.row]], return_index=True)
                wanted = plain[words.row]
            first = np.flatnonzero(wanted)[first]
            data = raw.tobytes()
            found = [self.segment(BLANK + data[a:b].decode("utf-8", "replace")) for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
            place = self.store.add(np.array([i for x in found for i in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
            at = np.searchsorted(self.keys, new)
            self.keys, self.places = np.insert(self.keys, at, new), np.insert(self.places, at, np.arange(place, place + len(new)))
        of_plain = plain[words.row]
        at, _ = self._find(keys[of_plain])
        ids, bounds = self.store.take(self.places[at]) if len(at) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        sizes = np.bincount(words.row[of_plain], np.diff(bounds), minlength=len(size)).astype(np.int64)
        other = np.flatnonzero(~plain & (size > 0))
        if not len(other):
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        rest = [self.encode_text(raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")) for i in other]
        sizes[other] = [len(x) for x in rest]
        out = np.zeros(sizes.sum(), np.uint32)
        mine = np.repeat(np.isin(np.arange(len(size)), other), sizes)
        out[~mine], out[mine] = ids, np.array([i for x in rest for i in x], np.uint32)
        return out, np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of a text from its ids."""
        text = b"".join(map(self.decoded.__getitem__, ids))
        return text[1:] if self.prefix and text[:1] == b" " else text


arrays.emptied_by(Pieces.of.cache_clear)


def encoded_batches(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    pieces = Pieces.of(model)
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            ids, bounds = pieces.encode(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), arrays.list_array(ids.astype(np.int32), bounds, pa.int32())], names=["doc_id", "ids"])


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs`` (``doc_id`` long, ``text`` string)."""
    return docs.select("doc_id", "text").mapInArrow(partial(encoded_batches, model=model), "doc_id long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    pieces = Pieces.of(model)
    for batch in batches:
        texts = [pieces.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, text`` of rows with ``doc_id`` and ``ids``."""
    return ids.select("doc_id", "ids").mapInArrow(partial(_decoded, model=model), "doc_id long, ids array<int>, text string")


def _both(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """Ids of each text with their checksum, and the hash of what they decode to."""
    pieces = Pieces.of(model)
    for batch in encoded_batches(batches, model):
        flat, ends = batch.column("ids").flatten().to_numpy(), batch.column("ids").offsets.to_numpy()
        data = flat.astype("<u4").tobytes()
        bounds = list(zip(ends.tolist(), ends[1:].tolist(), strict=False))
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in bounds]
        texts = [hashlib.sha256(pieces.decode(flat[a:b].tolist())).hexdigest() for a, b in bounds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), batch.column("ids"), pa.array(sums, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "ids_crc32", "decoded_sha256"])


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, decoded_sha256 string"
    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(partial(_both, model="piece_bpe_32k.model"), kinds)
