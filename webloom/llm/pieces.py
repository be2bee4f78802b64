"""SentencePiece encoding and decoding: shared-prefix Viterbi over a trie of the distinct marked words.

The vocabulary file is a parameter and is only read. A model of type *unigram* takes the
segmentation of the greatest total score. In a model of type *BPE*, an adjacent pair of pieces has
score 0 if merging their joined text yields just these two pieces and minus infinity otherwise;
the one path that survives is the segmentation that the merges make, since a prefix of it is the
segmentation of that prefix. Either way a forward state belongs to a prefix of a word, so words
sorted as a trie and visited depth-first share the states of their common prefixes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import chunks

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words, and pairs of pieces, that a Python worker remembers before it starts anew.
REMEMBERED = 500_000
# Fixed values of the model format: kinds of models and of pieces, and the penalty of an unknown character.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message: integers, 4-byte and 8-byte strings, or byte strings."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class PieceModel:
    """A vocabulary file: pieces, scores, kinds and the way text is normalised."""

    def __init__(self, data: bytes):
        self.kind, self.byte_fallback, self.dummy_prefix, self.squeeze, charsmap = UNIGRAM, False, True, True, b""
        self.pieces, self.scores, self.kinds = [], [], []
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = b"", 0.0, NORMAL
                for n, v in _fields(value):
                    piece, score, kind = (v if n == 1 else piece), (struct.unpack("<f", v)[0] if n == 2 else score), (v if n == 3 else kind)
                self.pieces.append(piece.decode())
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                options = dict(_fields(value))
                self.kind, self.byte_fallback = options.get(3, UNIGRAM), bool(options.get(35, 0))
            elif number == 3:
                options = dict(_fields(value))
                self.dummy_prefix, self.squeeze, charsmap = bool(options.get(3, 1)), bool(options.get(4, 1)), options.get(2, b"")
        if charsmap or self.squeeze or self.kind not in (UNIGRAM, BPE) or USER_DEFINED in self.kinds:
            raise ValueError("only unigram and BPE models with identity normalisation and without user-defined pieces are supported")
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_fallback = self.byte_fallback and len(self.byte_id) == 256
        self.longest = max(map(len, self.id), default=1)
        self.known = {c for p in self.id for c in p}
        self.penalty = min((self.scores[i] for i in self.id.values()), default=0.0) - UNKNOWN_PENALTY
        # no piece holds a mark after another character, and none a line end: so words are cut before a run of marks, and at line ends
        cut_marks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        lines = "\n" not in self.known
        other = f"[^{MARK}" + "\n" * lines + "]"
        self.words = re.compile(f"\n|{MARK}*{other}+|{MARK}+" if lines else f"{MARK}*{other}+|{MARK}+") if cut_marks else re.compile("(?s).+")
        self.pairs: dict[tuple[str, str], bool] = {}
        # what a piece stands for, to decode
        self.surface = [p.replace(MARK, " ").encode() for p in self.pieces]
        for byte, i in self.byte_id.items():
            self.surface[i] = bytes([byte])
        for i, k in enumerate(self.kinds):
            if k not in (NORMAL, BYTE):
                self.surface[i] = b" \xe2\x81\x87 " if k == UNKNOWN else b""

    def marked(self, text: str) -> str:
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """Pieces that the merges make: again and again the adjacent pair with the best joined piece, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.id.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def adjacent(self, left: str, right: str) -> bool:
        """Whether the merges leave these two pieces side by side; left may be empty."""
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            # an unreachable piece never stands anywhere; a character that no piece is may stand by any piece
            self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return self.pairs[key]

    def segment_sorted(self, words: list[str]) -> list[list[str]]:
        """Pieces of each of the sorted words; forward states of a prefix that the last word shares are kept."""
        out, last = [], ""
        ids, scores, longest, bpe, known = self.id, self.scores, self.longest, self.kind == BPE, self.known
        pairs = self.pairs
        total, piece = [0.0], [""]  # by prefix length: the best score, and the piece that ends there
        for word in words:
            shared = 0
            for a, b in zip(word, last):  # noqa: B905  the shorter ends it
                if a != b:
                    break
                shared += 1
            del total[shared + 1 :], piece[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, found = None, word[end - 1]
                if found not in known:
                    best = total[end - 1] + self.penalty
                elif bpe:
                    best = 0.0
                    for start in range(max(0, end - longest), end):
                        one = word[start:end]
                        if one in ids:
                            before = piece[start]
                            fits = pairs.get((before, one))
                            if fits is None:
                                fits = self.adjacent(before if before in ids else "", one)
                                pairs[before, one] = fits
                            if fits:
                                found = one
                                break
                else:
                    for start in range(max(0, end - longest), end):
                        i = ids.get(word[start:end])
                        if i is not None and (best is None or total[start] + scores[i] > best):
                            best, found = total[start] + scores[i], word[start:end]
                    if found not in ids:
                        best = total[end - 1] + self.penalty
                total.append(best)
                piece.append(found)
            end, parts = len(word), []
            while end:
                parts.append(piece[end])
                end -= len(piece[end])
            out.append(parts[::-1])
            last = word
        return out

    def ids_of(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_fallback:
                out += [self.byte_id[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:  # neighbouring unknown characters are one piece
                out.append(self.unknown)
        return out


class Encoder:
    """Encodes slices of texts; words met before are looked up."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.bounds = array("i"), array("q", [0])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds of each text)."""
        split = [self.model.words.findall(self.model.marked(t)) for t in texts]
        if len(self.index) > REMEMBERED:
            self.forget()
        new = sorted({w for words in split for w in words}.difference(self.index))
        for word, parts in zip(new, self.model.segment_sorted(new), strict=True):
            self.index[word] = len(self.bounds) - 1
            self.flat.extend(self.model.ids_of(parts))
            self.bounds.append(len(self.flat))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        nth = np.fromiter((self.index[w] for words in split for w in words), np.int64, int(counts.sum()))
        bounds, flat = np.array(self.bounds), np.array(self.flat, np.int32)
        lengths = bounds[nth + 1] - bounds[nth]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.arange(upto[-1]) - np.repeat(upto[:-1] - bounds[nth], lengths)] if len(nth) else np.zeros(0, np.int32)
        return ids, upto[np.concatenate(([0], np.cumsum(counts)))]

    def decode(self, ids: np.ndarray) -> str:
        surface = self.model.surface
        text = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    with open(SparkFiles.get(name), "rb") as f:
        data = f.read()
    key = hashlib.sha256(data).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(PieceModel(data))
    return _encoders[key]


def encode(docs: DataFrame, model_file: str = MODEL_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text, and whether they decode to the text exactly.

    The distinct new words of a slice of rows are sorted and segmented along their trie; ids are
    then gathered for all its texts. No row leaves its partition, so nothing is shuffled, and what
    a worker remembers is bounded by REMEMBERED.

    A null or empty text has no tokens and decodes to the empty text. A text that itself holds the
    mark U+2581 comes back with a space there (round_trip false), as the format cannot tell them
    apart. An empty table gives an empty result; columns other than id and text are ignored.

    Returns doc_id, n_tokens, token_ids, round_trip.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]

    def run(batches):
        encoder = _encoder(name)
        for part in chunks(batches, 2 << 20):
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids, bounds = encoder.encode(texts)
            same = [encoder.decode(ids[bounds[i] : bounds[i + 1]]) == t for i, t in enumerate(texts)]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), lists, pa.array(same)], names=["doc_id", "n_tokens", "token_ids", "round_trip"])

    picked = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return picked.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """Texts of token_ids (null: the empty text); returns doc_id and text."""
    tokens.sparkSession.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]

    def run(batches):
        encoder = _encoder(name)
        for part in chunks(batches, 1000):
            texts = [encoder.decode(np.array(x or [], np.int64)) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    """Token ids of all documents by the 32,000-piece vocabulary."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
