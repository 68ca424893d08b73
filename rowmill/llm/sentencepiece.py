"""Best-score segmentation of texts into the pieces of a vocabulary, and back."""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.table import fresh, ready, replace

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# The vocabulary is sent to every task, so its size is bounded.
MOST_PIECES = 1_000_000
# Segmented stretches that a Python worker remembers (two generations of so many; about 60 MB).
REMEMBERED = 150_000
# Longer stretches are not remembered.
LONGEST_REMEMBERED = 64
# A character that is no piece costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0

SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; ``SPACE`` stands for a space. ``byte_ids`` are the 256 pieces of single bytes."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    key: str = field(compare=False, default="")

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        """Read a model file on the driver; only pieces, scores and kinds are used."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        if len(ids) > MOST_PIECES:
            raise ValueError(f"at most {MOST_PIECES} pieces")
        pieces = tuple(model.id_to_piece(i) for i in ids)
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in ids]
        by_name = {pieces[i]: i for i in ids if model.is_byte(i)}
        if len(by_name) != 256:
            raise ValueError("the vocabulary has no piece for every byte, so not every text can be encoded")
        key = hashlib.sha256("\0".join(pieces).encode()).hexdigest()
        scores = tuple(model.get_score(i) for i in ids)
        return cls(pieces, scores, tuple(not s for s in special), tuple(by_name[f"<0x{b:02X}>"] for b in range(256)), key)


class Segmenter:
    """The automaton over the pieces, and what has been segmented lately."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        usable = [i for i, ok in enumerate(v.normal) if ok and v.pieces[i]]
        for i in usable:
            self.automaton.add_word(v.pieces[i], (len(v.pieces[i]), v.scores[i], i))
        self.automaton.make_automaton()
        self.singles = frozenset(v.pieces[i] for i in usable if len(v.pieces[i]) == 1)
        self.unknown = min((v.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        inner = {c for i in usable for c in v.pieces[i]}
        # Where a line break is in no piece, and no piece goes on past the end of a word, best segmentations
        # of the stretches between these places make up the best segmentation of the text.
        self.cut_lines = "\n" not in inner
        self.cut_words = not any(SPACE in v.pieces[i].lstrip(SPACE) for i in usable)
        self.new: dict[str, array] = {}
        self.old: dict[str, array] = {}
        data = [p.replace(SPACE, " ").encode() if ok else b"" for p, ok in zip(v.pieces, v.normal, strict=True)]
        for b, i in enumerate(v.byte_ids):
            data[i] = bytes([b])
        self.piece_data = np.frombuffer(b"".join(data), np.uint8)
        self.piece_ends = np.cumsum([len(d) for d in data])
        self.piece_sizes = np.array([len(d) for d in data])

    def bytes_of(self, text: str) -> array:
        return array("i", [self.vocabulary.byte_ids[b] for b in text.encode()])

    def viterbi(self, text: str) -> array:
        """The pieces of highest total score, by one pass over the automaton's matches.

        Matches come by their end, all pieces that end there one after another (the automaton's output
        links, longest first); each relaxes the best score of its end. Equal totals keep the longer last piece.
        """
        n = len(text)
        best, back = [0.0] + [-float("inf")] * n, [(0, -1)] * (n + 1)
        if self.singles.issuperset(text):
            for end, (size, score, piece) in self.automaton.iter(text):
                end += 1
                total = best[end - size] + score
                if total > best[end]:
                    best[end], back[end] = total, (size, piece)
        else:
            matches = self.automaton.iter(text)
            end, found = next(matches, (n, None))
            for i in range(n):
                while end == i and found:
                    size, score, piece = found
                    total = best[i + 1 - size] + score
                    if total > best[i + 1]:
                        best[i + 1], back[i + 1] = total, (size, piece)
                    end, found = next(matches, (n, None))
                if text[i] not in self.singles and best[i] + self.unknown > best[i + 1]:
                    best[i + 1], back[i + 1] = best[i] + self.unknown, (1, -1)
        parts, at = [], n
        while at:
            size, piece = back[at]
            parts.append([piece] if piece >= 0 else self.bytes_of(text[at - 1]).tolist())
            at -= size
        return array("i", [i for part in reversed(parts) for i in part])

    def stretch(self, text: str) -> array:
        """As ``viterbi``, looked up first."""
        found = self.new.get(text)
        if found is None:
            found = self.old.get(text)
            if found is None:
                found = self.viterbi(text)
            if len(text) <= LONGEST_REMEMBERED:
                if len(self.new) >= REMEMBERED:
                    self.old, self.new = self.new, {}
                self.new[text] = found
        return found

    def encode(self, text: str, out: array) -> None:
        """Append the pieces of a text; one space is put before it, as the vocabulary expects."""
        if not text:
            return
        known, stretch = self.new, self.stretch
        first = True
        for part_no, part in enumerate(text.split(SPACE)):
            if part_no:
                out.extend(self.bytes_of(SPACE))
            lines = part.split("\n") if self.cut_lines else [part]
            for line_no, line in enumerate(lines):
                if line_no:
                    out.extend(self.bytes_of("\n"))
                if first:
                    line, first = " " + line, False
                if not line:
                    continue
                if not self.cut_words:
                    out.extend(self.viterbi(line.replace(" ", SPACE)))
                    continue
                head, *words = line.split(" ")
                if head:
                    out.extend(stretch(head))
                spaces = SPACE
                for word in words:
                    if not word:
                        spaces += SPACE
                        continue
                    unit = spaces + word
                    out.extend(known.get(unit) or stretch(unit))
                    spaces = SPACE
                    known = self.new
                if len(spaces) > 1:
                    out.extend(stretch(spaces[1:]))

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Lists of piece numbers; NULL stays NULL."""
        ids, ends = array("i"), [0]
        for text in texts.to_pylist():
            self.encode(text or "", ids)
            ends.append(len(ids))
        values = pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32))
        null = texts.is_null() if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=null)

    def decode_all(self, lists: pa.Array) -> pa.Array:
        """Texts of lists of piece numbers; bytes that are no UTF-8 become replacement characters."""
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = self.piece_sizes[ids]
        at = np.concatenate([[0], np.cumsum(sizes)])
        data = self.piece_data[np.repeat(self.piece_ends[ids] - at[1:], sizes) + np.arange(at[-1])]
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = at[np.concatenate([[0], np.cumsum(counts)])]
        # The space put before each text goes again.
        full = np.diff(ends) > 0
        keep = np.ones(len(data), bool)
        spaced = ends[:-1][full]
        spaced = spaced[data[spaced] == ord(" ")]
        keep[spaced] = False
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[keep]))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            raw = data[keep].tobytes()
            texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.large_string())
        null = pa.array(np.asarray(lists.is_null())) if lists.null_count else None
        texts = texts.cast(pa.string())
        return texts if null is None else pc.if_else(null, pa.scalar(None, pa.string()), texts)


_segmenters: dict[str, Segmenter] = {}


def _segmenter(vocabulary: Vocabulary) -> Segmenter:
    """One automaton per Python worker and vocabulary."""
    if vocabulary.key not in _segmenters:
        _segmenters.clear()
        _segmenters[vocabulary.key] = Segmenter(vocabulary)
    return _segmenters[vocabulary.key]


def encode(df: DataFrame, vocabulary: Vocabulary, text_column: str = "text", name: str = "pieces") -> DataFrame:
    """Add the piece numbers of each text (array<int>).

    The segmentation is the one of highest total score. One space is put before a text that is not empty. A
    character that is no piece is given as the pieces of its bytes, as is a literal U+2581, which would otherwise
    come back as a space: every text is restored exactly by ``decode``. Empty: an empty list; NULL: NULL.
    A column of the same name is replaced; any other is kept.
    """
    ready(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def apply(texts: pa.Array) -> pa.Array:
        return _segmenter(sent.value).encode_all(texts)

    temporary, = fresh(df, "piece_numbers")
    return replace(df.withColumn(temporary, apply(F.col(f"`{text_column}`"))), {name: F.col(temporary)}).drop(temporary)


def decode(df: DataFrame, vocabulary: Vocabulary, pieces_column: str = "pieces", name: str = "text") -> DataFrame:
    """Add the text of each list of piece numbers. NULL gives NULL; control pieces give nothing."""
    ready(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def apply(lists: pa.Array) -> pa.Array:
        return _segmenter(sent.value).decode_all(lists)

    temporary, = fresh(df, "piece_text")
    return replace(df.withColumn(temporary, apply(F.col(f"`{pieces_column}`"))), {name: F.col(temporary)}).drop(temporary)


def document_pieces(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_pieces, pieces, restored``: every text encoded, decoded again and compared."""
    encoded = encode(docs.select("doc_id", "text"), vocabulary)
    decoded = decode(encoded, vocabulary, name="decoded")
    return decoded.select(
        "doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("bigint").alias("n_pieces"), "pieces",
        F.col("decoded").eqNullSafe(F.col("text")).alias("restored"),
    )
