"""Token counts of a unigram tokenizer without tokenizing: count-only Viterbi.

An Aho-Corasick automaton lists all vocabulary pieces that end at each place; dynamic programming over the
places carries only the best score and that path's number of pieces. Ties go as in the tokenizer: of
equally good ways to reach a place, the one whose last piece is longest. A character that is no piece
costs the lowest score less 10 and counts as its UTF-8 bytes.

Text is one dummy space and the text, with every space as U+2581. No piece has that sign behind another
character, so no piece crosses from a word into the spaces behind it: words are counted one by one, and
counts of short words are remembered. With scores that are whole numbers, as here, sums are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words remembered by a worker, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
#: Characters of a text held as words at a time.
PIECE = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """pieces with scores, and the lowest score of the whole model."""

    pieces: dict[str, float]
    lowest: float


def load(path: str) -> Vocabulary:
    """The ordinary pieces of a SentencePiece model file; control, unknown and byte pieces match no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    lowest = 0.0
    for i in range(sp.vocab_size()):
        lowest = min(lowest, sp.get_score(i))
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            pieces[sp.id_to_piece(i)] = sp.get_score(i)
    return Vocabulary(pieces, lowest)


def joined(parts: list[str]) -> list[str]:
    """Parts between single spaces to words: an empty part is a sign more before the next."""
    out, signs = [], 0
    for p in parts:
        if p:
            out.append(SPACE * signs + p)
            signs = 0
        else:
            signs += 1
    return [*out, SPACE * (signs - 1)] if signs else out


class Counter(dict):
    """word -> (pieces, score); words are without their leading sign, which is added."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        if any(SPACE in p.lstrip(SPACE) for p in vocabulary.pieces):
            raise ValueError("a piece of this vocabulary crosses words")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.most = max(map(len, vocabulary.pieces), default=1)
        self.unknown = vocabulary.lowest - UNKNOWN_PENALTY

    def viterbi(self, text: str) -> tuple[int, float]:
        """Places no farther back than the longest piece are held, in a ring."""
        ring = self.most + 1
        best: list[float | None] = [None] * ring
        count = [0] * ring
        best[0] = 0.0
        matches = self.automaton.iter(text)
        ahead = next(matches, None)
        for end, c in enumerate(text):
            top, pieces, length = None, 0, 0
            while ahead is not None and ahead[0] == end:
                size, score = ahead[1]
                before = best[(end + 1 - size) % ring]
                if before is not None:
                    score += before
                    if top is None or score > top or score == top and size > length:
                        top, pieces, length = score, count[(end + 1 - size) % ring] + 1, size
                ahead = next(matches, None)
            if c not in self.single:
                score = best[end % ring] + self.unknown
                if top is None or score > top:
                    top, pieces = score, count[end % ring] + len(c.encode("utf-8", "surrogatepass"))
            best[(end + 1) % ring], count[(end + 1) % ring] = top, pieces
        return count[len(text) % ring], best[len(text) % ring]

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.viterbi(SPACE + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found

    def words(self, text: str) -> Iterator[list[str]]:
        """The words in lists of bounded size, without their first sign; spaces stand before a word."""
        at = 0
        while True:
            end = text.find(" ", at + PIECE) if len(text) - at > PIECE else -1
            while end > 0 and text[end - 1] == " ":  # not inside a run of spaces
                end = text.find(" ", end + 1)
            parts = (text[at:end] if end >= 0 else text[at:]).split(" ")
            yield joined(parts) if "" in parts else parts
            if end < 0:
                return
            at = end + 1

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        pieces, score = 0, 0.0
        for part in self.words(text):
            found = [self[w] for w in part]
            pieces += sum(f[0] for f in found)
            score += sum(f[1] for f in found)
        return pieces, score


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])
_counters: dict[str, Counter] = {}


def count(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the best path's score of every row's whole text.

    path: a SentencePiece model file, read on the driver; its pieces and scores are the unigram vocabulary
    (some MB, fixed by the file). Null and empty texts have no tokens and score 0. Rows keep their null
    or repeated ids; other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared, name = spark.sparkContext.broadcast(load(path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _counters:
            _counters.clear()
            _counters[name] = Counter(shared.value)
        counter = _counters[name]
        for batch in batches:
            got = [counter.count(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], schema=SCHEMA
            )

    return common.slim(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, score double")


def op8(docs: DataFrame, path: str) -> DataFrame:
    return count(docs, path)
