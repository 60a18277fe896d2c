"""Token counts of a unigram tokenizer: count-only Viterbi over an Aho-Corasick of its pieces.

The automaton enumerates the vocabulary pieces that end at each character; the dynamic programme carries, per position,
the best score and the number of pieces on the way there, and no back pointers. Ties follow the Unigram model of the
`tokenizers` library: of two ways with the same score the one whose last piece is longer stays, as it was found
from the earlier position; a character that is no piece by itself costs the worst score less 10. Such characters count
as their UTF-8 bytes where the model falls back to bytes; else a run of them counts as one unknown token, as in that
library. Scores add up in double precision.

The text is prepared as the model has it: spaces become the mark U+2581, and a mark is put in front. No piece has a
mark after another character (checked when the model is loaded), so every way passes each such boundary, the text falls
into independent segments there, and a segment that was counted once is looked up from then on.

None of the public vocabularies at hand is a unigram model; `op2` uses the 32k-piece vocabulary with its own scores
under unigram rules; the tests compare with the `tokenizers` library's Unigram model over the same pieces.

Defined cases: null and empty texts have 0 tokens; very long texts without spaces are one segment, counted in linear
time; repeated rows give repeated results; an empty table gives an empty result; the input's other columns are left aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Segments that a task remembers; beyond, it starts anew.
REMEMBERED = 400_000
#: Longer segments are counted each time.
LONGEST_REMEMBERED = 64
UNKNOWN_PENALTY = 10.0
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

SCHEMA = "doc_id long, n_tokens long, n_bytes long"


class Unigram:
    """pieces: text to score; fallback: unknown characters count as their UTF-8 bytes."""

    def __init__(self, pieces: dict[str, float], fallback: bool):
        import ahocorasick

        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece has a mark after another character: texts don't fall into segments")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.fallback = fallback

    def count(self, segment: str) -> int:
        """Tokens of one prepared segment."""
        n = len(segment)
        best: list[float | None] = [None] * (n + 1)
        pieces = [0] * (n + 1)
        unknown = [False] * (n + 1)  # the best way to a position ends in an unknown character
        best[0] = 0.0
        reached = 0

        def step(end: int) -> None:
            # The last character by itself, if it is no piece: it is offered after all longer ways, as it starts last.
            char = segment[end - 1]
            if char not in self.single and best[end - 1] is not None:
                score = best[end - 1] + self.unknown
                if best[end] is None or score > best[end]:
                    best[end], unknown[end] = score, True
                    pieces[end] = pieces[end - 1] + (len(char.encode()) if self.fallback else 0 if unknown[end - 1] else 1)

        for last, (length, score) in self.automaton.iter(segment):
            end = last + 1
            while reached < last:  # positions where no further piece ends
                reached += 1
                step(reached)
            before = best[end - length]
            if before is not None:
                score += before
                # Pieces that end here come from the longest to the shortest: the earlier start stays on a tie.
                if best[end] is None or score > best[end]:
                    best[end], pieces[end], unknown[end] = score, pieces[end - length] + 1, False
        while reached < n:
            reached += 1
            step(reached)
        return pieces[n]


class Counts(dict):
    """Tokens of each segment seen so far."""

    def __init__(self, model: Unigram):
        super().__init__()
        self.model = model

    def __missing__(self, segment: str) -> int:
        n = self.model.count(segment)
        if len(segment) <= LONGEST_REMEMBERED:
            self[segment] = n
        return n


def count_tokens(text: str | None, counts: Counts) -> int:
    if not text:
        return 0
    words = text.split(" ")
    if "" not in words and MARK not in text:
        total = sum(map(counts.__getitem__, [MARK + w for w in words]))
    else:
        # Runs of spaces stand in front of the next word, or at the end by themselves.
        total = sum(map(counts.__getitem__, _SEGMENT.findall(MARK + text.replace(" ", MARK))))
    if len(counts) > REMEMBERED:
        counts.clear()
    return total


@lru_cache(maxsize=4)
def load(model_file: str) -> Unigram:
    """The normal pieces of a sentencepiece model with their scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Unigram({sp.id_to_piece(i): sp.get_score(i) for i in ids}, any(sp.is_byte(i) for i in range(sp.get_piece_size())))


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, n_bytes. model_file: a sentencepiece model, at this path on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(load(model_file))
        for batch in batches:
            n_tokens, n_bytes = [], []
            for text in batch.column(1):
                text = text.as_py()
                n_tokens.append(count_tokens(text, counts))
                n_bytes.append(len(text.encode()) if text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_bytes, pa.int64())], ["doc_id", "n_tokens", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
