"""Token counts under a unigram vocabulary, without making the tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at each character.
Dynamic programming carries, for each end, only the best score and the number of pieces on the
best path.  Ties follow the tokenizer's own rule: candidates are met in the order of their starts
and a later one must be strictly better, so the longest of equal candidates stays.  A character
without a piece of its own may also be unknown, at ten below the least score, and then counts as
its UTF-8 bytes where the model falls back to bytes.

No piece reaches from a word into the blank behind it (checked when the vocabulary is loaded), so
the best path of a text is the best paths of its words, each kept once for a task.  Scores are
added word by word in double precision; the library adds single floats along the whole text.

Defined edge cases: null and empty texts have no tokens and score 0; long texts are counted whole;
repeated rows are each counted; an empty table gives no rows; extra columns are carried only when named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Score of an unknown character below the least score of the vocabulary.
UNKNOWN = 10.0
#: Words kept for reuse in a task; a full store starts anew.
KEPT_WORDS = 500_000
_LOADED: dict[str, "Vocabulary"] = {}
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Vocabulary:
    def __init__(self, pieces: dict[str, float], bytes_for_unknown: bool = True, prefix: bool = True):
        crossing = [p for p in pieces if BLANK in p.lstrip(BLANK)]
        if crossing:
            raise ValueError(f"pieces reach over words: {crossing[:3]}")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN
        self.bytes_for_unknown, self.prefix = bytes_for_unknown, prefix
        self.words: dict[str, tuple[int, float]] = {}

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """The normal pieces and scores of a sentencepiece model, once for each worker process."""
        if path not in _LOADED:
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
            fallback = any(model.is_byte(k) for k in range(model.get_piece_size()))
            _LOADED[path] = cls({model.id_to_piece(k): model.get_score(k) for k in ids}, fallback)
        return _LOADED[path]

    def best(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path over ``word``."""
        n = len(word)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        matches = self.automaton.iter(word)
        end, pending = -1, next(matches, None)
        for at in range(n):
            top, pieces = None, 0
            while pending is not None and pending[0] == at:  # the longest piece comes first
                size, own = pending[1]
                value = score[at + 1 - size] + own
                if top is None or value > top:
                    top, pieces = value, count[at + 1 - size] + 1
                pending = next(matches, None)
            if word[at] not in self.singles:
                value = score[at] + self.unknown
                if top is None or value > top:
                    top, pieces = value, count[at] + (len(word[at].encode("utf-8")) if self.bytes_for_unknown else 1)
            score[at + 1], count[at + 1] = top, pieces
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        whole = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        total, score, words = 0, 0.0, self.words
        for word in _WORD.findall(whole):
            got = words.get(word)
            if got is None:
                if len(words) >= KEPT_WORDS:
                    words.clear()
                got = words[word] = self.best(word)
            total += got[0]
            score += got[1]
        return total, score


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens and the path's score, of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            got = [vocabulary.count(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], [*keep, "n_tokens", "score"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(F.col(text).alias("__text"), *[F.col(c) for c in keep]).mapInArrow(run, kinds + "n_tokens bigint, score double")
