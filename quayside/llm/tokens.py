"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi (operator 10).

An Aho-Corasick automaton lists every vocabulary piece that occurs in a word; dynamic programming keeps, for every place, the
best score and the number of pieces of the best cut, nothing else. Rules of the tokenizer that matter: a space before a text
and every run of white space become one mark at the front of the next word, and pieces never cross it; a letter that no
piece covers is the unknown piece, scored 10 below the worst piece, and a run of unknown letters counts once; of two cuts
with equal scores the one whose last piece is longer wins, as pieces are tried from the left and only a strictly better
score replaces what was found.

The vocabulary is that of a public file, with the scores of a rank law, -log(rank + 1): no file with unigram scores is at
hand, and tokenizers are not trained here. Words are counted once per worker; the table of known words is emptied when full.
Null and empty texts and texts of white space have 0 tokens. Texts of any length are counted whole, repeated rows each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import ship_package, table
from quayside.llm.registry import register

MARK = "▁"
CACHE_WORDS = 1_000_000
UNKNOWN_BELOW = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a model file in rank order with scores of the rank law; the unknown piece is the first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [("<unk>", 0.0)] + [(piece, -math.log(rank + 1)) for rank, piece in enumerate(plain, 1)]


SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for Python, letters for the tokenizer
BETWEEN = re.compile(r"(?:\S|[\x1c-\x1f])+")


def words_in(text: str) -> list[str]:
    return BETWEEN.findall(text) if SEPARATORS.search(text) else text.split()


def front(word: str) -> str:
    """The word behind the mark; a word that begins with it gets no second one."""
    return word if word.startswith(MARK) else MARK + word


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces[1:]:
            if MARK not in piece[1:]:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.letters = {piece for piece, _ in pieces[1:] if len(piece) == 1}
        self.unknown = min(score for _, score in pieces[1:]) - UNKNOWN_BELOW
        self.known: dict[str, int] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        covered = [w for w in words if self.letters.issuperset(w)]
        for first in range(0, len(covered), 20_000):
            self.learn_covered(covered[first : first + 20_000])
        for word in words:
            if word not in self.known:
                self.known[word] = self.count_word(word)

    def learn_covered(self, words: list[str]) -> None:
        """Words whose every letter is a piece, in one walk over all of them, parted by line ends, which no piece holds.

        Matches come by their ends, the longest first, so a place's value is final before it is used.
        """
        marked = [front(w) for w in words]
        joined = "\n".join(marked)
        starts, at = [], 0
        for w in marked:
            starts.append(at)
            at += len(w) + 1
        best, pieces = [-math.inf] * (len(joined) + 1), [0] * (len(joined) + 1)
        for start in starts:
            best[start] = 0.0
        for end, (length, score) in self.automaton.iter(joined):
            end += 1
            total = best[end - length] + score
            if total > best[end]:
                best[end] = total
                pieces[end] = pieces[end - length] + 1
        for start, word, whole in zip(starts, words, marked):
            self.known[word] = pieces[start + len(whole)]

    def count_word(self, word: str) -> int:
        """The same for a word with letters that no piece covers."""
        marked = front(word)
        n = len(marked)
        best, pieces, open_ = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        matches: dict[int, list[tuple[int, float]]] = {}
        for end, match in self.automaton.iter(marked):
            matches.setdefault(end + 1, []).append(match)
        for i in range(1, n + 1):
            for length, score in matches.get(i, ()):
                if best[i - length] + score > best[i]:
                    best[i], pieces[i] = best[i - length] + score, pieces[i - length] + 1
            if marked[i - 1] not in self.letters and best[i - 1] + self.unknown > best[i]:
                best[i], open_[i] = best[i - 1] + self.unknown, True
                pieces[i] = pieces[i - 1] + (not open_[i - 1])
        return pieces[n]

    def counts(self, texts: list) -> list[int]:
        out = []
        for first in range(0, len(texts), 256):
            split = [words_in(t) if t else [] for t in texts[first : first + 256]]
            new = [w for w in set().union(*split) if w not in self.known]
            if new:
                self.learn(new)
            for words in split:
                try:
                    out.append(sum([self.known[w] for w in words]))
                except KeyError:  # the table was emptied meanwhile
                    self.learn(list(set(words)))
                    out.append(sum([self.known[w] for w in words]))
        return out


_COUNTERS: dict[str, Counter] = {}


def counted(docs: DataFrame, path: str, column: str = "n_tokens") -> DataFrame:
    """All rows with the number of tokens of ``text``; a column of that name is replaced."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from quayside.llm import tokens

        if path not in tokens._COUNTERS:
            tokens._COUNTERS[path] = tokens.Counter(tokens.vocabulary(path))
        for texts in batches:
            yield pd.Series(tokens._COUNTERS[path].counts(list(texts)), dtype="int64")

    carried = [f"`{c}`" for c in docs.columns if c != column]
    return docs.select(*carried, F.pandas_udf(run, "long")("text").alias(column))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register("op10_token_counts")
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counted(table(spark, folder, "documents").select("doc_id", "text"), default_model()).select("doc_id", "n_tokens")
