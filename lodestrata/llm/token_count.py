"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots: one for the pieces that open a word and one for those that
continue it.  A failure link of a node leads to the node reached after the longest pieces at its
head have been popped; how many are popped is computed beforehand, so a word is counted in one pass
over its characters without building a piece.

Defined results: null and empty texts have no word and no token; a word that the vocabulary cannot
spell counts as one token; words of any length are read whole; repeated rows count one by one.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

from pyspark.sql import DataFrame

from lodestrata.llm.common import WordCache, map_text

WORD_START = "▁"


class LongestMatch:
    def __init__(self, starts: set[str], continuations: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        for root, words in ((0, starts), (1, continuations)):
            for word in words:
                at = root
                for c in word:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    at = to
                piece[at] = at > 1
        size = len(self.next)
        #: Failure links (-1: none) and the number of pieces popped on following them.
        self.fail, self.popped = [-1] * size, [0] * size
        queue = deque([0, 1])
        while queue:
            at = queue.popleft()
            for c, to in self.next[at].items():
                if piece[to]:
                    self.fail[to], self.popped[to] = 1, 1
                else:
                    link, popped = self.fail[at], self.popped[at]
                    while link >= 0 and c not in self.next[link]:
                        popped += self.popped[link]
                        link = self.fail[link]
                    if link >= 0:
                        self.fail[to], self.popped[to] = self.next[link][c], popped
                queue.append(to)

    def count(self, word: str) -> int:
        """Pieces of the greedy longest-match split; 0 if there is none."""
        step, fail, popped = self.next, self.fail, self.popped
        at, pieces = 0, 0
        for c in word:
            while c not in step[at]:
                if fail[at] < 0:
                    return 0
                pieces += popped[at]
                at = fail[at]
            at = step[at][c]
        while at > 1:  # what is left must pop until the continuation root is reached
            if fail[at] < 0:
                return 0
            pieces += popped[at]
            at = fail[at]
        return pieces if at == 1 else 0


def sentencepiece_vocabulary(model_path: str) -> tuple[set[str], set[str]]:
    """Pieces that open a word (they carry its mark) and pieces that continue one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    starts, rest = set(), set()
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            p = sp.id_to_piece(i)
            (starts if p.startswith(WORD_START) else rest).add(p)
    return {p for p in starts if WORD_START not in p[1:]}, rest


@lru_cache(maxsize=4)
def automaton(model_path: str) -> LongestMatch:
    return LongestMatch(*sentencepiece_vocabulary(model_path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_tokens, n_unknown (words without a split), as long."""

    def factory():
        count = automaton(model_path).count
        # tokens in the low half, unknown words in the high one: one sum gives both
        cache = WordCache(lambda w: count(WORD_START + w.decode()) or (1 << 40) + 1)

        def work(text):
            words = text.encode().split() if text else []
            total = sum(map(cache.__getitem__, words))
            return len(words), total & ((1 << 40) - 1), total >> 40

        return work

    return map_text(docs, [id_col], text_col, factory, "n_words bigint, n_tokens bigint, n_unknown bigint")
