"""Word-piece token counts by a linear longest-match automaton.

Two tries hold the pieces that may start a word and those that may continue one. Each node knows how many
pieces a word that has come this far must give up when the next letter has no edge, and where matching goes
on (its failure link), so a word costs one step per letter and no piece is ever built.
"""

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cladeframe.llm.common import bounded_batches, table


class PieceCounter(dict):
    """Greedy word-piece counts, remembered per word; a word that cannot be split counts as one unknown token."""

    def __init__(self, starts: Iterable[str], continues: Iterable[str], remembered: int = 300_000):
        self.remembered = remembered
        self.edges: list[dict[str, int]] = [{}, {}]
        ends = set()
        for root, pieces in ((0, starts), (1, continues)):
            for piece in pieces:
                at = root
                for letter in piece:
                    if letter not in self.edges[at]:
                        self.edges[at][letter] = len(self.edges)
                        self.edges.append({})
                    at = self.edges[at][letter]
                if at != root:
                    ends.add(at)
        self.link: list[int | None] = [None] * len(self.edges)
        self.popped = [0] * len(self.edges)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for letter, node in self.edges[parent].items():
                queue.append(node)
                if node in ends:
                    self.link[node], self.popped[node] = 1, 1
                    continue
                at, count = self.link[parent], self.popped[parent]
                while at is not None and letter not in self.edges[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at is not None:
                    self.link[node], self.popped[node] = self.edges[at][letter], count

    def __missing__(self, word: str) -> int:
        at, count = 0, 0
        for letter in word:
            while letter not in self.edges[at]:
                count += self.popped[at]
                at = self.link[at]
                if at is None:
                    return self.remember(word, 1)
            at = self.edges[at][letter]
        while at != 1:
            count += self.popped[at]
            at = self.link[at]
            if at is None:
                return self.remember(word, 1)
        return self.remember(word, count)

    def remember(self, word: str, count: int) -> int:
        if len(self) < self.remembered:
            self[word] = count
        return count


def vocabulary_pieces(path: str) -> tuple[list[str], list[str]]:
    """Pieces of a sentencepiece vocabulary that start a word (marked there) and that continue one.

    Control, unknown and byte pieces take no part: word pieces know only whole letters.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    mark = "▁"
    return [p[1:] for p in pieces if p[:1] == mark and len(p) > 1 and mark not in p[1:]], [p for p in pieces if mark not in p]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens): words are split at white space, tokens are greedy word pieces.

    Null and empty texts have no words and no tokens; repeated rows are counted one by one; a null doc_id
    stays null; an empty table gives no rows; other columns are ignored. Words may be of any length.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n_words long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = PieceCounter(*vocabulary_pieces(vocabulary))
        for texts in batches:
            words = [text.split() for text in texts]
            yield pd.DataFrame({"n_words": [len(w) for w in words], "n_tokens": [sum(map(counter.__getitem__, w)) for w in words]})

    return docs.select("doc_id", count(F.coalesce("text", F.lit(""))).alias("c")).select("doc_id", "c.n_words", "c.n_tokens")


def op7(spark, folder: str) -> DataFrame:
    """Words and word-piece tokens of every document."""
    return token_counts(table(spark, folder, "documents"))
