"""Token counts by trie-shared dynamic programming.

A unigram model splits each pre-token into the vocabulary pieces of the greatest total score. The best score of a prefix
depends on the prefix alone, so the distinct pre-tokens of a batch are walked as a trie: in sorted order, with the path
to the current word on a stack, each shared prefix is scored once and every word ends in the count of its best split.
Counts of words are remembered per worker and added up per document.

The vocabulary's scores are its merge ranks, no probabilities; the model takes Zipf's law over the ranks.

Edge cases: a null or empty text has no pre-token and no token; a character that no piece holds counts as its UTF-8
bytes; repeated rows are counted each; a null ``doc_id`` is reported like any other; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
REMEMBERED = 500_000  # words whose counts a worker keeps
BATCH_WORDS = 200_000  # distinct new words that are walked at once

SPACE = "▁"
COUNTS = "doc_id bigint, n_pretokens bigint, n_tokens bigint"

# A run of spaces belongs to the word after it; a line break stands alone. No piece crosses such a border.
_PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n")


class Pieces:
    """Log-probabilities of the vocabulary's pieces."""

    def __init__(self, file: str):
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=file)
        names = [
            vocabulary.id_to_piece(i)
            for i in range(vocabulary.get_piece_size())
            if not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i))
        ]
        norm = math.log(sum(1 / (rank + 2.7) for rank in range(len(names))))
        self.score = {name: -math.log(rank + 2.7) - norm for rank, name in enumerate(names)}
        if any(_PRETOKEN.fullmatch(name) is None for name in names):
            raise ValueError("the vocabulary has pieces that cross pre-tokens")
        self.longest = max(map(len, names))
        self.unknown = min(self.score.values()) - 10

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word's best split; of equal splits, the one with fewer tokens."""
        score, longest, unknown = self.score.get, self.longest, self.unknown
        best, tokens = [0.0], [0]  # of the prefixes of the current word, along its path in the trie
        previous, out = "", {}
        for word in sorted(words):
            shared = 0
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, fewest = best[end - 1] + unknown, tokens[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                for start in range(max(0, end - longest), end):
                    own = score(word[start:end])
                    if own is not None:
                        total = best[start] + own
                        if total > top or total == top and tokens[start] < fewest:
                            top, fewest = total, tokens[start] + 1
                best.append(top)
                tokens.append(fewest)
            out[word] = tokens[-1]
            previous = word
        return out


def pretokens(text: str | None) -> list[str]:
    return _PRETOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens), a row per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = Pieces(model or model_path()), {}
        for batch in batches:
            ids, words, tokens = batch.column(0).to_pylist(), [], []
            at = 0
            while at < len(batch):
                # As many documents as bring a bounded number of new words, one at least.
                group, new = [], set()
                while at < len(batch) and len(new) < BATCH_WORDS:
                    group.append(pretokens(batch.column(1)[at].as_py()))
                    new.update(w for w in group[-1] if w not in known)
                    at += 1
                fresh = pieces.counts(new)
                if len(known) + len(fresh) <= REMEMBERED:
                    known.update(fresh)
                    fresh = known
                else:
                    fresh = _Both(fresh, known)
                words += map(len, group)
                tokens += [sum(map(fresh.__getitem__, g)) for g in group]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (ids, words, tokens)], ["doc_id", "n_pretokens", "n_tokens"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, COUNTS)


class _Both(dict):
    """A first table, and a second for what it lacks."""

    def __init__(self, first: dict, second: dict):
        super().__init__(first)
        self.second = second

    def __missing__(self, key):
        return self.second[key]
