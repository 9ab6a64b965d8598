"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a part of the corpus are inserted in a trie. A node (a prefix) gets the best unigram forward
score and the number of tokens of that segmentation, computed once from the nodes above it however many
pre-tokens share the prefix. A pre-token's terminal node holds its token count, and a text's count is the sum over its pre-tokens.
Of equally good segmentations the one with fewer tokens counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import PRE_TOKEN, Vocabulary, default_path, shared_prefixes, vocabulary

#: Terminal counts that a task keeps; texts that are counted at a time.
KEPT, CHUNK = 1_000_000, 500


def terminal_counts(vocab: Vocabulary, words: Iterable[str]) -> dict[str, int]:
    """The token count of each word. The path of open trie nodes is a stack; a sibling branch goes on from its shared prefix."""
    out: dict[str, int] = {}
    score, count = [0.0], [0]
    for w, same in shared_prefixes(list(words)):
        del score[same + 1 :], count[same + 1 :]
        for end in range(same + 1, len(w) + 1):
            best, fewest = -1e300, 0
            for start, weight, ids in vocab.ending(w, end):
                s, n = score[start] + weight, count[start] + len(ids)
                if s > best or s == best and n < fewest:
                    best, fewest = s, n
            score.append(best)
            count.append(fewest)
        out[w] = count[len(w)]
    return out


def token_counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row of ``docs(doc_id, text)``.

    A null or empty text has none of either. Repeated rows and null doc_ids keep their rows; other columns are ignored.
    """
    path = model_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(path), {}
        for big in batches:
            for b in (big.slice(at, CHUNK) for at in range(0, big.num_rows, CHUNK)):
                bags = [Counter(PRE_TOKEN.findall(t or "")) for t in b.column(1).to_pylist()]
                if len(known) > KEPT:
                    known.clear()
                known.update(terminal_counts(vocab, {w for bag in bags for w in bag if w not in known}))
                words = [sum(bag.values()) for bag in bags]
                tokens = [sum(n * known[w] for w, n in bag.items()) for bag in bags]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
