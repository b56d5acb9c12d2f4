"""Token counts by a unigram model, scored once per shared prefix of a trie.

A pre-token is cut into the pieces whose summed log probability is highest. Distinct
pre-tokens are inserted into a trie of bytes; a node keeps the best score (the forward
score of the unigram lattice) and the number of pieces for the bytes on its path. Both
depend on the path alone, so pre-tokens with a common prefix share them, and the count
of a pre-token is that of its terminal node.

The trie belongs to a task and is started afresh when it has ``max_nodes`` nodes, which
changes no count. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.common import batch_of, chunks, in_tasks

#: Fixed-point unit of log probabilities: sums are exact, so ties are real ties.
UNIT = 100_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def vocabulary(ranks_path: str | None) -> dict[bytes, int]:
    """Piece -> log probability in units, by Zipf's law over the ranks of the file."""
    import public_tokenizers

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    harmonic = sum(1 / (rank + 1) for rank in ranks.values())
    return {piece: round(-math.log((rank + 1) * harmonic) * UNIT) for piece, rank in ranks.items()}


@lru_cache(maxsize=2)
def pattern(text: str | None):
    import public_tokenizers
    import regex

    return regex.compile(text or public_tokenizers.PATTERN)


class CountTrie(dict):
    """Maps a pre-token to its number of pieces; a missing one is inserted into the trie.

    Nodes are numbers; ``child[node * 256 + byte]`` is the next node. ``forward`` holds
    the best score times 2**32 less the number of its pieces, so that equal scores are
    settled by fewer pieces. All single bytes are pieces, so every node has a score.
    """

    def __init__(self, pieces: dict[bytes, int], max_nodes: int) -> None:
        super().__init__()
        self.max_nodes = max_nodes
        # Also holds, as 0, what is only an end of pieces: looking back stops elsewhere.
        self.ends = {piece[k:]: 0 for piece in pieces for k in range(len(piece))}
        self.ends.update((piece, (score << 32) - 1) for piece, score in pieces.items())
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}
        self.forward = [0]

    def __missing__(self, pretoken: str) -> int:
        if len(self.forward) >= self.max_nodes:
            self.reset()
        data, node, path = pretoken.encode("utf-8", "surrogatepass"), 0, [0]
        child, forward, ends = self.child, self.forward, self.ends.get
        for end, byte in enumerate(data, 1):
            key = node << 8 | byte
            node = child.get(key, 0)
            if node:
                path.append(forward[node])
                continue
            best, begin = path[-1] + ends(data[end - 1 : end]), end - 2
            while begin >= 0 and (score := ends(data[begin:end])) is not None:
                if score and path[begin] + score > best:
                    best = path[begin] + score
                begin -= 1
            node = child[key] = len(forward)
            forward.append(best)
            path.append(best)
        count = self[pretoken] = -path[-1] & 0xFFFFFFFF
        return count


def count_batches(ranks_path: str | None, split: str | None, max_nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, find = CountTrie(vocabulary(ranks_path), max_nodes), pattern(split).findall
        for batch in chunks(batches, 2000, 8_000_000, "text"):
            chars, pretokens, tokens = [], [], []
            for text in batch.column("text").to_pylist():
                found = find(text) if text else []
                chars.append(len(text or ""))
                pretokens.append(len(found))
                tokens.append(sum(map(trie.__getitem__, found)))
            yield batch_of(SCHEMA, [batch.column("doc_id"), chars, pretokens, tokens])

    return run


def token_counts(
    docs: DataFrame, ranks_path: str | None = None, split: str | None = None, max_nodes: int = 1_000_000
) -> DataFrame:
    """One row per document: ``doc_id, n_chars, n_pretokens, n_tokens``.

    ``ranks_path`` is a file of byte pieces and ranks (default: the public one of 50k
    entries), ``split`` the pattern of pre-tokens. A null or empty text has no tokens;
    repeated rows and null ids are counted row by row; other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_tasks(
        source,
        count_batches(ranks_path, split, max_nodes),
        "doc_id long, n_chars long, n_pretokens long, n_tokens long",
    )
