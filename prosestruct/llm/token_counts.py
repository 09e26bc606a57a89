"""Token counts under a unigram vocabulary, by dynamic programming shared over a trie.

A vocabulary file of merges has no probabilities, only ranks. These are taken for ranks of frequency, and by Zipf's law the
r-th of n pieces has the log-probability -ln(r) - ln(1 + 1/2 + ... + 1/n). A vocabulary with scores other than whole numbers
is a unigram one, and its scores are used as they are.

A pre-token is a maximal run of characters other than ASCII white space, with the word mark put before it. Its tokens
are those of the segmentation with the largest sum of piece scores; equal sums go to the segmentation whose last piece
is longest, then likewise leftwards. A character no piece covers scores UNKNOWN_PENALTY below the worst piece and
counts one token for each of its UTF-8 bytes.

The best score of a prefix depends on that prefix alone. So the distinct pre-tokens of a batch of texts form a trie, each
of whose nodes has the forward score and the counts of its prefix, computed once from the nodes above it; a terminal's
counts are the pre-token's. Sorted pre-tokens visit the trie depth first, so only the nodes of the present path are held,
and of the rest the terminals. Terminals stay for the next batches of a task, up to MAX_LETTERS of their letters; beyond
that they are dropped, which costs time and changes no result. A document's count is the sum over its words. There is no
shuffle.

Null and empty texts have no words and zero tokens. Repeated rows and null ids stay as they are; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .common import arrow_map

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_LETTERS = 2_000_000
#: Pre-tokens with more characters are computed alone and not kept, so one endless word can't fill the path.
MAX_KEPT = 96
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long, score double"


def log_probabilities(scores: dict[str, float]) -> dict[str, float]:
    """Scores as they are, or ranks, given as whole negative numbers, by Zipf's law; ties by the piece."""
    if not all(float(s).is_integer() for s in scores.values()):
        return scores
    whole = math.log(sum(1 / r for r in range(1, len(scores) + 1)))
    return {piece: -math.log(r) - whole for r, piece in enumerate(sorted(scores, key=lambda p: (-scores[p], p)), 1)}


def load_pieces(path: str) -> dict[str, float]:
    """Log-probabilities of the ordinary pieces of a sentencepiece model; pieces with a word mark inside can't occur in a pre-token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
    return log_probabilities({
        piece: model.get_score(i)
        for i in range(model.get_piece_size())
        if not any(f(i) for f in special) and MARK not in (piece := model.id_to_piece(i))[1:]
    })


Node = tuple[int, int, float]  # tokens, unknown characters, forward score


class TrieCounter:
    """Counts of pre-tokens; see the module's text. `max_nodes` bounds the letters, so the nodes, that kept terminals stand for."""

    def __init__(self, pieces: dict[str, float], max_nodes: int = MAX_LETTERS) -> None:
        self.pieces, self.max_nodes = pieces, max_nodes
        self.longest = max(map(len, pieces), default=0)
        self.endings = {piece[at:] for piece in pieces for at in range(len(piece))}  # what no piece ends in can't grow into one
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.kept: dict[bytes, Node] = {}
        self.letters = 0

    def _node(self, marked: str, end: int, path: list[Node]) -> Node:
        """The node of marked[:end]; path holds the nodes of all shorter prefixes that a piece can reach back to."""
        pieces, endings = self.pieces, self.endings
        tokens, unknown, score = path[-1]
        letter = marked[end - 1]
        gain = pieces.get(letter)
        if gain is None:
            best = (tokens + len(letter.encode("utf-8", "surrogatepass")), unknown + 1, score + self.unknown)
        else:
            best = (tokens + 1, unknown, score + gain)
        for start in range(end - 2, max(-1, end - self.longest - 1), -1):
            part = marked[start:end]
            if part not in endings:
                break
            gain = pieces.get(part)
            if gain is not None:
                tokens, unknown, score = path[start - end]
                if score + gain >= best[2]:  # of equal ones the longest
                    best = (tokens + 1, unknown, score + gain)
        return best

    def _alone(self, marked: str) -> Node:
        path: list[Node] = [(0, 0, 0.0)]
        for end in range(1, len(marked) + 1):
            path.append(self._node(marked, end, path))
            if len(path) > self.longest + 1:
                del path[0]
        return path[-1]

    def _visit(self, words: set[bytes]) -> None:
        """Put the terminals of `words` into kept, by a depth-first walk of their trie."""
        path, before = [(0, 0, 0.0)], ""
        for marked, word in sorted((MARK + w.decode("utf-8", "surrogatepass"), w) for w in words):
            if len(marked) > MAX_KEPT:
                self.kept[word] = self._alone(marked)
                continue
            same, most = 0, min(len(before), len(marked))
            while same < most and marked[same] == before[same]:
                same += 1
            del path[same + 1 :]
            for end in range(same + 1, len(marked) + 1):
                path.append(self._node(marked, end, path))
            self.kept[word], before = path[-1], marked
            self.letters += len(marked)

    def counts(self, texts: list[list[bytes]]) -> list[Node]:
        """The sums over the words of each text."""
        if self.letters > self.max_nodes:
            self.kept, self.letters = {}, 0
        new = set().union(*texts) - self.kept.keys()
        self._visit(new)
        out = []
        for words in texts:
            tokens, unknown, scores = zip(*map(self.kept.__getitem__, words), strict=True) if words else ((), (), ())
            out.append((sum(tokens), sum(unknown), float(sum(scores))))
        for word in new:
            if len(word) >= MAX_KEPT and len(word.decode("utf-8", "surrogatepass")) >= MAX_KEPT:
                del self.kept[word]
        return out

    def __call__(self, word: bytes) -> Node:
        return self.counts([[word]])[0]


def token_counts(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown (characters without a piece), score (sum of the words' forward scores)."""

    def make():
        counter = TrieCounter(load_pieces(model_path))

        def work(batch):
            texts = [(text or "").encode("utf-8", "surrogatepass").split() for text in batch["text"].to_pylist()]
            tokens, unknown, scores = zip(*counter.counts(texts), strict=True) if texts else ((), (), ())
            return {"doc_id": batch["doc_id"], "n_words": list(map(len, texts)), "n_tokens": tokens, "n_unknown": unknown, "score": scores}

        return work

    return arrow_map(documents.select("doc_id", "text"), make, SCHEMA)
