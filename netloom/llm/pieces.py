"""SentencePiece encoding with the N best segmentations, and decoding.

The lattice of a text has an edge for every piece of the vocabulary that stands in it, weighted with the piece's score;
a character in no piece is an edge of its UTF-8 bytes' pieces. A forward Viterbi pass gives, for every position, the
best score from the beginning; these are exact heuristics for an A-star search backward from the end, which therefore
yields complete segmentations in the order of their scores. No piece holds a space mark after another character, so
every path passes through each word's beginning: the search runs over each different word once in a worker, and the
best segmentations of the text are the best sums of those of its words. Scores within 1e-6 are ties, in any order.

The scores are those of the vocabulary file. In a file of the BPE kind they rank the merges, and the library encodes by
merging in that order, not by the best sum, so its encoding need not be the first segmentation here (a file of the
unigram kind has log probabilities, for which it is).

Null text is empty and has one segmentation, without pieces. A text with fewer segmentations gives fewer. Work grows in
proportion to a text's length, also for one long word. Repeated rows are encoded alike; an empty table gives an empty
result. Columns besides the keys are ignored; keys may have any names but scores, ids, decoded.
"""

from __future__ import annotations

import heapq
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import slices

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Scores are summed in whole billionths.
SCALE = 10**9
#: The key of a piece in the tree; no character is empty.
END = ""
_NOTHING: dict = {}
UNKNOWN = 10.0  #: below the least score of any piece, as the library does for unknown characters
REMEMBERED = 200_000


def _whole(score: float) -> int:
    return round(score * SCALE)


class Segmenter:
    """The pieces of one vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, self.score, self.id, self.byte = self.model, {}, {}, {}
        for i in range(m.get_piece_size()):
            if m.is_byte(i):
                self.byte[int(m.id_to_piece(i)[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.score[m.id_to_piece(i)], self.id[m.id_to_piece(i)] = m.get_score(i), i
        self.least = min(self.score.values()) - UNKNOWN
        self.tree: dict = {}  # by characters; under END stands the piece that ends there
        for piece, s in self.score.items():
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[END] = (_whole(s), (self.id[piece],))
        self.words: dict = {}

    def normalize(self, text: str) -> str:
        """The text with the library's normalisation, space marks and leading mark."""
        text = self.model.normalize(text).replace(" ", MARK)
        return text if text.startswith(MARK) or not text else MARK + text

    def lattice(self, word: str) -> tuple[list[list[tuple[int, int, tuple[int, ...]]]], list[int]]:
        """For each position the edges that end there, (where they begin, score, ids), and the best score from the beginning."""
        into: list = [[] for _ in range(len(word) + 1)]
        best: list = [0] + [None] * len(word)
        for a in range(len(word)):
            node, start, b = self.tree, best[a], a
            for c in word[a:] if len(word) - a < 64 else itertools.islice(word, a, None):
                node = node.get(c)
                if node is None:
                    break
                b += 1
                piece = node.get(END)
                if piece:
                    into[b].append((a, *piece))
                    if best[b] is None or start + piece[0] > best[b]:
                        best[b] = start + piece[0]
            if not self.tree.get(word[a], _NOTHING).get(END):
                s = _whole(self.least)
                into[a + 1].append((a, s, tuple(self.byte.get(x, 0) for x in word[a].encode("utf-8", "surrogatepass"))))
                if best[a + 1] is None or start + s > best[a + 1]:
                    best[a + 1] = start + s
        return into, best

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each position, the edges that end there: (where they begin, score, ids)."""
        return [[(a, s / SCALE, ids) for a, s, ids in into] for into in self.lattice(word)[0]]

    def nbest_word(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one word, best first."""
        into, best = self.lattice(word)
        # A state is (cost, age, position, score from there to the end, (ids, state after)): among equal costs the
        # youngest goes on, so that a tie is followed to its end instead of all ties side by side. Scores are whole numbers of
        # billionths, so sums are exact and ties are ties.
        agenda, found, age = [(-best[-1], 0, len(word), 0, None)], [], 0
        push, pop = heapq.heappush, heapq.heappop
        while agenda and len(found) < n:
            _, _, at, done, after = pop(agenda)
            if at == 0:
                ids = []
                while after:
                    ids.extend(after[0])
                    after = after[1]
                found.append((round(done / SCALE, 6), tuple(ids)))
                continue
            for a, s, piece in into[at]:
                age -= 1
                total = s + done
                push(agenda, (-best[a] - total, age, a, total, (piece, after)))
        return found

    def nbest(self, text: str | None, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text as (score, ids), best first."""
        ways = []
        for w in _WORD.findall(self.normalize(text or "")):
            known = self.words.get((w, n))
            if known is None:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                found = self.nbest_word(w, n)
                known = self.words[w, n] = (found, [round(found[0][0] - f[0], 6) for f in found[1:]])
            ways.append(known)
        base = [i for found, _ in ways for i in found[0][1]]
        total = sum(found[0][0] for found, _ in ways)
        # A change of a word whose cheapest change is not among the n cheapest is worse than n other changes.
        near = heapq.nsmallest(n, ((lost[0], j) for j, (_, lost) in enumerate(ways) if lost))
        worse = heapq.nsmallest(n, ((x, j, k) for _, j in near for k, x in enumerate(ways[j][1], 1)))
        out, agenda, seen = [], [(0.0, ())], {()}
        while agenda and len(out) < n:  # combinations of a few changed words, cheapest first
            lost, changed = heapq.heappop(agenda)
            out.append((round(total - lost, 6), self._changed(base, ways, changed)))
            for cost, j, k in worse:
                if all(j != i for i, _ in changed):
                    more = tuple(sorted((*changed, (j, k))))
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(agenda, (round(lost + cost, 6), more))
        return out

    @staticmethod
    def _changed(base: list[int], ways, changed) -> list[int]:
        ids, at, word = list(base), 0, 0
        for j, k in changed:  # in the order of words
            at += sum(len(found[0][1]) for found, _ in ways[word:j])
            ids[at : at + len(ways[j][0][0][1])] = ways[j][0][k][1]
            at, word = at + len(ways[j][0][k][1]), j + 1
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_held: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    """One for each worker and vocabulary."""
    if path not in _held:
        _held[path] = Segmenter(path)
    return _held[path]


def nbest_segmentations(texts: DataFrame, path: str, keys: list[str], n: int = 4) -> DataFrame:
    """keys, scores array<double>, ids array<array<int>>, decoded: the n best segmentations and the text of the best."""
    schema = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                found = [segmenter(path).nbest(t, n) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(len(keys))), pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64())), pa.array([[i for _, i in f] for f in found], pa.list_(pa.list_(pa.int32()))), pa.array([segmenter(path).decode(f[0][1]) for f in found], pa.string())],
                    [*keys, "scores", "ids", "decoded"],
                )

    return texts.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{schema}, scores array<double>, ids array<array<int>>, decoded string")
