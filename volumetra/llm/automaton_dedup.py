"""Removal of repeated word passages with suffix automata.

The reference is the corpus itself, cut into shards of passages that can repeat
(see repeats.py). A shard's suffix automaton is built in the task that holds the
shard, and the passages of all documents that can match it stream through it for
their matching statistics: at each word, the length of the longest match that ends
there, and how often it stands in the shard. Windows within a match of at least
their length that stands more than once are repeated. Sending passages to their
shard, rather than every automaton to every task, keeps what a task holds
independent of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from volumetra.llm.common import utf8, word_spans
from volumetra.llm.repeats import Words, covered, repeated

#: Production parameters: words of a repeated window, and of an anchor's gram.
WINDOW, GRAM = 35, 15
#: Words of a shard.
SHARD_WORDS = 150_000


class Automaton:
    """Suffix automaton of several word sequences, with weighted occurrence counts."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: list, weight: int) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:  # the sequence so far is known
                count[q] += weight
                last = q
                continue
            if q is not None:
                last = self._clone(last, w, q)
                count[last] += weight
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            count.append(weight)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link = self.next, self.link
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        link.append(link[q])
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def finish(self) -> None:
        """Carry occurrences over to the suffixes of what was met."""
        link, count = self.link, self.count
        for s in np.argsort(self.length, kind="stable")[:0:-1].tolist():
            count[link[s]] += count[s]

    def stream(self, words: list, most: int):
        """Matching statistics of a document: at each word, the length (up to `most`) of the longest match that ends there,
        and its state. Matches of one length share a state only if they are equal."""
        nxt, link, length = self.next, self.link, self.length
        state = have = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                have = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                have += 1
            while state and length[link[state]] >= most:
                state = link[state]
            have = min(have, length[state], most)
            yield have, state


def solve(gh: np.ndarray, contents: list[bytes], anchor: np.ndarray, n: np.ndarray, copies: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """See repeats.repeated(): equal windows share their state in the shard's automaton."""
    shard = Automaton()
    for content, times in zip(contents, copies.tolist()):
        shard.add(content.split(b" "), times)
    shard.finish()
    states: list[int] = []
    for content in contents:
        states += [state for have, state in shard.stream(content.split(b" "), window) if have == window]
    group = np.array(states, np.int64)
    return group, np.array(shard.count, np.int64)[group]


def dedup_word_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD_WORDS) -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts elsewhere in the corpus.

    Takes `doc_id` and `text` (other columns are ignored). Returns, a row for each row of docs: doc_id,
    n_words, n_removed and kept (kept words joined by one space, as UTF-8 bytes).
    Null, empty and blank texts have no words; a null doc_id stays null; equal rows count as occurrences of each other;
    an empty table gives an empty one. Very long texts are searched in parts that overlap.
    """

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch["text"])
            out: tuple[list, ...] = ([], [], [])
            for k, ranges in enumerate(batch["ranges"].to_pylist()):
                own = data[bounds[k] : bounds[k + 1]]
                words = own.tobytes().split()
                gone = covered(len(words), ranges, window)
                left = [w for w, g in zip(words, gone.tolist()) if not g] if ranges else words
                for x, v in zip(out, (len(words), int(gone.sum()), b" ".join(left))):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "n_words", "n_removed", "kept"])

    return repeated(docs, Words, window, gram, solve, shard).mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept binary")
