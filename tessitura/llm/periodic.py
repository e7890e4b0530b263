"""Periodic runs of words: a suffix automaton whose link tree is accessed once per appended word.

A run is a stretch of words with smallest period q, at least twice as long as q, that no neighbouring word extends.

1. The words of a stretch make a suffix automaton; its suffix links are a tree, and the states of all suffixes that
   end at a word are the path from the word's state to the root.
2. Every state has a colour, the last position where its strings ended. Appending word i accesses that path: the
   preferred paths, of one colour each, are cut where the path leaves them and the whole path takes colour i. As the
   tree is known once the automaton stands, the preferred paths lie on its heavy chains, each a stack of (deepest
   length, colour) with the shallowest on top; an access pops what it covers, O(log n) amortised.
3. A recoloured segment of colour p whose longest string has length L means that L words end both at p and at i. With
   d = i - p <= L that is a square of period d, and d is its smallest period. The first square of a run is
   extended to both sides; squares inside a known run of their period are passed over.

Most texts have no run, so a filter without loss picks the stretches: the words of a run after its first period all
start or continue a ``SEED``-word sequence that occurred at most q words earlier, and are at least q many. Blocks of such
starts that reach back further than they are long are dropped until nothing changes; a block and as many words before
it hold its runs whole. Overlapping stretches are joined.

A text is one row of one task, and the automaton takes about 600 bytes a word of its periodic stretches.

Defined results: null and empty texts have no words and no runs; ids may be null or repeat, each row is judged on
its own; an empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import slices, text_bytes
from tessitura.llm.hashing import mix, words

LEAST = 12
#: At least half of the shortest run repeats what came one period before.
SEED = 6
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Automaton:
    """Suffix automaton of a word sequence; ``prefix[i]`` is the state of the words up to i."""

    def __init__(self, ids: Sequence[int]) -> None:
        self.length, self.link, self.prefix = [0], [-1], []
        length, link, steps = self.length, self.link, [{}]
        last = 0
        for i, w in enumerate(ids):
            new = len(length)
            length.append(i + 1)
            link.append(0)
            steps.append({})
            at = last
            while at >= 0 and w not in steps[at]:
                steps[at][w] = new
                at = link[at]
            if at >= 0:
                to = steps[at][w]
                if length[to] != length[at] + 1:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    steps.append(dict(steps[to]))
                    link[to] = copy
                    while at >= 0 and steps[at].get(w) == to:
                        steps[at][w] = copy
                        at = link[at]
                    to = copy
                link[new] = to
            last = new
            self.prefix.append(new)


class Accessed:
    """Last-occurrence colours of the link tree's paths, as preferred paths on heavy chains."""

    def __init__(self, automaton: Automaton) -> None:
        self.length, self.link = automaton.length, automaton.link
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        below, heavy = [1] * len(order), [-1] * len(order)
        largest = [0] * len(order)
        for v in reversed(order[1:]):
            up = self.link[v]
            below[up] += below[v]
            if below[v] > largest[up]:
                largest[up], heavy[up] = below[v], v
        self.head = head = list(range(len(order)))
        for v in order[1:]:
            if heavy[self.link[v]] == v:
                head[v] = head[self.link[v]]
        self.paths: dict[int, list[tuple[int, int]]] = {}

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """Gives the path from ``v`` to the root the ``colour``; (longest length, colour before) of what it took."""
        taken, length, link, head, paths = [], self.length, self.link, self.head, self.paths
        while v > 0:
            top, reach, covered = head[v], length[v], 0
            path = paths.setdefault(top, [])
            while path and path[-1][0] <= reach:
                segment = path.pop()
                covered = segment[0]
                taken.append(segment)
            if path and covered < reach:
                taken.append((reach, path[-1][1]))
            path.append((reach, colour))
            v = link[top]
        return taken


def all_runs(ids: Sequence[int], least: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words, by start, then period."""
    automaton = Automaton(ids)
    tree, n = Accessed(automaton), len(ids)
    found, known = [], {}
    for i, state in enumerate(automaton.prefix):
        for longest, before in tree.access(state, i):
            d = i - before
            if d > longest or known.get(d, -1) >= i:
                continue
            start, end = before - longest + 1, i + 1
            while start > 0 and ids[start - 1] == ids[start - 1 + d]:
                start -= 1
            while end < n and ids[end] == ids[end - d]:
                end += 1
            known[d] = end - 1
            if end - start >= least:
                found.append((start, end - start, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _blocks(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def stretches(own: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last blocks of seed starts that may belong to runs, from word hashes and each word's text."""
    n = max(0, len(own) - SEED + 1)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = mix(own[:-1] + np.uint64(0x9E3779B97F4A7C15) * own[1:])
    seeds = mix(mix(two[:n] + np.uint64(0xC2B2AE3D27D4EB4F) * two[2 : n + 2]) + np.uint64(0x165667B19E3779F9) * two[4 : n + 4] + text[:n].astype(np.uint64))
    order = np.argsort(seeds, kind="stable")
    after = np.flatnonzero(seeds[order[1:]] == seeds[order[:-1]]) + 1
    back = np.full(n, len(own), np.int64)
    back[order[after]] = order[after] - order[after - 1]
    back[text[:n] != text[SEED - 1 :]] = len(own)
    marks = back < len(own)
    while True:
        first, last = _blocks(marks)
        reach = np.repeat(last - first + SEED, last - first + 1)
        good = back[marks] <= reach
        if good.all():
            return first, last
        marks[np.flatnonzero(marks)[~good]] = False


def text_runs(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
    """Word counts of several texts and the runs of those that have any; bytes and offsets as ``text_bytes`` gives them."""
    found = words(data, offsets)
    count = np.bincount(found.text, minlength=len(offsets) - 1)
    begin = np.cumsum(count) - count
    first, last = stretches(found.prefix_hash(), found.text)
    owner = found.text[first] if len(first) else np.zeros(0, np.int64)
    low = np.maximum(begin[owner], first - (last - first + SEED) - 1)
    high = np.minimum(begin[owner] + count[owner], last + SEED + 1)
    out: dict[int, list[tuple[int, int, int]]] = {}
    order = np.argsort(low, kind="stable").tolist()
    k = 0
    while k < len(order):
        text, at, end = int(owner[order[k]]), int(low[order[k]]), int(high[order[k]])
        k += 1
        while k < len(order) and owner[order[k]] == text and low[order[k]] <= end:
            end, k = max(end, int(high[order[k]])), k + 1
        names: dict[bytes, int] = {}
        ids = [names.setdefault(w, len(names)) for w in data[found.start[at] : found.end[end - 1]].tobytes().split()]
        shift = at - int(begin[text])
        here = [(s + shift, n, q) for s, n, q in all_runs(ids, least)]
        if here:
            out.setdefault(text, []).extend(here)
    return count, {t: sorted(r, key=lambda x: (x[0], x[2])) for t, r in out.items()}


def collapsed(content: list[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return content
    steps = np.zeros(len(content) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    inside = np.cumsum(steps)[:-1] > 0
    return [w for w, gone in zip(content, inside.tolist(), strict=True) if not gone]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs(doc_id, text, ...)``."""
    if least < 2 * SEED:
        raise ValueError(f"the filter needs runs of {2 * SEED} words or more")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for rows in slices(batch, "text"):
                data, offsets = text_bytes(rows.column("text"))
                count, found = text_runs(data, offsets, least)
                texts = [b" ".join(collapsed(data[a:b].tobytes().split(), found.get(i, ()))).decode() for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(i, ())] for i in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(count, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, RUNS)
