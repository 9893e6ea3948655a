"""Licence scans by matching statistics against a generalised suffix automaton.

The automaton holds the token sequences of all licence templates and of the
base phrases.  A text is streamed through it, which gives for every token the
longest match that ends there.  Base phrases are read off the suffix links of
the states passed; maximal matches of some length are chained, in order, to
covered spans of the template they come from.
"""

from __future__ import annotations

import bisect
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import slices, pieces, words

#: Phrases of the base labels.  Fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Texts by which licences are told, one a line, after their label: names, grants, conditions and disclaimers.
LICENCES = os.path.join(os.path.dirname(__file__), "licences.txt")
#: A match counts in a chain from so many tokens on; a label is given from so much of a template covered.
MIN_MATCH, MIN_COVER = 3, 0.75
#: Tokens that may stand between two matches of one chain.
MAX_GAP = 8
FIELDS = T.StructType().add("n_words", "long").add("base", T.ArrayType(T.StructType().add("label", "string").add("start", "long").add("end", "long"))).add("covered", T.ArrayType(T.StructType().add("label", "string").add("start", "long").add("end", "long").add("cover", "double"))).add("score", "double")


def load(path: str = LICENCES) -> dict[str, list[str]]:
    """Templates by label, from a file that the driver reaches."""
    out: dict[str, list[str]] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            label, _, text = line.partition(":")
            if text.split():
                out.setdefault(label.strip(), []).append(" ".join(text.split()))
    return out


class Automaton:
    """A suffix automaton of several token sequences (lists of ints)."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def add(self, tokens: list[int]) -> None:
        last = 0
        for t in tokens:
            last = self._extend(last, t)

    def mark(self, sequences: list[list[int]]) -> None:
        """Once all is added: in each state, by sequence, all indices of it that end there."""
        self.at: list[dict[int, list[int]]] = [{} for _ in self.link]
        for k, tokens in enumerate(sequences):
            state = 0
            for i, t in enumerate(tokens):
                state = self.next[state][t]
                up = state
                while up > 0:
                    self.at[up].setdefault(k, []).append(i)
                    up = self.link[up]
        for k, tokens in enumerate(sequences):
            state = 0
            for t in tokens:
                state = self.next[state][t]
            self.ends[state].append((k, len(tokens)))

    def step(self, state: int, n: int, token: int) -> tuple[int, int]:
        while state and token not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        if token in self.next[state]:
            return self.next[state][token], n + 1
        return 0, 0


def _model(base: dict[str, str], templates: dict[str, list[str]]) -> dict:
    """The automaton, the ids of the tokens by their hash, and whose sequence is which."""
    sequences = [(label, phrase.split(), True) for phrase, label in base.items()]
    sequences += [(label, t.split(), False) for label, ts in templates.items() for t in ts]
    tokens = sorted({w for _, s, _ in sequences for w in s})
    ids = {w: i + 1 for i, w in enumerate(tokens)}
    machine, coded = Automaton(), [[ids[w] for w in s] for _, s, _ in sequences]
    for s in coded:
        machine.add(s)
    machine.mark(coded)
    hashes = np.empty(len(tokens), np.uint64)
    for _, data, bounds in pieces(pa.array([" ".join(tokens)], pa.large_string())):
        hashes = words(data, bounds, "alnum")[3]
    order = np.argsort(hashes)
    return {"machine": machine, "owner": [(label, len(s), is_base) for label, s, is_base in sequences], "hashes": hashes[order], "ids": order + 1, "words": [w.encode() for w in tokens]}


def _matches(machine: Automaton, tokens: list[int], owner: list) -> tuple[list, dict]:
    """Base places (label, first, end), and by sequence its maximal matches (first, end, index of its end)."""
    base, found = [], {}
    state = n = 0
    passed = []
    for i, t in enumerate([*tokens, 0]):
        before = state, n
        state, n = machine.step(state, n, t) if t else (0, 0)
        if n <= before[1] and before[1] >= MIN_MATCH:  # the match that ended at i - 1 could not be extended
            passed.append((i, before))
        up = state
        while up > 0:
            for k, size in machine.ends[up]:
                if size <= n and owner[k][2]:
                    base.append((owner[k][0], i + 1 - size, i + 1))
            up = machine.link[up]
    for end, (s, size) in passed:
        for k, indices in machine.at[s].items():
            if not owner[k][2]:
                found.setdefault(k, []).extend((end - size, end, index) for index in indices)
    return base, found


def _best(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(covered tokens, first, end) of the best chain that ends in each match of one template.

    A chain goes on with a match that ends later in text and template and
    begins at most MAX_GAP tokens after; so only matches of a template's
    length and that gap before are looked at.
    """
    places = sorted(set(places), key=lambda p: (p[1], p[2]))
    ends, out = [p[1] for p in places], []
    for i, (a, b, at) in enumerate(places):
        best = (b - a, a, b)
        for j in range(bisect.bisect_left(ends, a - MAX_GAP), i):
            gain = min(b - max(a, places[j][1]), at - places[j][2])
            if gain > 0 and out[j][0] + gain > best[0]:
                best = (out[j][0] + gain, out[j][1], b)
        out.append(best)
    return out


def _chains(found: dict, owner: list) -> list[tuple[str, int, int, float]]:
    """Covered spans: the best chains of each template that do not overlap; of different labels that do, the one that covers more."""
    chains = []
    for k, places in found.items():
        label, size, _ = owner[k]
        taken: list[tuple[int, int]] = []
        for n, first, end in sorted(_best(places), key=lambda c: (-c[0], c[1], c[2])):
            if n < MIN_COVER * size:
                break
            i = bisect.bisect_left(taken, (first, end))
            if (i == 0 or taken[i - 1][1] <= first) and (i == len(taken) or end <= taken[i][0]):
                taken.insert(i, (first, end))
                chains.append((first, end, n, label, min(1.0, n / size)))
    chains.sort()
    longest = max((e - f for f, e, *_ in chains), default=0)
    starts, out = [c[0] for c in chains], []
    for first, end, n, label, cover in chains:
        near = chains[bisect.bisect_left(starts, first - longest) : bisect.bisect_left(starts, end)]
        if not any(e > first and m > n and other != label for _, e, m, other, _ in near):
            out.append((label, first, end, cover))
    return sorted(set(out), key=lambda x: (x[1], x[0], x[2]))


def scan(docs: DataFrame, text: str = "text", base: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns of ``docs`` without the text, with n_words, base, covered, score.

    base lists every place of a base phrase (label, start, end in words from
    0, places in order of their starts); covered the spans chained from
    matches, with the part of the template they cover; score is the largest
    such part, or 1 where a base phrase stands.  A span of which different
    labels cover as much has all of them.  Null and empty texts have no words
    and nothing found, with score 0; without phrases and templates nothing is
    found anywhere.  Long texts are streamed whole; what is kept of one are its
    matches.  Rows stay as they are, repeated ones too, and an empty table gives
    an empty one; columns of ``docs`` with the names of results are replaced.
    """
    model = _model(BASE if base is None else base, load() if templates is None else templates)
    keep = [c for c in docs.columns if c != text and c not in FIELDS.names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        hashes, ids, owner, machine = m["hashes"], m["ids"], m["owner"], m["machine"]
        shortest = min([MIN_MATCH, *(size for _, size, is_base in owner if is_base)])
        for batch in slices(batches):
            n = batch.num_rows
            n_words, base_at, covered, score = [0] * n, [[] for _ in range(n)], [[] for _ in range(n)], [0.0] * n
            for lo, data, bounds in pieces(batch.column(batch.schema.get_field_index(text))):
                start, end, row, h = words(data, bounds, "alnum")
                for i, c in enumerate(np.diff(np.searchsorted(row, np.arange(len(bounds)))).tolist()):
                    n_words[lo + i] = c
                if not len(h) or not len(hashes):
                    continue
                first = np.searchsorted(row, np.arange(len(bounds)))
                place = np.searchsorted(hashes, h)
                place[place == len(hashes)] = 0
                known = hashes[place] == h
                # runs of licence tokens within a text; shorter ones can hold no match
                edge = known & np.concatenate(([True], ~known[:-1] | (row[1:] != row[:-1])))
                begin = np.flatnonzero(edge)
                stop = np.flatnonzero(known & np.concatenate((~known[1:] | (row[1:] != row[:-1]), [True]))) + 1
                long = stop - begin >= shortest
                runs: dict[int, list] = {}
                for a, b in zip(begin[long].tolist(), stop[long].tolist()):
                    runs.setdefault(int(row[a]), []).append((a, b))
                for i, parts in runs.items():
                    zero, all_base, all_found = int(first[i]), [], {}
                    for a, b in parts:
                        codes = [int(x) for x in ids[place[a:b]]]
                        low = data[start[a] : end[b - 1]].tobytes().lower()
                        s0 = int(start[a])
                        codes = [c if low[start[j] - s0 : end[j] - s0] == m["words"][c - 1] else 0 for j, c in zip(range(a, b), codes)]
                        got, found = _matches(machine, codes, owner)
                        all_base += [(x, s + a - zero, e + a - zero) for x, s, e in got]
                        for k, v in found.items():
                            all_found.setdefault(k, []).extend((s + a - zero, e + a - zero, at) for s, e, at in v)
                    chains = _chains(all_found, owner)
                    base_at[lo + i] = [dict(zip(("label", "start", "end"), x)) for x in sorted(all_base, key=lambda x: (x[1], x[2], x[0]))]
                    covered[lo + i] = [dict(zip(("label", "start", "end", "cover"), x)) for x in chains]
                    score[lo + i] = 1.0 if all_base else max((x[3] for x in chains), default=0.0)
            place3 = [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
            made = [pa.array(n_words, pa.int64()), pa.array(base_at, pa.list_(pa.struct(place3))), pa.array(covered, pa.list_(pa.struct([*place3, ("cover", pa.float64())]))), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *made], names=[*keep, *FIELDS.names])

    return docs.drop(*(c for c in FIELDS.names if c != text)).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *FIELDS.fields]))
