"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

Learning (on a bounded sample of labelled documents):

1. Lexicon.  Words, and stems (beginnings that several words share), which
   stand in toxic documents so often that chance is ruled out, become entries
   of a trie.  Near copies count once: documents are counted by a minimum hash
   of their word triples.
2. Automaton.  Positions (trie node, edits) of the Levenshtein automata of all
   entries together, made deterministic: one table, states x character
   classes.  A word of 5 letters may have one edit, of 9 two; a stem of 7 one.
   So a text's words are matched against all entries and all their
   misspellings by one table look-up a character; words that no entry can
   match any more leave after a few characters.
3. Weights.  Each (entry, edits) has the log-odds of its documents; few
   documents leave it near that of the entry, less for each edit.  The window
   of WINDOW words around a hit tells quotation from abuse: quotation marks
   around it and words that go with hits in clean documents take heat off it.
4. A logistic layer on the heat of a document's hits: of the distinct
   entries, and of all hits for its length.

Scoring reads whole texts, without a shuffle; the model's size is bounded by
the number of entries.
"""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.session import on_workers

from .arrowtext import pieces
from .common import first_by_hash, one_each

ENTRIES, WINDOW, CONTEXTS = 300, 4, 2000
QUOTES = "\"“”„«»‹›"
DEAD, START = 0, 1
_BLANK, _LETTER, _OTHER = 0, 1, 2  # classes of characters that no entry has


def edits_allowed(entry: str, stem: bool) -> int:
    n = len(entry)
    return int(n >= 7) if stem else (n >= 5) + (n >= 9)


@lru_cache(maxsize=1)
def _plain_classes() -> np.ndarray:
    every = np.full(sys.maxunicode + 1, _OTHER, np.int16)
    every[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = _LETTER
    every[[0x20, *range(0x09, 0x0E)]] = _BLANK
    return every


@dataclass
class Automaton:
    """``step[state, class]``; ``entry`` and ``edits`` of accepting states (else
    -1): as a whole word, or (``done``) whatever follows."""

    alphabet: str
    step: np.ndarray
    entry: np.ndarray
    edits: np.ndarray
    done: np.ndarray

    def classes(self) -> np.ndarray:
        out = _plain_classes().copy()
        for i, c in enumerate(self.alphabet):
            out[ord(c)] = 3 + i
        return out


def automaton(entries: list[tuple[str, bool]]) -> Automaton:
    """The union of the Levenshtein automata of (entry, is a stem), made
    deterministic along the trie of the entries."""
    children: list[dict[str, int]] = [{}]
    ends: list[list[int]] = [[]]
    most = [0]
    for number, (entry, stem) in enumerate(entries):
        node, allowed = 0, edits_allowed(entry, stem)
        for c in entry:
            most[node] = max(most[node], allowed)
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append([])
                most.append(0)
            node = children[node][c]
        most[node] = max(most[node], allowed)
        ends[node].append(number)
    alphabet = "".join(sorted({c for e, _ in entries for c in e}))

    def closed(positions: dict[int, int]) -> dict[int, int]:
        """With the positions that leaving out letters of an entry reaches."""
        todo = list(positions)
        while todo:
            node = todo.pop()
            e = positions[node] + 1
            for child in children[node].values():
                if e <= most[child] and e < positions.get(child, 99):
                    positions[child] = e
                    todo.append(child)
        return positions

    def found(positions: dict[int, int], stems: bool) -> tuple[int, int]:
        """(edits, entry) of the best entry that ends here; (99, -1) without one."""
        return min(((e, n) for node, e in positions.items() for n in ends[node] if entries[n][1] == stems and e <= edits_allowed(*entries[n])), default=(99, -1))

    def after(positions: dict[int, int], c: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, e in positions.items():
            reached = [(child, e + (x != c)) for x, child in children[node].items()] + [(node, e + 1)]
            for to, k in reached:
                if k <= most[to] and k < out.get(to, 99):
                    out[to] = k
        return closed(out)

    letters = ["", "", "", *alphabet]  # letters that no entry has, and other characters, match nothing
    numbers: dict[object, int] = {None: DEAD, tuple(sorted(closed({0: 0}).items())): START}
    states: list[object] = [None, dict(closed({0: 0}))]
    step, entry, edits, done = [[DEAD] * len(letters)], [-1], [-1], [False]
    at = 1
    while at < len(states):
        now = states[at]
        if isinstance(now, tuple):  # a stem was found: stay, whatever follows
            step.append([at] * len(letters))
            edits.append(now[0])
            entry.append(now[1])
            done.append(True)
        else:
            e, n = found(now, False)
            entry.append(n)
            edits.append(e if n >= 0 else -1)
            done.append(False)
            row = [DEAD]
            for c in letters[1:]:
                to = after(now, c)
                stem = found(to, True)
                key = ("stem", *stem) if stem[1] >= 0 else tuple(sorted(to.items())) or None
                if key not in numbers:
                    numbers[key] = len(states)
                    states.append(stem if stem[1] >= 0 else to)
                row.append(numbers[key])
            step.append(row)
        at += 1
    return Automaton(alphabet, np.array(step, np.int32), np.array(entry, np.int32), np.array(edits, np.int8), np.array(done, bool))


@dataclass
class Words:
    """Words of many texts: runs without blanks, from their first to their last
    letter, in small letters."""

    text: str
    chars: np.ndarray
    kinds: np.ndarray  # classes of the characters
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray

    def word(self, i: int) -> str:
        return self.text[self.start[i]:self.end[i]]


def words_of(texts: list[str], classes: np.ndarray) -> Words:
    lowered = [t.lower() for t in texts]
    text = " ".join(lowered) + " "
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = classes[chars]
    letter = np.flatnonzero((kinds == _LETTER) | (kinds > _OTHER))
    run = np.cumsum(kinds == _BLANK)[letter]
    new = np.append(True, run[1:] != run[:-1]) if len(run) else np.zeros(0, bool)
    start, end = letter[new], letter[np.append(new[1:], True)] + 1 if len(run) else letter
    first = np.cumsum([0, *(len(t) + 1 for t in lowered)])[:-1]
    return Words(text, chars, kinds, start, end, np.searchsorted(first, start, "right") - 1)


def matches(machine: Automaton, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, entry, edits) of all words that the automaton accepts: all words
    go one character on at a time, those of dead states leave."""
    live = np.arange(len(words.start))
    state, at, end = np.full(len(live), START, np.int32), words.start, words.end
    hits = []
    while len(live):
        state = machine.step[state, words.kinds[at]]
        at = at + 1
        over = (at == end) | machine.done[state]
        some = over & (machine.entry[state] >= 0)
        hits.append(np.stack([live[some], state[some]]))
        left = ~over & (state != DEAD)
        live, state, at, end = live[left], state[left], at[left], end[left]
    word, state = np.concatenate(hits, 1) if hits else np.zeros((2, 0), np.int64)
    order = np.argsort(word, kind="stable")
    return word[order], machine.entry[state[order]], machine.edits[state[order]]


def windows_of(words: Words, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of the window around each hit, within its text."""
    bound = np.searchsorted(words.owner, words.owner[word]), np.searchsorted(words.owner, words.owner[word], "right") - 1
    return np.maximum(word - WINDOW, bound[0]), np.minimum(word + WINDOW, bound[1])


def quoted(words: Words, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a quotation opens before the hit and closes after it in its window."""
    mark = np.isin(words.chars, [ord(c) for c in QUOTES])
    n = np.concatenate([[0], np.cumsum(mark)])
    left = np.maximum(words.start[low] - 1, 0)
    right = np.minimum(words.end[high] + 1, len(words.chars))
    return ((n[words.start[word]] - n[left]) % 2 == 1) & (n[right] > n[words.end[word]])


@dataclass
class Model:
    """``weight[entry, edits]``; ``context``: heat that a word in the window
    adds; ``quotation``: what quotation marks add; ``layer``: bias, weight of
    the distinct entries' heat, weight of all heat for the length."""

    entries: list[tuple[str, bool]]
    machine: Automaton
    weight: np.ndarray
    context: dict[str, float] = field(default_factory=dict)
    quotation: float = -3.0
    layer: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def heat(self, words: Words, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Weight of each hit, less what its window takes off."""
        word, entry, edits = found
        low, high = windows_of(words, word)
        lean = 2.0 + self.quotation * quoted(words, word, low, high)
        if self.context:
            for i, (w, a, b) in enumerate(zip(word.tolist(), low.tolist(), high.tolist())):
                lean[i] += sum(self.context.get(words.word(j), 0.0) for j in range(a, b + 1) if j != w)
        return self.weight[entry, edits] / (1 + np.exp(-np.clip(lean, -30, 30)))

    def inputs(self, texts: list[str], classes: np.ndarray) -> np.ndarray:
        words = words_of(texts, classes)
        found = matches(self.machine, words)
        heat, n = self.heat(words, found), len(texts)
        of = words.owner[found[0]]
        best = np.zeros(0)
        key = of.astype(np.int64) * max(1, len(self.entries)) + found[1]
        order = np.lexsort((-heat, key))
        first = np.append(True, key[order][1:] != key[order][:-1]) if len(order) else np.zeros(0, bool)
        best = order[first]
        distinct = np.bincount(of[best], heat[best], n)
        spread = np.bincount(of, heat, n) / np.sqrt(np.bincount(words.owner, minlength=n) + 10)
        return np.stack([np.clip(distinct, -20, 20), np.clip(spread, -20, 20)], 1)

    def score(self, texts: list[str], classes: np.ndarray) -> np.ndarray:
        x = self.inputs(texts, classes)
        return 1 / (1 + np.exp(-np.clip(self.layer[0] + x @ np.array(self.layer[1:]), -30, 30)))


def surprise(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    """Twice the log-likelihood ratio of ``pos`` of n_pos and ``neg`` of n_neg
    documents against one rate for both; 0 if the rate is not higher in pos."""
    if not pos or pos * n_neg <= neg * n_pos:
        return 0.0
    p = (pos + neg) / (n_pos + n_neg)
    term = lambda k, n: k * math.log(k / (n * p)) if k else 0.0
    rest = lambda k, n: (n - k) * math.log((n - k) / (n * (1 - p))) if n > k and p < 1 else 0.0
    return 2 * (term(pos, n_pos) + term(neg, n_neg) + rest(pos, n_pos) + rest(neg, n_neg))


def lexicon(counts: dict[str, tuple[float, float]], n_pos: float, n_neg: float) -> list[tuple[str, bool]]:
    """(entry, is a stem) from the documents of each label that hold a word.
    An entry must be so surprising that among all words and stems looked at
    less than one would get there by chance, and at least eight times as
    frequent in toxic documents."""
    if not n_pos or not n_neg:
        return []
    stems: dict[str, list] = defaultdict(lambda: [0, 0, 0])
    for w, (p, q) in counts.items():
        for k in range(4, min(len(w), 9)):
            s = stems[w[:k]]
            s[0] += p
            s[1] += q
            s[2] += p >= 2
    least = 2 * math.log(max(10, len(counts))) + 4
    steep = lambda p, q: (p + 0.5) / n_pos >= 8 * (q + 0.5) / n_neg
    chosen = {s: surprise(min(p, n_pos), min(q, n_neg), n_pos, n_neg) for s, (p, q, kinds) in stems.items() if kinds >= 3 and p >= 4 and steep(p, q)}
    chosen = {s: g for s, g in chosen.items() if g >= least and not any(s[:k] in chosen and chosen[s[:k]] >= least for k in range(4, len(s)))}
    whole = {w: surprise(p, q, n_pos, n_neg) for w, (p, q) in counts.items() if p >= 3 and len(w) >= 3 and steep(p, q)}
    whole = {w: g for w, g in whole.items() if g >= least}
    of_stem: dict[str, list[str]] = defaultdict(list)
    for w in whole:
        for k in range(4, len(w)):
            if w[:k] in chosen:
                of_stem[w[:k]].append(w)
    # a stem that one word carries alone is that word
    stemmed = {s: g for s, g in chosen.items() if len(of_stem[s]) != 1 or stems[s][0] > 1.5 * counts[of_stem[s][0]][0]}
    covered = {w for s in stemmed for w in of_stem[s]}
    every = [(g, s, True) for s, g in stemmed.items()] + [(g, w, False) for w, g in whole.items() if w not in covered]
    return [(w, stem) for _, w, stem in sorted(every, key=lambda x: (-x[0], x[1]))[:ENTRIES]]


def log_odds(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    return math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))


def _logistic(x: np.ndarray, y: np.ndarray, pull: float = 0.02, rounds: int = 25) -> np.ndarray:
    """Bias and weights by Newton steps, pulled towards (-3, 1, 1)."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    prior = np.array([-3.0, 1.0, 1.0])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * len(y) / 100 * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(3) * (pull * len(y) / 100 + 1e-6)
        move = np.linalg.solve(hess, grad)
        w = w - np.clip(move, -2, 2)
    w[1:] = np.maximum(w[1:], 0)
    return w


def learned(texts: list[str], labels: np.ndarray) -> Model:
    """A model from labelled texts.  Without texts of both labels nothing is
    learned: every score is the share of label 1 (0.5 without texts)."""
    share = float(np.mean(labels)) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model([], automaton([]), np.zeros((0, 3)), layer=(math.log(p / (1 - p)), 0.0, 0.0))
    plain = _plain_classes()
    groups: list[set] = [set(), set()]
    held: dict[str, tuple[set, set]] = {}
    group_of = []
    for t, y in zip(texts, labels.tolist()):
        words = words_of([t], plain)
        ws = [words.word(i) for i in range(len(words.start))]
        threes = [xxhash.xxh3_64_intdigest(" ".join(ws[i:i + 3])) for i in range(max(1, len(ws) - 2))]
        group = min(threes)
        group_of.append(group)
        groups[y].add(group)
        for w in set(ws):
            held.setdefault(w, (set(), set()))[y].add(group)
    n_pos, n_neg = len(groups[1]), len(groups[0])
    counts = {w: (len(p), len(q)) for w, (q, p) in held.items() if p}
    for w, (q, p) in held.items():  # words of clean documents count against stems
        if not p:
            counts[w] = (0, len(q))
    del held
    entries = lexicon(counts, n_pos, n_neg)
    model = Model(entries, automaton(entries), np.zeros((len(entries), 3)))
    classes = model.machine.classes()
    hit_groups: dict[tuple[int, int], tuple[set, set]] = {}
    around: tuple[Counter, Counter] = (Counter(), Counter())
    in_quotes, hits = [0, 0], [0, 0]
    for t, y, group in zip(texts, labels.tolist(), group_of):
        words = words_of([t], classes)
        word, entry, edits = matches(model.machine, words)
        low, high = windows_of(words, word)
        marks = quoted(words, word, low, high)
        seen = set()
        for w, n, e, a, b in zip(word.tolist(), entry.tolist(), edits.tolist(), low.tolist(), high.tolist()):
            hit_groups.setdefault((n, e), (set(), set()))[y].add(group)
            seen.update(words.word(j) for j in range(a, b + 1) if j != w)
        around[y].update(seen)
        in_quotes[y] += bool(marks.any())
        hits[y] += len(word) > 0
    for n in range(len(entries)):
        exact = hit_groups.get((n, 0), ((), ()))
        base = log_odds(len(exact[1]), len(exact[0]), n_pos, n_neg)
        model.weight[n, 0] = base
        for e in (1, 2):
            clean, toxic = hit_groups.get((n, e), ((), ()))
            k = len(clean) + len(toxic)
            model.weight[n, e] = (k * log_odds(len(toxic), len(clean), n_pos, n_neg) + 5 * base * 0.6**e) / (k + 5)
    if hits[0]:
        lean = {w: log_odds(around[1][w], around[0][w], hits[1], hits[0]) for w in around[0] if around[0][w] >= 3 and surprise(around[0][w], around[1][w], hits[0], hits[1]) >= 2 * math.log(max(10, len(around[0]))) + 4}
        model.context = dict(sorted(lean.items(), key=lambda x: (x[1], x[0]))[:CONTEXTS])
        model.quotation = min(0.0, (5 * model.quotation + (in_quotes[0] + in_quotes[1]) * log_odds(in_quotes[1], in_quotes[0], hits[1], hits[0])) / (5 + in_quotes[0] + in_quotes[1]))
    x = np.concatenate([model.inputs(texts[i:i + 500], classes) for i in range(0, len(texts), 500)])
    model.layer = tuple(_logistic(x, labels.astype(float)).tolist())
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = 2000) -> Model:
    """Learn from at most ``per_label`` documents of each value of
    ``labels.toxic`` (whole texts, one row of each doc_id: that of the smallest
    text hash).  Rows of ``labels`` that disagree on a doc_id, or are null,
    teach nothing, nor do null texts.  The driver sees these texts only."""
    agreed = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    agreed = agreed.filter(F.col("toxic") == F.col("_most")).select("doc_id", "toxic")
    ids = first_by_hash(agreed.filter(usable), ["toxic"], "doc_id", per_label)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    table = one_each(rows, ["doc_id", "toxic"]).toArrow().sort_by("doc_id")
    return learned(table.column("text").to_pylist(), np.array(table.column("toxic").to_pylist(), np.int64))


def predictions(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold), one row per row.

    A null or empty text has no hits: its score is that of the bias alone.
    Whole texts are read, in runs of about 1 MB (a longer text by itself)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        classes = own.machine.classes()
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                s = own.score([t or "" for t in part.column(1).to_pylist()], classes)
                yield pa.record_batch([part.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return on_workers(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double, predicted int")
