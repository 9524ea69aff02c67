"""Toxicity of whole texts: a Levenshtein automaton over a learned lexicon's trie, weighed by context."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, ship

_WORD = re.compile(r"[^\W_]+")
# Marks of quotation, words that report speech, words that address someone.
QUOTES = (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("‹", "›"), ("‘", "’"))
REPORTING = {"said", "says", "wrote", "called", "calling", "word", "term", "quote", "quoted", "dit", "mot", "dijo", "palabra", "sagte", "wort"}
ADDRESS = {"you", "your", "youre", "u", "du", "dein", "dich", "ihr", "tu", "toi", "vous", "ton", "usted", "tus", "eres"}
#: An apostrophe within a word is no mark of quotation.
_APOSTROPHE = re.compile(r"(?<=\w)[’‘](?=\w)")
#: Tokens on each side of a hit that make its context.
CONTEXT = 6
FEATURES = 5


class FuzzyLexicon:
    """All words near a term: a trie of the terms intersected with their Levenshtein automata.

    A state is a set of (trie node, edits used); states and their steps are made when a word first needs
    them. Terms shorter than ``fuzzy_from`` letters match exactly only, those of ``twice_from`` letters or
    more within two edits, the others within one. A term cut into one part more than its edits has a part
    that no edit touches, so words that hold no part of a term at a place it can have moved to skip the automaton.
    """

    def __init__(self, terms: dict[str, float], known: set[str] = frozenset(), fuzzy_from: int = 5, twice_from: int = 10, max_states: int = 200_000):
        self.terms, self.known, self.fuzzy_from, self.twice_from, self.max_states = terms, known, fuzzy_from, twice_from, max_states
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, str] = {}
        self.most = [0]  # edits allowed to any term below a node
        self.by_length: dict[int, list[str]] = {}
        self.parts: dict[int, list[tuple[int, int, set[str]]]] = {}
        for term in sorted(terms):
            if len(term) >= fuzzy_from:
                node, edits = 0, self.edits(term)
                self.by_length.setdefault(len(term), []).append(term)
                self.most[0] = max(self.most[0], edits)
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.most.append(0)
                    node = self.children[node][c]
                    self.most[node] = max(self.most[node], edits)
                self.term_at[node] = term
        self._reset()

    def edits(self, term: str) -> int:
        return 0 if len(term) < self.fuzzy_from else 2 if len(term) >= self.twice_from else 1

    def _reset(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.start = self._state({(0, 0)})
        self.seen: dict[str, tuple | None] = {}

    def _state(self, pairs: set) -> int:
        least: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, used = todo.pop()
            if used <= self.most[node] and used < least.get(node, 9):
                least[node] = used
                if used < self.most[node]:
                    todo += [(child, used + 1) for child in self.children[node].values()]  # a letter of the term is missing
        key = frozenset(least.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        if (state, c) not in self.steps:
            after = set()
            for node, used in self.states[state]:
                child = self.children[node].get(c)
                if child is not None:
                    after.add((child, used))
                if used < self.most[node]:
                    after.add((node, used + 1))  # an extra letter
                    after |= {(x, used + 1) for x in self.children[node].values()}  # another letter
            self.steps[state, c] = self._state(after)
        return self.steps[state, c]

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, the heavier one of equals; None if none is near enough or the word is known to be clean."""
        try:
            return self.seen[word]
        except KeyError:
            pass
        if len(self.seen) > 500_000 or len(self.states) > self.max_states:
            self._reset()
        found = self._find(word)
        self.seen[word] = found
        return found

    def _parts(self, length: int) -> list[tuple[int, int, set[str]]]:
        """(start, end, parts of terms that an unedited part of a word of this length can be there)."""
        if length not in self.parts:
            at: dict[tuple[int, int], set[str]] = {}
            for n in range(length - 2, length + 3):
                for term in self.by_length.get(n, ()):
                    edits = self.edits(term)
                    cuts = [n * i // (edits + 1) for i in range(edits + 2)]
                    for first, last in zip(cuts, cuts[1:]):
                        for moved in range(-edits, edits + 1):
                            # Letters gained before the part and behind it are edits, too.
                            if abs(moved) + abs(length - n - moved) <= edits and 0 <= first + moved and last + moved <= length:
                                at.setdefault((first + moved, last + moved), set()).add(term[first:last])
            self.parts[length] = [(first, last, found) for (first, last), found in at.items()]
        return self.parts[length]

    def _find(self, word: str) -> tuple[str, int] | None:
        if word in self.terms:
            return word, 0
        if word in self.known or len(word) < self.fuzzy_from - 1:
            return None
        if not any(word[first:last] in found for first, last, found in self._parts(len(word))):
            return None
        state = self.start
        for c in word:
            state = self._step(state, c)
            if not self.states[state]:
                return None
        ends = [(used, -self.terms[term], term) for node, used in self.states[state] if (term := self.term_at.get(node)) and used <= self.edits(term)]
        return (min(ends)[2], min(ends)[0]) if ends else None


def is_quoted(before: str, after: str) -> bool:
    """Whether a mark that opens is left open at the end of ``before`` and closed in ``after``."""
    before, after = _APOSTROPHE.sub("", before), _APOSTROPHE.sub("", after)
    for opening, closing in QUOTES:
        if opening == closing:
            left = before.count(opening) % 2 == 1
        else:
            left = before.rfind(opening) > before.rfind(closing)
        if left and closing in after:
            return True
    return False


def hits(text: str | None, lexicon: FuzzyLexicon) -> tuple[list[tuple], int]:
    """((start, end, term, edits, weight, quoted) of every hit, number of words). Places are code points of the whole text."""
    words = _WORD.findall(text.lower()) if text else []
    near_terms = {w: found for w in set(words) if (found := lexicon.match(w))}
    if not near_terms:
        return [], len(words)
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) != len(words):  # a few letters become two code points in lower case
        words = [text[start:end].lower() for start, end in spans]
        near_terms = {w: found for w in set(words) if (found := lexicon.match(w))}
    out = []
    for i, word in enumerate(words):
        if word in near_terms:
            (term, edits), (start, end) = near_terms[word], spans[i]
            first, last = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
            quoted = is_quoted(text[max(0, spans[first][0] - 1) : start], text[end : spans[last - 1][1] + 1])
            around = set(words[first:last])
            weight = lexicon.terms[term] * (0.25 if quoted else 1.0) * (0.5 if around & REPORTING else 1.0) * (1.5 if around & ADDRESS else 1.0)
            out.append((start, end, term, edits, weight, quoted))
    return out, len(words)


def features(found: list[tuple], words: int) -> list[float]:
    exact = sum(h[4] for h in found if not h[3])
    fuzzy = sum(h[4] for h in found if h[3])
    return [log1p(exact), log1p(fuzzy), log1p(sum(h[5] for h in found)), float(exact > 0), min(1.0, 20 * (exact + fuzzy) / max(1, words))]


class ToxicityModel:
    def __init__(self, lexicon: FuzzyLexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def score(self, text: str | None) -> tuple[float, list[tuple]]:
        found, words = hits(text, self.lexicon)
        return float(1 / (1 + np.exp(-(np.dot(features(found, words), self.weights) + self.bias)))), found

    def __getstate__(self):  # the automaton's states are made again where they are needed
        return self.lexicon.terms, self.lexicon.known, self.lexicon.fuzzy_from, self.lexicon.twice_from, self.weights, self.bias

    def __setstate__(self, s):
        self.lexicon, self.weights, self.bias = FuzzyLexicon(*s[:4]), s[4], s[5]


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton's method."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) / weight.sum() + ridge * w
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a / weight.sum() + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 4000, max_clean: int = 8000) -> ToxicityModel:
    """Learn the lexicon and the weights from a bounded sample: at most ``max_toxic`` and ``max_clean`` labelled texts, by least hash of the id.

    Terms are all words of the sampled toxic texts that its clean ones hardly have. Words of two or more
    sampled clean texts that are near a term are known and no misspellings. Both are words of the
    sample, so they are bounded as it is, and none is left out. ``labels`` has the id and the label, 1 for
    toxic. Rows with a null id, text or label teach nothing; repeated ids teach once a row of ``docs``;
    without toxic rows every text scores low.
    """
    ship(docs.sparkSession)
    ids = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).cast("int").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    parts = [ids.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("_id"), "_id").limit(most) for toxic, most in ((1, max_toxic), (0, max_clean))]
    picked = cut(parts[0].unionByName(parts[1]).dropDuplicates(["_id"]), "toxic-sample")  # bounded, so the texts are filtered where they are read
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = cut(texts.join(F.broadcast(picked), F.col("id") == F.col("_id")).select("id", "text", "toxic"), "toxic-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n[toxic].update(set(_WORD.findall(text.lower())))
        names = list(n[0].keys() | n[1].keys())
        for i in range(0, len(names), 50_000):
            own = names[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"word": own, "clean": [n[0][w] for w in own], "toxic": [n[1][w] for w in own]})

    counted = sample.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = cut(counted, "toxic-words")
    n_toxic, n_clean = min(max_toxic, total.get(1, 0)), min(max_clean, total.get(0, 0))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    least = max(3, n_toxic // 400)
    terms = {r["word"]: min(1.0, r["odds"] / 6) for r in counted.withColumn("odds", odds).filter((F.col("toxic") >= least) & (F.col("odds") >= 2.5) & (F.length("word") >= 3)).collect()}
    draft = FuzzyLexicon(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = FuzzyLexicon(terms)
        for batch in batches:
            own = [i for i, w in enumerate(batch.column(0).to_pylist()) if (lexicon.match(w) or ("", 0))[1]]
            yield batch.take(pa.array(own, pa.int64()))

    known = {r["word"] for r in counted.filter("clean >= 2").select("word", "clean").mapInArrow(near, "word string, clean long").collect()} if terms else set()
    lexicon = FuzzyLexicon(terms, known)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FuzzyLexicon(terms, known)
        for batch in batches:
            xs = [features(*hits(t, own)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(2), "x": pa.array(xs, pa.list_(pa.float64()))})

    got = sample.mapInArrow(measure, "toxic int, x array<double>").collect() if terms else []
    if not got:
        return ToxicityModel(draft, np.zeros(FEATURES), -4.0)
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], dtype=float)
    # The sample holds more toxic texts than the labels do: weights restore the share.
    weight = np.where(y == 1, total.get(1, 0) / max(1, y.sum()), total.get(0, 0) / max(1, (1 - y).sum()))
    return ToxicityModel(lexicon, *_fit(x, y, weight))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7, with_hits: bool = True) -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` (1 at ``threshold`` or more) and, if asked for, ``hits`` (places, terms, edits, weights, quotation) to every row.

    Whole texts are read. Null and empty text have no hits and get the score of that. Each row is judged
    by its text alone, so ties, null ids and repeated rows change nothing. Other columns stay; equally
    named ones are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # words of a bounded sample
    hit = "struct<start:int,end:int,term:string,edits:int,weight:double,quoted:boolean>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("weight", pa.float64()), ("quoted", pa.bool_())]))

    @F.arrow_udf(f"struct<score:double,hits:array<{hit}>>" if with_hits else "double")
    def judge(text: pa.Array) -> pa.Array:
        got = [shared.value.score(t.as_py()) for t in text]
        scores = pa.array([g[0] for g in got], pa.float64())
        if not with_hits:
            return scores
        names = ("start", "end", "term", "edits", "weight", "quoted")
        return pa.StructArray.from_arrays([scores, pa.array([[dict(zip(names, h)) for h in g[1]] for g in got], kind)], ["score", "hits"])

    name = free_name(docs, "judged")
    out = docs.withColumn(name, judge(F.col(text_col).cast("string")))
    found = F.col(f"{name}.score") if with_hits else F.col(name)
    added = {"score": found, "predicted": (found >= threshold).cast("int")} | ({"hits": F.col(f"{name}.hits")} if with_hits else {})
    return out.withColumns(added).drop(name)
