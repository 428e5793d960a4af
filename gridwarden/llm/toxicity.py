"""Toxicity: a Levenshtein automaton over a lexicon trie finds abusive terms, misspelled ones too; the words around a
hit tell abuse from quotation.

The automata of all terms run as one, intersected with the trie: its states are sets of (trie node, errors so far),
made into a deterministic automaton as words need them. Hits are weighted by a logistic model learned from labels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored
from .learning import held_out, labelled

#: Common insults.
LEXICON = (
    "bastard", "bitch", "clown", "coward", "creep", "cretin", "degenerate", "despicable", "dimwit", "disgusting", "dumb", "dumbass", "filth", "fool", "freak", "garbage", "idiot", "idiotic", "imbecile",
    "jerk", "loser", "lowlife", "lunatic", "maggot", "moron", "moronic", "nitwit", "parasite", "pathetic", "pig", "repulsive", "savage", "scum", "scumbag", "shit", "slut", "stupid", "subhuman",
    "trash", "ugly", "vermin", "vile", "whore", "worthless", "wretch",
)
#: Characters written in place of letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Words that report speech, words that address someone, marks that quote.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes term word phrase reported allegedly titled".split())
ADDRESSING = frozenset("you your you're youre u ur they them these those".split())
QUOTES = "\"'“”„«»‘’"
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—¡¿"
#: Words on each side of a hit that form its window.
WINDOW = 6
FEATURES = ("exact", "near", "far", "quoted", "addressed", "shouted", "density", "any")
#: Letters of a learned stem, at least.
STEM = 5
#: Labelled documents that weights are fitted on, at most.
SAMPLE = 12_000
#: Weights used where there are no labels of both kinds: bias, then one for each of FEATURES.
DEFAULT = np.array([-4.0, 3.0, 1.5, 0.5, -2.0, 1.0, 0.5, 1.0, 2.5])


def allowed_errors(term: str) -> int:
    """Errors that a hit may have: by length, but for learned terms, which say it themselves, as "=2word"."""
    return int(term[1]) if term[0] == "=" else 0 if len(term) < 4 else 1 if len(term) < 8 else 2


def letters(term: str) -> str:
    """The letters of a term. A learned stem, "=1word*", is met by words that go on behind it."""
    return term[2:].rstrip("*") if term[0] == "=" else term


class Automaton:
    """find(word) gives (term, distance) of the lexicon term nearest to a word, or None."""

    def __init__(self, terms: tuple[str, ...]):
        self.children: list[dict[str, int]] = [{}]
        self.reach: list[int] = [0]  # most errors that a term below a node allows
        self.ends: list[tuple[str, int] | None] = [None]
        self.stems: set[int] = set()
        for term in terms:
            node = 0
            self.reach[0] = max(self.reach[0], allowed_errors(term))
            for c in letters(term):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                    self.ends.append(None)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], allowed_errors(term))
            if term[-1] == "*":
                self.stems.add(node)
            if self.ends[node] is None:
                self.ends[node] = (letters(term), allowed_errors(term))
        self.swapped = {s: t for t in terms if len(t) > 4 and t[0] != "=" for i in range(1, len(t) - 1) if (s := t[:i] + t[i + 1] + t[i] + t[i + 2 :]) not in terms}
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.passed: list[tuple[str, int] | None] = []  # the stem that ends in a state
        self.start = self._state({(0, 0)})
        self.known: dict[str, tuple[str, int] | None] = {}

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The state of a set of (node, errors), closed under skipped letters; fewest errors of a node only. -1: none."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e <= self.reach[node] and e < best.get(node, 9):
                best[node] = e
                todo += [(x, e + 1) for x in self.children[node].values()]
        key = frozenset(best.items())
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            for out, own in ((self.found, key), (self.passed, [x for x in key if x[0] in self.stems])):
                ends = [(e, self.ends[n][0]) for n, e in own if self.ends[n] and e <= self.ends[n][1]]
                out.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            out.add((node, e + 1))
            for x, child in self.children[node].items():
                out.add((child, e if x == c else e + 1))
        return self._state(out)

    def find(self, word: str) -> tuple[str, int] | None:
        if word in self.known:
            return self.known[word]
        if len(self.known) > 400_000:
            self.known.clear()
        plain = word.strip(EDGES).lower()
        hit = self._run(plain)
        if hit is None and any(c in plain for c in "0134570@$!"):
            hit = self._run(plain.translate(LOOKALIKES))
            hit = hit and (hit[0], max(1, hit[1]))
        if hit is None and plain in self.swapped:
            hit = (self.swapped[plain], 1)
        self.known[word] = hit
        return hit

    def _run(self, word: str) -> tuple[str, int] | None:
        state, steps, best = self.start, self.steps, None
        for c in word:
            follow = steps[state].get(c)
            if follow is None:
                follow = steps[state][c] = self._step(state, c)
            if follow < 0:
                return best
            state = follow
            stem = self.passed[state]
            if stem and (best is None or stem[1] < best[1]):
                best = stem
        whole = self.found[state]
        return whole if whole and (best is None or whole[1] <= best[1]) else best


_AUTOMATA: dict[tuple[str, ...], Automaton] = {}


def automaton(terms: tuple[str, ...]) -> Automaton:
    if terms not in _AUTOMATA:
        _AUTOMATA[terms] = Automaton(terms)
    return _AUTOMATA[terms]


def hits(text: str | None, auto: Automaton) -> tuple[list[str], list[tuple[int, str, int]]]:
    """The words of a whole text, and (place, term, distance) of each hit."""
    words = (text or "").split()
    known = auto.known
    found = []
    for w in {w for w in words if (known[w] if w in known else auto.find(w)) is not None}:
        term, distance = auto.find(w)
        found += [(i, term, distance) for i, x in enumerate(words) if x == w]
    return words, sorted(found)


def text_evidence(text: str | None, auto: Automaton) -> list[float]:
    """FEATURES of a whole text, all 0 without a hit. Each hit weighs less if quoted or reported, more if it addresses someone."""
    words, found = hits(text, auto)
    if not found:
        return [0.0] * len(FEATURES)
    by_distance, quoted, addressed, shouted, weight = [0.0, 0.0, 0.0], 0, 0, 0, 0.0
    for i, _, d in found:
        around = words[max(0, i - WINDOW) : i + WINDOW + 1]
        lower = {w.strip(EDGES).lower() for w in around}
        opened = sum(w[0] in QUOTES for w in words[max(0, i - WINDOW) : i + 1])
        closed = sum(w.rstrip(".,;:!?")[-1:] in QUOTES and w.rstrip(".,;:!?") != "" for w in words[i : i + WINDOW + 1])
        is_quoted = bool(opened and closed) or bool(lower & REPORTING)
        is_addressed = bool(lower & ADDRESSING)
        quoted, addressed, shouted = quoted + is_quoted, addressed + is_addressed, shouted + (words[i].strip(EDGES).isupper() or "!" in words[i])
        by_distance[d] += 1 - 0.5 * is_quoted
        weight += (1 - 0.5 * is_quoted) / (1 + d)
    n = len(found)
    return [math.log1p(by_distance[0]), math.log1p(by_distance[1]), math.log1p(by_distance[2]), quoted / n, addressed / n, shouted / n, min(1.0, 50 * weight / max(50, len(words))), float(by_distance[0] > 0)]


def fit_weights(rows: np.ndarray, labels: np.ndarray, steps: int = 25, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's method; DEFAULT unless there are labels of both kinds."""
    if len(labels) < 20 or labels.min() == labels.max():
        return DEFAULT
    x = np.c_[np.ones(len(rows)), rows]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (p - labels) + ridge * w)
    return w


def learned_terms(chosen: DataFrame, text_col: str, docs_least: int = 6, share: float = 0.9, words_least: int = 3) -> tuple[str, ...]:
    """Words, and stems of several words, that occur almost only in texts labelled 1, from a bounded sample with __label,
    and the errors each allows.

    A word counts once for a document, and only where its neighbours there are its own: copies of a passage count once.
    A term allows as many errors as others of its length, or fewer, if the words of the sample that it would meet with
    errors occur in texts labelled 0 as well.
    """

    def contexts(frames):
        for pdf in frames:
            out = []
            for doc, label, text in zip(pdf["doc"], pdf["label"], pdf["text"], strict=True):
                words = ["", *(x for w in (text or "").split() if (x := w.strip(EDGES).lower())), ""]
                out += [(w, f"{a} {b}", doc, label) for a, w, b in {*zip(words, words[1:], words[2:], strict=False)} if len(w) > 2]
            yield pd.DataFrame(out, columns=["word", "context", "doc", "label"])

    plain = chosen.select(F.xxhash64(text_col).alias("doc"), F.col("__label").alias("label"), F.col(text_col).alias("text"))
    rows = plain.mapInPandas(contexts, "word string, context string, doc long, label int")
    once = rows.groupBy("word", F.xxhash64("context").alias("c")).agg(F.min(F.struct("doc", "label")).alias("d")).groupBy("word", "d.doc").agg(F.max("d.label").alias("label"))
    counted = stored(once.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")), "toxic-words")
    found = sorted(r["word"] for r in counted.where((F.col("k") >= docs_least) & (F.col("k") >= share * F.col("n"))).select("word").collect())
    ends = F.explode(F.sequence(F.lit(STEM), F.length("word") - 1))
    prefixes = counted.where(F.length("word") > STEM).withColumn("end", ends).select("n", "k", F.expr("substring(word, 1, end)").alias("stem"))
    families = prefixes.groupBy("stem").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    stems: list[str] = []
    for r in sorted(families.where((F.col("words") >= words_least) & (F.col("k") >= docs_least) & (F.col("k") >= share * F.col("n"))).select("stem").collect()):
        if not stems or not r["stem"].startswith(stems[-1]):  # sorted: the shortest stem comes first
            stems.append(r["stem"])
    tails = {w: "" for w in found} | {w: "*" for w in stems}
    most = {w: min(allowed_errors(w), 1 if tail else 2) for w, tail in tails.items()}
    tried = tuple(f"={e}{w}{tails[w]}" for w, e in most.items())

    @F.pandas_udf("term string, distance int")
    def met(words: pd.Series) -> pd.DataFrame:
        auto = automaton(tried)
        return pd.DataFrame([hit or (None, None) for hit in map(auto.find, words)], columns=["term", "distance"])

    by_distance = counted.select("n", "k", met("word").alias("m")).where("m.distance > 0").groupBy("m.term", "m.distance").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    for r in sorted(by_distance.collect(), key=lambda r: r["distance"]):
        if r["k"] < share * r["n"]:
            most[r["term"]] = min(most[r["term"]], r["distance"] - 1)
    return tuple(f"={e}{w}{tails[w]}" for w, e in most.items())


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, tuple[str, ...]]:
    """Weights of FEATURES, and the lexicon with learned terms, from at most `sample` labelled documents outside the held-out fifth."""
    prepare(docs.sparkSession)
    chosen = stored(labelled(docs.select(id_col, text_col), labels, label_col, id_col, sample), "toxic-sample")
    terms = LEXICON + tuple(t for t in learned_terms(chosen, text_col) if letters(t) not in LEXICON)

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        auto = automaton(terms)
        return pd.Series([text_evidence(t, auto) for t in texts])

    got = chosen.select("__label", evidence(F.col(text_col)).alias("f")).toPandas()
    rows = np.array([list(f) for f in got["f"]], float).reshape(len(got), len(FEATURES))
    order = np.lexsort([got["__label"].to_numpy(), *rows.T]) if len(got) else slice(0)
    return (fit_weights(rows[order], got["__label"].to_numpy(float)[order]) if len(got) else DEFAULT), terms


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", terms: tuple[str, ...] = LEXICON) -> DataFrame:
    """docs with score (0 to 1) of every whole text. A text without a hit, null and empty ones included, gets the
    score of no evidence; repeated rows score alike; a column named score is replaced."""
    prepare(docs.sparkSession)
    w = [float(x) for x in weights]

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        auto = automaton(terms)
        z = [w[0] + sum(a * b for a, b in zip(w[1:], text_evidence(t, auto), strict=True)) for t in texts]
        return pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z], dtype="float64")

    return docs.withColumn("score", scored(F.col(f"`{text_col}`").cast("string")))


def spans(docs: DataFrame, text_col: str = "text", terms: tuple[str, ...] = LEXICON) -> DataFrame:
    """docs with toxic_hits: place (word), term and distance of each hit; empty for null texts."""

    @F.pandas_udf("array<struct<place:int,term:string,distance:int>>")
    def found(texts: pd.Series) -> pd.Series:
        auto = automaton(terms)
        return pd.Series([[{"place": i, "term": t, "distance": d} for i, t, d in hits(x, auto)[1]] for x in texts])

    return docs.withColumn("toxic_hits", found(F.col(f"`{text_col}`").cast("string")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, score and predicted (1 from the threshold on). An empty table gives an empty result."""
    weights, terms = fit(docs, labels, "toxic", id_col, text_col, sample)
    scored = score(docs, weights, text_col, terms)
    return scored.withColumns({"held_out": held_out(F.col(f"`{id_col}`")), "predicted": (F.col("score") >= threshold).cast("int")})
