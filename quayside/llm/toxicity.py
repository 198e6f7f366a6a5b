"""Toxicity by Levenshtein automata on a lexicon trie, with context-window scores (operator 1).

Learning, on a bounded sample of labelled rows: words, and stems with many endings, that mark toxic documents make up the
lexicon. Its trie is intersected with the Levenshtein automaton of one edit by subset construction; the result is one table
(state, letter) -> state that finds every misspelled term in one walk over the letters. Walks of all words of a block of
texts advance together. Around every hit a window is read: quotation marks on both sides, words of reporting and words that
the sample shows around harmless uses turn a hit from abuse to mention. A logistic model on these sums gives the score.

Null and empty texts have no hits and get the model's score for that. Texts of any length are read whole, in windows around
hits only for context. Repeated rows score alike. Without labelled rows of both kinds nothing is learnt and every score is
0. Ties between terms go to fewer edits, then to the smaller term.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import cut_lineage, held_out, ship_package, table
from quayside.llm.registry import register

#: Words of reporting, marks that open and close a quotation.
REPORTING = {"said", "says", "say", "quote", "quoted", "quotes", "called", "wrote", "word", "words", "term", "dit", "sagte", "dijo", "cita", "citation", "zitat", "wort", "mot", "palabra"}
OPENING, CLOSING = "\"“„«»", "\"”“»«"
WINDOW = 80
STEM = range(4, 9)
LETTERS = 1 << 16


def letters_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of the texts, each followed by a line end, and where each text starts."""
    folded = [(t or "").lower() for t in texts]
    starts = np.cumsum([0] + [len(t) + 1 for t in folded])
    joined = "\n".join(folded) + "\n"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), starts


_KINDS: list[np.ndarray] = []


def word_letter(points: np.ndarray) -> np.ndarray:
    """Whether code points are letters, digits or marks; beyond the first plane all count as letters."""
    if not _KINDS:
        _KINDS.append(np.array([unicodedata.category(chr(i))[0] in "LNM" for i in range(LETTERS)] + [True]))
    return _KINDS[0][np.minimum(points, LETTERS)]


def words(text: str | None) -> set[str]:
    points, _ = letters_of([text])
    inside = word_letter(points)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    folded = (text or "").lower()
    return {folded[a:b] for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())}


@dataclass
class Automaton:
    """The lexicon's trie intersected with Levenshtein automata, made deterministic."""

    letter: np.ndarray  # code point -> column of the table; 0: not a word letter, 1: a letter that no term has
    step: np.ndarray  # state, column -> state; 0 is dead
    found: np.ndarray  # state -> term * 2 + edits at the word's end, or -1
    stem: np.ndarray  # state -> a stem is complete: the rest of the word does not matter

    def hits(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(first letter, last + 1 letter, term, edits) of every word that is a term or begins with a stem."""
        column = self.letter[np.minimum(points, LETTERS)]
        inside = column > 0
        at = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        first, state = at, np.ones(len(at), dtype=np.int32)
        out = []
        while len(at):
            state = self.step[state, column[at]]
            at = at + 1
            ended = column[at] == 0
            done = (self.stem[state] | ended) & (self.found[state] >= 0)
            for i in np.flatnonzero(done).tolist():
                code = int(self.found[state[i]])
                out.append((int(first[i]), int(at[i]), code // 2, code % 2))
            live = (state > 0) & ~done & ~ended
            at, first, state = at[live], first[live], state[live]
        return sorted(out)


def build_automaton(terms: list[tuple[str, bool]], fuzzy_from: int = 5) -> Automaton:
    """terms: (text, is a stem). Whole words of ``fuzzy_from`` letters or more may differ by one edit, stems by none."""
    children: list[dict[str, int]] = [{}]
    whole: dict[int, int] = {}
    stems: dict[int, int] = {}
    reach: list[bool] = [False]  # a whole word long enough for an edit lies below
    for number, (term, is_stem) in enumerate(terms):
        node = 0
        for letter in term:
            reach[node] |= not is_stem and len(term) >= fuzzy_from
            if letter not in children[node]:
                children[node][letter] = len(children)
                children.append({})
                reach.append(False)
            node = children[node][letter]
        reach[node] |= not is_stem and len(term) >= fuzzy_from
        (stems if is_stem else whole).setdefault(node, number)
    alphabet = sorted({c for term, _ in terms for c in term})
    columns = {c: i + 2 for i, c in enumerate(alphabet)}
    long_enough = [len(t) >= fuzzy_from for t, _ in terms]

    def closed(items: set[tuple[int, int]]) -> frozenset:
        out = set(items)
        for node, edits in items:  # a letter of the term left out
            if edits == 0 and reach[node]:
                out |= {(child, 1) for child in children[node].values() if reach[child]}
        return frozenset(out)

    def advance(state: frozenset, letter: str | None) -> frozenset:
        out = set()
        for node, edits in state:
            child = children[node].get(letter) if letter else None
            if child is not None and (edits == 0 or reach[child]):
                out.add((child, edits))
            if edits == 0 and reach[node]:
                out.add((node, 1))
                out |= {(c, 1) for c in children[node].values() if reach[c]}
        return closed(out)

    def outcome(state: frozenset) -> tuple[int, bool]:
        best = [(0, stems[n], True) for n, e in state if e == 0 and n in stems]
        best += [(e, whole[n], False) for n, e in state if n in whole and (e == 0 or long_enough[whole[n]])]
        if not best:
            return -1, False
        edits, term, is_stem = min(best)
        return term * 2 + edits, is_stem

    start = closed({(0, 0)})
    numbers = {frozenset(): 0, start: 1}
    rows, found, stem, todo = {0: [0] * (len(alphabet) + 2)}, {0: (-1, False)}, {}, [start]
    while todo:
        state = todo.pop()
        row = [0]
        for letter in [None, *alphabet]:
            after = advance(state, letter)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append(numbers[after])
        rows[numbers[state]] = row
        found[numbers[state]] = outcome(state)
    n = len(numbers)
    letter = word_letter(np.arange(LETTERS + 1)).astype(np.int32)
    for c, i in columns.items():
        if ord(c) < LETTERS:
            letter[ord(c)] = i
    return Automaton(letter, np.array([rows[i] for i in range(n)], dtype=np.int32), np.array([found[i][0] for i in range(n)], dtype=np.int32), np.array([found[i][1] for i in range(n)]))


def window_words(text: str, a: int, b: int) -> list[str]:
    around = text[max(0, a - WINDOW) : a] + " " + text[b : b + WINDOW]
    return ["".join(c for c in w if c.isalnum()) for w in around.split()]


def is_quoted(text: str, a: int, b: int) -> bool:
    """Whether the hit stands between quotation marks of its window and line."""
    before = text[max(0, a - WINDOW) : a].rpartition("\n")[2]
    after = text[b : b + WINDOW].partition("\n")[0]
    opened = max((before.rfind(c) for c in OPENING), default=-1)
    if opened < 0 or not any(c in after for c in CLOSING):
        return False
    return before[opened] != '"' or before.count('"') % 2 == 1


@dataclass
class Model:
    automaton: Automaton
    strength: list[float]  # per term: log odds of a toxic document
    context: dict[str, float]  # words around harmless uses, with their log odds
    weights: np.ndarray  # bias, then one per feature

    def features(self, texts: list) -> np.ndarray:
        points, starts = letters_of(texts)
        out = np.zeros((len(texts), 6))
        per_text: dict[int, list] = defaultdict(list)
        for hit in self.automaton.hits(points):
            per_text[int(np.searchsorted(starts, hit[0], side="right")) - 1].append(hit)
        for i, hits in per_text.items():
            text = texts[i].lower()
            abuse, fuzzy, mention, strongest = 0.0, 0.0, 0.0, 0.0
            for a, b, term, edits in hits:
                a, b = a - int(starts[i]), b - int(starts[i])
                around = window_words(text, a, b)
                harmless = sum(self.context.get(w, 0.0) for w in around) + 0.5 * any(w in REPORTING for w in around)
                if is_quoted(text, a, b) or harmless >= 1.0:
                    mention += 1
                elif edits:
                    fuzzy += 1
                    strongest = max(strongest, 0.7 * self.strength[term])
                else:
                    abuse += 1
                    strongest = max(strongest, self.strength[term])
            out[i] = [np.log1p(abuse), np.log1p(fuzzy), np.log1p(mention), strongest / 5, abuse + fuzzy > 0, np.log1p(100 * (abuse + fuzzy) / (1 + len(text) / 6))]
        return out

    def scores(self, texts: list) -> np.ndarray:
        z = self.weights[0] + self.features(texts) @ self.weights[1:]
        return 1 / (1 + np.exp(-z))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Newton's method with halved steps on a few columns; the penalty keeps weights finite where classes part."""
    x = np.column_stack([np.ones(len(x)), x])
    shrink = np.array([1e-3] + [ridge] * (x.shape[1] - 1))

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + shrink @ (w * w) / 2

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * move) > loss(w):
            size /= 2
        w = w + size * move
        if np.abs(size * move).max() < 1e-8:
            break
    return w


def in_texts(texts: list, size: int = 500_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` characters; walking a run takes about sixteen times its characters of memory."""
    first = held = 0
    for i, t in enumerate(texts):
        if i > first and held + len(t or "") > size:
            yield first, i
            first, held = i, 0
        held += len(t or "")
    if first < len(texts):
        yield first, len(texts)


#: Terms that a task holds before it sends them on.
HELD_TERMS = 50_000


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 10_000, most_terms: int = 1_000, least_docs: int = 4, least_odds: float = 4.0) -> Model | None:
    """Learn from at most ``per_class`` labelled rows of each kind (those of the smallest id hash); labels: doc_id, toxic."""
    spark = docs.sparkSession
    ship_package(spark)
    labelled = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = labelled.where("toxic = 1").orderBy(order).limit(per_class).unionByName(labelled.where("toxic = 0").orderBy(order).limit(per_class))
    sample = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", order.alias("h")), "toxic-sample")  # at most 2 * per_class ids
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None

    def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, bool], list] = defaultdict(lambda: [0, []])

        def told() -> pd.DataFrame:
            rows = [(t, s, c[0], c[1]) for (t, s), c in seen.items()]
            seen.clear()
            return pd.DataFrame(rows, columns=["term", "stem", "clean", "docs"])

        for batch in batches:
            for text, toxic, h in zip(batch["text"], batch["toxic"], batch["h"]):
                if len(seen) > HELD_TERMS:  # what is told in parts is added up behind the shuffle
                    yield told()
                found = {w for w in words(text) if 3 <= len(w) <= 40}
                terms = {(w, False) for w in found} | {(w[:k], True) for w in found for k in STEM if len(w) > k}
                for term in terms:
                    if toxic:
                        seen[term][1].append(h)
                    else:
                        seen[term][0] += 1
        yield told()

    counts = sample.mapInPandas(count_terms, "term string, stem boolean, clean long, docs array<long>").groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.flatten(F.collect_list("docs")).alias("docs")).withColumn("toxic", F.size("docs"))
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    least = max(least_docs, sizes[1] / 100)  # rarer terms are mostly chance, or copies of one document
    strong = counts.withColumn("odds", odds).where((F.col("toxic") >= least) & (F.col("odds") >= least_odds))
    rows = strong.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term", "stem").limit(20 * most_terms).collect()
    docs_of = {(r.term, r.stem): set(r.docs) for r in rows}
    lexicon, covered = [], set()
    for term, stem, value in choose_terms([(r.term, r.stem, r.toxic, r.odds) for r in rows]):
        frequent = len(docs_of[term, stem]) >= max(least_docs, sizes[1] / 20)
        if (frequent or len(docs_of[term, stem] - covered) >= least) and len(lexicon) < most_terms:  # other words of copies explain nothing new
            lexicon.append((term, stem, value))
            covered |= docs_of[term, stem]
    if not lexicon:
        return None
    terms = sorted(lexicon)
    model = Model(build_automaton([(t, s) for t, s, _ in terms]), [o for _, _, o in terms], {}, np.zeros(7))

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            texts = list(batch["text"])
            for first, last in in_texts(texts):
                points, starts = letters_of(texts[first:last])
                for a, b, _, _ in model.automaton.hits(points):
                    i = int(np.searchsorted(starts, a, side="right")) - 1
                    text = texts[first + i].lower()
                    for w in set(window_words(text, a - int(starts[i]), b - int(starts[i]))):
                        seen[w][batch["toxic"].iat[first + i]] += 1
        yield pd.DataFrame([(w, c[0], c[1]) for w, c in seen.items()], columns=["word", "clean", "toxic"])

    near = sample.mapInPandas(around, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    harmless = near.where("word <> '' AND clean >= 5 AND clean > 4 * toxic").orderBy(F.desc("clean"), "word").limit(most_terms).collect()
    model.context = {r.word: float(np.log((r.clean + 1) / (r.toxic + 1))) / 3 for r in harmless}

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            for first, last in in_texts(texts):
                f = model.features(texts[first:last])
                yield pd.DataFrame({"toxic": batch["toxic"].iloc[first:last].to_numpy(), "f": list(f)})

    described = sample.mapInPandas(describe, "toxic int, f array<double>").collect()  # at most 2 * per_class rows of six numbers
    model.weights = logistic(np.array([r.f for r in described]), np.array([r.toxic for r in described], dtype=float))
    return model


def choose_terms(rows: list[tuple[str, bool, int, float]]) -> list[tuple[str, bool, float]]:
    """Stems that stand for many words, then words that no chosen stem covers; strongest first."""
    whole = {t: n for t, s, n, _ in rows if not s}
    below: dict[str, list[int]] = defaultdict(list)
    for word, n in whole.items():
        for k in STEM:
            if len(word) > k:
                below[word[:k]].append(n)
    stems = {t: (n, o) for t, s, n, o in rows if s and len(below[t]) >= 4 and 2 * max(below[t]) < n}
    chosen = {}
    for t in [t for t in stems if not any(t[:k] in stems for k in STEM if k < len(t))]:
        same = [u for u, (n, _) in stems.items() if u.startswith(t) and 10 * n >= 9 * stems[t][0]]
        longest = max(same, key=lambda u: (len(u), u))  # as long as it still covers the stem's documents
        chosen[longest] = stems[longest]
    out = [(t, True, o, n) for t, (n, o) in chosen.items()]
    out += [(t, s, o, n) for t, s, n, o in rows if not s and not any(t[:k] in chosen for k in STEM)]
    return [(t, s, o) for t, s, o, n in sorted(out, key=lambda r: (-r[2] * r[3] ** 0.5, r[0]))]


def score(docs: DataFrame, model: Model | None, column: str = "toxicity") -> DataFrame:
    """All rows with their score in ``column``; a column of that name is replaced."""
    carried = [c for c in docs.columns if c != column]
    if model is None:
        return docs.select(*[f"`{c}`" for c in carried], F.lit(0.0).alias(column))
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_terms terms

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = list(texts)
            yield pd.Series(np.concatenate([shared.value.scores(texts[a:b]) for a, b in in_texts(texts)]) if texts else np.empty(0))

    scored = F.pandas_udf(run, "double")  # an iterator of batches
    return docs.select(*[f"`{c}`" for c in carried], scored("text").alias(column))


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str, threshold: float = 0.3) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    learning = table(spark, folder, "labels").where(~held_out("doc_id", 4, 2))
    scored = score(docs, fit(docs, learning))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
