"""Toxicity scoring by a counterfactual-regularised classifier.

Features of a text are the presence of its lower-cased words and of word beginnings of 5 to
7 letters, hashed. A logistic regression is fitted on a bounded sample of labelled rows.
Every training sentence that names a group is copied with the term swapped for the other
terms of its list (``IDENTITIES``), and the squared change of the score (its log odds) between
a sentence and its copies is added to the loss: the weights of group terms, and of what only
goes with one of them, cannot carry the label. Terms of one list that the fit did not see
weigh 0.

Bounds (parameters): ``each`` rows of either class are fitted, ``keep`` features used. The
driver gets hashed feature lists of that sample and the distinct swaps, no texts. Every text
is scored whole, however long.

Null and empty texts have the score of a text without features. With labels of one kind or
none, the score is that share. A score of exactly 0.5 is predicted 1. Rows are scored one by
one, so repeated rows get equal scores; in training, rows with one id and label count once.
An empty table gives an empty result. Input columns named as an output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshflock.llm.carry import add_columns
from meshflock.llm.sampling import per_class
from meshflock.runtime import materialize

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
# Identity terms, by list; a term is swapped for the others of its list.
IDENTITIES = (
    ("men", "women"), ("man", "woman"), ("boy", "girl"), ("male", "female"), ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"), ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"), ("american", "mexican", "chinese", "indian", "russian", "german", "french", "british", "turkish", "polish"),
    ("hombres", "mujeres"), ("hombre", "mujer"), ("hommes", "femmes"), ("homme", "femme"), ("männer", "frauen"), ("mann", "frau"),
    ("cristianos", "musulmanes", "judíos"), ("chrétiens", "musulmans", "juifs"), ("christen", "muslime", "juden"), ("blancos", "negros"), ("blancs", "noirs"), ("weiße", "schwarze"),
    ("inmigrantes", "refugiados", "extranjeros"), ("immigrés", "réfugiés", "étrangers"), ("einwanderer", "flüchtlinge", "ausländer"), ("immigrant", "refugee", "native", "foreigner"), ("immigrants", "refugees", "natives", "foreigners"), ("disabled", "blind", "deaf"), ("old", "young", "elderly"),
)
SWAPS = {t: tuple(o for o in group if o != t) for group in IDENTITIES for t in group}


def number(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature)


def numbers(features: Iterable[str]) -> Iterator[int]:
    return map(xxhash.xxh32_intdigest, features)


def of_word(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (5, 6, 7) if len(word) >= n)]


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(found: set[str]) -> set[int]:
    return {number(f) for w in found for f in of_word(w)}


def counterfactuals(text: str) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(features that a swap adds, features that it takes away) for every swapped sentence."""
    out = []
    low = text.lower()
    if not any(t in low for t in SWAPS):
        return out
    for sentence in SENTENCE.split(low):
        have = set(WORD.findall(sentence))
        base = None
        for term in sorted(have & SWAPS.keys()):
            base = features(have) if base is None else base
            for other in SWAPS[term]:
                new = features((have - {term}) | {other})
                out.append((tuple(sorted(new - base)), tuple(sorted(base - new))))
    return out


def unique(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features, and the place of each one among them; small numbers are not sorted."""
    if not len(flat) or flat.min() < 0 or flat.max() >= 8 * len(flat):
        return np.unique(flat, return_inverse=True)
    there = np.bincount(flat) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[flat]


def fit(*args, rounds: int = 60, **options) -> tuple[dict[int, float], float]:
    """Weights by hashed feature, and the intercept, after ``rounds`` (see ``prepared``)."""
    return prepared(*args, **options)(rounds)


def prepared(flat: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray, pairs: list[tuple[list[int], list[int], int]], keep: int = 4000, ridge: float = 1.0, fairness: float = 10.0) -> Callable[[int], tuple[dict[int, float], float]]:
    """The fit of rows whose features have been chosen, a function of the rounds. ``flat`` has
    the features of all rows in turn, ``lengths`` their numbers."""
    total = max(weights.sum(), 1e-9)
    rate = float((weights * labels).sum() / total)
    if not 0 < rate < 1:
        return lambda rounds: ({}, 12.0 if rate >= 1 else -12.0)
    at = np.repeat(np.arange(len(lengths)), lengths)
    ids, col = unique(flat)
    pos = np.bincount(col, labels[at], len(ids))
    seen = np.bincount(col, minlength=len(ids)).astype(float)
    share = labels.mean()
    z = (pos - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    z[seen < 4] = 0
    chosen = np.argsort(-np.abs(z), kind="stable")[:keep]
    chosen = np.sort(chosen[np.abs(z[chosen]) > 3])
    place = np.full(len(ids), -1)
    place[chosen] = np.arange(len(chosen))
    ok = place[col] >= 0
    row, col = at[ok], place[col[ok]]
    index = {int(ids[c]): k for k, c in enumerate(chosen)}
    d_row = [(k, index[f], s) for k, (add, gone, _) in enumerate(pairs) for s, fs in ((1.0, add), (-1.0, gone)) for f in fs if f in index]
    pr, pc, ps = (np.array(x) for x in zip(*d_row, strict=True)) if d_row else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    times = np.array([n for _, _, n in pairs], float)

    def steps(rounds: int) -> tuple[dict[int, float], float]:
        w, b = np.zeros(len(chosen)), float(np.log(rate / (1 - rate)))
        # per-coordinate scaled gradient steps (Adam), fixed number, no randomness
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, 10 * rounds + 1):
            p = 1 / (1 + np.exp(-(np.bincount(row, w[col], len(lengths)) + b)))
            err = weights * (p - labels)
            g = np.bincount(col, err[row], len(w)) + ridge * w
            if len(pr):
                change = times * np.bincount(pr, ps * w[pc], len(pairs))
                g += fairness * np.bincount(pc, ps * change[pr], len(w))
            gb = err.sum()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            lr = 0.1 if t <= 6 * rounds else 0.02
            w -= lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            b -= lr * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        return {f: float(w[k]) for f, k in index.items()}, float(b)

    return steps


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", each: int = 4000, **options) -> tuple[dict[int, float], float]:
    """Fit on texts of ``docs`` (columns key, text) with a 0/1 label in ``labels`` (key, label).

    The sample is taken from the labels alone. It holds at most ``2 * each`` keys, which are
    broadcast to the texts; those are not shuffled."""
    rows = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias(label))
    sample, shares = per_class(docs, rows, label, each, key)
    sample = materialize(sample, "sample")

    def found_in(batches):
        for b in batches:
            found = [sorted(features(words(t or ""))) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["k", "label", "found"])

    def swapped_in(batches):
        for b in batches:
            n = Counter(pair for t in b.column(2).to_pylist() if t for pair in counterfactuals(t))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in n], lists), pa.array([g for _, g in n], lists), pa.array(list(n.values()), pa.int64())], names=["add", "gone", "n"])

    # a swap's features hardly depend on the sentence: the driver gets each with its number of sentences
    pairs = sample.mapInArrow(swapped_in, "add array<long>, gone array<long>, n long").groupBy("add", "gone").agg(F.sum("n").alias("n"))
    pairs = sorted((r["add"], r["gone"], r["n"]) for r in pairs.toArrow().to_pylist())
    got = sample.mapInArrow(found_in, "k string, label int, found array<long>").toArrow()
    got = got.sort_by([("k", "ascending"), ("label", "ascending")]).combine_chunks()
    labels = got.column("label").to_numpy().astype(float)
    weights = np.array([1 / shares[int(x)] for x in labels])
    if len(weights):
        weights *= len(weights) / weights.sum()
    found = got.column("found").combine_chunks()
    flat = found.flatten().to_numpy(zero_copy_only=False)
    lengths = found.value_lengths().to_numpy(zero_copy_only=False)
    return fit(flat, lengths, labels, weights, pairs, **options)


def score(docs: DataFrame, model: tuple[dict[int, float], float], text: str = "text", remember: int = 500_000) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) to every row."""
    weights, intercept = model

    def make():
        known: dict[str, tuple[int, ...]] = {}  # features with a weight, by word

        def of(word):
            hit = tuple(n for n in map(number, of_word(word)) if n in weights)
            if len(known) < remember:
                known[word] = hit
            return hit

        def scored(texts):
            out = []
            for t in texts.to_pylist():
                hits: set[int] = set()
                for w in words(t) if t else ():
                    h = known.get(w)
                    if h is None:
                        h = of(w)
                    if h:
                        hits.update(h)
                z = intercept + sum(weights[n] for n in sorted(hits))
                out.append(1 / (1 + np.exp(-z)) if z > -30 else 0.0)
            s = np.array(out, float)
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

        return scored

    return add_columns(docs, make, [("score", "double"), ("predicted", "int")], [text])
