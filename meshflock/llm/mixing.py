"""Mixing to target weights with soft domain membership.

A classifier learned from a labelled table gives every document posterior probabilities of
the domains. With document rates r (expected copies), token counts t and posteriors p, the
expected token total of domain d is sum(t * p_d * r). Projected gradient descent fits
nonnegative rates whose totals match the targets in least squares, every domain's gap
weighing alike; steps are scaled by H = sum(t * p * p') (of all documents, or of those not at
a bound). Every document starts at rate 1, so documents of one kind move alike.
A step changes r by -p.s for a vector s of one number per domain. The rates after k steps
follow from p and the k vectors alone: an iteration is two aggregations over the written
posteriors, and the driver holds a few numbers per domain.

Bounds (parameters): ``each`` labelled rows per domain are fitted, without those whose label
the others contradict (``doubt``); rates are at most ``most``.
A target that the documents cannot reach under it is lowered, the others are raised so that
the size stays, and a warning says so. Tokens are words between white space. Long texts are read whole. Empty and null
texts have no tokens and the posteriors of the classes' shares. Of domains that are likeliest
in equal measure each counts the document among its own. Domains without labelled rows
have posterior 0, so their share goes to the others. Without any labelled row all documents
keep rate 1. Repeated rows are mixed as separate documents with equal rates. An empty table
gives an empty result. Further columns of the input are not read or returned.
"""

from __future__ import annotations

import re
import warnings
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshflock.llm.sampling import per_class
from meshflock.llm.toxicity import number, numbers
from meshflock.llm.toxicity import prepared as fit_logistic
from meshflock.runtime import materialize

CHUNK = 1 << 20
LOWER, UPPER, OTHER = re.compile("[a-zß-öø-ÿ]+"), re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W_]+")
MARKS = ".,;:!?\"'()"
BEGINNINGS = (5, 6, 7)


def of_word(word: str) -> list[str]:
    """The word, its beginnings, and its shape: which kinds of characters in which order."""
    low = word.lower().strip(MARKS)
    shape = LOWER.sub("a", UPPER.sub("A", word))
    return [low, shape + "~", *(f"{low[:n]}*" for n in BEGINNINGS if len(low) >= n)]


def distinct(found: Iterable[str], n: int) -> tuple[list[str], np.ndarray]:
    """Distinct ones of ``n`` strings, and the place of each string among them."""
    places: dict[str, int] = defaultdict(count().__next__)
    at = np.fromiter(map(places.__getitem__, found), np.int64, n)
    return list(places), at


def of_words(words: list[str], values: Callable[[Iterable[str]], Iterable[int]]) -> np.ndarray:
    """``values`` of the features of many words, a row for each kind and a column for each word;
    -1 where a word is too short for a beginning. All words are one text to lower and to match:
    no word holds a line feed."""
    out = np.full((2 + len(BEGINNINGS), len(words)), -1, np.int64)
    if not words:
        return out
    text = "\n".join(words)
    low = [w.strip(MARKS) for w in text.lower().split("\n")]
    out[0] = np.fromiter(values(low), np.int64, len(low))
    shapes, at = distinct(LOWER.sub("a", UPPER.sub("A", text)).split("\n"), len(low))
    out[1] = np.fromiter(values([s + "~" for s in shapes]), np.int64, len(shapes))[at]
    longest = max(BEGINNINGS)
    heads, at = distinct([w[:longest] for w in low], len(low))
    sizes = np.fromiter(map(len, heads), np.int64, len(heads))
    for k, n in enumerate(BEGINNINGS, 2):
        row = np.full(len(heads), -1, np.int64)
        row[sizes >= n] = np.fromiter(values([h[:n] + "*" for h in heads if len(h) >= n]), np.int64, (sizes >= n).sum())
        out[k] = row[at]
    return out


def train(docs: DataFrame, labels: DataFrame, domains: list[str], label: str = "domain", key: str = "doc_id", each: int = 2500) -> list[tuple[dict[int, float], float] | None]:
    """One logistic model per domain (None where no row has it); ``labels`` has key and label."""
    rows = labels.where(F.col(label).isin(*domains)).select(key, label)
    sample, shares = per_class(docs, rows, label, each, key)

    def run(batches):
        words = Words(numbers, 300_000)
        for b in batches:
            found = []
            for _, _, rows in numbered(b.column(2).to_pylist(), words):
                own, values = words.features(rows)
                own, values = np.divmod(np.unique(own << 32 | values), 1 << 32)
                found += np.split(values.astype(np.uint32).view(np.int32), np.cumsum(np.bincount(own, minlength=len(rows)))[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["k", "label", "found"])

    got = sample.mapInArrow(run, "k string, label string, found array<int>").toArrow().sort_by([("k", "ascending"), ("label", "ascending")]).combine_chunks()
    names = np.array(got.column("label").to_pylist(), object)
    found = got.column("found").combine_chunks()
    flat, lengths = found.flatten().to_numpy(zero_copy_only=False).view(np.uint32), found.value_lengths().to_numpy(zero_copy_only=False)
    del got, found
    return fit_models(flat, lengths, names, np.array([1 / shares[n] for n in names]), domains)


def fit_models(flat: np.ndarray, lengths: np.ndarray, names: np.ndarray, weights: np.ndarray, domains: list[str], doubt: float = 0.25, rounds: int = 3) -> list[tuple[dict[int, float], float] | None]:
    """Models of labelled rows, of which some are labelled wrongly: rows whose own label has a
    posterior below ``doubt`` after a short fit are left out, ``rounds`` times at most or until
    the same rows stay, before the models are fitted."""
    own = np.repeat(np.arange(len(names), dtype=np.int32), lengths)
    ids = np.unique(flat)
    col = np.concatenate([np.zeros(0, np.int32), *(np.searchsorted(ids, flat[k : k + CHUNK]).astype(np.int32) for k in range(0, len(flat), CHUNK))])
    # features that are rare, or that go with no domain more than with the others, are not fitted
    times = np.bincount(col, minlength=len(ids))
    telling = np.zeros(len(ids), bool)
    for d in domains:
        share = float((names == d).mean()) if len(names) else 0.0
        hits = np.bincount(col[(names == d)[own]], minlength=len(ids))
        telling |= np.abs(hits - times * share) > 2 * np.sqrt(np.maximum(times * share * (1 - share), 1e-9))
    telling &= times >= 4
    kept = telling[col]
    ids, own, col = ids[telling], own[kept], (np.cumsum(telling, dtype=np.int32) - 1)[col[kept]]
    lengths = np.bincount(own, minlength=len(names))
    use = np.ones(len(names), bool)

    def prepare() -> list:
        w = weights[use] * use.sum() / max(weights[use].sum(), 1e-300)
        part = col[use[own]]
        return [fit_logistic(part, lengths[use], (names[use] == d).astype(float), w, [], keep=3000, ridge=0.3) if (names[use] == d).any() else None for d in domains]

    fits = prepare()
    for _ in range(rounds):
        place, by_domain, start = joined([f and f(20) for f in fits])
        at = np.full(len(ids), -1)
        at[list(place)] = list(place.values())
        known = at[col] >= 0
        p = posterior(by_domain, start, own[known], at[col[known]], len(names))
        sure = p[np.arange(len(names)), [domains.index(n) for n in names]] >= doubt
        for d in domains:  # a domain of which no row would be left keeps all
            sure |= (names == d) & ~(sure & (names == d)).any()
        if (sure == use).all():
            break
        use, fits = sure, None
        fits = prepare()
    return [m and ({int(ids[k]): w for k, w in m[0].items()}, m[1]) for m in (f and f(60) for f in fits)]


def joined(models: list) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Places of the features of all models, their weights by place and domain, the intercepts."""
    place = {f: k for k, f in enumerate(sorted({f for m in models if m for f in m[0]}))}
    weights = np.zeros((len(place), len(models)))
    for k, m in enumerate(models):
        for f, w in (m[0] if m else {}).items():
            weights[place[f], k] = w
    return place, weights, np.array([m[1] if m else -np.inf for m in models])


def posterior(weights: np.ndarray, start: np.ndarray, own: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
    """Posteriors of ``n`` texts that have features ``col`` in texts ``own``."""
    z = np.clip(start + np.stack([np.bincount(own, weights[col, k], n) for k in range(len(start))], 1), -30, 30)
    p = np.where(np.isfinite(start), 1 / (1 + np.exp(-z)), 0.0)
    return p / np.maximum(p.sum(1, keepdims=True), 1e-300)


class Words:
    """Words in the order of their first use, with ``values`` of their features (``of_words``).
    Beyond ``limit`` words they are forgotten, after the rows at hand."""

    def __init__(self, values: Callable[[Iterable[str]], Iterable[int]], limit: int):
        self.values, self.limit = values, limit
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = defaultdict(count().__next__)
        self.table = of_words([], self.values)

    def numbered(self, text: str | None) -> tuple[int, np.ndarray]:
        """How many words a text has, and the numbers of its distinct ones."""
        words = text.split() if text else ()
        found = set(words)
        return len(words), np.fromiter(map(self.codes.__getitem__, found), np.int32, len(found))

    def features(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Texts and values of the features of all their words, -1 left out; a value may repeat."""
        self.table = np.concatenate([self.table, of_words(list(islice(self.codes, self.table.shape[1], None)), self.values)], 1)
        own, codes = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        found = [values[codes] for values in self.table]
        kept = [f >= 0 for f in found]
        out = np.concatenate([own[k] for k in kept]), np.concatenate([f[k] for f, k in zip(found, kept, strict=True)])
        if len(self.codes) > self.limit:
            self.forget()
        return out


def numbered(texts: list[str | None], words: Words, most: int = CHUNK) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
    """Place of the first text, and numbers of words (``Words.numbered``) of it and the next:
    about ``most`` words and at most 1000 texts at a time. Texts are not cut."""
    first, tokens, rows, size = 0, [], [], 0
    for n, t in enumerate(texts, 1):
        total, found = words.numbered(t)
        tokens.append(total)
        rows.append(found)
        size += len(found)
        if size >= most or len(rows) == 1000 or n == len(texts):
            yield first, tokens, rows
            first, tokens, rows, size = n, [], [], 0


def posteriors(docs: DataFrame, models: list, domains: list[str], remember: int = 600_000) -> DataFrame:
    """doc_id, tokens and one column p_<domain> each."""
    place, weights, start = joined(models)

    def run(batches):
        words = Words(lambda found: map(place.get, numbers(found), repeat(-1)), remember)
        for b in batches:
            for first, tokens, rows in numbered(b.column(1).to_pylist(), words):
                own, col = words.features(rows)
                # every feature once a text, texts one after the other: sums do not depend on the order of the words
                has = np.zeros(len(rows) * len(place), bool)
                has[own * len(place) + col] = True
                own, col = np.divmod(np.flatnonzero(has), max(1, len(place)))
                p = posterior(weights, start, own, col, len(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), pa.array(tokens, pa.int64()), *(pa.array(p[:, k].round(9)) for k in range(len(models)))], names=["doc_id", "tokens", *[f"p_{d}" for d in domains]])

    schema = "doc_id long, tokens long, " + ", ".join(f"`p_{d}` double" for d in domains)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def rate(steps: list[np.ndarray], domains: list[str], most: float) -> Column:
    """The rate after some steps, as an expression of the posteriors."""
    r = F.lit(1.0)
    for s in steps:
        r = F.greatest(F.lit(0.0), F.least(F.lit(most), r - sum((F.col(f"p_{d}") * float(x) for d, x in zip(domains, s, strict=True)), F.lit(0.0))))
    return r


def within_reach(weights: np.ndarray, size: float, reach: np.ndarray) -> np.ndarray:
    """Wanted token totals: ``size`` shared out by weight, no domain above its reach. What such
    a domain cannot take goes to the others."""
    want, open_ = np.zeros(len(weights)), weights > 0
    while open_.any():
        share = weights / weights[open_].sum() * max(0.0, size - want[~open_].sum())
        over = open_ & (share > reach)
        if not over.any():
            want[open_] = share[open_]
            break
        want[over] = reach[over]
        open_ &= ~over
    return want


def fit_rates(post: DataFrame, targets: dict[str, float], budget: float = 1.0, most: float = 8.0, rounds: int = 15, tolerance: float = 1e-7) -> list[np.ndarray]:
    """Steps of projected gradient; ``targets`` are weights, ``budget`` the wanted size by the size now.

    A domain's reach is ``most`` times its tokens in documents of which it is the likeliest
    domain, and its tokens in the others as they are. Targets beyond it are lowered to it and
    the others raised, so that the size stays; a warning names every domain whose total ends
    more than 0.5 % of the size below its target or above it. All domains' gaps weigh alike.
    A step is tried in the metric of all documents and, at four lengths, in that of the
    documents whose rates are not at a bound, and along the gap itself; the one that comes
    nearest the targets is taken."""
    domains = list(targets)
    k = len(domains)
    t = F.col("tokens").cast("double")
    p = [F.col(f"p_{d}") for d in domains]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    likeliest = F.greatest(*p) if k > 1 else p[0]
    weights = np.array([targets[d] for d in domains], float) / sum(targets.values())

    def matrix(row, name):
        return np.array([[row[f"{name}{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])

    free = (F.col("_r") > 0) & (F.col("_r") < most)
    steps: list[np.ndarray] = []
    want = None
    for _ in range(rounds):
        at = post.withColumn("_r", rate(steps, domains, most))
        row = at.agg(
            F.sum(t).alias("t"), *[F.sum(t * q * F.col("_r")).alias(f"a{i}") for i, q in enumerate(p)], *([F.sum(F.when(q >= likeliest, t * q)).alias(f"o{i}") for i, q in enumerate(p)] if want is None else []),
            *[F.sum(t * p[i] * p[j]).alias(f"h{i}_{j}") for i, j in pairs], *[F.sum(F.when(free, t * p[i] * p[j])).alias(f"f{i}_{j}") for i, j in pairs],
        ).first()
        if not row["t"]:
            return []
        size = row["t"] * budget
        total = np.array([row[f"a{i}"] for i in range(k)])
        if want is None:
            own = np.array([row[f"o{i}"] or 0.0 for i in range(k)])
            want = within_reach(weights, size, most * own + total - own)
        gap = total - want
        if np.abs(gap).max() <= tolerance * row["t"]:
            break
        h, f = matrix(row, "h"), matrix(row, "f")
        whole, part = np.linalg.pinv(h, rcond=1e-9), np.linalg.pinv(f, rcond=1e-9)
        curve = float(gap @ f @ gap)
        along = gap * (float(gap @ gap) / curve if curve > 0 else 0.0)
        tried = [whole @ gap, *(part @ gap * x for x in (1.0, 0.5, 0.25, 0.1)), along, along * 0.25]
        ends = [rate([*steps, s], domains, most) for s in tried]
        sums = post.agg(*[F.sum(t * q * e).alias(f"a{n}_{i}") for n, e in enumerate(ends) for i, q in enumerate(p)]).first()
        gaps = [np.array([sums[f"a{n}_{i}"] for i in range(k)]) - want for n in range(len(tried))]
        loss = [float(g @ g) for g in gaps]
        best = int(np.argmin(loss))
        if loss[best] >= float(gap @ gap) * 0.99:
            break
        steps.append(tried[best])
        gap = gaps[best]
    for d, share, asked in zip(domains, (gap + want) / size, weights, strict=True):
        if abs(share - asked) > 0.005:
            warnings.warn(f"mixing: domain {d} makes {share:.2%} of the asked size, its target is {asked:.2%} (rates are at most {most:g})", stacklevel=2)
    return steps


def copies(key: str = "doc_id") -> Column:
    """Whole copies for a rate: its fraction is rounded by a hash of the key, so that the
    expected number is the rate."""
    spot = F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor("rate") + (spot < F.col("rate") - F.floor("rate")).cast("int")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float = 1.0, most: float = 8.0) -> DataFrame:
    """doc_id, tokens, posteriors, rate and copies of every document."""
    domains = list(targets)
    models = train(docs, labels, domains)
    post = materialize(posteriors(docs, models, domains), "posteriors")
    steps = fit_rates(post, targets, budget, most) if any(models) else []
    return post.withColumn("rate", F.round(rate(steps, domains, most), 9)).withColumn("copies", copies())


#: The mixture of the query: domains of the labels table and their weights.
TARGETS = {"clean": 0.94, "junk": 0.03, "toxic": 0.03}
BUDGET = 1.15


def domain_labels(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))
