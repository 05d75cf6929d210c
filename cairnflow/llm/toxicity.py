"""Toxicity by weak supervision.

1. Term statistics of labelled documents give a lexicon: whole words and word beginnings.
   Labels serve for nothing else.
2. Each term votes by its presence, and patterns of the text and of the terms' places in it
   vote toxic, clean or abstain on each training document.
3. A generative label model, fitted by EM without the labels, estimates each voter's
   accuracy and, as a tree over the voters, their correlations given the class.
4. Its posteriors are the targets of a linear classifier over term hits, which scores every
   document; 0.5 is where the posterior leaves the matter open.

The fit uses at most ``max_train_docs`` labelled documents (a documented bound, taken in
hash order of doc_id); scoring covers all. Neither labels, lang, source nor doc_id enter a
score.

Cases: null and empty texts score as a text without words; documents without labels are
scored all the same; labels that are null or of unknown documents are ignored; with no
usable training document, or those of one class only, every score is the rate of toxic
labels (0.0 without any); repeated rows get a row each; extra columns of any name are
ignored, or kept where ``keep`` names them: one called score or predicted makes the new
column's name end in an underscore.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fields, free_name, numbered, quoted, texts_of

TOKENS = re.compile(r"[^\W_]+").findall
SENTENCES = re.compile(r"[.!?\n]+")
#: Runs of exclamation marks, and words in capitals one after another.
SHOUT = re.compile(r"!{2,}|(?:\b[A-Z]{4,}\b[^\w\n]{1,3}){3,}")
PATTERNS = ("close", "spread", "insistent", "shouting", "no term", "one in a long text")
PREFIXES = (4, 5, 6, 7, 8)
#: Share of a voter's entropy that another tells, from which it counts as a copy.
COPY = 0.8


@dataclass(frozen=True)
class ToxicityParams:
    max_train_docs: int = 24_000
    max_terms: int = 96
    min_support: int = 4
    min_strength: float = 22.0
    max_voters: int = 28
    em_rounds: int = 25
    ridge: float = 1.0


@dataclass
class ToxicityModel:
    terms: list[str]
    weights: np.ndarray
    bias: float
    center: np.ndarray
    scale: np.ndarray
    voters: list[dict] = field(default_factory=list)
    prior: float = 0.0


def terms_of(text: str) -> Counter:
    """Occurrences of words and, marked by a star, of word beginnings."""
    words = Counter(TOKENS(text.lower()))
    out: Counter = Counter()
    for w, n in words.items():
        out[w] += n
        for k in PREFIXES:
            if len(w) < k:
                break
            out[w[:k] + "*"] += n
    return out


class Featurizer:
    """Counts of the model's terms in a text, and a few numbers of its form."""

    EXTRA = 5

    def __init__(self, terms: list[str]):
        self.whole = {t: i for i, t in enumerate(terms) if not t.endswith("*")}
        self.starts = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("*")}
        self.sizes = sorted({len(t) for t in self.starts})
        self.n = len(terms)

    def __call__(self, text: str) -> tuple[np.ndarray, int]:
        hits = np.zeros(self.n, np.float32)
        tokens = TOKENS(text.lower())
        for w, n in Counter(tokens).items():
            for i in self.terms(w):
                hits[i] += n
        return hits, len(tokens)

    def terms(self, word: str) -> Iterator[int]:
        if (i := self.whole.get(word)) is not None:
            yield i
        for k in self.sizes:
            if len(word) < k:
                break
            if (i := self.starts.get(word[:k])) is not None:
                yield i

    def pattern_votes(self, text: str) -> list[int]:
        """The votes of PATTERNS: 1 toxic, -1 clean, 0 abstains."""
        places, kinds, sentences = [], set(), 0
        n = 0
        for sentence in SENTENCES.split(text.lower()):
            before = len(places)
            for w in TOKENS(sentence):
                if found := frozenset(self.terms(w)):
                    places.append((n, w))
                    kinds.add(w)
                n += 1
            sentences += len(places) > before
        close = any(q - p <= 12 and u != w for (p, u), (q, w) in zip(places, places[1:]))
        letters = sum(map(str.isalpha, text))
        loud = letters >= 40 and sum(map(str.isupper, text)) > 0.4 * letters
        return [
            int(close),  # two words of the lexicon side by side
            int(sentences >= 3),  # spread over the text
            int(len(places) > len(kinds) > 0 and len(places) >= 3),  # insisting on a word
            int(bool(SHOUT.search(text)) or loud),
            -int(not places and n > 0),
            -int(len(places) == 1 and n >= 200),  # a slip in a long text
        ]

    def form(self, hits: np.ndarray, n: int) -> np.ndarray:
        total = float(hits.sum())
        return np.array([n / (n + 1000.0), np.log1p(n), total / max(n, 1) * 100, (hits > 0).sum(), np.log1p(total)], np.float32)

    def row(self, text: str) -> np.ndarray:
        hits, n = self(text)
        return np.concatenate([np.minimum(hits, 12), np.minimum(hits, 1), self.form(hits, n)])


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, p: ToxicityParams) -> DataFrame:
    """(doc_id, toxic, text) of at most ``max_train_docs`` labelled documents, cut into a table."""
    named = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    # one row per document, in an order that is the same on every run; a bounded top-k
    one = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = durable(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_train_docs))
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    # copies would count one author's words many times over
    return durable(found.withColumn("same", F.xxhash64("text")).dropDuplicates(["same", "toxic"]).drop("same"))


def term_scores(train: DataFrame) -> DataFrame:
    """(term, pos, neg): documents of either class that hold the term, combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for y, text in zip(b.column("toxic").to_pylist(), texts_of(b)):
                found[int(y)].update(terms_of(text).keys())
            if len(found[0]) > 1_000_000:
                yield emit(found)
                found = (Counter(), Counter())
        yield emit(found)

    def emit(found: tuple[Counter, Counter]) -> pa.RecordBatch:
        # a term without any toxic document can't enter the lexicon, wherever else it stands
        names = list(found[1].keys() | found[0].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][t] for t in names], pa.int64()), pa.array([found[0][t] for t in names], pa.int64())], names=["term", "pos", "neg"])

    parts = train.select("toxic", "text").mapInArrow(run, "term string, pos long, neg long")
    return parts.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_terms(scores: DataFrame, n_pos: int, n_neg: int, p: ToxicityParams) -> list[str]:
    """The terms that tell most, without word beginnings that say the same as a longer one."""
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    odds = F.log(rate("pos", n_pos) / rate("neg", n_neg))
    # signed log-likelihood ratio of the two classes' rates: small counts must not look strong by luck
    share = (F.col("pos") + F.col("neg")) / float(n_pos + n_neg)
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (share * n))).otherwise(0.0)
    strength = 2 * (part("pos", n_pos) + part("neg", n_neg))
    best = scores.where(F.col("pos") >= p.min_support).withColumn("odds", odds).withColumn("g", strength).where((F.col("odds") > 1.5) & (F.col("g") > p.min_strength))
    rows = best.orderBy(F.col("g").desc(), F.length("term").desc(), "term").limit(8 * p.max_terms).collect()
    chosen: list[str] = []
    same: set[tuple[int, int, str]] = set()
    for r in rows:  # longest first among equals: 'abcd*' after 'abcdef*' with the same counts adds nothing
        key = (r.pos, r.neg, r.term[:4])
        if key not in same:
            same.add(key)
            chosen.append(r.term)
        if len(chosen) == p.max_terms:
            break
    return chosen


def make_voters(hits: np.ndarray, patterns: np.ndarray, p: ToxicityParams) -> tuple[list[dict], np.ndarray]:
    """Voters and their votes (1 toxic, -1 clean, 0 abstains): the first terms' presence, then the patterns."""
    n = min(hits.shape[1], p.max_voters)
    voters = [{"kind": "term", "term": j} for j in range(n)] + [{"kind": "pattern", "name": x} for x in PATTERNS]
    return voters, np.hstack([(hits[:, :n] > 0).astype(int), patterns.astype(int)])


def label_model(votes: np.ndarray, rounds: int) -> tuple[np.ndarray, list[dict]]:
    """Posterior of the toxic class for each row, by EM.

    First the voters count as independent given the class, but for near copies; then the
    maximum spanning tree over their conditional mutual information becomes the correlation
    structure, and each voter's table is conditioned on its parent's vote.
    """
    n, m = votes.shape
    v = votes + 1  # 0 clean, 1 abstains, 2 toxic
    onehot = np.eye(3)[v]  # n, m, 3
    signal = votes.sum(1)
    q = 1 / (1 + np.exp(-(signal - 0.5)))
    parent = [-1] * m
    tables: list[np.ndarray] = []

    def m_step() -> tuple[float, list[np.ndarray]]:
        found = []
        for j in range(m):
            if parent[j] < 0:
                t = np.stack([((1 - q) @ onehot[:, j]), (q @ onehot[:, j])]) + 0.5
                found.append(t / t.sum(1, keepdims=True))
            else:
                up = onehot[:, parent[j]]
                t = np.stack([up.T @ (onehot[:, j] * w[:, None]) for w in (1 - q, q)]) + 0.5
                found.append(t / t.sum(2, keepdims=True))
        return float(np.clip(q.mean(), 1e-3, 1 - 1e-3)), found

    def e_step(pi: float, found: list[np.ndarray]) -> np.ndarray:
        score = np.full(n, np.log(pi / (1 - pi)))
        for j, t in enumerate(found):
            if parent[j] < 0:
                score += np.log(t[1][v[:, j]]) - np.log(t[0][v[:, j]])
            else:
                score += np.log(t[1][v[:, parent[j]], v[:, j]]) - np.log(t[0][v[:, parent[j]], v[:, j]])
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))

    def dependence() -> tuple[np.ndarray, np.ndarray]:
        info, alone = np.zeros((m, m)), np.zeros(m)
        for w in (1 - q, q):
            share = w.sum() / n
            joint = np.einsum("nia,njb,n->ijab", onehot, onehot, w, optimize=True) / max(w.sum(), 1e-9) + 1e-9
            single = np.einsum("nia,n->ia", onehot, w) / max(w.sum(), 1e-9) + 1e-9
            info += share * (joint * np.log(joint / (single[:, None, :, None] * single[None, :, None, :]))).sum((2, 3))
            alone -= share * (single * np.log(single)).sum(1)
        return info, alone

    def settle() -> None:
        nonlocal q, pi, tables
        for _ in range(rounds):
            pi, tables = m_step()
            q = e_step(pi, tables)

    pi = 0.5
    if m > 1:
        # near copies are tied first, by the majority's classes: once EM has settled, a voter
        # and its copy explain each other away and look independent
        info, alone = dependence()
        weight = np.ones(m)
        for j in range(1, m):
            up = int(info[j, :j].argmax())
            if info[j, up] > COPY * max(alone[j], 1e-9):
                parent[j], weight[j] = up, 0.0
        signal = votes @ weight
        q = 1 / (1 + np.exp(-(signal - 0.5)))
    settle()
    if m > 1:
        info, _ = dependence()
        for j in range(m):
            if parent[j] >= 0:
                info[j, parent[j]] = info[parent[j], j] = np.inf
        inside = {0}
        while len(inside) < m:
            gain, child, up = max((info[i, j], j, i) for i in inside for j in range(m) if j not in inside)
            parent[child] = up if gain > 0.002 else -1
            inside.add(child)
    settle()
    if q[signal > 0].sum() < (1 - q)[signal > 0].sum() and (signal > 0).any():
        q = 1 - q  # the votes say which class is which
    right = lambda j: float((q * (votes[:, j] == 1) + (1 - q) * (votes[:, j] == -1)).sum() / max((votes[:, j] != 0).sum(), 1))
    stats = [{"parent": parent[j], "accuracy": right(j)} for j in range(m)]
    return q, stats


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft targets by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        s = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (s - target) + penalty * w
        hess = (a * (s * (1 - s) + 1e-6)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Train on the labelled rows that satisfy ``usable`` (a condition on the labels table)."""
    train = training_rows(docs, labels, F.lit(True) if usable is None else usable, p)
    counts = {int(r.toxic): r["count"] for r in train.groupBy("toxic").count().collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    constant = ToxicityModel([], np.zeros(Featurizer.EXTRA), -40.0 if not n_pos else float(np.log(n_pos / max(n_neg, 1e-9))), np.zeros(Featurizer.EXTRA), np.ones(Featurizer.EXTRA), prior=n_pos / max(n_pos + n_neg, 1))
    if not n_pos or not n_neg:
        return constant
    terms = choose_terms(term_scores(train), n_pos, n_neg, p)
    if not terms:
        return constant
    featurize = Featurizer(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(*featurize(t), featurize.pattern_votes(t)) for t in texts_of(b)]
            hits, patterns = (pa.array([np.asarray(f[k], kind).tobytes() for f in found], pa.binary()) for k, kind in ((0, np.float32), (2, np.int8)))
            yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.int64()), hits, patterns], names=["n", "hits", "patterns"])

    rows = train.select("text").mapInArrow(run, "n long, hits binary, patterns binary").collect()  # at most max_train_docs
    rows.sort(key=lambda r: (r.n, bytes(r.hits), bytes(r.patterns)))
    hits, patterns = (np.stack([np.frombuffer(r[k], kind) for r in rows]) for k, kind in (("hits", np.float32), ("patterns", np.int8)))
    lengths = np.array([r.n for r in rows])
    voters, votes = make_voters(hits, patterns, p)
    posterior, stats = label_model(votes, p.em_rounds)
    x = np.stack([np.concatenate([np.minimum(h, 12), np.minimum(h, 1), featurize.form(h, n)]) for h, n in zip(hits, lengths)]).astype(float)
    center, scale = x.mean(0), x.std(0) + 1e-3
    w, bias = fit_linear((x - center) / scale, posterior, p.ridge)
    return ToxicityModel(terms, w, bias, center, scale, [a | b for a, b in zip(voters, stats)], n_pos / (n_pos + n_neg))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score and predicted for every document."""
    featurize = Featurizer(model.terms)
    w, bias, center, scale = model.weights, model.bias, model.center, model.scale
    names = list(keep)
    made = [free_name(names, "score"), free_name(names, "predicted")]
    read = list(dict.fromkeys([*names, "text"]))
    at = read.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([featurize.row(t) for t in texts_of(b, at)]) if b.num_rows else np.zeros((0, len(w)))
            z = (x - center) / scale @ w + bias
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, *made])

    return numbered(docs, read).mapInArrow(run, fields(docs, names, **{made[0]: "double", made[1]: "int"}))


def clean_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns."""
    scored = score_toxicity(docs, model, tuple(docs.columns))
    return scored.where(quoted(scored.columns[-1]) == 0).select(*map(quoted, docs.columns))
