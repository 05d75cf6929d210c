"""URL filters in DataFrame operations only: host and path rules, then boosted trees.

The trees judge what no rule fits. They use lexical features alone: length, depth, digit
ratio, character entropy, parameter counts and statistics of the host's suffix, and are
trained on labelled URLs; without labels of its own the operator learns from the URLs that
the rules judge. The fit uses at most ``max_train`` distinct labelled URLs (a documented bound,
in hash order); fitted trees are plain CASE expressions over the features, so scoring is a
projection without shuffle.

Cases: a null url, or one without ``://``, has empty host and path, no rule, and the
verdict of the trees on an empty url; repeated rows get a row each; an empty table gives an
empty result; without labelled rows of both classes the trees are one constant (allow unless
all labels say block); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, literal_doubles

#: (verdict, host and path)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
FOLDS = 4
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "entropy", "params", "hyphens", "secure", "fragment", "suffix_rate", "first_rate")


@dataclass(frozen=True)
class UrlParams:
    max_train: int = 20_000
    trees: int = 24
    depth: int = 3
    rate: float = 0.3
    bins: int = 24
    least: int = 20
    suffix_slots: int = 1024
    block_at: float = 0.9


@dataclass(frozen=True)
class UrlModel:
    """trees: nested (feature, cut, low branch, high branch) or a leaf's value; rates: block share by slot."""

    trees: tuple
    bias: float
    suffix_rates: tuple[float, ...]
    first_rates: tuple[float, ...]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        at, below = rule.partition("/")[0], "/" + rule.partition("/")[2]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(below)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _slot(text: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(slots)).cast("int")


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _first(host: Column, path: Column) -> Column:
    """Host suffix of two labels with the path's first segment."""
    return F.concat_ws("/", F.substring_index(host, ".", -2), F.get(F.split(path, "/"), 1))


def lexical_features(pages: DataFrame, p: UrlParams) -> DataFrame:
    """page columns, host, path and the features that need no model, plus the two slots."""
    url = F.coalesce(F.col("url"), F.lit(""))
    framed = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn("u", url)
    n = F.length("u")
    count = lambda c: (n - F.length(F.replace(F.col("u"), F.lit(c), F.lit("")))).cast("double")
    digits = (n - F.length(F.translate("u", "0123456789", ""))).cast("double")
    share = lambda c: (n - F.length(F.replace(F.col("u"), c, F.lit("")))) / n
    entropy = F.when(n == 0, 0.0).otherwise(F.aggregate(F.array_distinct(F.split("u", "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c)))))
    exact = {
        "length": n.cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"), "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"), "digits": digits, "digit_ratio": F.when(n == 0, 0.0).otherwise(digits / n), "entropy": F.round(entropy, 9),
        "params": F.when(F.col("u").contains("?"), count("&") + 1).otherwise(0.0), "hyphens": count("-"), "secure": F.lower(F.substring("u", 1, 6)).eqNullSafe("https:").cast("double"), "fragment": F.col("u").contains("#").cast("double"),
    }
    host, path = F.col("host"), F.col("path")
    return framed.select("*", *(c.alias(f"f_{k}") for k, c in exact.items()), _slot(_suffix(host), p.suffix_slots).alias("s_suffix"), _slot(_first(host, path), p.suffix_slots).alias("s_first")).drop("u")


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, p: UrlParams):
    """A regression tree on binned features, as nested tuples."""
    leaf = float(-p.rate * grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 2 * p.least:
        return leaf
    best = (1e-6, None, None)
    total = grad.sum() ** 2 / (hess.sum() + 1.0)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        at = np.searchsorted(edges, x[:, f], side="left")
        g, h, c = (np.bincount(at, w, len(edges) + 1).cumsum() for w in (grad, hess, np.ones(len(x))))
        gain = g[:-1] ** 2 / (h[:-1] + 1.0) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1.0) - total
        gain[(c[:-1] < p.least) | (c[-1] - c[:-1] < p.least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, float(edges[k]))
    if best[1] is None:
        return leaf
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[low], grad[low], hess[low], cuts, depth - 1, p), _grow(x[~low], grad[~low], hess[~low], cuts, depth - 1, p))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, _apply(low, x), _apply(high, x))


def _rates(slots: np.ndarray, y: np.ndarray, prior: float, p: UrlParams) -> np.ndarray:
    """Share of label 1 in each slot, drawn to the prior where there are few rows."""
    return (np.bincount(slots, y, p.suffix_slots) + 4 * prior) / (np.bincount(slots, minlength=p.suffix_slots) + 4)


def train_url_model(labelled: DataFrame, p: UrlParams = UrlParams()) -> UrlModel:
    """Fit on (url, label): 1 block, 0 allow. At most ``max_train`` distinct rows, in hash order, reach the driver."""
    known = labelled.where("url is not null and label in (0, 1)").select("url", "label").distinct()
    rows = known.orderBy(F.xxhash64("url"), "url", "label").limit(p.max_train)
    found = lexical_features(rows, p)
    plain = [f for f in FEATURES if not f.endswith("_rate")]
    data = found.select("label", *(F.col(f"f_{f}") for f in plain), "s_suffix", "s_first").collect()
    y = np.array([r.label for r in data], float)
    prior = float(y.mean()) if len(y) else 0.0
    flat = (prior,) * p.suffix_slots
    if not len(y) or prior in (0.0, 1.0):
        return UrlModel((), 8.0 if prior == 1.0 else -8.0, flat, flat)
    slots = np.array([[r.s_suffix, r.s_first] for r in data])
    rates, columns = [], []
    for s in slots.T:
        rates.append(_rates(s, y, prior, p))
        own = np.zeros(len(y))
        for k in range(FOLDS):  # a row's feature comes from the other folds, so that no label is its own evidence
            at = np.arange(len(y)) % FOLDS == k
            own[at] = _rates(s[~at], y[~at], prior, p)[s[at]]
        columns.append(own)
    x = np.hstack([np.array([[r[f"f_{f}"] for f in plain] for r in data], float), np.array(columns).T])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, p.bins + 1)[1:-1], method="lower")) for c in x.T]
    score = np.full(len(y), math.log(prior / (1 - prior)))
    bias, trees = float(score[0]), []
    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-score))
        tree = _grow(x, q - y, q * (1 - q), cuts, p.depth, p)
        trees.append(tree)
        score += _apply(tree, x)
    return UrlModel(tuple(trees), bias, tuple(map(float, rates[0])), tuple(map(float, rates[1])))


def _case(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(F.col(f"f_{FEATURES[f]}") <= cut, _case(low)).otherwise(_case(high))


def judge_urls(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, p: UrlParams = UrlParams()) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score (log-odds of block)."""
    found = lexical_features(pages.select("page_id", "url"), p)
    rate = lambda values, slot: F.get(literal_doubles(values), F.col(slot))
    full = found.withColumn("f_suffix_rate", rate(model.suffix_rates, "s_suffix")).withColumn("f_first_rate", rate(model.first_rates, "s_first"))
    score = F.lit(model.bias)
    for tree in model.trees:
        score = score + _case(tree)
    full = full.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", score)
    verdicts = F.create_map(*(F.lit(x) for v, r in rules for x in (r, v))) if rules else None
    by_trees = F.when(F.col("score") >= math.log(p.block_at / (1 - p.block_at)), "block").otherwise("allow")
    verdict = by_trees if verdicts is None else F.when(F.col("rule").isNull(), by_trees).otherwise(F.element_at(verdicts, F.col("rule")))
    return full.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def rule_labels(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(url, label) of the pages that a rule judges: 1 block, 0 allow."""
    verdicts = F.create_map(*(F.lit(x) for v, r in rules for x in (r, int(v == "block"))))
    rule = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    return pages.select("url", F.element_at(verdicts, rule).alias("label")).where("label is not null")
