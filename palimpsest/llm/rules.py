"""Document quality by a sparse ensemble of rules over text statistics, scored by Spark expressions alone.

Boosted shallow trees on statistics of labelled texts propose conjunctions (every path from a root to a node is a rule);
a logistic regression with an L1 penalty weighs them and drops most; what is left becomes one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most.
SAMPLE = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; shares of nothing are 0, a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)

    def share(pattern: str) -> Column:
        return (size - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(size, F.lit(1))

    words = size - F.length(F.replace(text, F.lit(" "))) + 1
    lines = size - F.length(F.replace(text, F.lit("\n"))) + 1
    split = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    return {
        "chars": size.cast("double"),
        "word_chars": size / words,
        "line_words": (words / lines).cast("double"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:'\"!?()\-]+"),
        "marks": share(r"[.,;:'\"!?()\-]+"),
        "exclaims": share(r"!+"),
        "capitals": share(r"\p{Lu}+"),
        "digits": share(r"\p{N}+"),
        "distinct_words": F.size(F.array_distinct(split)) / F.size(split),
        "repeats": F.regexp_count(text, F.lit(r"(?:^|\s)(\S+)\s\1(?!\S)")) / words,
    }


Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    """Rules, each a conjunction of (statistic, above, threshold), with their weights."""

    names: list[str]
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def column(self, values: dict[str, Column]) -> Column:
        """The score, from 0 to 1, as an expression."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            held = None
            for k, above, edge in rule:
                one = values[self.names[k]] > edge if above else values[self.names[k]] <= edge
                held = one if held is None else held & one
            total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-total))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for k, above, edge in rule:
        held &= (x[:, k] > edge) == above
    return held


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: Rule, least: int, rules: list[Rule], out: np.ndarray) -> None:
    """Grow one regression tree on gradients; add its paths to ``rules`` and its steps to ``out``."""
    if path:
        rules.append(path)
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, 0)
    if depth and len(rows) >= 2 * least:
        for k, cuts in enumerate(edges):
            if not len(cuts):
                continue
            bins = binned[rows, k]
            n = np.bincount(bins, minlength=len(cuts) + 1).cumsum()[:-1]
            gl = np.bincount(bins, grad[rows], len(cuts) + 1).cumsum()[:-1]
            hl = np.bincount(bins, hess[rows], len(cuts) + 1).cumsum()[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < least) | (len(rows) - n < least)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, at)
    if best[1] < 0:
        out[rows] += g / (h + 1)
        return
    _, k, at = best
    right = binned[rows, k] > at
    for above, part in ((False, rows[~right]), (True, rows[right])):
        _grow(binned, edges, grad, hess, part, depth - 1, (*path, (k, above, float(edges[k][at]))), least, rules, out)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, rounds: int = 400) -> Ensemble:
    """Fit on statistics ``x`` and labels ``y`` (0 or 1). Without both labels the score is a constant."""
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(prior / (1 - prior)))
    if not 0 < y.sum() < n:
        return Ensemble(names, bias=base)
    edges = []
    for k in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1]))
        values = np.unique(x[:, k])
        after = values[np.minimum(np.searchsorted(values, cuts, side="right"), len(values) - 1)]
        edges.append(np.unique((cuts + after) / 2)[: max(0, len(values) - 1)])
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    least = max(2, n // 500)
    score = np.full(n, base)
    found: list[Rule] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(n)
        _grow(binned, edges, y - p, p * (1 - p), np.arange(n), depth, (), least, found, step)
        score += rate * step
    rules = list(dict.fromkeys(found))
    hold = np.stack([_holds(r, x) for r in rules], axis=1).astype(float)
    # Accelerated proximal gradient; the bias isn't penalised.
    step = 4.0 * n / max(np.linalg.norm(hold, 2) ** 2 + n, 1)
    w = v = np.zeros(len(rules))
    b = c = base
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(hold @ v + c)))
        wide = v - step * (hold.T @ (p - y)) / n
        new, nb = np.sign(wide) * np.maximum(np.abs(wide) - step * penalty, 0), c - step * (p - y).mean()
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / after * (new - w), nb + (t - 1) / after * (nb - b)
        w, b, t = new, nb, after
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(names, [rules[i] for i in kept], [float(w[i]) for i in kept], float(b))


def held_out(id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """Fit on at most ``sample`` labelled documents that aren't held out, picked by the hash of their id.

    A document with several labels counts as good if most of them are 1; null ids and labels are left out. Only the
    sample's statistics come to the driver. The sample's ids, a bounded table, are broadcast.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id)))
    known = known.groupBy(F.col(id).alias("__id")).agg((F.avg(label) >= 0.5).cast("int").alias("__y"))
    # A little less than the bound is picked by the hash of the id, so that the limit has next to nothing to do.
    part = min(1.0, 0.97 * sample / max(1, known.count()))
    if part < 1.0:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * part)).limit(sample)
    values = statistics(F.col("__text"))
    texts = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id")
    rows = texts.select("__id", "__y", *(v.cast("double").alias(k) for k, v in values.items())).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return fit(rows[list(values)].to_numpy(float), rows["__y"].to_numpy(float), list(values))


def score(docs: DataFrame, model: Ensemble, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``, a double from 0 to 1; a column of that name, or one named __s, is an error."""
    if clash := {out.lower(), "__s"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are taken")
    used = {model.names[k] for rule in model.rules for k, _, _ in rule}
    values = {k: v for k, v in statistics(F.col(text)).items() if k in used}
    packed = docs.withColumn("__s", F.struct(*(v.cast("double").alias(k) for k, v in values.items())) if values else F.lit(None))
    # A generator keeps a later filter on the score from being pushed down to the texts, where every rule would work out
    # its statistics anew.
    return packed.select(*docs.columns, F.explode(F.array(model.column({k: F.col(f"__s.{k}") for k in values}))).alias(out))
