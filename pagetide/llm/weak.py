"""Label model for weak supervision: votes in {-1, 0, +1}, EM on vote patterns.

The corpus is read by Spark only: ``vote_patterns`` counts each combination of
votes (at most 3**k rows for k labelers, whatever the input), and EM runs on
that bounded table. The result is applied as a plain column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELERS = 8  # bounds the pattern table at 3**8 = 6561 rows


@dataclass(frozen=True)
class LabelModel:
    """log-odds of the positive class: ``bias + sum(weight[labeler][vote])``."""

    labelers: tuple[str, ...]
    bias: float
    weights: tuple[tuple[float, float, float], ...]  # for votes -1, 0, +1
    reliabilities: tuple[float, ...]  # P(vote agrees with the class | it votes)

    def log_odds(self, get=F.col) -> Column:
        total = F.lit(self.bias)
        for name, (neg, zero, pos) in zip(self.labelers, self.weights):
            total = total + F.when(get(name) < 0, neg).when(get(name) > 0, pos).otherwise(zero)
        return total

    def posterior(self, get=F.col) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(get)))


@dataclass(frozen=True)
class NaiveBayes:
    """Classifier over categorical features, fitted on soft labels."""

    bias: float
    tables: tuple[tuple[str, tuple[tuple[object, float], ...]], ...]

    def probability(self, get=F.col) -> Column:
        total = F.lit(self.bias)
        for name, weights in self.tables:
            term = None
            for value, weight in weights:
                term = F.when(get(name) == value, weight) if term is None else term.when(get(name) == value, weight)
            if term is not None:
                total = total + term.otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_naive_bayes(df: DataFrame, features: list[str], p: Column) -> NaiveBayes:
    """Fit on posteriors ``p``; ``features`` must have few distinct values (the
    sums per combination come to the driver)."""
    rows = df.groupBy(*features).agg(F.sum(p).alias("pos"), F.sum(F.lit(1.0) - p).alias("neg")).collect()
    pos, neg = sum(r["pos"] for r in rows) + 1.0, sum(r["neg"] for r in rows) + 1.0
    tables = []
    for name in features:
        sums: dict = {}
        for r in rows:
            a, b = sums.get(r[name], (0.0, 0.0))
            sums[r[name]] = (a + r["pos"], b + r["neg"])
        k = max(1, len(sums))
        tables.append((name, tuple(
            (value, math.log((a + 1.0) / (pos + k)) - math.log((b + 1.0) / (neg + k)))
            for value, (a, b) in sorted(sums.items(), key=str) if value is not None
        )))
    return NaiveBayes(math.log(pos / neg), tuple(tables))


def vote_patterns(df: DataFrame, labelers: list[str], extra: list[str] = ()) -> list:
    if len(labelers) > MAX_LABELERS:
        raise ValueError(f"at most {MAX_LABELERS} labelers")
    return df.groupBy(*labelers, *extra).count().collect()


def fit(
    df: DataFrame,
    labelers: list[str],
    prior_positive: float = 0.5,
    p_given_pos: tuple[float, float, float] = (0.1, 0.4, 0.5),
    p_given_neg: tuple[float, float, float] = (0.5, 0.4, 0.1),
    strength: float = 0.2,
    rounds: int = 50,
    false_alarm: tuple[float, ...] | None = None,
) -> LabelModel:
    """Dawid-Skene EM. ``p_given_*`` (probability of a vote -1, 0, +1 in either
    class) start the rounds and act as Dirichlet priors whose weight is
    ``strength`` of the rows of the class, so the classes keep their meaning.

    ``false_alarm`` bounds, for each labeler, the probability of a vote -1 on
    the positive class. Labelers that catch disjoint kinds of negatives hardly
    ever agree, so agreement alone cannot tell them from noise; the bound is
    what their author vouches for, and EM estimates the rest.

    An empty input gives the model of the priors alone.
    """
    rows = vote_patterns(df, labelers)
    patterns = [(tuple(int(r[c]) for c in labelers), int(r["count"])) for r in sorted(rows, key=str)]
    total = sum(n for _, n in patterns)
    k = len(labelers)
    theta = {1: [list(p_given_pos) for _ in range(k)], 0: [list(p_given_neg) for _ in range(k)]}
    prior = prior_positive
    for _ in range(rounds if total else 0):
        mass = {0: 0.0, 1: 0.0}
        seen = {y: [[0.0] * 3 for _ in range(k)] for y in (0, 1)}
        for votes, n in patterns:
            lo = math.log(prior / (1 - prior))
            for j, v in enumerate(votes):
                lo += math.log(theta[1][j][v + 1] / theta[0][j][v + 1])
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, lo))))
            for y, w in ((1, p * n), (0, (1 - p) * n)):
                mass[y] += w
                for j, v in enumerate(votes):
                    seen[y][j][v + 1] += w
        prior = min(0.99, max(0.01, (mass[1] + strength * total * prior_positive) / (total * (1 + strength))))
        for y, start in ((1, p_given_pos), (0, p_given_neg)):
            base = strength * mass[y] + 1.0
            for j in range(k):
                p = [(seen[y][j][i] + base * start[i]) / (mass[y] + base) for i in range(3)]
                if y and false_alarm and p[0] > false_alarm[j]:
                    p = [false_alarm[j], *(x * (1 - false_alarm[j]) / (1 - p[0]) for x in p[1:])]
                theta[y][j] = p
    weights = tuple(tuple(math.log(theta[1][j][i] / theta[0][j][i]) for i in range(3)) for j in range(k))
    rel = []
    for j in range(k):
        agree = prior * theta[1][j][2] + (1 - prior) * theta[0][j][0]
        voted = agree + prior * theta[1][j][0] + (1 - prior) * theta[0][j][2]
        rel.append(agree / voted if voted else 0.5)
    return LabelModel(tuple(labelers), math.log(prior / (1 - prior)), weights, tuple(rel))
