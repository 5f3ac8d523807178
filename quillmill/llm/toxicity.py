"""Toxicity scores by weak supervision.

Many voters (lexicons of words and word beginnings, and text patterns) vote on
each document. A generative label model estimates from their agreement how
accurate and how correlated they are; labels only orient and calibrate it. Its
posterior labels train a linear classifier, and the classifier scores whole
texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillmill.llm._shared import held_out, place_of, released, stage

#: Written by hand: words that insult or threaten, a lexicon for each group; none that is common in another language (as "die" is).
SEED_LEXICONS: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "moron", "stupid", "dumb", "fool", "imbecile", "clown", "loser", "pathetic", "worthless"),
    "contempt": ("scum", "trash", "garbage", "filth", "vermin", "disgusting", "vile", "parasite", "subhuman", "degenerate"),
    "threat": ("kill", "hurt", "destroy", "punch", "beat", "strangle", "murder", "hang", "shoot", "burn"),
}
PATTERNS: dict[str, str] = {
    "you_are": r"\byou(?:'re| are)? (?:a |an |such )?(?:idiot|moron|fool|loser|clown|trash)",
    "go_away": r"\b(?:shut up|get lost|drop dead|go to hell)\b",
    "masked": r"\b[a-z]+[*@#$%]{2,}[a-z]+\b",
}
WORD = re.compile(r"[^\W\d_]+")
#: Letters that a word-beginning feature has.
PREFIXES = (4, 5, 6)


def features(text: str) -> set[str]:
    """Distinct words and word beginnings of a whole text."""
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:k]}~" for w in words if len(w) > min(PREFIXES) for k in PREFIXES if len(w) >= k}


@dataclass(frozen=True)
class Lexicon:
    """A voter that speaks for toxic where a text has one of its features."""

    name: str
    features: frozenset[str]

    def vote(self, found: set[str]) -> bool:
        return not self.features.isdisjoint(found)


@dataclass
class LabelModel:
    """Voters' behaviour given the true label.

    ``rates[v, y]`` is the probability that voter v speaks if the label is y,
    ``correlations`` are those of votes given the label, and ``share[v]`` the
    part of a voter's evidence that its correlated fellows leave to it. A voter
    that is silent abstains: a row of which none speaks keeps the prior.
    """

    prior: float
    rates: np.ndarray
    correlations: np.ndarray

    @property
    def accuracy(self) -> np.ndarray:
        """The probability of label 1 where each voter speaks."""
        yes = self.prior * self.rates[:, 1]
        return yes / (yes + (1 - self.prior) * self.rates[:, 0])

    @property
    def share(self) -> np.ndarray:
        return 1 / np.maximum(1.0, (self.correlations**2).sum(axis=1))

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        return np.log(self.prior / (1 - self.prior)) + votes @ (np.log(self.rates[:, 1] / self.rates[:, 0]) * self.share)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return _logistic(self.log_odds(votes))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> LabelModel:
    """Estimate accuracies and correlations of voters from their agreement alone; no label is seen.

    Expectation maximisation over the unknown labels of the rows of ``votes``
    (voter speaks or not), of which a share of ``prior`` is toxic. It starts
    from where voters agree: two or more make a row likely, others keep the
    prior. Each round estimates the rates
    given the posterior labels, then the correlations of what the rates leave
    unexplained (squares less what chance gives in so many rows), and with
    both the new posteriors. Rates are smoothed by half a vote.
    """
    x = votes.astype(float)
    n, m = x.shape
    p = np.choose(np.minimum(votes.sum(axis=1), 2), [prior, prior, 0.95]).astype(float) if m else np.full(n, prior)
    model = LabelModel(prior, np.full((m, 2), 0.5), np.eye(m))
    for _ in range(rounds):
        weight = np.stack([1 - p, p])
        rates = ((weight @ x + 0.5) / (weight.sum(axis=1)[:, None] + 1)).T
        left = x - (1 - p)[:, None] * rates[:, 0] - p[:, None] * rates[:, 1]
        deviation = np.sqrt((left**2).mean(axis=0)) + 1e-9
        seen = left.T @ left / n / np.outer(deviation, deviation)
        correlations = np.sign(seen) * np.sqrt(np.maximum(0.0, seen**2 - 1 / n))
        np.fill_diagonal(correlations, 1.0)
        model = LabelModel(prior, rates, correlations)
        new = model.posterior(votes)
        done, p = np.abs(new - p).max() < 1e-6, new
        if done:
            break
    return model


def calibrated(log_odds: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, shift) by which labelled rows orient and scale log odds: a logistic curve of the label over them.

    Newton steps with a weak pull to slope 1 and shift 0; a negative slope
    turns the classes round.
    """
    x = np.column_stack([np.clip(log_odds, -30, 30), np.ones(len(label))])
    w, pull = np.array([1.0, 0.0]), np.array([1.0, 1.0])
    for _ in range(steps):
        q = _logistic(x @ w)
        slope = x.T @ (q - label) + pull * (w - [1.0, 0.0])
        bend = (x * (q * (1 - q))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(bend, slope)
        w = w - move / max(1.0, np.abs(move).max())
    return float(w[0]), float(w[1])


@dataclass
class Scorer:
    """The trained linear classifier: weights of features, and of lexicons that a text has a feature of."""

    weights: dict[str, float]
    bias: float
    members: dict[str, tuple[int, ...]]
    lexicon_weights: tuple[float, ...]

    def score(self, found: set[str]) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in found)
        hit = {v for f in found for v in self.members.get(f, ())}
        z += sum(self.lexicon_weights[v] for v in hit)
        return float(_logistic(np.float64(z)))


def _fit_linear(rows: list[np.ndarray], target: np.ndarray, width: int, ridge: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, binary features, by accelerated gradient descent."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    w, bias = np.zeros(width), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    speed, bias_speed = np.zeros(width), 0.0
    grad_sq, bias_sq = np.full(width, 1e-8), 1e-8
    for step in range(steps):
        z = bias + np.bincount(owner, w[flat], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(rows)
        g = np.bincount(flat, error[owner], width) + ridge * w / max(1, len(rows)) ** 0.5
        gb = error.sum()
        grad_sq, bias_sq = 0.99 * grad_sq + 0.01 * g * g, 0.99 * bias_sq + 0.01 * gb * gb
        speed, bias_speed = 0.9 * speed + 0.1 * g, 0.9 * bias_speed + 0.1 * gb
        rate = 0.05 * (1 - 0.9 * step / steps)
        w -= rate * speed / (np.sqrt(grad_sq) + 1e-6)
        bias -= rate * bias_speed / (np.sqrt(bias_sq) + 1e-6)
    return w, bias


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    modulus: int = 3,
    remainder: int = 1,
    sample_rows: int = 12_000,
    learned_voters: int = 60,
    chance: float = 0.01,
) -> Scorer:
    """Learn from labelled rows that are not held out.

    Everything is fitted on a bounded sample, about ``sample_rows`` labelled
    rows of the smallest hash of their id (all where there are fewer):

    1. in one half of the sample, features that go with the label beyond
       ``chance``, given how many were tried, become ``learned_voters``
       lexicons at most, beside the hand-written ones and the patterns;
    2. the label model estimates the voters' rates and correlations over the
       whole sample from their agreement, without labels;
    3. the labels of the other half give the prior, and orient and calibrate
       the posteriors;
    4. a logistic regression on features and lexicons learns the posteriors,
       not the labels.

    Texts are cut to features on the executors; the driver sees of the sample
    only the features that became voters'. Rows without a label of 0 or 1 are
    left out; of several labels of one id the larger counts. Without labelled
    rows every text gets the same low score.
    """
    clean = (
        labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__label"))
        .filter(F.col("__label").isin(0, 1) & ~held_out(F.col("__id"), modulus, remainder))
        .groupBy("__id")
        .agg(F.max("__label").alias("__label"))
    )
    there = clean.count()
    share = 1.0 if there <= sample_rows else sample_rows / there
    chosen = clean.filter(F.pmod(F.xxhash64(F.lit(23), "__id"), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))).withColumn("__half", F.pmod(F.xxhash64(F.lit(29), "__id"), F.lit(2)).cast("int"))
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            hits = [[k for k, p in PATTERNS.items() if re.search(p, t.lower())] for t in batch["text"]]
            yield pd.DataFrame({"key": batch["__id"].astype(str), "label": batch["__label"], "half": batch["__half"], "features": [list(f) for f in found], "patterns": hits})

    table = stage(texts.mapInPandas(cut, "key string, label int, half int, features array<string>, patterns array<string>"), "toxicity-sample")
    size = table.filter("half = 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("a")).collect()[0]
    grouped = stage(
        table.filter("half = 0").select("label", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("label").alias("a")).filter("n >= 3"),
        "toxicity-features",
    )
    tried = grouped.count()
    base = min(max(size["a"] / max(1, size["n"]), 1e-6), 1 - 1e-6)
    q = F.least(F.greatest(F.col("a") / F.col("n"), F.lit(1e-9)), F.lit(1 - 1e-9))
    gain = F.col("a") * F.log(q / base) + (F.col("n") - F.col("a")) * F.log((1 - q) / (1 - base))
    # what chance does not explain in a sample of bounded size
    counts = grouped.filter((q > max(0.6, base)) & (gain >= float(np.log(max(1, tried) / chance)))).toPandas()
    wanted = docs.sparkSession.sparkContext.broadcast(set(counts["f"]).union(*SEED_LEXICONS.values()))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(features=[[f for f in row if f in wanted.value] for row in batch["features"]])

    sample = table.mapInPandas(keep, table.schema).toPandas().sort_values("key", ignore_index=True)
    return fit(sample, counts, learned_voters)


def lexicons(counts: pd.DataFrame, most: int) -> list[Lexicon]:
    """The hand-written lexicons, and the features dealt in the order of their counts to ``most`` lexicons."""
    order = counts.sort_values(["a", "f"], ascending=[False, True])["f"].tolist()
    dealt = [frozenset(order[i::most]) for i in range(min(most, len(order)))]
    return [Lexicon(f"learned{i}", g) for i, g in enumerate(dealt)] + [Lexicon(k, frozenset(v)) for k, v in SEED_LEXICONS.items()]


def fit(sample: pd.DataFrame, counts: pd.DataFrame, learned_voters: int) -> Scorer:
    """The classifier from a sample of (label, half, features, patterns) and its features' counts; see ``learn``."""
    if not len(sample):
        return Scorer({}, -4.0, {}, ())
    voters = lexicons(counts, learned_voters)
    found = [set(f) for f in sample["features"]]
    hits = np.array([[v.vote(f) for v in voters] for f in found], bool)
    votes = np.column_stack([hits, np.array([[k in p for k in PATTERNS] for p in sample["patterns"]], bool)])
    label, other = sample["label"].to_numpy(float), sample["half"].to_numpy() == 1
    other = other if other.any() else ~other
    model = fit_label_model(votes, float(np.clip(label[other].mean(), 0.001, 0.999)))
    odds = model.log_odds(votes)
    slope, shift = calibrated(odds[other], label[other])
    target = _logistic(slope * np.clip(odds, -30, 30) + shift)
    names = sorted(set().union(*(v.features for v in voters)))
    numbers = {f: len(voters) + i for i, f in enumerate(names)}
    rows = [np.concatenate([np.flatnonzero(h), np.array(sorted(numbers[f] for f in s if f in numbers), np.int64)]) for h, s in zip(hits, found)]
    w, bias = _fit_linear(rows, target, len(voters) + len(names))
    members: dict[str, tuple[int, ...]] = {}
    for i, v in enumerate(voters):
        for f in v.features:
            members[f] = (*members.get(f, ()), i)
    return Scorer({f: float(w[i]) for f, i in numbers.items()}, bias, members, tuple(float(x) for x in w[: len(voters)]))


def score_documents(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` in 0 to 1, higher for texts likelier to be toxic.

    Whole texts are read, very long ones too; a null text counts as empty and
    gets the score of a text without features. Repeated rows get equal scores;
    an empty table gives no rows. Other columns pass through; a column
    ``score`` is replaced. The text column is found whatever its case.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    kept = [f for f in docs.schema.fields if f.name.lower() != "score"]
    place = place_of([f.name for f in kept], text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            scores = [reader.score(t or "") for t in batch.column(place).cast(pa.large_string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.select([F.col(f"`{f.name}`") for f in kept]).mapInArrow(lambda batches: released(score(batches)), StructType([*kept, StructField("score", DoubleType())]))


class Reader:
    """Scores texts, remembering which features of a word have weights."""

    def __init__(self, scorer: Scorer):
        self.scorer, self.table = scorer, {}

    def score(self, text: str) -> float:
        table = self.table
        if len(table) > 500_000:
            table.clear()
        found: set[str] = set()
        for w in set(WORD.findall(text.lower())):
            own = table.get(w)
            if own is None:
                own = table[w] = tuple(f for f in features(w) if f in self.scorer.members)
            if own:
                found.update(own)
        return self.scorer.score(found)
