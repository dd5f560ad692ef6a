"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize

#: The scorer is fitted on about this many documents, drawn by a hash; everything else covers all documents.
FIT_DOCUMENTS = 4_096
#: Hashed features, steps of the fit, its rate and its penalty.
DIMENSIONS, STEPS, RATE, PENALTY = 1 << 14, 300, 20.0, 1e-6
#: Documents whose score is at least this are kept.
THRESHOLD = 0.5
ROUNDS, CONVERGED = 200, 1e-9
#: Documents' worth of belief before any is seen, of votes (b, g, -) in bad and in good documents, and of the classes: a
#: labeller is right more often than wrong and most documents are good. It decides small corpora only.
VOTES_BEFORE, CLASSES_BEFORE = [[8.0, 1.0, 8.0], [0.5, 4.0, 8.0]], [2.0, 6.0]

_TAIL = re.compile(r"[^\w\s]{3,}$")
_LETTER_RUNS = re.compile(r"[^\W\d_]+")
_DIGIT_RUNS = re.compile(r"\d+")


@dataclass
class Facts:
    """What the labellers look at."""

    words: int
    distinct: float
    symbols: float
    upper: float
    bars: float
    length: float
    letters: float
    lines: float
    stops: float


def facts(text: str, tokens: list[str]) -> Facts:
    n = max(1, len(tokens))
    counts = Counter(tokens)
    tails = sum(c for t, c in counts.items() if not t[-1].isalnum() and (_TAIL.search(t) or t.endswith("!!")))
    bars = sum(c for t, c in counts.items() if len(t) <= 2 and not t.isalnum())
    upper = sum(c for t, c in counts.items() if len(t) > 1 and t.isupper())
    letters = sum(c for t, c in counts.items() if t[0].isalpha())
    stops = sum(c for t, c in counts.items() if t[-1] in ".,;:?!" and t[-2:-1].isalnum())
    lines = [x for x in text.split("\n") if x.strip()]
    return Facts(len(tokens), len(counts) / n, tails / n, upper / n, bars / n, (len(text) - text.count(" ")) / n, letters / n, len(set(lines)) / max(1, len(lines)), stops / n)


def _vote(bad: bool, good: bool) -> int:
    return 0 if bad else 1 if good else -1


# Each votes 0 (bad), 1 (good) or -1 (no opinion). The first three look at the whole text in different ways and vote both
# ways on nearly every text; each of the others knows one kind of junk. So every kind of junk is seen by two or more, and
# agreement tells how far each is to be trusted.
LABELLERS: dict[str, Callable[[Facts], int]] = {
    "punctuation": lambda f: _vote(f.words > 20 and f.stops < 0.02, f.stops >= 0.02 and (f.stops <= 0.5 or f.words <= 20) and f.bars < 0.1 and f.symbols < 0.1 and (f.distinct > 0.2 or f.words <= 60)),
    "word_shapes": lambda f: _vote(f.words == 0 or f.symbols > 0.2 or f.upper > 0.4 or f.words > 20 and f.letters < 0.5, f.symbols < 0.1 and f.upper < 0.2 and f.letters > 0.6 and f.length < 14),
    "variety": lambda f: _vote(f.words == 0 or f.bars > 0.15 and f.words > 20 or f.distinct < 0.1 and f.words > 60 or f.lines < 0.3, f.bars < 0.1 and f.lines > 0.5 and (f.distinct > 0.2 or f.words <= 60)),
    "symbol_tails": lambda f: _vote(f.symbols > 0.2, False),
    "upper_case": lambda f: _vote(f.upper > 0.4, False),
    "separators": lambda f: _vote(f.words > 20 and f.bars > 0.15, False),
    "repetition": lambda f: _vote(f.words > 60 and f.distinct < 0.1, False),
    "word_length": lambda f: _vote(f.length < 1.8 or f.length > 20, False),
    "letters": lambda f: _vote(f.words > 20 and f.letters < 0.5, False),
    "repeated_lines": lambda f: _vote(f.lines < 0.3, False),
    "empty": lambda f: _vote(f.words == 0, False),
}


def votes(f: Facts) -> str:
    """One character per labeller: b(ad), g(ood) or -."""
    return "".join("bg-"[v(f)] for v in LABELLERS.values())


@dataclass
class LabelModel:
    """prior[c], and likelihood[labeller][c][vote] of the votes b, g and -, for the classes bad and good."""

    prior: np.ndarray
    likelihood: np.ndarray

    def posterior(self, pattern: str) -> float:
        logs = np.log(self.prior) + sum(np.log(self.likelihood[k, :, "bg-".index(v)]) for k, v in enumerate(pattern))
        return float(1 / (1 + np.exp(logs[0] - logs[1])))

    def accuracies(self) -> dict[str, float]:
        """Of each labeller where it votes."""
        out = {}
        for k, name in enumerate(LABELLERS):
            right = self.prior[0] * self.likelihood[k, 0, 0] + self.prior[1] * self.likelihood[k, 1, 1]
            out[name] = float(right / (self.prior @ self.likelihood[k, :, :2].sum(axis=1)))
        return out


def fit_label_model(counts: dict[str, int]) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns; a document's labellers are independent given its class.

    It starts from each pattern's share of good votes and leans on VOTES_BEFORE and CLASSES_BEFORE. With no documents the model is neutral.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    seen = np.array([["bg-".index(c) for c in p] for p in patterns]).reshape(len(patterns), len(LABELLERS))
    good = np.array([(p.count("g") + 1) / (p.count("g") + 3 * p.count("b") + 2) for p in patterns])
    prior, likelihood = np.array([0.5, 0.5]), np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(ROUNDS if patterns else 0):
        share = np.stack([n * (1 - good), n * good])
        prior = (share.sum(axis=1) + CLASSES_BEFORE) / (n.sum() + sum(CLASSES_BEFORE))
        for k in range(len(LABELLERS)):
            for v in range(3):
                likelihood[k, :, v] = share[:, seen[:, k] == v].sum(axis=1) + np.array(VOTES_BEFORE)[:, v]
        likelihood /= likelihood.sum(axis=2, keepdims=True)
        logs = np.log(prior)[:, None] + sum(np.log(likelihood[k][:, seen[:, k]]) for k in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        done = np.abs(new - good).max() < CONVERGED
        good = new
        if done:
            break
    return LabelModel(prior, likelihood)


#: Most characters of a token's piece.
PIECE = 64


def _shape(token: str) -> str:
    """Letters and digits by case and kind, runs of one kind as one; other characters stay."""
    return _DIGIT_RUNS.sub("0", _LETTER_RUNS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", token))


def _slot(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), 0) & (DIMENSIONS - 1)


@lru_cache(maxsize=1 << 16)
def _shape_slot(shape: str) -> int:
    return _slot("s:" + shape)


def pieces(tokens: list[str]) -> list[str]:
    """The tokens, those of over PIECE characters cut into runs of as many, all of which count."""
    if max(map(len, tokens), default=0) <= PIECE:
        return tokens
    return [t[k : k + PIECE] for t in tokens for k in range(0, len(t), PIECE)]


def token_slots(token: str) -> tuple[int, int]:
    """Of the lower-cased token and of its shape. Most tokens are all letters, whose shape needs no pattern."""
    short = token[:PIECE]
    shape = ("A" if len(short) > 1 and short.isupper() else "a") if short.isalpha() else _shape(short)
    return _slot("w:" + token.lower()[:PIECE]), _shape_slot(shape)


def whole_slots(f: Facts) -> list[int]:
    """Features of the whole text, in tenths; each counts as a fifth of its tokens."""
    tenths = {"distinct": f.distinct, "lines": f.lines, "symbols": f.symbols, "upper": f.upper, "bars": f.bars, "letters": f.letters, "stops": f.stops}
    return [_slot(f"f:{k}:{int(10 * v)}") for k, v in tenths.items()] + [_slot(f"f:words:{len(bin(f.words))}")]


WHOLE_WEIGHT = 0.2


def features(text: str) -> dict[int, float]:
    tokens = text.split()
    out: Counter[int] = Counter()
    parts = pieces(tokens)
    for token, c in Counter(parts).items():
        for k in token_slots(token):
            out[k] += c / len(parts)
    for k in whole_slots(facts(text, tokens)):
        out[k] += WHOLE_WEIGHT
    return out


def fit_scorer(rows: Sequence[Mapping[int, float]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over features, fitted to labels between 0 and 1 by gradient descent with momentum."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    slot = np.fromiter((k for r in rows for k in r), np.int64)
    value = np.fromiter((v for r in rows for v in r.values()), float)
    w, b, step, step_b = np.zeros(DIMENSIONS), 0.0, np.zeros(DIMENSIONS), 0.0
    for _ in range(STEPS if len(rows) else 0):
        z = np.bincount(at, value * w[slot], minlength=len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        step = 0.9 * step - RATE * (np.bincount(slot, value * error[at], minlength=DIMENSIONS) + PENALTY * w)
        step_b = 0.9 * step_b - 0.1 * RATE * error.sum()
        w, b = w + step, b + step_b
    return w.astype(np.float32), float(b)


#: Tokens whose part of the score is kept in each worker.
CACHE_TOKENS = 1_000_000


def make_scorer(weights: np.ndarray, bias: float) -> Callable[[str, list[str], Facts], float]:
    kept: dict[str, float] = {}

    def score(text: str, tokens: list[str], f: Facts) -> float:
        if len(kept) > CACHE_TOKENS:
            kept.clear()
        total = 0.0
        parts = pieces(tokens)
        for t in parts:
            part = kept.get(t)
            if part is None:
                part = float(sum(weights[k] for k in token_slots(t)))
                kept[t] = part
            total += part
        z = bias + total / max(1, len(parts)) + WHOLE_WEIGHT * float(sum(weights[k] for k in whole_slots(f)))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

    return score


def observe(text: Column, drawn: Column) -> Column:
    """The vote pattern of each text and, of those drawn, the features."""

    @F.pandas_udf("pattern string, slots array<int>, amounts array<double>")
    def of(texts: pd.Series, drawn: pd.Series) -> pd.DataFrame:
        rows = []
        for t, own in zip(texts, drawn, strict=True):
            f = features(t) if own else None
            rows.append((votes(facts(t, t.split())), None if f is None else list(f), None if f is None else list(f.values())))
        return pd.DataFrame(rows, columns=["pattern", "slots", "amounts"])

    return of(text, drawn)


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def _text(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def fit(docs: DataFrame, text_col: str = "text", fit_documents: int = FIT_DOCUMENTS) -> QualityModel:
    """Label model from the vote patterns of all documents (at most three to the power of labellers rows reach the driver), then the scorer.

    One pass over the texts makes each document's pattern and, for at most about fit_documents different texts, drawn by a
    hash, the features; copies of one text are drawn once. One task fits the scorer to those features, labelled with the
    posteriors of their patterns. What reaches the driver is DIMENSIONS weights.
    """
    cut = min(1 << 31, int((1 << 31) * fit_documents / max(1, docs.count())) + 1)
    text, drawn = _text(text_col), F.pmod(F.xxhash64(F.lit(3), _text(text_col)), F.lit(1 << 31)) < cut
    seen = docs.select(F.when(drawn, F.xxhash64(text)).alias("h"), observe(text, drawn).alias("x")).select("h", "x.*")
    seen = materialize(seen, "observed")
    patterns = {r["pattern"]: r["n"] for r in seen.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    model = fit_label_model(patterns)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        labels = np.array([model.posterior(p) for p in rows["pattern"]])
        w, b = fit_scorer([dict(zip(k, v, strict=True)) for k, v in zip(rows["slots"], rows["amounts"], strict=True)], labels)
        return pd.DataFrame({"weights": [w.tobytes()], "bias": [b]})

    different = seen.where("h is not null").dropDuplicates(["h"])
    found = different.groupBy(F.lit(0).alias("one")).applyInPandas(train, "weights binary, bias double").collect()
    if not found:
        return QualityModel(model, np.zeros(DIMENSIONS, np.float32), 0.0)
    return QualityModel(model, np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"])


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", into: str = "quality_result") -> DataFrame:
    """docs with the column `into`: pattern, posterior of the labellers alone, score of the scorer. ValueError if docs has such a column."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    weights, bias, labels = model.weights, model.bias, model.labels

    @F.pandas_udf("pattern string, posterior double, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer, posteriors = make_scorer(weights, bias), {}
        for texts in batches:
            rows = []
            for t in texts:
                tokens = t.split()
                f = facts(t, tokens)
                p = votes(f)
                if p not in posteriors:
                    posteriors[p] = labels.posterior(p)
                rows.append((p, posteriors[p], scorer(t, tokens, f)))
            yield pd.DataFrame(rows, columns=["pattern", "posterior", "score"])

    return docs.withColumn(into, judge(_text(text_col)))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, votes, posterior, score, keep: one row per document, rows that repeat included.

    Null and blank texts have no words, get the vote of the `empty` labeller and are rejected.
    """
    out = score(docs.select("doc_id", "text"), fit(docs))
    r = F.col("quality_result")
    return out.select("doc_id", r["pattern"].alias("votes"), r["posterior"].alias("posterior"), r["score"].alias("score"), keep(r).alias("keep"))


def keep(result):
    """A score of exactly THRESHOLD is kept; a text without words is rejected whatever its score."""
    return (result["score"] >= THRESHOLD) & (F.substring(result["pattern"], list(LABELLERS).index("empty") + 1, 1) != "b")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns, whatever these are called; rows that repeat stay or go together."""
    name = next(n for n in (f"quality_result_{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    return score(docs, fit(docs), into=name).where(keep(F.col(name))).select(*docs.columns)
