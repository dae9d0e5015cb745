"""Scorers: whatever gives a text a number, from a lexicon or from a model, behind one form."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S

#: A scorer takes the name of a text column and gives a column: the direction from -1 to 1, or null if it can't tell.
Scorer = Callable[[str], Column]


def lexical_scorer(positive: Mapping[str, float], negative: Mapping[str, float]) -> Scorer:
    """Positive terms less negative ones; stays in the JVM."""
    return lambda column: S.clamp((S.density(column, positive) - S.density(column, negative)) * 2, -1, 1)


def score_text(rows: DataFrame, scorer: Scorer, column: str, into: str = "score") -> DataFrame:
    """``rows`` with the score; a null text or score is neutral (0)."""
    return rows.withColumn(into, F.coalesce(scorer(column), F.lit(0.0)))


_MODELS: dict[str, Callable] = {}


def _model(name: str, load: Callable[[], Callable]) -> Callable:
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def per_worker(name: str, load: Callable[[], Callable]) -> Callable:
    """The model that ``load`` returns, loaded when a worker process first scores with it and kept under ``name`` for its later batches and tasks."""
    return lambda texts: _model(name, load)(texts)


def halving(model: Callable[[list], Sequence], items: list) -> list:
    """The model's answers to ``items``; a batch that fails is halved until the single items that fail are found, whose answer is None.

    An answer of another length is a failure too. One bad item of n costs about 2 log2(n) more calls.
    """
    try:
        got = list(model(items))
        if len(got) == len(items):
            return got
    except Exception:  # noqa: S110 (whatever a model raises, its halves tell which items it can't answer)
        pass
    if len(items) == 1:
        return [None]
    mid = len(items) // 2
    return halving(model, items[:mid]) + halving(model, items[mid:])


def by_size(model: Callable[[list], Sequence], items: list[str], batch: int) -> list:
    """Answers in the order of ``items``, asked for in batches of like lengths, so that a batch is padded little; see ``halving``."""
    order = sorted(range(len(items)), key=lambda k: len(items[k]))
    out = [None] * len(items)
    for lo in range(0, len(items), batch):
        at = order[lo : lo + batch]
        for k, got in zip(at, halving(model, [items[k] for k in at]), strict=True):
            out[k] = got
    return out


def windowed_scores(rows: DataFrame, score: Callable[[list[str]], list[tuple[float, float, float]]], column: str, tokens: int = 510, batch: int = 16) -> DataFrame:
    """``rows`` with ``triple``, mean (positive, negative, neutral) over a long text's windows of ``tokens`` words, and ``failed``.

    ``score`` is a model on a list of texts (``per_worker`` keeps a heavy one). It is called on ``batch`` windows of like lengths at a time. An empty
    text is neutral; so is a window on which the model fails even alone, and ``failed`` counts these.
    """

    @F.pandas_udf("positive double, negative double, neutral double, failed int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            pieces = [(k, " ".join(w[lo : lo + tokens])) for k, w in enumerate((t or "").split() for t in texts) for lo in range(0, len(w), tokens)]
            sums, counts, lost = np.zeros((len(texts), 3)), np.zeros(len(texts)), np.zeros(len(texts), np.int32)
            for (k, _), triple in zip(pieces, by_size(score, [p for _, p in pieces], batch), strict=True):
                sums[k] += (0.0, 0.0, 1.0) if triple is None else triple
                counts[k] += 1
                lost[k] += triple is None
            sums[counts == 0, 2], counts[counts == 0] = 1, 1
            yield pd.DataFrame(sums / counts[:, None], columns=["positive", "negative", "neutral"]).assign(failed=lost)

    got = rows.withColumn("triple", run(F.col(column)))
    return got.withColumns({"triple": F.struct("triple.positive", "triple.negative", "triple.neutral"), "failed": F.col("triple.failed")})


def direction_label(positive: Column, negative: Column) -> Column:
    """A model's label by the direction, positive less negative."""
    d = positive - negative
    return F.when(d >= 0.25, "bullish").when(d <= -0.25, "bearish").otherwise("neutral")


#: Spellings of bands that a classifier may give.
BAND_NAMES = {"very low": "very_low", "low": "low", "med": "medium", "medium": "medium", "moderate": "medium", "high": "high", "very high": "very_high"}


def prompt(role: Column, section: Column, text: Column) -> Column:
    """What a classifier reads of a block."""
    known = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("[ROLE="), known(role), F.lit("] [SECTION="), known(section), F.lit("] "), F.trim(text))


def predict_bands(blocks: DataFrame, metric: str, classify: Callable[[list[str]], tuple[list[str], np.ndarray]], batch: int = 8) -> DataFrame:
    """doc_id, order_index, metric, band, score, predicted_confidence, probabilities of blocks (doc_id, order_index, prompt).

    ``classify`` maps texts to (labels, probabilities by row). The most probable label counts, the first among equals; a label's spelling is
    brought to a band's, and a label that is none gives no row. Batches hold prompts of like lengths; a prompt on which the model fails even
    alone gives a row whose band, score, confidence and probabilities are null, the others of its batch keep theirs.
    """

    def answers(prompts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        labels, p = classify(prompts)
        return [(labels, row) for row in p]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, o, got in zip(b["doc_id"], b["order_index"], by_size(answers, b["prompt"].fillna("").tolist(), batch), strict=True):
                if got is None:
                    rows.append((d, o, metric, None, None, None, None))
                    continue
                labels, row = got
                names = [BAND_NAMES.get(x.lower().replace("_", " ").strip()) for x in labels]
                best = int(np.argmax(row))
                if names[best]:
                    rows.append((d, o, metric, names[best], S.BANDS[names[best]], float(row[best]), {n: float(x) for n, x in zip(names, row, strict=True) if n}))
            yield pd.DataFrame(rows, columns=["doc_id", "order_index", "metric", "band", "score", "predicted_confidence", "probabilities"])

    return blocks.select("doc_id", "order_index", "prompt").mapInPandas(run, "doc_id bigint, order_index bigint, metric string, band string, score double, predicted_confidence double, probabilities map<string,double>")
