"""Scores of text blocks and companies as column expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, phrase, sentences

MAX_HITS = 3
#: The score that each band stands for, in order.
BANDS = {"very_low": 10.0, "low": 30.0, "medium": 50.0, "high": 70.0, "very_high": 90.0}


def clamp(value: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def known(value: Column, low: float, high: float) -> Column:
    """``clamp`` for a value that is never null: the value stands in the expression once."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def hits_sql(column: str, term: str) -> str:
    """Occurrences of a term in a column, MAX_HITS at most and none for null, as SQL: one parse is far cheaper than hundreds of column calls."""
    return f'least(coalesce(regexp_count(lower({column}), r"{phrase(term)}"), 0), {MAX_HITS})'


def density_sql(column: str, terms: Mapping[str, float]) -> str:
    used = {t: float(w) for t, w in terms.items() if w > 0}
    if not used:
        return "0D"
    total = sum(used.values()) * MAX_HITS
    hits = " + ".join(f"{w!r}D * {hits_sql(column, t)}" for t, w in used.items())
    return f"coalesce(greatest(0D, least(1D, ({hits}) / {total!r}D)), 0D)"


def term_hits(column: str, term: str) -> Column:
    return F.expr(hits_sql(column, term))


def density(column: str, terms: Mapping[str, float]) -> Column:
    """Weighted hits (three per term count) over the most possible, 0 to 1; 0 for null."""
    return F.expr(density_sql(column, terms))


def matched_terms(column: str, terms: Mapping[str, float], most: int = 8) -> Column:
    found = ", ".join(f'CASE WHEN {hits_sql(column, t)} > 0 THEN r"{t}" END' for t, w in terms.items() if w > 0)
    return F.expr(f"slice(array_compact(array({found})), 1, {most})")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_words(term: str) -> bool:
    """Whether a term's occurrences are runs of whole pieces that never overlap: it begins and ends in ASCII letters or digits and no head of it is its tail."""
    parts = re.findall(r"\w+|\W+", term)
    return term.isascii() and bool(re.fullmatch(r"\w(?:.*\w)?", term, re.S)) and not any(parts[:k] == parts[-k:] for k in range(1, len(parts)))


def term_counts(column: str, *lexicons: Mapping[str, float]) -> Column:
    """map<term, hits>: the terms of all lexicons that occur in a text, with their hits, MAX_HITS at most; empty for null.

    The text is cut once into words and what stands between them. Where a word begins a term, the runs of pieces from there, as
    long as terms are, are looked up in the set of all terms; so the work does not grow with the number of terms. Terms that begin or end in
    other characters, or that can overlap themselves, are counted by ``hits_sql``.
    """
    terms = dict.fromkeys(t.lower() for lexicon in lexicons for t, w in lexicon.items() if w > 0)
    looked, others = [t for t in terms if _by_words(t)], [t for t in terms if not _by_words(t)]
    entries = []
    if looked:
        pieces = [re.findall(r"\w+|\W+", t) for t in looked]
        firsts, known_ = ", ".join(map(_quoted, dict.fromkeys(x[0] for x in pieces))), ", ".join(map(_quoted, looked))
        widest = max(len(x) for x in pieces) // 2
        entries.append(
            rf"""transform(array(coalesce(regexp_extract_all(lower({column}), r"(?U)\w+|\W+", 0), array())), p ->
            transform(array(flatten(transform(filter(transform(p, (x, i) -> if(x IN ({firsts}), i + 1, 0)), i -> i > 0), i ->
              filter(transform(sequence(0, least({widest}, (size(p) - i) div 2)), k -> array_join(slice(p, i, 2 * CAST(k AS INT) + 1), '')), g -> g IN ({known_}))))), found ->
            transform(array_distinct(found), t -> struct(t AS term, least(size(filter(found, g -> g = t)), {MAX_HITS}) AS hits)))[0])[0]"""
        )
    if others:
        entries.append("filter(array(" + ", ".join(f"struct({_quoted(t)} AS term, {hits_sql(column, t)} AS hits)" for t in others) + "), e -> e.hits > 0)")
    return F.expr(f"map_from_entries(concat({', '.join(entries)}))" if entries else "CAST(map() AS map<string, int>)")


def _listed(terms: Mapping[str, float]) -> str:
    return "array(" + ", ".join(f"struct({_quoted(t.lower())} AS t, {float(w)!r}D AS w)" for t, w in terms.items() if w > 0) + ")"


def _counted_sql(hits: str, terms: Mapping[str, float]) -> str:
    total = sum(float(w) for w in terms.values() if w > 0) * MAX_HITS
    return f"greatest(0D, least(1D, aggregate({_listed(terms)}, 0D, (a, x) -> a + x.w * coalesce(try_element_at({hits}, x.t), 0)) / {total!r}D))" if total > 0 else "0D"


def counted_density(hits: str, terms: Mapping[str, float]) -> Column:
    """``density`` from a column of ``term_counts``."""
    return F.expr(_counted_sql(hits, terms))


def counted_topic(hits: str, topics: Mapping[str, Mapping[str, float]], least: float = 0.03) -> Column:
    """``topic`` from a column of ``term_counts``."""
    return F.expr(_topic_sql({name: _counted_sql(hits, t) for name, t in topics.items()}, least))


def counted_terms(hits: str, terms: Mapping[str, float], most: int = 8) -> Column:
    """array<string>: a lexicon's terms in a column of ``term_counts``, in the lexicon's order, ``most`` of them."""
    return F.expr(f"slice(transform(filter({_listed(terms)}, x -> map_contains_key({hits}, x.t)), x -> x.t), 1, {most})" if any(w > 0 for w in terms.values()) else "CAST(array() AS array<string>)")


def _topic_sql(densities: Mapping[str, str], least: float) -> str:
    scored = ", ".join(f"struct({d} AS density, -{k} AS k, '{name}' AS topic)" for k, (name, d) in enumerate(densities.items()))
    return f"transform(array(array_max(array({scored}))), b -> struct(if(b.density < {least!r}D, 'general', b.topic) AS topic, b.density AS density))[0]"


def topic(column: str, topics: Mapping[str, Mapping[str, float]], least: float = 0.03) -> Column:
    """struct<topic, density>: the densest topic, the earlier one among equals; "general" below ``least``."""
    return F.expr(_topic_sql({name: density_sql(column, t) for name, t in topics.items()}, least))


def numeric_density(text: Column) -> Column:
    """Share of sentences that hold a digit."""
    share = lambda s: F.coalesce(F.try_divide(F.size(F.filter(s, lambda x: x.rlike(r"\d"))).cast("double"), F.size(s)), F.lit(0.0))
    return F.get(F.transform(F.array(sentences(text)), share), F.lit(0))  # a text is cut once


def net(positive: Column, counter: Column, weight: float) -> Column:
    return known(positive - weight * counter, 0, 1)


def bounded_percent(value: Column, smoothing: float) -> Column:
    """100 * (0.5 + 0.5 * tanh(value * curve)) for a value from 0 to 1."""
    return known((F.tanh(value * (1.9 + max(0.0, min(1.0, smoothing)) * 2.6)) * 0.5 + 0.5) * 100, 0, 100)


def block_scores(d: Mapping[str, Column], numeric: Column, *, counter_weight: float = 0.65, smoothing: float = 0.35) -> dict[str, Column]:
    """The five scores of a block (0 to 100) from its nine densities and its numeric density, none of them null."""
    n = known(numeric * 0.65 + d["specificity"] * 0.35, 0, 1)
    cw = max(0.0, counter_weight)
    part = lambda x: bounded_percent(x, smoothing)
    outlook = part(net(d["forward"], d["forward_counter"], cw))
    conf = part(net(d["confidence"] + d["specificity"] * 0.25 + d["forward"] * 0.15, d["confidence_counter"] + d["hedge"] * 0.35 + d["risk"] * 0.2, cw))
    spec = part(net(d["specificity"] + n * 0.25, d["specificity_counter"], cw))
    evas = part(net(d["hedge"] + d["risk"] * 0.25, d["directness"] + d["specificity"] * 0.15, cw))
    risk = part(net(d["risk"], d["directness"] * 0.3, max(0.25, cw * 0.45)))
    return {
        "confidence": known(F.lit(14.0) + conf * 0.68 + spec * 0.14 + n * 14 - evas * 0.10, 0, 100),
        "evasiveness": known(F.lit(10.0) + evas * 0.72 + (F.lit(1.0) - n) * 14 + risk * 0.08 - spec * 0.10, 0, 100),
        "specificity": known(F.lit(14.0) + spec * 0.72 + n * 18 - evas * 0.12, 0, 100),
        "outlook": known(F.lit(12.0) + outlook * 0.78 - evas * 0.10, 0, 100),
        "risk": known(F.lit(10.0) + risk * 0.80 + evas * 0.08, 0, 100),
    }


def blended(lexical: Mapping[str, Column], model: Mapping[str, Column], confidence: Column, weight: float) -> dict[str, Column]:
    """Densities moved towards a model's by weight times its confidence; without a model's row they stay."""
    towards = {
        "forward": "forward", "forward_counter": "risk", "risk": "risk", "hedge": "hedge", "specificity": "specificity", "confidence": "specificity",
        "confidence_counter": "hedge", "specificity_counter": "hedge", "directness": "specificity",
    }
    w = F.coalesce(confidence, F.lit(0.0)) * weight
    return {k: F.coalesce(c * (F.lit(1.0) - w) + model[towards[k]] * w, c) for k, c in lexical.items()}


def nearest_band(score: Column, labels: tuple[str, ...] = tuple(BANDS)) -> Column:
    """The label whose score is nearest; the earlier one on a tie."""
    options = F.array(*[F.struct(F.abs(F.lit(BANDS[b]) - score).alias("off"), F.lit(k).alias("k"), F.lit(b).alias("band")) for k, b in enumerate(labels)])
    return F.array_min(options)["band"]


def band_score(band: Column) -> Column:
    return reduce(lambda c, b: c.when(F.lower(F.trim(band)) == b[0], F.lit(b[1])), list(BANDS.items())[1:], F.when(F.lower(F.trim(band)) == "very_low", F.lit(BANDS["very_low"])))


#: Short administrative remarks.
ADMIN = r"(?i)(?:next question|please go ahead|line is open|operator|moderator|opening remarks|closing remarks)"


def guard_reason(text: Column) -> Column:
    """Why a block is not given to a model; null if it may be."""
    c = compact(F.coalesce(text, F.lit("")))
    return (
        F.when(c == "", F.lit("missing_text"))
        .when(F.length(c) < 24, F.lit("text_too_short"))
        .when(F.size(F.split(c, " ")) < 6, F.lit("too_few_tokens"))
        .when((F.length(c) < 180) & c.rlike(ADMIN), F.lit("short_admin_or_operator_like"))
    )


def stance(score: Column) -> Column:
    return F.when(score >= 0.12, "bullish").when(score <= -0.12, "bearish").otherwise("mixed")


def sentiment_label(score: Column) -> Column:
    return (
        F.when(score >= 0.5, "strongly_bullish").when(score >= 0.15, "cautiously_bullish").when(score <= -0.5, "strongly_bearish").when(score <= -0.15, "cautiously_bearish").otherwise("mixed")
    )


def severity(percent: Column) -> Column:
    return F.when(percent >= 25, "high").when(percent >= 12, "medium").otherwise("low")


def growth_percent(new: Column, old: Column) -> Column:
    """Change in percent of the old value's size; null if either is missing or the old one is 0."""
    return F.when(old != 0, (new - old) / F.abs(old) * 100)


def growth_signal(revenue: Column, eps: Column) -> Column:
    zero = F.lit(0.0)
    return clamp((F.coalesce(revenue, zero) * 0.55 + F.coalesce(eps, zero) * 0.45) / 50, -1, 1)


def analyst_signal(recommendation_mean: Column, upside: Column) -> Column:
    rec, up = clamp((F.lit(3.0) - recommendation_mean) / 2, -1, 1), clamp(upside / 30, -1, 1)
    return F.coalesce(clamp(rec * 0.65 + up * 0.35, -1, 1), rec, up)


def fundamentals_signal(growth: Column, analyst: Column) -> Column:
    return F.coalesce(clamp(growth * 0.8 + analyst * 0.2, -1, 1), clamp(growth, -1, 1))


#: Calibrated weight, mean and deviation of each management mean, and the intercept.
CALIBRATION = {
    "sentiment": (-0.1401634692187762, 0.21078121062965025, 0.19059907568499407),
    "confidence": (-0.018278288860921532, 66.75376972941926, 2.6604270552701204),
    "directness": (0.015206414272671791, 66.07434537052912, 3.489541394240505),
    "outlook": (-0.11552397904346766, 43.44859716002433, 3.6659477149803137),
    "specificity": (-0.08887882362418172, 55.778186220330234, 5.680196748327937),
    "risk": (-0.0394870057888973, 58.85238912055554, 2.562695988859408),
}
INTERCEPT = -0.019738131823252437


def transcript_probability(means: Mapping[str, Column], calibration: Mapping[str, tuple[float, float, float]] = CALIBRATION, intercept: float = INTERCEPT) -> Column:
    linear = F.lit(intercept)
    for name, (weight, mean, deviation) in calibration.items():
        linear = linear + F.lit(weight) * ((means[name] - F.lit(mean)) / F.lit(deviation if math.isfinite(deviation) and deviation > 0 else 1.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clamp(linear, -35, 35)))


#: Default shares of the overall score, in percent.
WEIGHTS = {"transcript": 40.0, "fundamentals": 35.0, "news": 15.0, "social": 10.0}


def shares(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights over their sum; invalid ones count 0, and if nothing is left the defaults hold."""
    clean = {k: float(w) if math.isfinite(w := weights.get(k, 0.0)) and w >= 0 else 0.0 for k in WEIGHTS}
    total = sum(clean.values())
    return {k: v / total for k, v in clean.items()} if total > 0 else shares(WEIGHTS)


def overall(signals: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted sum; a missing signal counts as 0."""
    w = shares(weights)
    return clamp(reduce(lambda a, b: a + b, [F.lit(w[k]) * F.coalesce(signals[k], F.lit(0.0)) for k in w]), -1, 1)


def feed_confidence(kind: str, items: Column) -> Column:
    """How far a feed's signal is trusted, by how much it holds."""
    base, step = {"fundamentals": (42.0, 12.0), "news": (30.0, 4.0), "social": (30.0, 4.0)}[kind]
    return known(F.lit(base) + F.coalesce(items, F.lit(0)) * step, 0, 100)


def composite(signals: Mapping[str, Column], weights: Mapping[str, float]) -> dict[str, Column]:
    """The weighted sum without a clamp, evidence for buying and selling, and conviction, all but the first 0 to 100."""
    w = shares(weights)
    c = reduce(lambda a, b: a + b, [F.lit(w[k]) * F.coalesce(signals[k], F.lit(0.0)) for k in w])
    return {"composite": c, "buy": known(c * 35 + 50, 0, 100), "sell": known(c * -35 + 50, 0, 100), "conviction": known(F.abs(c) * 100, 0, 100)}


def recency(at: Column, as_of: Column, days: int) -> Column:
    """1 at ``as_of`` down to 0 at ``days`` before it; 0.35 for an unknown time."""
    age = F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", at, as_of) / F.lit(86400e6))
    return F.when(at.isNull(), 0.35).when(age >= days, 0.0).otherwise(F.round(F.lit(1.0) - age / float(max(days, 1)), 4))
