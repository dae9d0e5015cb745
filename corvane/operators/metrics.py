"""Metric scores of transcript blocks and their aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.lexicons import METRICS, TOPICS
from ..functions.text import compact, fixed, quote_key, sentences, word_count

METRIC_COLUMNS = ("confidence", "evasiveness", "specificity", "outlook", "risk")


def scorable(blocks: DataFrame) -> DataFrame:
    """Without blank blocks and short remarks that name the operator."""
    text = F.coalesce("text", F.lit(""))
    # words are counted of texts that name the operator only
    return blocks.where(text.rlike(r"(?U)\S") & ~(F.contains(F.lower(text), F.lit("operator")) & (word_count(text) < 7)))


def block_metrics(
    blocks: DataFrame, lexicons: Mapping[str, Mapping[str, float]] = METRICS, topics: Mapping[str, Mapping[str, float]] = TOPICS, *, counter_weight: float = 0.65, smoothing: float = 0.35
) -> DataFrame:
    """Blocks with nine densities (d_*), numeric density, topic, five scores and a lexical direction.

    Narrow projections: no shuffle, all in the JVM. The terms of all lexicons and topics are counted in one pass over a text. The direction
    stands in for a sentiment model: positive terms less negative ones, -1 to 1.
    """
    counted = scorable(blocks).withColumn("__hits", S.term_counts("text", *lexicons.values(), *topics.values()))
    dense = {f"d_{name}": S.counted_density("__hits", terms) for name, terms in lexicons.items()}
    out = counted.withColumns(dense | {"numeric_density": S.numeric_density(F.col("text")), "best": S.counted_topic("__hits", topics)}).drop("__hits")
    d = {name: F.col(f"d_{name}") for name in lexicons}
    scores = S.block_scores(d, F.col("numeric_density"), counter_weight=counter_weight, smoothing=smoothing)
    direction = S.known((d["confidence"] + d["forward"] - d["hedge"] - d["risk"]) * 2, -1, 1)
    return out.withColumns(scores | {"topic": F.col("best.topic"), "topic_density": F.col("best.density"), "direction": direction}).drop("best")


def matched_terms(blocks: DataFrame, lexicons: Mapping[str, Mapping[str, float]] = METRICS, most: int = 8) -> DataFrame:
    """doc_id, order_index, lexicon, terms: which terms of each lexicon a block holds, in the lexicon's order, ``most`` of them; no row where it holds none."""
    counted = scorable(blocks).select("doc_id", "order_index", S.term_counts("text", *lexicons.values()).alias("hits")).where(F.size("hits") > 0)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("lexicon"), S.counted_terms("hits", terms, most).alias("terms")) for name, terms in lexicons.items()]))
    return counted.select("doc_id", "order_index", each.alias("m")).select("doc_id", "order_index", "m.*").where(F.size("terms") > 0)


def role_of(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin("operator", "moderator", "host"), "operator").when(low.isin("analyst", "research"), "analyst").when(low.isin("management", "executive"), "management").otherwise(low)


def without_operator(rows: DataFrame) -> DataFrame:
    name = F.lower(F.trim(F.coalesce("speaker", F.lit(""))))
    return rows.where((role_of(F.col("speaker_role")) != "operator") & ~name.rlike(r"^(operator|moderator)( |$)"))


def management_only(rows: DataFrame) -> DataFrame:
    return rows.where(role_of(F.col("speaker_role")) == "management")


def speaker_rollup(metrics: DataFrame, keys: tuple[str, ...] = ("speaker",)) -> DataFrame:
    """Per speaker: mentions, mean direction, confidence and evasiveness, and the commonest topic (first by name on a tie)."""
    rows = without_operator(metrics)
    by_topic = rows.groupBy(*keys, "topic").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("direction", "confidence", "evasiveness")])
    return by_topic.groupBy(*keys).agg(
        F.sum("n").alias("mention_count"),
        *[(F.sum(c) / F.sum("n")).alias(f"avg_{c}") for c in ("direction", "confidence", "evasiveness")],
        F.min_by("topic", F.struct(-F.col("n"), "topic")).alias("dominant_topic"),
    )


def management_means(metrics: DataFrame, keys: tuple[str, ...] = ("doc_id",), *, outlook_default: float = 50.0) -> DataFrame:
    """Means over management's blocks per key, with defaults for keys that have none."""
    rows = metrics.withColumn("m", role_of(F.col("speaker_role")) == "management")
    mean = lambda c, d: F.coalesce(F.avg(F.when(F.col("m"), F.col(c))), F.lit(d))
    return rows.groupBy(*keys).agg(
        F.count_if("m").alias("n"), mean("direction", 0.0).alias("direction"), mean("confidence", 45.0).alias("confidence"), mean("evasiveness", 40.0).alias("evasiveness"),
        mean("outlook", outlook_default).alias("outlook"), mean("specificity", 50.0).alias("specificity"), mean("risk", 50.0).alias("risk"),
    )


def section_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.count_if(F.col("section_type") == "prepared_remarks").alias("prepared"), F.count_if(F.col("section_type") == "qa").alias("qa"))


def select_metric(metrics: DataFrame, predictions: DataFrame, metric: str = "confidence", *, min_confidence: float = 0.6, blend: float = 0.5) -> DataFrame:
    """Which score counts for a block: the model's, the lexicon's or a blend, and why.

    In order: a guarded block keeps the lexicon's; so does one without a prediction; an unsure
    prediction is blended; any other is taken.
    """
    p = predictions.where(F.col("metric") == metric).select("doc_id", "order_index", F.col("score").alias("p_score"), F.col("band").alias("p_band"), F.col("predicted_confidence").alias("p_conf"))
    rows = metrics.join(p, ["doc_id", "order_index"], "left").withColumn("guard", S.guard_reason(F.col("text")))
    lex = F.col(metric)
    source = F.when(F.col("guard").isNotNull(), "guard_fallback").when(F.col("p_score").isNull(), "missing_fallback").when(F.col("p_conf") < min_confidence, "blend").otherwise("model")
    value = F.when(F.col("source") == "model", F.col("p_score")).when(F.col("source") == "blend", F.col("p_score") * blend + lex * (1 - blend)).otherwise(lex)
    return rows.withColumn("source", source).withColumn("value", value).withColumn("band", F.when(F.col("source") == "model", F.col("p_band")).otherwise(S.nearest_band(F.col("value"))))


#: The metrics a classifier gives, the score each stands beside, and the bands it knows.
THREE, FIVE = ("low", "medium", "high"), tuple(S.BANDS)
MODEL_METRICS = {"confidence": ("confidence", THREE), "directness": (None, THREE), "outlook_strength": ("outlook", FIVE), "specificity": ("specificity", FIVE), "risk_intensity": ("risk", FIVE)}


def resolve_metrics(
    metrics: DataFrame, predictions: DataFrame, *, primary: tuple[str, ...] = ("confidence", "directness"), forced: tuple[str, ...] = (), blended: tuple[str, ...] = (), blend: float = 0.35, error: str | None = None
) -> DataFrame:
    """doc_id, order_index, metric, lexical, value, band, source, reason: which score counts for every block and metric.

    In order: a forced metric, a guarded block, a failed model and a missing prediction keep the lexicon's score (a fallback, where
    the model is primary); then the prediction is blended in, or taken if the model is primary. Directness is lexically 100 less
    evasiveness; evasiveness is 100 less a directness that came from the model, and its own score otherwise.
    """
    lexical = {name: F.lit(100.0) - F.col("evasiveness") if column is None else F.col(column) for name, (column, _) in MODEL_METRICS.items()}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), S.known(c, 0, 100).alias("lexical")) for name, c in lexical.items()]))
    rows = metrics.withColumn("guard", S.guard_reason(F.col("text"))).select("doc_id", "order_index", "guard", "evasiveness", each.alias("x")).select("doc_id", "order_index", "guard", "evasiveness", "x.*")
    p = predictions.select("doc_id", "order_index", "metric", F.col("score").alias("p_score"), F.col("band").alias("p_band"))
    rows = rows.join(p, ["doc_id", "order_index", "metric"], "left")
    m = F.col("metric")
    reason = F.when(m.isin(*forced), "forced_lexical_fallback").when(F.col("guard").isNotNull(), F.col("guard")).when(F.lit(error).isNotNull(), F.lit(error)).when(F.col("p_score").isNull(), "student_prediction_missing")
    rows = rows.withColumn("reason", reason)
    open_ = F.col("reason").isNull()
    mixed = open_ & m.isin(*blended)
    taken = open_ & ~mixed & m.isin(*primary)
    value = F.when(mixed, S.known(F.col("lexical") * (1 - blend) + F.col("p_score") * blend, 0, 100)).when(taken, S.known(F.col("p_score"), 0, 100)).otherwise(F.col("lexical"))
    source = F.when(taken, "student_primary").when(~open_ & m.isin(*primary), "lexical_fallback").otherwise("lexical_primary")
    rows = rows.withColumns({"value": value, "source": source, "taken": taken})
    band = F.when(F.col("taken"), F.col("p_band")).when(m.isin(*[k for k, (_, bands) in MODEL_METRICS.items() if bands == THREE]), S.nearest_band(F.col("value"), THREE)).otherwise(S.nearest_band(F.col("value")))
    out = rows.withColumn("band", band).select("doc_id", "order_index", "metric", "lexical", "value", "band", "source", "reason", "evasiveness")
    direct = out.where("metric = 'directness'")
    evasive = F.when(F.col("source") == "student_primary", F.lit(100.0) - F.col("value")).otherwise(F.col("evasiveness"))
    own = direct.withColumn("value", evasive).select("doc_id", "order_index", F.lit("evasiveness").alias("metric"), F.col("evasiveness").alias("lexical"), "value", S.nearest_band(F.col("value")).alias("band"), "source", "reason", "evasiveness")
    return out.unionByName(own).drop("evasiveness")


def with_model_topic(metrics: DataFrame, features: DataFrame, weight: float, least: float = 0.2) -> DataFrame:
    """``topic`` by the model's (doc_id, order_index, ai_topic, sure), where it names one and weighs enough."""
    out = metrics.join(features.select("doc_id", "order_index", "ai_topic", "sure"), ["doc_id", "order_index"], "left")
    takes = (F.col("ai_topic") != "general") & (F.col("sure") * weight >= least)
    return out.withColumn("topic", F.when(takes, F.col("ai_topic")).otherwise(F.col("topic"))).drop("ai_topic", "sure")


def evidence(best: Column, worst: Column, text: Column, most: int = 2) -> Column:
    """array<string>: the strongest segments for and against and the first sentences, each once, ``most`` of them."""
    said = F.concat(F.array(F.trim(best), F.trim(worst)), F.slice(sentences(text), 1, 2))
    return F.slice(F.array_distinct(F.filter(said, lambda x: x.isNotNull() & (x != ""))), 1, most)


def diagnostics(metrics: DataFrame, counter_weight: float = 0.65, smoothing: float = 0.35) -> DataFrame:
    """doc_id, order_index and a struct of how the scores came about: densities, net densities, settings (the terms: ``matched_terms``)."""
    d = lambda name: F.col(f"d_{name}")
    n = S.known(F.col("numeric_density") * 0.65 + d("specificity") * 0.35, 0, 1)
    net = {
        "outlook": S.net(d("forward"), d("forward_counter"), counter_weight),
        "confidence": S.net(d("confidence") + d("specificity") * 0.25 + d("forward") * 0.15, d("confidence_counter") + d("hedge") * 0.35 + d("risk") * 0.2, counter_weight),
        "specificity": S.net(d("specificity") + n * 0.25, d("specificity_counter"), counter_weight),
        "evasiveness": S.net(d("hedge") + d("risk") * 0.25, d("directness") + d("specificity") * 0.15, counter_weight),
    }
    parts = [F.lit("lexical_weighted").alias("method"), F.round("numeric_density", 4).alias("numeric_density"), F.lit(counter_weight).alias("counter_weight"), F.lit(smoothing).alias("density_smoothing")]
    parts += [F.round(c, 4).alias(f"{k}_net_density") for k, c in net.items()] + [F.round(F.col("topic_density"), 4).alias("topic_score_lex"), F.col("topic").alias("topic_label_lex")]
    return metrics.select("doc_id", "order_index", F.struct(*parts).alias("diagnostics"))


def findings(metrics: DataFrame, keys: tuple[str, ...] = ("doc_id",), k: int = 4) -> DataFrame:
    """Per key: a summary, takeaways and pressure points in words, from management's blocks."""
    m = management_only(metrics)
    tenths = lambda c: fixed(F.col(c), "%.1f")
    lead = F.max_by(F.struct("speaker", "topic"), F.struct(F.col("outlook"), -F.col("doc_id"), -F.col("order_index")))
    one = m.groupBy(*keys).agg(F.avg("confidence").alias("c"), F.avg("evasiveness").alias("e"), lead.alias("lead"))
    w = Window.partitionBy(*keys).orderBy(F.desc("evasiveness"), "doc_id", "order_index")
    worst = m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    said = F.format_string("%s: evasiveness %s in %s.", "speaker", tenths("evasiveness"), "topic")
    points = worst.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", said.alias("said")))), lambda x: x["said"]).alias("pressure_points"))
    text = F.format_string("Management transcript analysis highlights communication quality more than directional score. Confidence averaged %s, while evasiveness averaged %s.", tenths("c"), tenths("e"))
    takeaways = F.array(
        F.format_string("Average management confidence across speaker turns is %s.", tenths("c")), F.format_string("Average evasiveness across speaker turns is %s.", tenths("e")),
        F.format_string("Strongest forward-looking language appears in %s (%s).", "lead.speaker", "lead.topic"),
    )
    return one.join(points, list(keys)).select(*keys, text.alias("summary"), takeaways.alias("takeaways"), "pressure_points")


def merged_quotes(block_quotes: DataFrame, document_quotes: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, rank, quote, score of blocks' (doc_id, quote, score) and documents' quotes (doc_id, quote); the latter score by length alone. Of one wording the block's counts."""
    own = document_quotes.select("doc_id", "quote", (F.lit(22.0) + F.least(F.lit(14.0), F.length("quote") / 10)).alias("score"), F.lit(0).alias("first"))
    both = block_quotes.select("doc_id", "quote", "score", F.lit(1).alias("first")).unionByName(own).where(~low_information(F.col("quote"))).withColumn("key", quote_key(F.col("quote")))
    best = both.groupBy("doc_id", "key").agg(F.max(F.struct("first", "score", F.length("quote").alias("chars"), "quote")).alias("q"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("q.score"), F.desc("q.chars"), "key")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("doc_id", "rank", "q.quote", "q.score")


def pressure_points(metrics: DataFrame, k: int = 4) -> DataFrame:
    """The k most evasive answers of each document."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("evasiveness"), "order_index")
    return management_only(metrics).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Remarks that say nothing.
EMPTY_QUOTES = ("yes", "yeah", "sure", "okay", "ok", "thank you", "thanks", "hi", "hello", "good morning", "good afternoon")


def low_information(text: Column, chars: int = 45) -> Column:
    c = compact(F.coalesce(text, F.lit("")))
    return _says_nothing(c, quote_key(c), chars)


def _says_nothing(text: Column, key: Column, chars: int = 45) -> Column:
    """``low_information`` of a compact text and its key."""
    return (F.length(text) < chars) | key.isin(*EMPTY_QUOTES) | (F.size(F.filter(F.split(key, " "), lambda w: w != "")) < 6)


def key_quotes(metrics: DataFrame, keys: tuple[str, ...] = ("doc_id",), k: int = 10, per_block: int = 2) -> DataFrame:
    """The k best quotes per key: a block's first sentences, each once (where it is said first), by the block's scores and length."""
    # sentences are compact; their keys come with them from the generator, as filters on a projected key would make it again for each use. The
    # outer form cuts a text once (of the inner one Spark asks beforehand whether there is a sentence); a null quote says nothing and goes
    said = F.transform(F.slice(sentences(F.col("text")), 1, per_block), lambda q: F.struct(q.alias("quote"), quote_key(q).alias("key")))
    s = metrics.select(*dict.fromkeys((*keys, "doc_id", "order_index", "direction", *METRIC_COLUMNS)), F.posexplode_outer(said).alias("pos", "q"))
    s = s.where(~_says_nothing(F.col("q.quote"), F.col("q.key"))).select("*", "q.quote", "q.key").drop("q")
    first = s.groupBy(*keys, "key").agg(F.min_by(F.struct("quote", "direction", *METRIC_COLUMNS), F.struct("doc_id", "order_index", "pos")).alias("q"), F.min(F.struct("doc_id", "order_index", "pos")).alias("at"))
    score = (
        F.abs("q.direction") * 34 + F.col("q.confidence") * 0.28 + F.col("q.evasiveness") * 0.24 + F.col("q.specificity") * 0.2 + F.col("q.outlook") * 0.18
        + F.least(F.lit(18.0), F.length("q.quote") / 8)
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc(F.length("quote")), "at")
    rows = first.select(*keys, "at", F.col("q.quote").alias("quote"), score.alias("score"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("at")
