"""Language identification by hierarchical discrimination.

A text's hashed character n-grams give a fixed-length vector. A linear support vector machine for each
family says to which family the text belongs; inside the family, one machine for each pair of
its languages votes (one versus one), so close languages are told apart by what separates just them.
Machines are fitted on a bounded sample of labelled texts and sent to the tasks; each text is
classified whole, where it lies.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type

DIM = 1 << 12
#: Labelled texts per language that machines are fitted on, at most.
SAMPLE_PER_LANG = 400
#: Families of common languages; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
}
FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs.split()}
def has_letter(text: str) -> bool:
    """Whether any character is of the Unicode categories L; digits, fractions, marks and symbols are not."""
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """L2-normed log counts of hashed n-grams of 1 to 4 letters; other characters are one blank."""
    codes = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    counts = np.zeros(DIM, np.float64)
    gram = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            if len(codes) < n:
                break
            gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            mixed = (gram ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((mixed >> np.uint64(64 - 12)).astype(np.int64), minlength=DIM)
    out = np.log1p(counts)
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, *, c: float = 10.0, epochs: int = 20) -> np.ndarray:
    """Weights and bias of a linear SVM (dual coordinate descent on the squared hinge), y in -1, 1; both classes weigh alike."""
    xb = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    cost = np.where(y > 0, c * len(y) / (2 * max((y > 0).sum(), 1)), c * len(y) / (2 * max((y < 0).sum(), 1)))
    alpha, w = np.zeros(len(y)), np.zeros(xb.shape[1])
    diagonal = (xb * xb).sum(1) + 1 / (2 * cost)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            g = y[i] * (xb[i] @ w) - 1 + alpha[i] / (2 * cost[i])
            new = max(0.0, alpha[i] - g / diagonal[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * xb[i]
                alpha[i] = new
    return w.astype(np.float32)


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_w: np.ndarray | None = None
    pair_w: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of each row: the family's and the language's share of softmax margins, multiplied."""
        xb = np.hstack([x, np.ones((len(x), 1), np.float32)])
        soft = lambda m: np.exp(4 * (m - m.max(1, keepdims=True)))
        if len(self.families) > 1:
            p = soft(xb @ self.family_w.T)
            p /= p.sum(1, keepdims=True)
        else:
            p = np.ones((len(x), 1))
        best = p.argmax(1)
        out: list[tuple[str, float]] = [("", 0.0)] * len(x)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            langs = self.members[name]
            pairs = list(combinations(range(len(langs)), 2))
            votes = np.zeros((len(rows), len(langs)))
            if pairs and len(rows):
                margins = 1 / (1 + np.exp(-4 * (xb[rows] @ self.pair_w[name].T)))
                for k, (a, b) in enumerate(pairs):
                    votes[:, a] += margins[:, k]
                    votes[:, b] += 1 - margins[:, k]
                votes /= len(langs) - 1
            else:
                votes += 1
            for r, v in zip(rows, votes, strict=True):
                at = int(v.argmax())
                out[r] = (langs[at], float(min(1.0, p[r, f] * v[at])))
        return out


def fit(x: np.ndarray, langs: list[str], families: dict[str, str] | None = None) -> Model:
    """A model of the languages in ``langs``; ``families`` maps languages to family names."""
    family = FAMILY if families is None else families
    model = Model()
    members = defaultdict(list)
    for lang in sorted(set(langs)):
        members[family.get(lang.lower()[:2] if families is None else lang, f"only {lang}")].append(lang)
    model.members, model.families = dict(members), sorted(members)
    y = np.array(langs)
    of = np.array([next(f for f, m in members.items() if lang in m) for lang in langs])
    if len(model.families) > 1:
        model.family_w = np.stack([fit_svm(x, np.where(of == f, 1.0, -1.0)) for f in model.families])
    for name, group in members.items():
        rows = [fit_svm(x[(y == a) | (y == b)], np.where(y[(y == a) | (y == b)] == a, 1.0, -1.0)) for a, b in combinations(group, 2)]
        if rows:
            model.pair_w[name] = np.stack(rows)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(rows, pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG, max_langs: int = 200, families: dict[str, str] | None = None) -> Model:
    """Fits on at most ``per_lang`` whole texts of each non-null language, the least by hash of the text.

    Rows are thinned by hash before they are ranked, so that no task ranks a whole language. What the
    driver gets is per_lang * languages vectors of DIM numbers. More than ``max_langs`` languages are refused.
    Texts without a letter teach nothing.
    """
    t = F.col(text).cast("string")
    rows = docs.select(F.col(lang).cast("string").alias("lang"), t.alias("text"), F.xxhash64(t).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct("h").alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return Model()
    # the share of each language that holds per_lang texts with room to spare, copies left out
    share = {k: min(1.0, (2 * per_lang + 50) / n) for k, n in counts.items()}
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    thin = rows.where(F.col("h") / 2.0**64 + 0.5 <= limit[F.col("lang")])
    least = thin.dropDuplicates(["lang", "h"])
    ranked = least.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY h) AS n").where(F.col("n") <= per_lang).select("lang", "text")
    got = ranked.mapInArrow(_features, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return fit(np.stack([np.frombuffer(r["x"], np.float32) for r in got]), [r["lang"] for r in got], families)


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every whole text.

    Null, empty and letterless texts, and all texts if the model has learned nothing, are ``und`` with
    score 0. Rows are independent: repeated rows get equal results; other columns are ignored; a very long text is one vector like any other;
    an empty table gives an empty result; ids may be text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages squared times DIM at most

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            out = [("und", 0.0)] * b.num_rows
            texts = b.column("text")
            for lo in range(0, b.num_rows, 256):
                at = [(i, t) for i in range(lo, min(lo + 256, b.num_rows)) if (t := texts[i].as_py()) and m.families and has_letter(t)]
                if at:
                    for (i, _), got in zip(at, m.predict(np.stack([features(t) for _, t in at])), strict=True):
                        out[i] = got
            langs, scores = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = id_type(docs, doc_id)
    rows = docs.select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
