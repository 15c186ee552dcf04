"""Language identification as a mixture: EM finds each document's language proportions from trigram likelihoods.

The log-likelihood of proportions is concave, so EM reaches its maximum. Languages join the chosen set in the order of
their proportions while each raises the likelihood by more than a penalty that grows with the document's length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vivarium.llm.common import crc_mod, filter_rows, map_columns
from vivarium.llm.shingles import U, mix

BUCKETS, SMOOTHING = 1 << 16, 0.1
#: The model is fitted on about so many labelled documents of each language, chosen by a hash of doc_id.
TRAIN_PER_LANGUAGE = 2000
#: A further language must raise the log-likelihood by this times ln(1 + trigrams).
PENALTY = 6.0
ROUNDS, UNKNOWN = 30, "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: the probability of a trigram

    @property
    def logs(self) -> np.ndarray:
        return np.log(self.table)


_letters: np.ndarray | None = None


def _table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams, and where each text's begin: lower-cased letters, anything between them one space."""
    lower = [" " + (t or "").lower() + " " for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in lower])
    letter = _table()[codes]
    kept = letter | np.concatenate(([True], letter[:-1]))
    kept[ends[:-1]] = True  # each text begins with a space
    values = np.where(letter, codes, 32).astype(U)[kept]
    place = np.concatenate(([0], np.cumsum(kept)))
    first = place[np.concatenate(([0], ends))]
    if len(values) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    grams = (mix((values[:-2] << U(42)) | (values[1:-1] << U(21)) | values[2:]) >> U(48)).astype(np.int64)
    inner = np.ones(len(values), bool)  # no trigram runs into the next text
    inner[-2:] = False
    for k in (1, 2):
        inner[np.maximum(first[1:] - k, 0)] = False
    counts = np.concatenate(([0], np.cumsum(inner)))
    return grams[inner[:-2]], counts[first]


def _counted(texts: list, langs: list):
    out: list[list] = [[], [], []]
    grams, first = trigrams(texts)
    for lang in sorted(set(langs)):
        rows = [grams[first[i] : first[i + 1]] for i, x in enumerate(langs) if x == lang]
        n = np.bincount(np.concatenate(rows), minlength=BUCKETS)
        at = np.flatnonzero(n)
        out[0] += [lang] * len(at)
        out[1] += at.tolist()
        out[2] += n[at].tolist()
    yield out


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Fit on documents with text and language whose crc32(doc_id) mod 4 is not 2: about per_language of each."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 4) != 2))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    counts = map_columns(sample.select("text", "lang"), _counted, "lang string, bucket int, n long", by=0)
    languages = sorted(sizes)
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    for r in counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS a language
        table[r["bucket"], languages.index(r["lang"])] += r["n"]
    return Model(languages, table / table.sum(axis=0))


def proportions(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM for the mixture: p is trigrams x languages, n their counts; the proportions and the log-likelihood."""
    pi = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        new = pi * (p.T @ (n / (p @ pi))) / total
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi, float(n @ np.log(p @ pi))


def mixture(grams: np.ndarray, model: Model, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """The chosen languages of one document, the largest proportion first, and their proportions."""
    at, n = np.unique(grams, return_counts=True)
    p = model.table[at]
    single = n @ np.log(p)
    best = int(np.argmax(single))
    fee = penalty * math.log1p(len(grams))
    if ((n @ (p / p[:, best : best + 1])) <= len(grams)).all():  # no other language can raise the likelihood
        return [best], np.ones(1)
    pi, full = proportions(p, n)
    if full - single[best] <= fee:
        return [best], np.ones(1)
    order = [best, *(int(i) for i in np.argsort(-pi, kind="stable") if i != best)]
    chosen, share, score = [best], np.ones(1), single[best]
    for m in range(2, len(order) + 1):
        own, ll = proportions(p[:, order[:m]], n)
        if ll - score <= fee:
            break
        chosen, share, score = order[:m], own, ll
    by_share = np.argsort(-share, kind="stable")
    return [chosen[i] for i in by_share], share[by_share]


def predict(texts: list[str | None], model: Model) -> list[tuple[str, float, str]]:
    """(language, its proportion, all chosen languages with proportions) for each text."""
    grams, first = trigrams(texts)
    out = []
    for i in range(len(texts)):
        own = grams[first[i] : first[i + 1]]
        if not len(own) or not model.languages:
            out.append((UNKNOWN, 0.0, ""))
            continue
        chosen, share = mixture(own, model)
        out.append((model.languages[chosen[0]], float(min(share[0], 1.0)), ",".join(f"{model.languages[c]}:{s:.3f}" for c, s in zip(chosen, share))))
    return out


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, languages.

    lang_pred is the language of the largest proportion and score that proportion. A null text, one without a letter,
    and every text when nothing could be learned: 'und', 0 and ''. held_out: crc32(doc_id) mod 4 is 2 (false for a null
    id). Ties go to the first language in alphabetical order; repeated rows get equal results; texts of any length are
    used whole.
    """
    model = train(docs) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids: list, held: list, texts: list):
        got = predict(texts, sent.value)
        yield [ids, held, [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]]

    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return map_columns(docs.select("doc_id", held, "text"), run, "doc_id long, held_out boolean, lang_pred string, score double, languages string", by=2)


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs, all columns (whatever their names), without those whose language is 'und': null and empty texts, and texts without a letter.

    Very long texts are judged whole, repeated rows share their fate, null ids are no matter; an empty table stays empty.
    Where no document has a language to learn from, every language is 'und' and none is left.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    return filter_rows(docs, "text", lambda texts: [g[0] != UNKNOWN for g in predict(texts, sent.value)])
