"""Language mixtures by expectation-maximisation over n-gram likelihoods.

Training sums hashed byte-trigram counts for each language over all labelled texts. A document is seen
as a mixture: every trigram comes from one of the languages, with the document's own proportions.
Expectation-maximisation estimates them, until no proportions can be likelier by more than a trifle; which languages take part is chosen by the
likelihood less a penalty for each language (Schwarz's, times ``penalty``), among the nested sets that the full mixture ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import schema_with, small_batches
from factorloom.llm.features import ngram_counts

BITS = 12
#: languages that are learnt, those with most rows: their tables, 2**12 numbers each, are collected and broadcast
MOST_LANGUAGES = 1_000
#: log likelihood that the best proportions may have over those found, and steps after which a row is left as it is
GAP, MOST_ROUNDS = 1e-4, 5_000


class Languages(dict[str, np.ndarray]):
    """Language to log probabilities of the trigram buckets, in order of names; ``prior`` is each one's share of the rows learnt from."""

    def __init__(self, tables: dict[str, np.ndarray], prior: dict[str, float] | None = None) -> None:
        super().__init__(sorted(tables.items()))
        self.prior = np.array([prior[x] if prior else 1 / len(tables) for x in self])


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; digits, fractions and letter-like numbers are none."""
    return any(map(str.isalpha, text or ""))


def trigrams(text: str | None) -> np.ndarray:
    return ngram_counts(np.frombuffer((text or "").lower().encode(), np.uint8).astype(np.uint64), 3, BITS)


def fit_languages(df: DataFrame, learn, lang_col: str = "lang", text_col: str = "text") -> Languages:
    """The languages of every row that ``learn`` (a condition) admits.

    Each task adds up its share, so what is shuffled and collected is languages x 2**12 numbers at most
    per task, whatever the number of rows. Rows with a null language are not learnt from. Of more than
    ``MOST_LANGUAGES`` languages those with most rows (ties: that sort first) are learnt.
    """
    small_batches(df.sparkSession)
    labelled = df.where(F.col(lang_col).isNotNull() & learn)
    rows_of = {r[0]: r["count"] for r in labelled.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MOST_LANGUAGES).collect()}
    known = list(rows_of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        kept = set(known)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang in kept:
                    sums.setdefault(lang, np.zeros(1 << BITS))
                    sums[lang] += trigrams(text)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    rows = labelled.select(lang_col, text_col).mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = {lang: np.full(1 << BITS, 0.5) for lang in known}
    for r in rows.collect():
        sums[r["lang"]][r["bucket"]] += r["n"]
    every = max(1, sum(rows_of.values()))
    return Languages({lang: np.log(n / n.sum()) for lang, n in sums.items()}, {lang: n / every for lang, n in rows_of.items()})


def _em(counts: np.ndarray, prob: np.ndarray, start: np.ndarray, enough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (rows x languages), log likelihoods, and bounds that no proportions over the languages of ``start`` exceed.

    Languages that start at 0 stay out. With g a language's mean of its likelihood over the mixture's, log likelihoods are at most
    the one at hand and n log max g, as Jensen's inequality gives; a row ends when that is within ``GAP``, or when its bound is not
    over ``enough``, so that nothing better can come of it.
    """
    total = np.maximum(counts.sum(1), 1)
    share, fit, bound = start.copy(), np.zeros(len(counts)), np.zeros(len(counts))
    at = np.arange(len(counts))
    within = start > 0
    for _ in range(MOST_ROUNDS):
        mix = share[at] @ prob + 1e-300
        c = counts[at]
        gain = np.where(within[at], (c / mix) @ prob.T / total[at, None], 0)
        fit[at] = (c * np.log(mix)).sum(1)
        bound[at] = fit[at] + total[at] * np.log(np.maximum(gain.max(1), 1))
        over = bound[at] - fit[at] > GAP
        if enough is not None:
            over &= bound[at] > enough[at]
        share[at] = np.where(over[:, None], share[at] * gain, share[at])
        at = at[over]
        if not len(at):
            break
    return share / np.maximum(share.sum(1, keepdims=True), 1e-300), fit, bound


def mixtures(counts: np.ndarray, log_prob: np.ndarray, penalty: float = 4.0, prior: np.ndarray | None = None) -> np.ndarray:
    """Each row's proportions over the chosen languages; rows sum to 1. ``prior`` decides between single languages where the text doesn't."""
    k = len(log_prob)
    counts, prob = counts.astype(float), np.exp(log_prob)
    cost = penalty * 0.5 * np.log(np.maximum(counts.sum(1), 2))
    single = counts @ log_prob.T
    first = (single + (np.log(np.maximum(prior, 1e-300)) if prior is not None else 0)).argmax(1)
    chosen = np.eye(k)[first]
    value = single.max(1) - cost
    # a set of several languages costs one more penalty at least and can't fit better than the best mixture of all
    full, _, bound = _em(counts, prob, np.full((len(counts), k), 1 / k), value + 2 * cost)
    open_ = np.flatnonzero(bound - 2 * cost > value)
    rank = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, k + 1):
        if not len(open_):
            break
        start = np.zeros((len(open_), k))
        np.put_along_axis(start, rank[open_, :size], np.take_along_axis(full[open_], rank[open_, :size], 1) + 1e-4, 1)
        share, ll, _ = _em(counts[open_], prob, start / start.sum(1, keepdims=True), value[open_] + size * cost[open_])
        better = ll - size * cost[open_] > value[open_]
        at = open_[better]
        chosen[at], value[at] = share[better], (ll - size * cost[open_])[better]
        open_ = open_[bound[open_] - (size + 1) * cost[open_] > value[open_]]
    return chosen


def certainty(counts: np.ndarray, log_prob: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Each row's probabilities of the languages, one of which wrote it all: what a text says of them, and the prior where it says nothing."""
    z = counts.astype(float) @ log_prob.T + np.log(np.maximum(prior, 1e-300))
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def language_ids(df: DataFrame, languages: dict[str, np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and proportions (language to share).

    The score is the language's proportion in a mixture; of a text in one language it is that language's probability, so little text
    scores little: a text of one or two bytes, which has no trigram, gets the language with most rows and its share of them.
    ``und`` with score 0 for texts that are null or have no letter, and for all if no language was learnt.
    Whole texts are used; repeated rows stay; an empty table gives an empty result; ties go to the
    language that sorts first; other columns of ``df`` are not read.
    """
    small_batches(df.sparkSession)
    known = languages if isinstance(languages, Languages) else Languages(languages)
    fitted = df.sparkSession.sparkContext.broadcast((list(known), np.stack(list(known.values())) if known else np.zeros((0, 1 << BITS)), known.prior))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_prob, prior = fitted.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            pred, score, parts = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            at = [i for i, t in enumerate(texts) if names and has_letter(t)]
            if at:
                counts = np.stack([trigrams(texts[i]) for i in at])
                share, sure = mixtures(counts, log_prob, prior=prior), certainty(counts, log_prob, prior)
                for i, row, one in zip(at, share, sure):
                    j = int(row.argmax())
                    pred[i], score[i] = names[j], min(1.0, float(one[j] if row[j] == 1 else row[j]))
                    parts[i] = [(names[x], float(row[x])) for x in np.flatnonzero(row > 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(parts, pa.map_(pa.string(), pa.float64()))], names=[*batch.schema.names[:-1], "lang_pred", "score", "proportions"])

    schema = schema_with(df, keep, "lang_pred string, score double, proportions map<string,double>")
    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(predict, schema)
