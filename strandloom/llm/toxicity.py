"""Toxicity by non-negative positive-unlabelled learning with a numpy linear classifier.

Training sees confirmed toxic texts (P) and texts without a label (U); labelled clean texts serve only to
estimate the class prior and, with toxic ones that are kept from the first fits, to choose how far to correct it. With logistic loss l, prior p and scores f, the risk is
    p * mean_P l(f) + max(0, mean_U l(-f) - p * mean_P l(-f)),
where the clipped part keeps a flexible model from driving the estimate of the clean class's risk below zero.

Features say whether a word (without punctuation behind it), or a longer word with a beginning of 4 to 8 bytes, occurs
in a text (lower-cased A-Z); so the length of a text doesn't matter. They are hashed to 2 ** BITS; the `features` most telling ones by a G statistic are kept.

The sample is bounded: at most `positives` toxic, `unlabelled` other and `validation` labelled texts, least by hash of doc_id. Its counts
are summed in the cluster, and the driver gets `features` counts and the sample's bits of them. Scoring covers
every text and needs no shuffle.

The labelled shares' prior is multiplied by one of CAUTIONS, since a full prior calls more clean texts toxic: the one with the fewest errors on the
validation texts, a quarter of the labelled ones by hash; the last fit takes their toxic ones into P. Kinds of features, GAIN and the bound of the bias were chosen by
four-fold cross-validation on the rows of one table that may be learnt from, never on rows held out.

Cases: null and empty texts get the score of the bias alone. Without toxic labels all scores are 0 but for rounding. Labels that
are null are ignored, of several for one document the highest counts. If every document is labelled, U is
drawn from all of them, without their labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .text import Words, hash_words, mix, slices, utf8

BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
#: Least log-likelihood gain p * log(p / e) - (p - e) of a feature seen p times in P where e were expected; chance exceeds it about once in exp(GAIN).
GAIN = 6.0
CAUTIONS, MIDDLE = (0.7, 0.8, 0.9, 1.0), 0.85  # and what counts where no texts are left to choose by
U, P, CLEAN, TOXIC = range(4)  # kinds of texts in the sample; the last two for validation


def word_features(words: pa.Array) -> np.ndarray:
    """Of each different word its features, one column for each kind; -1: none."""
    bare = pc.utf8_rtrim(words.cast(pa.large_string()), characters=".,;:!?").cast(pa.large_binary())
    words = pc.if_else(pc.equal(pc.binary_length(bare), 0), words, bare)
    whole = hash_words(words)[0]
    out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
    out[:, 0] = (whole >> np.uint64(64 - BITS)).astype(np.int64)
    length = pc.binary_length(words).to_numpy(zero_copy_only=False)
    for k, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(length > n)
        if len(long):
            begin = pc.binary_slice(words.take(pa.array(long)), 0, n)
            h = hash_words(begin.cast(pa.large_binary()))[0]
            out[long, k] = (mix(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
    return out


def text_features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different (text, feature) pairs of a string column, of the wanted features (a mask) or all."""
    data, offsets = utf8(column)
    words = Words(data, offsets, lower=True)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, different = words.coded()
    features = word_features(different)
    use = features >= 0
    if wanted is not None:
        use &= wanted[features]
    row = words.text
    some = use.any(axis=1)[code]
    code, row = code[some], row[some]
    pairs = np.concatenate([(row[use[code, k]] << BITS) | features[code[use[code, k]], k] for k in range(features.shape[1])])
    pairs = np.unique(pairs)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        wanted, at = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
        wanted[self.features], at[self.features] = True, self.weights
        row, feature = text_features(column, wanted)
        total = np.bincount(row, at[feature], len(column)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit_nnpu(row: np.ndarray, column: np.ndarray, positive: np.ndarray, prior: float, n: int, rounds: int = 500, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias for the bits (row, column) of len(positive) texts; positive: which texts are in P, the rest are U.

    The bias stays at the prior's log-odds or below, so a text without telling features is never toxic.
    Gradient steps on the clipped risk plus decay / 2 * |w|^2; of all steps the one of least value counts.
    """
    w, b = np.zeros(n), np.log(prior / (1 - prior))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    p, u = positive, ~positive
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    least, best, top = np.inf, (w, b), b
    for step in range(1, rounds + 1):
        f = np.bincount(row, w[column], len(p)) + b
        s = 1 / (1 + np.exp(-np.clip(f, -60, 60)))
        clean = np.logaddexp(0, f)  # l(-f)
        clean_risk = clean[u].sum() / n_u - prior * clean[p].sum() / n_p
        value = prior * np.logaddexp(0, -f[p]).sum() / n_p + max(0.0, clean_risk) + decay / 2 * (w @ w)
        if value < least:
            least, best = value, (w, b)
        d = np.where(p, prior / n_p * (s - 1), 0.0)
        if clean_risk > 0:
            d += np.where(p, -prior / n_p, 1 / n_u) * s
        g = np.append(np.bincount(column, d[row], n) + decay * w, d.sum())
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], min(b - move[-1], top)
    return best[0], float(best[1])


def train_toxicity(docs: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 12000, validation: int = 6000, features: int = 4096) -> Model:
    """docs (doc_id, text, ...), labels (doc_id, toxic, ...) that may be learnt from."""
    small_batches(docs)
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marks.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0))).first()
    if not toxic:
        return Model(np.zeros(0, np.int64), np.zeros(0), -1000.0)

    def prior(caution):
        return min(max(caution * toxic / n, 1e-3), 0.9)

    order = F.xxhash64("doc_id")
    marks = marks.withColumn("apart", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(4)) == 0)
    p_ids = marks.filter("toxic > 0 and not apart").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(P).alias("kind"))
    v_ids = marks.filter("apart").orderBy(order, "doc_id").limit(validation).select("doc_id", F.when(F.col("toxic") > 0, TOXIC).otherwise(CLEAN).alias("kind"))
    ids = docs.select("doc_id").filter("doc_id is not null")
    u_ids = ids.join(marks, "doc_id", "left_anti").distinct().orderBy(order, "doc_id").limit(unlabelled)
    if u_ids.limit(1).count() == 0:
        u_ids = ids.distinct().orderBy(order, "doc_id").limit(unlabelled)
    chosen = F.broadcast(p_ids.union(v_ids).union(u_ids.select("doc_id", F.lit(U).alias("kind"))))  # positives + validation + unlabelled ids at most
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("text", "kind")

    def counts(batches):
        seen = np.zeros((2, 1 << BITS), np.int64)
        texts = np.zeros(2, np.int64)
        for batch in slices(batches, size=1 << 20):
            row, feature = text_features(batch.column("text"))
            kind = batch.column("kind").to_numpy(zero_copy_only=False).astype(np.int64)
            texts += np.bincount(kind, minlength=4)[:2]
            for k in (0, 1):
                seen[k] += np.bincount(feature[kind[row] == k], minlength=1 << BITS)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[0][at], texts[0])), pa.array(np.append(seen[1][at], texts[1]))], ["feature", "u", "p"]
        )

    counted = sample.filter(F.col("kind") < CLEAN).mapInArrow(counts, "feature int, u long, p long").groupBy("feature").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    counted = counted.cache()
    total = counted.filter("feature = -1").first()
    n_u, n_p = (float(total["u"]), float(total["p"])) if total else (0.0, 0.0)
    if not n_p or not n_u:
        counted.unpersist()
        return Model(np.zeros(0, np.int64), np.zeros(0), -1000.0)
    p, expected = F.col("p"), n_p * (F.col("u") + 0.5) / (n_u + 1)
    gain = p * F.log(p / expected) - (p - expected)
    top = counted.filter("feature >= 0 and p >= 3").filter((p > expected) & (gain > GAIN)).orderBy(gain.desc(), "feature").limit(features).collect()
    counted.unpersist()
    kept = np.array(sorted(r["feature"] for r in top), np.int64)
    if not len(kept):
        return Model(kept, np.zeros(0), float(np.log(prior(MIDDLE) / (1 - prior(MIDDLE)))))
    wanted = np.zeros(1 << BITS, bool)
    wanted[kept] = True

    def bits(batches):
        for batch in slices(batches, size=1 << 20):
            row, feature = text_features(batch.column("text"), wanted)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.searchsorted(kept, feature), pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, batch.column("kind")], ["bits", "kind"])

    table = sample.mapInArrow(bits, "bits array<int>, kind int").toArrow()
    lists = table["bits"].combine_chunks()
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    column, row = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(length)), length)
    kind = table["kind"].to_numpy()

    def fit(positive, caution, **options):
        use = positive | (kind == U)
        own = use[row]
        return fit_nnpu((np.cumsum(use) - 1)[row[own]], column[own], positive[use], prior(caution), len(kept), **options)

    def errors(caution):
        w, b = fit(kind == P, caution, rounds=250)
        found = np.bincount(row, w[column], len(kind)) + b >= 0
        return int((found & (kind == CLEAN)).sum() + (~found & (kind == TOXIC)).sum())

    best = min(CAUTIONS, key=errors) if (kind == CLEAN).any() and (kind == TOXIC).any() else MIDDLE
    w, b = fit((kind == P) | (kind == TOXIC), best)
    return Model(kept, w, b)


def toxicity_score(text: Column, model: Model) -> Column:
    """Column of scores from 0 to 1 of a text column."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = [pa.array(model.scores(part.column("text"))) for part in slices([pa.RecordBatch.from_arrays([column], ["text"])])]
        return pa.concat_arrays(out) if out else pa.array([], pa.float64())

    return score(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
