"""Quality classification by importance resampling with hashed n-gram models.

Two generative models over hashed n-grams (words and punctuation runs, and pairs of successive ones): the
target model, of texts labelled good (quality 1, not toxic), and the raw model, of all texts. A text's
``log_importance`` is the log of its target probability over its raw probability: the sum over its n-grams of
log((target count + prior) / (expected count + prior)), where the expected count is the raw count times the
target's share of all n-grams. Documents are then resampled: k of them without replacement, those with the k
largest keys, log importance + standard Gumbel noise (made from id and text, so the same in any run). The k-th largest key
is found by counting in ever narrower bins, not by a sort.

Over a whole text, a few words of abuse weigh less than what chance adds up in hundreds of clean ones. So a second decision, ``fit``,
comes first: unfit documents are not resampled. It looks at the text's worst passage of ``span`` successive tokens, by the same
ratio, over the texts that have an n-gram (how often a text says it makes no difference), of words, the first 3 to
7 letters of words (a token counts by its lowest) and pairs (all words said twice or more one after another
count as one pair); an n-gram counts only where the target has it less often than expected by more than ``errors`` standard errors. A
document is fit if its ``passage_importance`` reaches the cut with the best balanced accuracy on the labels, of the cuts that
keep ``least_kept`` of the good ones. ``fit_only=False`` leaves this out.

k is a parameter; without it all fit documents stay.

Bounds: the models have ``4 * BUCKETS`` counts each, whatever the input. The target model and the cut use at
most ``labelled`` labelled ids (those first by hash of their id), of an id's rows the worst; everything else covers all.

Defined cases: a null, empty or blank text has importances 0. Rows that repeat id and text get equal keys; a tie at the cut is kept
whole. Labels with nulls are not used; conflicting labels for an id count as not good. Without any good label all documents are fit.
Of rows that repeat an id, each is judged by its own text; a label holds for all of them. Columns that clash in name don't matter.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import Rows, resident, stored, whole_text

BUCKETS = 1 << 18
LABELLED = 50_000
SPAN = 32
PRIOR = 2.0
ERRORS = 3.0
LEAST_KEPT = 0.99
SLICES = 64
ROWS_AT_ONCE = 500
TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\s]+")
PREFIXES = range(3, 8)
SLOTS = 1 + len(PREFIXES)
SHOUTED, AGAIN = 1, np.uint32(2)


class Features(dict):
    """Hashed n-grams of texts, kept for each piece between spaces; a missing one is made, and kept while there is room."""

    def __init__(self, most: int = 500_000):
        super().__init__({"": b""})
        self.most = most

    def __missing__(self, piece: str) -> bytes:
        low, hashed = piece.lower(), xxhash.xxh32_intdigest
        hashes = array("I")
        for token in [low] if low.isalpha() else TOKEN.findall(low):
            word, n = hashed(token), len(token)
            hashes.append(word)
            for k in PREFIXES:
                hashes.append(hashed(token[:k], k) if k <= n else word)
        if len(piece) > 2 and piece.isupper():
            hashes.extend([SHOUTED] * SLOTS)
        got = hashes.tobytes()
        if len(piece) <= 64 and len(self) < self.most:
            self[piece] = got
        return got

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts, one after another, a row each (word, then its beginnings), and where each text's end."""
        get = self.__getitem__
        parts = [b"".join(map(get, text.replace("\n", " ").split(" "))) for text in texts]
        return np.frombuffer(b"".join(parts), "<u4").reshape(-1, SLOTS), np.cumsum([0, *map(len, parts)])[1:] // (4 * SLOTS)


@resident(maxsize=1)
def _features() -> Features:
    """One for each Python worker."""
    return Features()


def pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs that end in each word but the first, and the same with all repeats as one pair. Pairs across texts are among them."""
    pair = (words[:-1] * np.uint32(0x9E3779B1)) ^ (words[1:] * np.uint32(0x85EBCA6B))
    pair ^= pair >> np.uint32(15)
    again, merged = words[:-1] == words[1:], pair.copy()
    merged[1:][again[1:] & again[:-1]] = AGAIN
    merged[2:][again[2:] & again[:-2]] = AGAIN
    return pair, merged


MASK = np.uint32(BUCKETS - 1)
#: Where the counts begin: occurrences of words, of pairs; texts with a word or beginning, with a pair.
WORDS, PAIRS, IN_TEXTS, PAIR_TEXTS, ALL = (i * BUCKETS for i in range(5))


def ngrams(slots: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words, of pairs, of words and beginnings (a row a token) and of pairs with repeats as one; a text's first token has no pair (-1)."""
    one = (slots & MASK).astype(np.int32)
    two = np.full((2, len(slots)), -1, np.int32)
    if len(slots) > 1:
        plain, merged = pairs(slots[:, 0])
        two[0, 1:], two[1, 1:] = plain & MASK, merged & MASK
        starts = np.append(0, ends[:-1])
        two[:, starts[starts < len(slots)]] = -1
    return one[:, 0], two[0], one, two[1]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one partition, raw then target, in slices; the numbers of n-grams and of texts come last."""
    features, total, sums = _features(), np.zeros((2, ALL), np.int64), np.zeros((2, 2), np.int64)
    last = np.zeros(2 * BUCKETS, np.int32)

    def distinct(at: np.ndarray) -> np.ndarray:
        """The different values, by which writer of several a cell remembers."""
        order = np.arange(len(at), dtype=np.int32)
        last[at] = order
        return at[last[at] == order]

    for b in batches:
        for lo in range(0, b.num_rows, ROWS_AT_ONCE):
            own = b.slice(lo, ROWS_AT_ONCE)
            slots, ends = features.tokens(own.column(0).to_pylist())
            word, pair, all_, merged = ngrams(slots, ends)
            good = own.column(1).to_numpy(zero_copy_only=False).astype(bool)
            starts = np.append(0, ends[:-1])
            in_texts = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                two = merged[s:e]
                in_texts.append(distinct(np.concatenate([all_[s:e].ravel(), two[two >= 0] + BUCKETS])))
            of_good = np.repeat(good, ends - starts)
            for k, (tokens, texts) in enumerate(((slice(None), in_texts), (of_good, [x for x, g in zip(in_texts, good, strict=True) if g]))):
                w, p = word[tokens], pair[tokens]
                p = p[p >= 0]
                total[k, WORDS:PAIRS] += np.bincount(w, minlength=BUCKETS)
                total[k, PAIRS:IN_TEXTS] += np.bincount(p, minlength=BUCKETS)
                total[k, IN_TEXTS:] += np.bincount(np.concatenate([np.zeros(0, np.int32), *texts]), minlength=2 * BUCKETS)
                sums[k] += [len(w) + len(p), len(texts)]
    salt = TaskContext.get().partitionId() % 64
    parts = total.reshape(2, SLICES, -1)
    yield pa.RecordBatch.from_pydict(
        {"salt": [salt] * (SLICES + 1), "slice": list(range(SLICES + 1)), "counts": [zlib.compress(x.astype("<i8").tobytes(), 1) for x in [*(parts[:, i] for i in range(SLICES)), sums]]},
        schema=pa.schema([("salt", pa.int32()), ("slice", pa.int32()), ("counts", pa.binary())]),
    )


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total: np.ndarray | int = 0
    for x in rows["counts"]:
        total = total + np.frombuffer(zlib.decompress(x), "<i8")
    return pd.DataFrame({"salt": [0], "slice": [rows["slice"].iloc[0]], "counts": [zlib.compress(total.astype("<i8").tobytes(), 1)]})


def log_ratios(counts: np.ndarray, sums: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """For each n-gram, the log of its target probability over its raw one. counts: raw, target; sums: all of each."""
    return np.log((counts[1] + prior) / (counts[0] * (sums[1] / max(1, sums[0])) + prior))


def shortages(counts: np.ndarray, texts: np.ndarray, prior: float = PRIOR, errors: float = ERRORS) -> np.ndarray:
    """The log ratios of the n-grams that the target lacks beyond chance, and 0 for others. counts: raw and target texts that have them; texts: all such."""
    expected = counts[0] * (texts[1] / max(1, texts[0]))
    return np.where(expected - counts[1] > errors * np.sqrt(expected + 1), log_ratios(counts, texts, prior), 0.0)


def importances(slots: np.ndarray, ends: np.ndarray, ratios: np.ndarray, lacks: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Log importance of each text and of its worst passage. ratios: of words, then pairs; lacks: of words and beginnings, then pairs."""
    n = len(ends)
    if not len(slots):
        return np.zeros(n), np.zeros(n)
    word, pair, all_, merged = ngrams(slots, ends)
    whole = ratios[word] + np.where(pair >= 0, ratios[pair + BUCKETS], 0.0)
    low = lacks[all_[:, 0]]
    for i in range(1, SLOTS):
        np.minimum(low, lacks[all_[:, i]], out=low)
    low += np.where(merged >= 0, lacks[merged + BUCKETS], 0.0)
    starts = np.append(0, ends[:-1])
    total, sums = (np.append(0.0, np.cumsum(x)) for x in (whole, low))
    # each passage by its last token; a shorter one begins with its text
    first = np.maximum(np.arange(1, len(slots) + 1) - span, np.repeat(starts, ends - starts))
    passage = sums[1:] - sums[first]
    # a longer text's first passages are parts of a whole one
    passage[(np.arange(1, len(slots) + 1) - np.repeat(starts, ends - starts) < span) & (np.repeat(ends - starts, ends - starts) >= span)] = np.inf
    some = ends > starts
    worst = np.zeros(n)
    worst[some] = np.minimum.reduceat(passage, starts[some])
    long_enough = some & (ends - starts < span)
    worst[long_enough] = (sums[ends] - sums[starts])[long_enough]
    return np.where(some, total[ends] - total[starts], 0.0), worst


def _scored(ratios: np.ndarray, lacks: np.ndarray, span: int, carried: int):
    packed = ratios.astype("<f4").tobytes(), lacks.astype("<f4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _features()
        both = [np.frombuffer(x, "<f4").astype(float) for x in packed]
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                own = b.slice(lo, ROWS_AT_ONCE)
                found = importances(*features.tokens(own.column(0).to_pylist()), *both, span)
                yield pa.RecordBatch.from_arrays([*own.columns[1:], *map(pa.array, found)], [*own.schema.names[1:], "log_importance", "passage_importance"])

    return run


def best_cut(scores: np.ndarray, good: np.ndarray, least_kept: float = LEAST_KEPT) -> float:
    """The cut with the best balanced accuracy for score >= cut, of those that keep so many of the good; of equal ones the lowest."""
    if not good.any() or good.all():
        return -np.inf
    values, at = np.unique(scores, return_inverse=True)
    right = np.bincount(at[good], minlength=len(values))[::-1].cumsum()[::-1] / good.sum()
    wrong = np.bincount(at[~good], minlength=len(values))[::-1].cumsum()[::-1] / (~good).sum()
    best = int(np.argmax(np.where(right >= least_kept, right - wrong, -1)))
    # halfway to the next lower score: clean texts of other samples lie a little below the lowest here
    return float(values[best] if not best else (values[best] + values[best - 1]) / 2)


def kth_largest(df: DataFrame, col: str, k: int, enough: int = 10_000, bins: int = 1024) -> float:
    """The k-th largest value (ties counted) by counting in ever narrower bins."""
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n")).first()
    lo, hi, above, inside = row.lo, row.hi, 0, row.n
    if k >= row.n:
        return lo
    while inside > enough and hi > lo:
        width = (hi - lo) / bins
        if lo + width == lo:
            break
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col(col) - lo) / width)).cast("int")
        found = {r.b: r["count"] for r in df.where(F.col(col).between(lo, hi)).groupBy(bin_.alias("b")).count().collect()}
        b = bins
        while above < k and b > 0:
            b -= 1
            above += found.get(b, 0)
        above -= found.get(b, 0)
        inside = found.get(b, 0)
        lo, hi = lo + b * width, (hi if b == bins - 1 else lo + (b + 1) * width)
    rest = df.where(F.col(col).between(lo, hi)).orderBy(F.col(col).desc()).limit(min(inside, max(1, k - above)))
    return rest.agg(F.min(col)).first()[0]


def resample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, fit_only: bool = True, carry: list[str] | None = None,
    labelled: int = LABELLED, span: int = SPAN, prior: float = PRIOR, errors: float = ERRORS, seed: int = 7,
) -> DataFrame:
    """One row a document: id (or the columns to carry), log_importance, passage_importance, key, fit, kept."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    sample = good.select(F.col("doc_id").cast("long").alias("label_id"), "good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    carried = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry or [id_col])]
    text = whole_text(text_col)
    rows = docs.select(text.alias("text"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text, F.lit(seed)).alias("noise"), *carried)
    # at most `labelled` rows of 9 bytes
    marked = rows.join(F.broadcast(stored(sample, "labels")), F.col("id") == F.col("label_id"), "left").drop("label_id")
    parts = marked.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_counts, "salt int, slice int, counts binary")
    slices = parts.groupBy("slice", "salt").applyInPandas(_summed, "salt int, slice int, counts binary").groupBy("slice").applyInPandas(_summed, "salt int, slice int, counts binary")
    counts, sums = np.zeros((2, SLICES, ALL // SLICES), np.int64), np.zeros((2, 2), np.int64)
    for r in slices.collect():  # the model: a fixed number of counts
        own = np.frombuffer(zlib.decompress(r.counts), "<i8").reshape(2, -1)
        if r.slice < SLICES:
            counts[:, r.slice] = own
        else:
            sums = own
    counts = counts.reshape(2, -1)
    ratios, lacks = log_ratios(counts[:, :IN_TEXTS], sums[:, 0], prior), shortages(counts[:, IN_TEXTS:], sums[:, 1], prior, errors)
    out = marked.drop("text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", log_importance double, passage_importance double"
    scored = stored(marked.select("text", *out.columns).mapInArrow(_scored(ratios, lacks, span, len(carried)), kinds), "importances")
    cut = -np.inf
    if fit_only:
        known = scored.where("good IS NOT NULL").groupBy("id").agg(F.min("passage_importance").alias("x"), F.first("good").alias("good")).toPandas()  # an id once: at most `labelled` rows
        cut = best_cut(known["x"].to_numpy(), known["good"].to_numpy(bool)) if len(known) and known["good"].any() else -np.inf
    uniform = (F.shiftrightunsigned("noise", 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    names = [F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry or [id_col])]
    keyed = scored.withColumn("key", F.col("log_importance") - F.log(-F.log(uniform))).withColumn("fit", F.col("passage_importance") >= F.lit(float(cut)))
    kept = F.col("fit")
    if k is not None:
        last = kth_largest(keyed.where("fit"), "key", k) if k > 0 else np.inf
        kept = kept & (F.col("key") >= F.lit(float(last if last is not None else -np.inf)))
    return keyed.select(*names, "log_importance", "passage_importance", "key", "fit", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns; each row is judged on its own text."""
    rows = Rows(docs)
    return rows.without(resample(rows.keyed(), labels, id_col, text_col, carry=rows.key).where("NOT kept").select(*rows.key))
