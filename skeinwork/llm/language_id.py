"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters (with marks and apostrophes inside). A word's emission score for a language is the sum of the
weights of its features: the word as a lexicon entry, its prefixes and suffixes of 1 to 3 characters, its n-grams of 2 to 4
characters, its shape, and a bias. Weights and transitions between languages are learned together, by gradient descent on the chains'
conditional likelihood, whose gradient is the difference of observed and expected counts from forward-backward. At prediction
forward-backward gives each word its probabilities, so a switch of language inside a text is seen; the text's
language is the one with most expected words, and the score is its mean probability.

Labels are known for documents, not words, so training makes code-switched text of them: half of the chains begin with words of one training
document and go on with words of another, which is what the transitions are learned from.

Chains are cut at CHAIN words, in training and prediction alike; each word of the whole text is in one chain, and a run of more than LONGEST
letters is several words. Training fits on a bounded sample: at most PER_LANGUAGE training documents of each language, those of least hash,
and at most SAMPLE documents of all, of SAMPLE_WORDS words each. Every language of the training documents is learned; memory follows their number.

Defined results: a text that is null or has no letter is "und" with score 0; without labelled training documents all are;
repeated rows each get a row; an empty table gives no rows; a text of any length is read whole. lang, source and doc_id never enter a
prediction; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PER_LANGUAGE = 200
SAMPLE_WORDS = 150
SAMPLE = 50_000
LONGEST = 24
CHAIN = 32
BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
EPOCHS = 5
RATE = 0.3
DECAY = 1e-5
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def words_of(text: str) -> list[str]:
    """Words with a letter: the pattern alone also takes number signs that are no decimal digits."""
    found = [w for w in WORDS.findall(text) if w.isalpha() or any(c.isalpha() for c in w)]
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def features(words: list[str]):
    """(word, feature) pairs of hashed features, as two arrays, for all words at once.

    Prefixes and suffixes are the n-grams that hold the mark of a word's start or end."""
    import numpy as np

    cores = [w.lower() for w in words]
    codes = np.frombuffer("".join([f"<{c}>" for c in cores]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(c) + 2 for c in cores])
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters from here to the word's end
    out_word, out = [np.arange(len(words))], [np.zeros(len(words), np.int64)]

    def add(of, h, kind: int):
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        out_word.append(of)
        out.append(((h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))

    with np.errstate(over="ignore"):
        h = codes
        for n in GRAMS:
            h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            fits = left[: len(h)] >= n
            add(word[: len(h)][fits], h[fits], n)
        power = np.cumprod(np.full(4 * LONGEST, 0x9E3779B1, np.uint64))
        add(np.arange(len(words)), np.add.reduceat(codes * power[left - 1], ends - lengths), 100)
        add(np.arange(len(words)), np.array([w[:1].isupper() + 2 * w.isupper() for w in words], np.uint64), 200)
    return np.concatenate(out_word), np.concatenate(out)


def chains(n_words: list[int]):
    """For texts of so many words: each word's chain and place, the chains' lengths, and the text of each chain."""
    import numpy as np

    lengths, owner = [], []
    for i, n in enumerate(n_words):
        for a in range(0, n, CHAIN):
            lengths.append(min(CHAIN, n - a))
            owner.append(i)
    lengths = np.array(lengths, np.int64)
    chain = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return chain, place, lengths, np.array(owner, np.int64)


def forward_backward(emit, chain, place, lengths, trans, start):
    """Each word's probabilities, and the expected transitions of all chains together."""
    import numpy as np

    n, langs = len(lengths), len(start)
    steps = int(lengths.max())
    grid = np.zeros((steps, n, langs))
    grid[place, chain] = emit
    live = np.arange(steps)[:, None] < lengths[None, :]
    top = grid.max(2, keepdims=True)
    grid = np.exp(grid - top)
    move = np.exp(trans)
    alpha, beta = np.empty_like(grid), np.ones_like(grid)
    alpha[0] = grid[0] * np.exp(start)
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for t in range(1, steps):
        alpha[t] = alpha[t - 1] @ move * grid[t]
        alpha[t] /= alpha[t].sum(1, keepdims=True)
    pairs = np.zeros((langs, langs))
    for t in range(steps - 2, -1, -1):
        ahead = grid[t + 1] * beta[t + 1]
        on = live[t + 1][:, None]
        both = ahead @ move.T
        beta[t] = np.where(on, both / both.sum(1, keepdims=True), 1.0)
        weight = np.where(on, alpha[t], 0.0)
        norm = (weight * both).sum(1, keepdims=True)
        pairs += ((weight / np.where(norm > 0, norm, 1.0)).T @ np.where(on, ahead, 0.0)) * move
    out = alpha * beta
    out /= out.sum(2, keepdims=True)
    return out[place, chain], pairs


class Field:
    """Weights (BUCKETS x languages), transitions and start scores."""

    def __init__(self, languages: list[str], weights, trans, start):
        self.languages, self.weights, self.trans, self.start = languages, weights, trans, start

    @classmethod
    def fit(cls, sample: list[tuple[str, str]]) -> Field:
        """Learns from (text, language) rows; all words of a text carry its language."""
        import numpy as np

        languages = sorted({lang for _, lang in sample})
        size = len(languages)
        number = {lang: i for i, lang in enumerate(languages)}
        texts = [(words_of(t)[:SAMPLE_WORDS], number[lang]) for t, lang in sample]
        parts = [(words[i : i + CHAIN], y) for words, y in texts for i in range(0, len(words), CHAIN)]
        field = cls(languages, np.zeros((BUCKETS, size)), np.zeros((size, size)), np.zeros(size))
        rng = np.random.default_rng(5)
        seen_w, seen_t, seen_s = np.full((BUCKETS, size), 1e-3), np.full((size, size), 1e-3), np.full(size, 1e-3)

        def switched(row):
            """A chain and its words' languages; every other chain goes on with the words of another one."""
            words, y = row
            labels = [y] * len(words)
            if len(words) > 1 and rng.random() < 0.5:
                other, z = parts[rng.integers(len(parts))]
                k = int(rng.integers(1, len(words)))
                words, labels = words[:k] + other[: CHAIN - k], labels[:k] + [z] * len(other[: CHAIN - k])
            return words, labels

        for _ in range(EPOCHS if size > 1 else 0):
            for block in np.array_split(rng.permutation(len(parts)), max(1, len(parts) // 64)):
                rows = [switched(parts[i]) for i in block]
                of, index = features([w for words, _ in rows for w in words])
                size_of = sum(len(words) for words, _ in rows)
                emit = np.stack([np.bincount(of, field.weights[index, k], size_of) for k in range(size)], axis=1)
                chain, place, lengths, _ = chains([len(words) for words, _ in rows])
                y = np.array([y for _, labels in rows for y in labels])
                p, pairs = forward_backward(emit, chain, place, lengths, field.trans, field.start)
                p[np.arange(len(y)), y] -= 1
                at, inverse = np.unique(index, return_inverse=True)
                grad = np.stack([np.bincount(inverse, p[of, k], len(at)) for k in range(size)], axis=1) / len(rows) + DECAY * field.weights[at]
                inside = np.flatnonzero(place[1:] > 0)
                truth = np.bincount(y[inside] * size + y[inside + 1], minlength=size * size).reshape(size, size)
                g_start = p[place == 0].sum(0) / len(rows)
                g_trans = (pairs - truth) / len(rows) + 1e-3 * field.trans
                seen_w[at] += grad**2
                field.weights[at] -= RATE * grad / np.sqrt(seen_w[at])
                seen_t += g_trans**2
                field.trans -= RATE * g_trans / np.sqrt(seen_t)
                seen_s += g_start**2
                field.start -= RATE * g_start / np.sqrt(seen_s)
        return field

    def emissions(self, words: list[str]):
        """Scores of words, made once for each distinct one."""
        import numpy as np

        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        of, index = features(list(number))
        scores = np.stack([np.bincount(of, self.weights[index, k], len(number)) for k in range(len(self.languages))], axis=1)
        return scores[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]

    def label(self, text: str) -> list[tuple[str, str]]:
        """(word, its most probable language) for the words of a text."""
        words = words_of(text)
        if not words or not self.languages:
            return [(w, "und") for w in words]
        chain, place, lengths, _ = chains([len(words)])
        p, _ = forward_backward(self.emissions(words), chain, place, lengths, self.trans, self.start)
        return [(w, self.languages[k]) for w, k in zip(words, p.argmax(1).tolist())]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        import numpy as np

        words = [words_of(t) if t else [] for t in texts]
        out = [("und", 0.0)] * len(texts)
        if not self.languages or not any(words):
            return out
        chain, place, lengths, owner = chains([len(w) for w in words])
        p, _ = forward_backward(self.emissions([w for ws in words for w in ws]), chain, place, lengths, self.trans, self.start)
        text = owner[chain]
        mass = np.stack([np.bincount(text, p[:, k], len(texts)) for k in range(len(self.languages))], axis=1)
        for i, ws in enumerate(words):
            if ws:
                best = int(mass[i].argmax())
                out[i] = (self.languages[best], float(min(1.0, mass[i, best] / len(ws))))
        return out


def remainder(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def training_sample(rows: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most per_language texts of each language, fewer if that were more than SAMPLE in all, by least hash; ends of longer texts are cut
    where SAMPLE_WORDS words must be past."""
    fit = rows.filter("fold <> 0 and lang is not null and text is not null")
    # Only hashes below a language's bound come to its one window, some times as many as are wanted.
    sizes = common.staged(fit.groupBy("lang").count().withColumnRenamed("lang", "l"), "languages")
    n = sizes.count()
    per_language = max(1, min(per_language, SAMPLE // max(1, n)))
    h = F.xxhash64(F.lit(9), F.col("doc_id"), F.col("text"))
    keyed = fit.select("lang", "doc_id", "text", h.alias("h")).join(F.broadcast(sizes) if n <= SAMPLE else sizes, F.col("lang") == F.col("l"))
    near = keyed.filter((F.shiftrightunsigned("h", 11) / float(1 << 53)) * F.col("count") <= 4.0 * per_language + 50)
    cut = near.select("lang", "h", F.substring("text", 1, 40 * SAMPLE_WORDS).alias("text"))
    first = cut.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("i") <= per_language)
    return sorted((r["text"], r["lang"]) for r in first.select("text", "lang").collect())


def identify(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents, learned from those that are not held out."""
    import pyarrow as pa

    spark = documents.sparkSession
    common.batches(spark)
    rows = common.pick(documents, "doc_id", "text", "lang")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), remainder(F.col("doc_id")).alias("fold"))
    field = Field.fit(training_sample(rows, per_language))
    sent = spark.sparkContext.broadcast((field.languages, field.weights, field.trans, field.start))

    def run(batches):
        own = Field(*sent.value)
        for b in batches:
            got = own.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", (F.col("fold") == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
