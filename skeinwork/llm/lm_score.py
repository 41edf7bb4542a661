"""Language-model scores by a log-bilinear neural model, trained with noise-contrastive estimation.

The model predicts a token's class from the CONTEXT classes before it: score(w, h) = (sum over places i of c_i * r_{h_i}) . q_w + b_w.
Classes are the CLASSES - 1 most frequent training tokens (the end token always), and BUCKETS classes for all others, as targets and as
contexts, by a hash of their last bytes. Inside such a class tokens are dealt to GROUPS groups by a hash of their first bytes: P(g | class, h)
is in proportion to the group's smoothed count in the class times exp((sum over i of c_i * r_{h_i}) . u_g), and is trained on its exact
gradient. So each token has two learned vectors, shared with what begins or ends alike; among the tokens with both hashes it has its
smoothed share of the training tokens, with one share for all tokens never seen. So probabilities are normalised over an open vocabulary, at a
size that does not grow with it.

Texts are split twice: once to count, once to turn each token into its code (class and group), which is staged; training and scoring read
codes. All training documents count. A hash of id and text deals them to ROUNDS rounds, each GROWTH times the one before, and to SHARDS shards, which are as many
however much there is to learn; a shard has its documents in the order of that hash, so the model does not depend on how the input lies in partitions. In a
round every shard starts from the same parameters and the same sums of squared gradients (AdaGrad's, carried through all rounds), and streams its documents. A parameter then moves by
the shards' moves, each weighted by the shard's own sum of squares over that of all shards together: where gradients are rare and small these moves add up as if made one
after the other, where each shard has seen enough, or makes many steps in a round, they are averaged. A momentum over rounds (Nesterov's) is added. Sums are in fixed point, so that no order of addition shows; a
task adds up its shards before it sends them, and what it sends, and the driver gets, has the size of two models.

Scoring: normalisers of all contexts are made once, by batched matrix products dealt over the cluster, a table of fixed size; a token's
score is then looked up in the matrices of context and target. Counts of the up to HEAD most frequent tokens (of HEAD_BYTES bytes
together) go to every task, a bounded table; all other tokens of all documents meet their counts in a join, exactly. A token too long for the head may be frequent; the join's
table of counts has one row for it, so adaptive execution splits the other side.

Defined results: null text is empty, with just the end token; a null doc_id is hashed as the empty text; repeated rows each get
a row and count as often in training; without training documents N and V are 0; an empty table gives no rows. A text of any length is one
row of codes, four bytes a token; extra columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CLASSES = 1024
BUCKETS = 256
GROUPS = 32
SUFFIX, PREFIX = 3, 3
CONTEXT = 2
DIM = 32
HEAD = 1 << 17
HEAD_BYTES = 8 << 20
NAMED_BYTES = 64  # longer tokens have no class of their own
END = b"\n"  # no word has white space

SHARDS = 64
ROUNDS = 24
GROWTH = 1.15
#: Learning rates of the first and the last round, those between by equal factors; how far a round's move is taken, and how much of it the next keeps.
RATES = (0.4, 0.05)
STEP, MOMENTUM = 0.7, 0.5
#: Moves that add up count as that many minibatches one after the other, at most: beyond that they start from parameters too old to add.
STALE = 200
NOISE = 25.0
SAMPLES = 64
MINIBATCH = 1024
_BUFFER = 1 << 16
_POINT = 1 << 36
_START = 1e-2  # of the sums of squares


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


SHORT = 16
_LOWER = bytes(32 if b in b"\t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words:
    """The words of texts as places in one buffer, and what tells words of at most SHORT bytes apart: their bytes as two numbers, and their
    length. h is a hash of the three."""

    def __init__(self, texts: list[bytes]):
        import numpy as np

        self.buffer = b" ".join(texts).translate(_LOWER) + b" " * (SHORT + 8)
        data = np.frombuffer(self.buffer, np.uint8)
        inside = np.concatenate([[False], data != 32])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        behind = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(behind, self.starts, side="right")
        self.size = self.ends - self.starts
        eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        self.low = eights[self.starts] & masks[np.minimum(self.size, 8)]
        self.high = eights[self.starts + 8] & masks[np.clip(self.size - 8, 0, 8)]
        self.long = np.flatnonzero(self.size > SHORT)
        self.h = _mixed(self.low, self.high, self.size)

    def slices(self, at) -> list[bytes]:
        return [self.buffer[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]

    def counts(self) -> dict[bytes, int]:
        """How often each word is there; END is not counted."""
        from collections import Counter

        import numpy as np

        out = Counter(self.slices(self.long))
        short = np.flatnonzero(self.size <= SHORT)
        order = short[np.argsort(self.h[short], kind="stable")]
        h, low, high, size = (x[order] for x in (self.h, self.low, self.high, self.size))
        same = h[1:] == h[:-1]
        if (same & ((low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (size[1:] != size[:-1]))).any():
            return Counter(self.slices(np.arange(len(self.starts))))  # two words of one hash
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else order
        out.update(dict(zip(self.slices(order[first]), np.diff(np.append(first, len(order))).tolist())))
        return out


def _mixed(low, high, size):
    import numpy as np

    with np.errstate(over="ignore"):
        h = low * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(29)) + high
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(32)) + size.astype(np.uint64)
        h = h * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(29)


class Places:
    """Looks up the places of words in a list, for many words at once."""

    BITS = 18

    def __init__(self, words: list[bytes]):
        import numpy as np

        self.last, self.of_long = len(words), {w: i for i, w in enumerate(words) if len(w) > SHORT}
        short = [w for w in words if len(w) <= SHORT]
        pairs = np.frombuffer(b"".join(w.ljust(SHORT, b"\0") for w in short), "<u8").reshape(-1, 2)
        size, place = np.array([len(w) for w in short], np.int64), np.array([i for i, w in enumerate(words) if len(w) <= SHORT], np.int64)
        h = _mixed(pairs[:, 0], pairs[:, 1], size)
        order = np.argsort(h, kind="stable")
        self.h, self.low, self.high, self.size, self.place = h[order], pairs[order, 0], pairs[order, 1], size[order], place[order]
        # Words by the first BITS bits of their hash.
        self.cuts = np.searchsorted(self.h, np.arange((1 << self.BITS) + 1, dtype=np.uint64) << np.uint64(64 - self.BITS)) if len(h) else np.zeros((1 << self.BITS) + 1, np.int64)
        self.cuts[-1] = len(h)

    def find(self, words: Words):
        """Each word's place, or the list's length."""
        import numpy as np

        out = np.full(len(words.h), self.last, np.int64)
        key = (words.h >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, end = self.cuts[key], self.cuts[key + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            spot = at[open_]
            hit = (self.h[spot] == words.h[open_]) & (self.low[spot] == words.low[open_]) & (self.high[spot] == words.high[open_]) & (self.size[spot] == words.size[open_])
            out[open_[hit]] = self.place[spot[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        out[words.long] = [self.of_long.get(w, self.last) for w in words.slices(words.long)]
        return out


def remainder(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def cell(token: bytes) -> int:
    """class * GROUPS + group of a token that has no class of its own; cell_column says the same of a column."""
    from zlib import crc32

    return crc32(token[-SUFFIX:]) % BUCKETS * GROUPS + crc32(token[:PREFIX]) % GROUPS


def cell_column(token):
    return F.crc32(F.substring(token, -SUFFIX, SUFFIX)) % BUCKETS * GROUPS + F.crc32(F.substring(token, 1, PREFIX)) % GROUPS


class Model:
    """r, q, b, c, u and the frequencies of the classes; log-weights of the groups in each class."""

    def __init__(self, freq, weights, dim: int = DIM, context: int = CONTEXT):
        import numpy as np

        rng = np.random.default_rng(11)
        classes = len(freq)
        self.noise = np.asarray(freq, np.float64) + 0.5
        self.noise /= self.noise.sum()
        self.weights = np.asarray(weights, np.float32)
        self.r = (rng.standard_normal((classes + 1, dim)) * 0.1).astype(np.float32)  # the last: before the text
        self.q = (rng.standard_normal((classes, dim)) * 0.1).astype(np.float32)
        self.b = np.log(self.noise).astype(np.float32)
        self.c = np.ones((context, dim), np.float32)
        self.u = np.zeros((GROUPS, dim), np.float32)
        self.seen: dict = {}

    def rows(self, seen: bool = False):
        """The parameters, or the sums of their squared gradients, as rows of equal length."""
        import numpy as np

        r, q, b, c, u = (self.seen.setdefault(n, np.full_like(getattr(self, n), _START)) if seen else getattr(self, n) for n in "rqbcu")
        pad = lambda x: np.hstack([x, np.zeros((len(x), 1), np.float32)])
        return np.vstack([pad(r), np.hstack([q, b[:, None]]), pad(c), pad(u)])

    def take(self, rows, seen=None) -> Model:
        import numpy as np

        n, d = self.r.shape

        def parts(rows):
            rows = np.asarray(rows, np.float32)
            cut = {"r": rows[:n, :d], "q": rows[n : 2 * n - 1, :d], "b": rows[n : 2 * n - 1, d], "c": rows[2 * n - 1 : -GROUPS, :d], "u": rows[-GROUPS:, :d]}
            return {k: x.copy() for k, x in cut.items()}

        self.__dict__.update(parts(rows))
        if seen is not None:
            self.seen = parts(seen)
        return self

    def contexts(self, classes, lengths):
        """For the classes of texts of these lengths, one after the other: the CONTEXT classes before each, nearest first."""
        import numpy as np

        first = np.cumsum(lengths) - lengths
        place = np.arange(len(classes)) - np.repeat(first, lengths)
        out = np.empty((len(classes), len(self.c)), np.int32)
        for i in range(len(self.c)):
            out[:, i] = len(self.q)
            inside = np.flatnonzero(place > i)
            out[inside, i] = classes[inside - i - 1]
        return out

    def _moved(self, name, at, grad, rate) -> None:
        import numpy as np

        x = getattr(self, name)
        seen = self.seen.setdefault(name, np.full_like(x, _START))
        now = seen[at] + grad * grad
        seen[at] = now
        x[at] += rate * grad / np.sqrt(now)

    def train(self, words, before, rate: float, seed, groups) -> None:
        """One pass over the tokens in an order of the seed; groups is -1 for tokens with classes of their own."""
        import numpy as np

        rng = np.random.default_rng(seed)
        rate, k, m, classes = np.float32(rate), np.float32(NOISE), SAMPLES, len(self.q)
        shift = np.log(NOISE * self.noise).astype(np.float32)
        cumulated = np.cumsum(self.noise)
        order = rng.permutation(len(words))
        words, before, groups = words[order], before[order], groups[order]
        one = np.float32(1)

        def summed(ids, grad):
            """Distinct ids and the sums of their rows."""
            by = np.argsort(ids, kind="stable")  # 16 bits are sorted by counting
            ids = ids[by]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            return ids[first], np.add.reduceat(grad[by], first)

        def sigmoid(x, scale):
            """scale / (1 + exp(x)), in place; an overflow gives 0."""
            with np.errstate(over="ignore"):
                np.exp(x, out=x)
            x += one
            return np.divide(scale, x, out=x)

        kind = np.uint16 if classes < 1 << 16 else np.int32
        for i in range(0, len(order), MINIBATCH):
            w, h, own = words[i : i + MINIBATCH], before[i : i + MINIBATCH], groups[i : i + MINIBATCH]
            size = np.float32(len(w))
            rh = self.r[h]
            ctx = np.einsum("bij,ij->bj", rh, self.c)
            noise = np.minimum(np.searchsorted(cumulated, rng.random(m)), classes - 1)
            qw, qn = self.q[w], self.q[noise]
            g_data = sigmoid(np.einsum("bj,bj->b", ctx, qw) + (self.b[w] - shift[w]), one / size)
            s_noise = ctx @ -qn.T
            s_noise -= self.b[noise] - shift[noise]
            g_noise = sigmoid(s_noise, -k / np.float32(m) / size)
            g_ctx = g_data[:, None] * qw
            g_ctx += g_noise @ qn
            if len(at := np.flatnonzero(own >= 0)):
                inner = ctx[at]
                t = inner @ self.u.T
                t += self.weights[w[at]]
                t -= t.max(1, keepdims=True)
                np.exp(t, out=t)
                t /= t.sum(1, keepdims=True) * -size
                t[np.arange(len(at)), own[at]] += one / size
                g_ctx[at] += t @ self.u
                self._moved("u", slice(None), t.T @ inner, rate)
            g_r = g_ctx[:, None, :] * self.c
            self._moved("c", slice(None), np.einsum("bij,bj->ij", rh, g_ctx), rate)
            grad = np.empty((len(w) + m, ctx.shape[1] + 1), np.float32)
            np.multiply(g_data[:, None], ctx, out=grad[: len(w), :-1])
            grad[: len(w), -1] = g_data
            np.matmul(g_noise.T, ctx, out=grad[len(w) :, :-1])
            grad[len(w) :, -1] = g_noise.sum(0)
            ids, grad = summed(np.concatenate([w, noise]).astype(kind), grad)
            self._moved("q", ids, grad[:, :-1], rate)
            self._moved("b", ids, grad[:, -1], rate)
            self._moved("r", *summed(h.ravel().astype(kind), g_r.reshape(-1, ctx.shape[1])), rate)

    def parts(self):
        """For each place of the context the matrix of (class before, class) scores; the last has the biases."""
        import numpy as np

        out = [(self.r * c) @ self.q.T for c in self.c]
        out[-1] = out[-1] + self.b
        return [np.ascontiguousarray(x, np.float32) for x in out]

    def normalisers(self, parts):
        """Natural logarithms of the sums over all classes, for each context."""
        import numpy as np

        top = parts[-1].max(1, keepdims=True)
        rest, log_top = np.exp(parts[-1] - top), top[:, 0]
        if len(parts) == 1:
            return np.log(rest.sum(1)) + log_top
        out = np.empty((len(parts[0]), len(rest)), np.float32)
        for i in range(0, len(out), 256):
            near = parts[0][i : i + 256]
            peak = near.max(1, keepdims=True)
            out[i : i + 256] = np.log(np.exp(near - peak) @ rest.T) + peak + log_top
        return out

    def log_probabilities(self, words, before, parts, log_z):
        """Natural logarithms of the classes' normalised probabilities."""
        s = -log_z[tuple(before.T)]
        for i, x in enumerate(parts):
            s += x[before[:, i], words]
        return s

    def log_within(self, words, before, groups):
        """For tokens of shared classes, natural logarithms of their probabilities in their class for each unit of their weights; 0 for others."""
        import numpy as np

        out = np.zeros(len(words), np.float32)
        rare = np.flatnonzero(groups >= 0)
        parts = [(self.r * c) @ self.u.T for c in self.c]
        size = np.exp(self.weights - self.weights.max(1, keepdims=True))
        top = self.weights.max(1)
        for i in range(0, len(rare), 1 << 14):
            at = rare[i : i + (1 << 14)]
            t = sum(x[before[at, j]] for j, x in enumerate(parts))
            s = t[np.arange(len(at)), groups[at]]
            peak = t.max(1)
            out[at] = s - peak - top[words[at]] - np.log(np.einsum("bg,bg->b", np.exp(t - peak[:, None]), size[words[at]]))
        return out


def classes_of(codes):
    """Classes of codes, and groups, -1 for tokens with classes of their own."""
    import numpy as np

    classes = codes // GROUPS
    return classes, np.where(classes < BUCKETS, codes % GROUPS, -1)


def _rows(documents: DataFrame) -> DataFrame:
    rows = common.pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumns({"fold": remainder(F.col("doc_id")), "h": F.xxhash64(F.lit(3), "doc_id", F.coalesce("text", F.lit("")))})


def token_counts(training: DataFrame, most: int = 400_000) -> DataFrame:
    """Staged token (binary), c over all rows' texts. Counts are partial where the texts lie, at most so many at a time."""
    import pyarrow as pa

    def run(batches):
        from collections import Counter

        seen: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        for b in batches:
            seen.update(Words(common.texts(b.column("text"))).counts())
            seen[END] += len(b)
            if len(seen) > most:
                yield flush()
                seen.clear()
        yield flush()

    counted = training.select("text").mapInArrow(run, "token binary, n long").filter("n > 0").groupBy("token").agg(F.sum("n").alias("c"))
    return common.staged(counted, "token-counts")


def head_of(counts: DataFrame, size: int = HEAD, most_bytes: int = HEAD_BYTES) -> dict[bytes, int]:
    """Counts of the most frequent tokens, the end token first: those whose count is at or above the least limit that leaves at most
    size tokens of most_bytes bytes together. Limits are powers of the fourth root of two, so a histogram of a few hundred rows
    finds it, and no more than that comes to the driver, from all partitions together. At a limit with too many bytes, longer tokens stay out."""
    words = counts.filter(F.col("token") != F.lit(END))
    step = F.floor(F.log2("c") * 4 + 1e-9).cast("int")
    length, room, least = F.length("token"), [size - 1, most_bytes], None
    short = length <= NAMED_BYTES
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count_if(short).alias("n"), F.coalesce(F.sum(F.when(short, length)), F.lit(0)).alias("bytes")).collect(), reverse=True):
        room = [room[0] - r["n"], room[1] - r["bytes"]]
        if min(room) < 0:
            break
        least = r["step"]
    top = words.filter((step >= least) & short).collect() if least is not None else []
    if least is not None:  # long ones that are as frequent, while they fit
        left = [size - 1 - len(top), most_bytes - sum(len(r["token"]) for r in top)]
        for r in words.filter((step >= least) & ~short & (length <= most_bytes // 16)).orderBy(F.col("c").desc(), length, "token").limit(16).collect():
            if (left := [left[0] - 1, left[1] - len(r["token"])]) and min(left) >= 0:
                top.append(r)
    end = counts.filter(F.col("token") == F.lit(END)).collect()
    return {bytes(r["token"]): r["c"] for r in [*end, *sorted(top, key=lambda r: (-r["c"], bytes(r["token"])))]}


def cells(counts: DataFrame, named: list[bytes]):
    """Training tokens by shared class, and smoothed weights by shared class and group, of all tokens that are not named."""
    import numpy as np

    n, distinct = np.zeros(BUCKETS * GROUPS), np.zeros(BUCKETS * GROUPS)
    others = counts.filter(~F.col("token").isin(named)) if named else counts
    for r in others.groupBy(cell_column(F.col("token")).alias("at")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("d")).collect():  # BUCKETS * GROUPS rows at most
        n[r["at"]], distinct[r["at"]] = r["c"], r["d"]
    by = lambda x: x.reshape(BUCKETS, GROUPS)
    return by(n).sum(1), by(n + 0.5 * (distinct + 1))


class Vocabulary:
    """Counts of training tokens: totals, the head by token, and the codes of the head's tokens."""

    def __init__(self, counts: DataFrame, classes: int = CLASSES, size: int = HEAD):
        import numpy as np

        self.total, self.distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.head = head_of(counts, size)
        self.named = [w for w in self.head if len(w) <= NAMED_BYTES][: classes - 1]
        place = {w: BUCKETS + i for i, w in enumerate(self.named)}
        rare, weights = cells(counts, self.named)
        self.freq = np.concatenate([rare, [self.head[w] for w in self.named], np.zeros(classes - 1 - len(self.named))])
        self.log_weights = np.log(weights).astype(np.float32)
        self.codes = np.array([place[w] * GROUPS if w in place else cell(w) for w in self.head], np.int32)

    def model(self) -> Model:
        return Model(self.freq, self.log_weights)


def encoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Staged row, doc_id, fold, h, n_tokens, codes (little-endian 32-bit numbers), n_known, known_share and rare_share (of the head's tokens; of
    those in shared classes), tail (the tokens that are not of the head) for each of rows."""
    import pyarrow as pa

    sent = rows.sparkSession.sparkContext.broadcast((vocabulary.head, vocabulary.codes))

    def run(batches):
        import numpy as np

        head, head_codes = sent.value
        places, last = Places(list(head)), len(head)
        end = list(head).index(END) if END in head else last
        head_codes = np.append(head_codes, np.int32(0))
        share = np.log10(np.array([*head.values(), 0.5], np.float64) + 0.5)  # nothing for the tail: log10(1)
        for b in batches:
            words = Words(common.texts(b.column("text")))
            lengths = np.bincount(words.doc, minlength=len(b)) + 1
            doc = np.repeat(np.arange(len(lengths)), lengths)
            at = np.full(len(doc), end)  # each text's last token
            own = np.arange(len(words.doc)) + words.doc
            at[own] = found = places.find(words)
            missed = np.flatnonzero(found == last)
            tail, rest = own[missed], words.slices(missed)
            if end == last:  # no training rows
                rest = [w for _, w in sorted([*zip(tail.tolist(), rest), *zip((np.cumsum(lengths) - 1).tolist(), [END] * len(lengths))])]
                tail = np.flatnonzero(at == last)
            code = head_codes[at]
            code[tail] = [cell(w) for w in rest]
            shares, n = share[at], len(lengths)
            by = lambda x, weights=None: np.bincount(x, weights, n)
            ends = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int32)
            cols = {c: b.column(c) for c in ("doc_id", "fold", "h")} | {
                "n_tokens": pa.array(lengths), "codes": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends(lengths * 4)), pa.py_buffer(code)]),
                "n_known": pa.array(lengths - by(doc[tail])), "known_share": pa.array(by(doc, shares)), "rare_share": pa.array(by(doc, np.where(code < BUCKETS * GROUPS, shares, 0.0))),
                "tail": pa.ListArray.from_arrays(pa.array(ends(by(doc[tail]))), pa.array(rest, pa.binary())),
            }
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    made = rows.select("doc_id", "fold", "h", "text").mapInArrow(run, "doc_id long, fold long, h long, n_tokens long, codes binary, n_known long, known_share double, rare_share double, tail array<binary>")
    # In the order of h, so a round's rows are a few pages of each file.
    return common.staged(made.sortWithinPartitions("h").withColumn("row", F.monotonically_increasing_id()), "coded")


def round_ends(rounds: int, growth: float) -> list[int]:
    """Upper limits of h (signed, 64 bits), by round, the last one aside."""
    sizes = [growth**k for k in range(rounds)]
    return [int(sum(sizes[: k + 1]) / sum(sizes) * 2**64) - 2**63 for k in range(rounds - 1)]


def train(coded: DataFrame, vocabulary: Vocabulary, shards: int = SHARDS, rounds: int = ROUNDS, growth: float = GROWTH) -> Model:
    """The model of the training rows of encoded(). The same rows give the same model, however they lie in partitions."""
    import numpy as np
    import pyarrow as pa

    context = coded.sparkSession.sparkContext
    model = vocabulary.model()
    seen, velocity, width = model.rows(True).astype(np.float64), 0.0, model.rows().shape[1]
    sent = context.broadcast((vocabulary.freq, vocabulary.log_weights))
    rows = coded.filter("fold <> 1").select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "doc_id", "codes")
    tasks = min(shards, context.defaultParallelism)
    for k, (rate, low, high) in enumerate(zip(np.geomspace(*RATES, rounds), [None, *(ends := round_ends(rounds, growth))], [*ends, None])):
        begin = context.broadcast((model.rows(), seen.astype(np.float32)))

        def run(batches, k=k, rate=rate, begin=begin):
            shard, own, held, size, part, total, n, m = None, None, [], 0, 0, None, 0, 0

            def learned():
                classes, groups = classes_of(np.concatenate(held))
                own.train(classes, own.contexts(classes, [len(x) for x in held]), rate, (k, part), groups)

            def ended():
                if held:
                    learned()
                squares = own.rows(True).astype(np.float64)
                moved = (own.rows().astype(np.float64) - begin.value[0]) * squares
                sums = np.rint(np.hstack([moved, squares - begin.value[1]]) * _POINT).astype(np.int64)
                return sums if total is None else total + sums

            for b in batches:
                for s, codes in zip(b.column("shard").to_pylist(), b.column("codes").to_pylist()):
                    if s != shard:
                        if own is not None:
                            total = ended()
                        shard, own, held, size, part, m = s, Model(*sent.value).take(*begin.value), [], 0, 0, m + 1
                    held.append(np.frombuffer(codes, np.int32))
                    size, n = size + len(held[-1]), n + len(held[-1])
                    if size >= _BUFFER:
                        learned()
                        held, size, part = [], 0, part + 1
            if own is not None:
                total = ended()
                values = np.concatenate([[n, m], total.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["i", "v"])

        inside = [F.col("h") >= low] * (low is not None) + [F.col("h") < high] * (high is not None)
        mine = rows.filter(functools.reduce(lambda x, y: x & y, inside, F.lit(True))).repartition(tasks, "shard").coalesce(tasks).sortWithinPartitions("shard", "h", "doc_id")
        sums = mine.mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # as many rows as two models have numbers
        if len(sums):
            got = np.empty(len(sums), np.int64)
            got[sums["i"].to_numpy()] = sums["v"].to_numpy()
            n, m, at, before = *got[:2].tolist(), got[2:].reshape(-1, 2 * width) / _POINT, seen
            seen = np.maximum(before + at[:, width:], 1e-9)  # rows are padded with zeros
            added = np.maximum(m * before + at[:, width:], 1e-9) / seen  # sums of the weights of m shards
            move = at[:, :width] / seen * np.minimum(1, max(1, STALE * MINIBATCH * m / n) / added)
            velocity = MOMENTUM * velocity + move
            model.take(model.rows() + STEP * (MOMENTUM * velocity + move))
        begin.unpersist()
    return model


def score(documents: DataFrame, classes: int = CLASSES, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of documents."""
    import numpy as np
    import pyarrow as pa

    spark = documents.sparkSession
    common.batches(spark)
    rows = _rows(documents)
    counts = token_counts(rows.filter("fold <> 1"))
    vocabulary = Vocabulary(counts, classes, HEAD)
    coded = encoded(rows, vocabulary)
    model = train(coded, vocabulary, shards, rounds)
    sent = spark.sparkContext.broadcast((vocabulary.freq, vocabulary.log_weights, model.rows(), model.normalisers(model.parts())))

    def run(batches):
        freq, log_weights, params, log_z = sent.value
        own = Model(freq, log_weights).take(params)
        parts = own.parts()
        for b in batches:
            lengths = b.column("n_tokens").to_numpy()
            score = np.zeros(len(b))
            if len(b):
                classes, groups = classes_of(np.concatenate([np.frombuffer(x, np.int32) for x in b.column("codes").to_pylist()]))
                before = own.contexts(classes, lengths)
                p = own.log_probabilities(classes, before, parts, log_z).astype(np.float64) + own.log_within(classes, before, groups)
                score = np.add.reduceat(p, np.cumsum(lengths) - lengths) / np.log(10)  # each text has its end token
            names = ["row", "doc_id", "fold", "n_tokens", "n_known", "known_share", "rare_share"]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(score)], [*names, "model"])

    scored = coded.drop("h", "tail").select("row", "doc_id", "fold", "n_tokens", "n_known", "known_share", "rare_share", "codes")
    scored = scored.mapInArrow(run, "row long, doc_id long, fold long, n_tokens long, n_known long, known_share double, rare_share double, model double")
    tail = coded.select("row", F.explode("tail").alias("t")).join(counts, F.col("t") == counts["token"], "left")
    tail = tail.groupBy("row").agg(F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("share"))
    share, base_den = F.coalesce("share", F.lit(0.0)), vocabulary.total + 0.5 * (vocabulary.distinct + 1)
    return scored.join(tail, "row", "left").select(
        "doc_id", (F.col("fold") == 1).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("known_share") + share - F.col("n_tokens") * F.lit(float(np.log10(base_den)))).alias("base_score"),
        (F.col("model") + F.col("rare_share") + share).alias("score"),
    )


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
