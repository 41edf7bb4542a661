"""Token counts by a compiled finite-state tokenizer.

Byte-pair encoding has a property that makes it finite-state: the encoding of every prefix of a text ends in just one token that
may follow the token where it starts, and whether two tokens may stand side by side is a fact of the vocabulary (their
joint encoding is these two). So a deterministic transducer reads characters; its state holds the suffixes of what it
has read that a longer token may still begin with, each with the token before it and the count there. A transition
is annotated with the change in the number of tokens of the prefix read so far, so the counts of a text sum up to its number of
tokens. Where two characters stand side by side in no token, the state is the start state whatever came before.

States are compiled when they are first met, as there are far more of them than a corpus visits; a full table is dropped and
built again. Texts are cut into chunks of equal length, which run side by side, one numpy operation for each
character of all chunks. A chunk's state map is constant from its first start state on, so that tail runs at once, and the head waits for its
entry, the end of the chunk before. Chunks without a start state have a state map over the few states that can stand before them:
each starts with the state that the characters before it lead to from the start state, and passes the ends it finds on to the next chunk as
entries, until all ends are entries that the next one knows; equal chunks share one map. These maps are composed by a parallel prefix scan, in as many rounds as the logarithm
of their number, which gives each chunk its entry. Should the maps need more than MOST_ENTRIES states, the rest runs chunk after chunk.

Texts are counted in batches of BATCH_CHARS characters; a longer text is cut where the start state stands whatever came before.

Models: byte-pair models of the sentencepiece library with the identity normaliser (a dummy prefix is handled), without
user-defined symbols; others are refused. Defined results: null text is empty; an empty text has no tokens; repeated rows
each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
CHUNK = 384
BATCH_CHARS = 4_000_000
TABLE_CELLS = 36_000_000
MOST_ENTRIES = 256
LEAD = 64


class Transducer:
    def __init__(self, path: str):
        import numpy as np
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, model.SentencePiece
        if model.trainer_spec.model_type != model.trainer_spec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not model.trainer_spec.byte_fallback or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: not a byte-fallback BPE model with the identity normaliser")
        pieces = sorted((p for p in model.pieces if p.type == kinds.NORMAL), key=lambda p: -p.score)
        self.prefix = norm.add_dummy_prefix
        self.rank = {p.piece: i for i, p in enumerate(pieces)}
        chars = {c for p in self.rank for c in p}
        self.cost = {p: 1 for p in self.rank} | {c: len(c.encode()) for c in chars if c not in self.rank}
        self.cost = {p: n for p, n in self.cost.items() if len(p) < 3 or self._merge(p) == [p]}
        self.begins = {p[:i] for p in self.cost for i in range(1, len(p))}
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        # Classes of characters: 1 to 4 for those in no pair, by their number of tokens; each of the others has its own.
        paired = sorted({c for p in self.pairs for c in p})
        self.kind = np.full(0x110000, 0, np.int16)
        self.kind[:0x80], self.kind[0x80:0x800], self.kind[0x800:0x10000], self.kind[0x10000:] = 1, 2, 3, 4
        for c in self.rank:
            if len(c) == 1:
                self.kind[ord(c)] = 1
        self.char = ["", "\0", "\0\0", "\0\0\0", "\0\0\0\0", *paired]
        for i, c in enumerate(paired):
            self.kind[ord(c)] = i + 5
        self.kind[ord(" ")] = self.kind[ord(SPACE)]
        number = {c: i + 5 for i, c in enumerate(paired)}
        self.joined = np.zeros((len(self.char), len(self.char)), bool)
        for p in self.pairs:
            self.joined[number[p[0]], number[p[1]]] = True
        self.halves: dict[str, tuple[str, str]] = {}
        for p in self.cost:
            if len(p) > 1:
                self.halves[p] = self._halves(p)
        self.spines: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.column = np.full(len(self.char), -1, np.int32)
        self.classes: list[int] = []
        self.width = 64
        self.states: list[tuple] = [((("", None, 0)),)]
        self.number = {self.states[0]: 0}
        self.table = np.full((1024, self.width), -1, np.int32)

    def _merge(self, text: str) -> list[str]:
        """The encoding of a short text by its definition."""
        part = list(text)
        while True:
            best = min(((self.rank.get(part[i] + part[i + 1], 1 << 30), i) for i in range(len(part) - 1)), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return part
            part[best[1] : best[1] + 2] = [part[best[1]] + part[best[1] + 1]]

    def _halves(self, piece: str) -> tuple[str, str]:
        """What the last merge that makes a piece joins. Both are older than the piece, so ranks rise along a spine."""
        part = list(piece)
        while len(part) > 2:
            _, i = min((self.rank.get(part[i] + part[i + 1], 1 << 30), i) for i in range(len(part) - 1))
            part[i : i + 2] = [part[i] + part[i + 1]]
        a, b = part
        if any(len(x) > 1 and self.rank[x] >= self.rank[piece] for x in part):
            raise ValueError(f"{piece!r} is older than its parts")
        return a, b

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The pieces at a token's right (1) or left (0) end as it is built, each with the rank of the merge that ends it."""
        if (found := self.spines.get((token, side))) is None:
            chain = [(token, 1 << 30)]
            while len(chain[-1][0]) > 1:
                whole = chain[-1][0]
                chain.append((self.halves[whole][side], self.rank[whole]))
            found = self.spines[token, side] = chain[::-1]
        return found

    def _follows(self, a: str | None, b: str) -> bool:
        """Whether a and b stay apart: at no time would a merge over their border be the next one."""
        if a is None:
            return True
        if (found := self.fits.get((a, b))) is None:
            left, right, i, j, found = self._spine(a, 1), self._spine(b, 0), 0, 0, True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                # Of equal ranks the leftmost goes first: a's own before the border's, the border's before b's own.
                if (over := self.rank.get(x + y)) is not None and over < x_ends and over <= y_ends:
                    found = False
                    break
                if x_ends == y_ends == 1 << 30:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[a, b] = found
        return found

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """The next state, and the change in the number of tokens."""
        if len(state) > 1 and state[0][0][-1] + char not in self.pairs:
            state = self.states[0]
        if char[0] == "\0":
            return self.states[0], len(char)
        for begun, before, count in state:
            if (token := begun + char) in self.cost and self._follows(before, token):
                change = count + self.cost[token]
                break
        else:
            raise AssertionError("every character is a token")
        left = [(u + char, before, count - change) for u, before, count in state if u + char in self.begins]
        return ((*left, ("", token, 0)) if left else self.states[0]), change

    def compile(self, state: int, column: int) -> None:
        import numpy as np

        after, change = self.step(self.states[state], self.char[self.classes[column]])
        if (n := self.number.get(after)) is None:
            n = self.number[after] = len(self.states)
            self.states.append(after)
            if n >= len(self.table):
                self.table = np.concatenate([self.table, np.full((max(1024, n // 4), self.width), -1, np.int32)])
        self.table[state, column] = n << 8 | change + 128

    def columns(self, kinds):
        """Table columns of classes; new classes get new columns."""
        import numpy as np

        for k in np.flatnonzero((np.bincount(kinds, minlength=len(self.char)) > 0) & (self.column < 0)):
            self.column[k] = len(self.classes)
            self.classes.append(int(k))
        if (more := len(self.classes) - self.width) > 0:
            more = (more + 15) // 16 * 16
            self.table = np.concatenate([self.table, np.full((len(self.table), more), -1, np.int32)], axis=1)
            self.width += more
        return self.column[kinds]

    def walk(self, columns, starts, ends, states, changes=None):
        """Runs the transducer over columns[start:end] of all chunks side by side: their last states and, without changes to write to,
        the sums of the changes in the number of tokens."""
        import numpy as np

        out, sums = states.astype(np.int64).copy(), np.zeros(len(starts), np.int64)
        live = np.flatnonzero(starts < ends)
        at, end, now = starts[live].copy(), ends[live], out[live]
        shortest = int((end - at).min()) if len(live) else 0
        t = 0
        while len(live):
            column = columns[at]
            got = self.table.ravel()[now * self.width + column]
            while (got < 0).any():
                miss = got < 0
                for pair in set((now[miss] * self.width + column[miss]).tolist()):
                    self.compile(*divmod(pair, self.width))
                got = self.table.ravel()[now * self.width + column]
            change = (got & 255) - 128
            if changes is None:
                sums[live] += change
            else:
                changes[at] = change
            now = (got >> 8).astype(np.int64)
            at += 1
            t += 1
            if t >= shortest:
                done = at >= end
                if done.any():
                    out[live[done]] = now[done]
                    left = ~done
                    live, at, end, now = live[left], at[left], end[left], now[left]
                    shortest = t + (int((end - at).min()) if len(live) else 0)
        return out, sums

    def entries(self, columns, starts, ends, settled, last):
        """The entry states of the chunks that are not settled, by composing state maps; -1 where their maps need too many states. last has
        the ends of the settled ones."""
        import numpy as np

        n = len(starts)
        out = np.full(n, -1, np.int64)
        open_ = np.flatnonzero(~settled)
        # Equal chunks have one map; next_ are the pairs of chunks that follow each other.
        rows = np.zeros((len(open_), CHUNK), columns.dtype)
        for i, (a, b) in enumerate(zip(starts[open_].tolist(), ends[open_].tolist())):
            rows[i, : b - a] = columns[a:b] + 1
        _, sample, kind = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        kind, sample = kind.ravel(), open_[sample]
        follows = np.flatnonzero(open_[1:] == open_[:-1] + 1)
        next_ = np.unique(np.stack([kind[follows], kind[follows + 1]], axis=1), axis=0)
        # What the characters before a chunk lead to is its first guess; it is the entry itself behind a start state that near.
        guess, _ = self.walk(columns, np.maximum(starts[open_] - LEAD, 0), starts[open_], np.zeros(len(open_), np.int64))
        is_first = settled[open_ - 1]
        first = open_[is_first]
        true = last[first - 1]
        chunk, state = np.concatenate([kind, kind[is_first]]), np.concatenate([guess, true])
        number: dict[int, int] = {}
        known = np.zeros((len(sample), 0), bool)
        moves: list[tuple] = []
        while len(chunk):
            for x in np.unique(state).tolist():
                number.setdefault(x, len(number))
            if len(number) > MOST_ENTRIES:
                return out
            known = np.hstack([known, np.zeros((len(sample), len(number) - known.shape[1]), bool)])
            column = np.array([number[x] for x in state.tolist()], np.int64)
            pair = np.unique((chunk * len(number) + column)[~known[chunk, column]])
            chunk, column = pair // len(number), pair % len(number)
            known[chunk, column] = True
            end, _ = self.walk(columns, starts[sample[chunk]], ends[sample[chunk]], np.array(list(number), np.int64)[column])
            moves.append((chunk, column, end))
            at, behind = np.searchsorted(next_[:, 0], chunk), np.searchsorted(next_[:, 0], chunk, side="right")
            of = np.repeat(np.arange(len(chunk)), behind - at)
            chunk, state = next_[np.arange(len(of)) - np.repeat(np.cumsum(behind - at) - behind, behind - at), 1], end[of]
        for x in np.unique(np.concatenate([m[2] for m in moves])).tolist():
            number.setdefault(x, len(number))
        # Row i maps entries of chunk i to its ends; a chunk after a settled one maps all to what its true entry gives.
        of_kind = np.full((len(sample), len(number)), -1, np.int64)
        for chunk, column, end in moves:
            of_kind[chunk, column] = [number[x] for x in end.tolist()]
        maps = np.full((n, len(number)), -1, np.int64)
        maps[open_] = of_kind[kind]
        for i, x in zip(first.tolist(), true.tolist()):
            maps[i] = maps[i, number[x]]
            out[i] = x
        d = 1
        start_of = np.zeros(n, np.int64)
        start_of[first] = first
        start_of = np.maximum.accumulate(start_of)
        while d < n:
            again = open_[open_ - d >= start_of[open_]]
            if not len(again):
                break
            before = maps[again - d]
            made = np.where(before >= 0, np.take_along_axis(maps[again], np.maximum(before, 0), axis=1), -1)
            maps[again] = made
            d *= 2
        rest = np.setdiff1d(open_, first)
        names = np.array(list(number), np.int64)
        # After the scan a chunk's map is that of all its run so far, so it is constant: any column that is known tells its end.
        out[rest] = names[maps[rest - 1].max(1)]
        return out

    def pieces(self, text: str) -> list[str]:
        """A long text cut into pieces of about BATCH_CHARS characters where the start state stands whatever came before."""
        import numpy as np

        out = []
        while len(text) > 2 * BATCH_CHARS:
            at, step = BATCH_CHARS, 1 << 12
            while at < len(text):
                kinds = self.kind[np.frombuffer(text[at - 1 : at + step].encode("utf-32-le", "surrogatepass"), "<u4")]
                if len(cut := np.flatnonzero(~self.joined[kinds[:-1], kinds[1:]])):
                    at += int(cut[0])
                    break
                at += step
            if at >= len(text):
                break
            out.append(text[:at])
            text = text[at:]
        return [*out, text]

    def counts(self, texts: list[str]):
        """Number of tokens of each text; only texts that are not cut from another have the prefix."""
        import numpy as np

        if len(texts) == 1 and len(cut := self.pieces(texts[0])) > 1:
            # The prefix counts for the first piece only, and the others start where it would change nothing.
            return np.array([sum(int(self._counts([x], i == 0)[0]) for i, x in enumerate(cut))])
        return self._counts(texts, True)

    def _counts(self, texts: list[str], whole: bool):
        import numpy as np

        if self.table.size > TABLE_CELLS:
            self.clear()
        first = SPACE if self.prefix and whole else ""
        codes = np.frombuffer("".join(first + t + "\0" if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(t) + len(first) + 1 if t else 0 for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        if not len(codes):
            return lengths
        kinds = self.kind[codes]
        kinds[bounds[1:][lengths > 0] - 1] = 1  # what parts texts is a character that stands in no pair, and does not count
        columns = self.columns(kinds)
        fresh = np.ones(len(codes), bool)  # the start state stands before this character
        fresh[1:] = ~self.joined[kinds[:-1], kinds[1:]]
        fresh[bounds[:-1][lengths > 0]] = True
        changes = np.zeros(len(codes), np.int16)
        starts = np.arange(0, len(codes), CHUNK)
        ends = np.minimum(starts + CHUNK, len(codes))
        known = np.flatnonzero(fresh)
        k = np.searchsorted(known, starts)
        tails = np.minimum(np.where(k < len(known), known[np.minimum(k, len(known) - 1)], len(codes)), ends)
        last, _ = self.walk(columns, tails, ends, np.zeros(len(starts), np.int64), changes)
        settled = tails < ends
        settled[0] = True  # a text starts there
        if not settled.all():
            entry = self.entries(columns, starts, ends, settled, last)
        else:
            entry = np.full(len(starts), -1, np.int64)
        heads = np.flatnonzero(tails > starts)
        at = heads[(entry[heads] >= 0) & ~settled[heads]]
        last[at], _ = self.walk(columns, starts[at], ends[at], entry[at], changes)
        done = settled.copy()
        done[at] = True
        for i in np.flatnonzero(~done).tolist():  # only if there were too many states
            last[i : i + 1], _ = self.walk(columns, starts[i : i + 1], ends[i : i + 1], last[i - 1 : i], changes)
        at = heads[settled[heads]]
        self.walk(columns, starts[at], tails[at], last[at - 1], changes)
        changes[bounds[1:][lengths > 0] - 1] = 0
        total = np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]


_made: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _made:
        _made.clear()
        _made[path] = Transducer(path)
    return _made[path]


def count_tokens(documents: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of documents."""
    import pyarrow as pa

    common.batches(documents.sparkSession)
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def run(batches):
        import numpy as np

        ids, texts, size = [], [], 0

        def flush():
            n = transducer(model).counts(texts)
            sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(n), pa.array(n > limit)], names)

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if ids and size + len(t or "") > BATCH_CHARS:
                    yield flush()
                    ids, texts, size = [], [], 0
                ids.append(d)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= BATCH_CHARS:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    rows = common.pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_count(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
