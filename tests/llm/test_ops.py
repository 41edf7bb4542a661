"""Each operator against a brute-force version or an exact round trip, and its defined results for odd rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import chat_format, common, decontam, language_id, lm_score, mixing, quality_rules, simhash_dedup, suffix_dedup, token_count, token_output

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, parts=3):
    """Documents with a clashing extra column or two."""
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA).repartition(parts)
    return df.select("*", F.lit(1).alias("size"), F.lit("x").alias("k1"), F.lit("other").alias("TEXT"), F.lit(0).alias("n_words"), F.lit(1).alias("source_size"))


def some_documents(seed=0, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioustrnéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = sentence(60)
    rows = []
    for i in range(n):
        t = ".\n".join(sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))
        kind = rng.random()
        if rows and kind < 0.15:
            t = rng.choice(rows)[1] or ""
        elif rows and kind < 0.3:
            w = (rng.choice(rows)[1] or "x").split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind < 0.4:
            t = sentence(5) + passage + sentence(5)
        rows.append((i, t, rng.choice(["en", "fr"]), rng.choice(["s1", "s2", "s3", None])))
    return [*rows, (n, None, None, None), (n + 1, "", "en", "s1"), (n + 2, " \n\t", "fr", "s9"), (None, "no id here at all", "en", "s1"), (3, rows[3][1], "en", "s2"), (5, "again five", "en", "s2"), (n + 3, "x" * 3000 + " end", "en", "s4")]


@pytest.fixture(scope="module")
def rows():
    return some_documents()


@pytest.fixture(scope="module")
def documents(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark, documents):
    return documents.limit(0)


def counted(rows):
    return Counter(map(tuple, rows))


def from_sql(sql, **tables):
    """Rows of DuckDB SQL over rows of documents and the like, as a multiset, columns by name."""
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    for name, (columns, data) in tables.items():
        c.register(name, pd.DataFrame(data, columns=columns).convert_dtypes())
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(r[i] for i in order) for r in got.fetchall())


def from_spark(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


DOCUMENTS = ["doc_id", "text", "lang", "source"]


# 1


HARD = ["", "<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "a<", "<|", "\\", "<\\\\|x", "é😀\n", "<|im_end", "%0A"]


def test_chat_turns_come_back():
    rng = random.Random(1)
    for _ in range(300):
        turns = [("".join(rng.choices(["user", "assistant", "\n", "<|im_end|>", "%", "<"], k=rng.randint(0, 3))), "".join(rng.choices(HARD, k=rng.randint(0, 4)))) for _ in range(rng.randint(0, 4))]
        whole = "".join(chat_format.render_turn(*t) for t in turns)  # a conversation as one text
        assert [t[:2] for t in chat_format.parse(whole)] == turns
    with pytest.raises(chat_format.GrammarError):
        chat_format.parse("<|im_start|>user\nno end")


def test_chat_digests(spark):
    turns = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "assistant", "x"), (2, 5, "assistant", "é"), (2, 5, "assistant", "é")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("block"), F.lit(2).alias("Role"))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("\n\nuser\na\nassistant\nb<|im_end|>\n")
    assert got[1]["loss_chars"] == 11 and got[1]["loss_sha256"] == sha("b<|im_end|>")
    assert got[2]["n_turns"] == 2 and got[2]["loss_sha256"] == sha("éé") and got[None]["n_turns"] == 1
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


# 2


def brute_contamination(text, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, own = word(text), set(), set()
    for item, t in items:
        x = word(t)
        for i in range(max(1, len(x) - 9) if x else 0):
            win = x[i : i + 10]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    own.add(str(item))
    return len(w), len(hit), sorted(own)


@pytest.mark.parametrize("block_bytes", [1 << 19, 200])
def test_contamination(spark, documents, rows, block_bytes):
    rng = random.Random(5)
    texts = [t for _, t, _, _ in rows if t and len(t.split()) > 12]
    items = [(i, " ".join(rng.choice(texts).split()[3:14]).upper() + "!") for i in range(12)] + [(20, "again, FIVE"), (21, None), (22, "..."), (23, "again five")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_contamination(documents, bench, block_bytes=block_bytes).collect()
    want = counted((i, *brute_contamination(t, items)[:2], ",".join(brute_contamination(t, items)[2])) for i, t, _, _ in rows)
    assert counted((r["doc_id"], r["n_words"], sum(x["behind"] - x["first"] for x in r["hit_words"]), ",".join(r["items"])) for r in got) == want
    text = {i: t for i, t, _, _ in rows}
    spans = [(r["doc_id"], s) for r in got for s in r["hit_bytes"] if r["doc_id"] == 5]
    assert spans and text[5].encode()[spans[0][1]["start"] : spans[0][1]["end"]].decode() == "again five"
    kept = decontam.drop_contaminated(documents, bench, block_bytes=block_bytes)
    assert kept.columns == documents.columns and kept.count() == sum(n for (_, _, h, _), n in want.items() if not h)
    assert decontam.find_contamination(documents, bench.limit(0)).filter("size(items) > 0").count() == 0
    assert decontam.find_contamination(documents.limit(0), bench).count() == 0


# 3


def test_scores(documents, rows, empty, monkeypatch):
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    counts = Counter(w for i, t, _, _ in rows if not held(i) for w in tokens(t))
    total, den = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    monkeypatch.setattr(lm_score, "HEAD", 150)
    # The model as fitted, in plain Python.
    some = common.staged(lm_score._rows(documents), "t")
    vocabulary = lm_score.Vocabulary(lm_score.token_counts(some.filter("fold <> 1")), 64, 150)
    m = lm_score.train(lm_score.encoded(some, vocabulary), vocabulary, rounds=3)
    number, shared = {w: lm_score.BUCKETS + i for i, w in enumerate(vocabulary.named)}, lm_score.BUCKETS * lm_score.GROUPS
    cell = {w: divmod(lm_score.cell(w), lm_score.GROUPS) for i, t, _, _ in rows for w in tokens(t) if w not in number}
    mass = np.zeros((lm_score.BUCKETS, lm_score.GROUPS)) + 0.5
    for w, c in counts.items():
        if w not in number:
            mass[cell[w]] += c + 0.5
    r, q, c, u = (x.astype(float) for x in (m.r, m.q, m.c, m.u))

    def brute(t):
        before, out = [len(q)] * lm_score.CONTEXT, 0.0
        for w in tokens(t):
            k = number.get(w, cell.get(w, (0,))[0])
            ctx = sum(r[h] * x for h, x in zip(before, c))
            s = q @ ctx + m.b
            p = np.exp(s[k]) / np.exp(s).sum()
            if w not in number:
                inside = mass[k] * np.exp(u @ ctx)
                p *= inside[cell[w][1]] / inside.sum() * (counts[w] + 0.5) / mass[cell[w]]
            out += np.log10(p)
            before = [k, *before[:-1]]
        return out

    want = counted((i, held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), total, round(sum(np.log10((counts[w] + 0.5) / den) for w in tokens(t)), 5), round(brute(t), 1)) for i, t, _, _ in rows)
    for parts in (1, 7):
        got = lm_score.score(documents.repartition(parts), classes=64, rounds=3).collect()
        assert counted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 1)) for r in got) == want
    assert shared and lm_score.score(empty, classes=64).count() == 0


def test_scores_do_not_depend_on_partitions_and_beat_the_base(spark):
    rng = random.Random(7)
    tongues = [["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) + end for _ in range(400)] for letters, end in (("aeiou", "s"), ("bcdfg", "um"), ("xyzw", "ka"))]
    docs = [(i, " ".join(rng.choices(rng.choice(tongues), k=120)), "en", "s") for i in range(900)]
    docs += docs[:40] + [(2000, " ".join(rng.choices(tongues[0], k=150_000)), "en", "s")]
    by = []
    for parts in (1, 16):
        got = lm_score.score(frame(spark, docs, parts), classes=64, shards=8, rounds=12).collect()
        by.append(sorted((r["doc_id"], r["score"]) for r in got))
        out = [r for r in got if r["held_out"] and r["doc_id"] < 900]
        assert sum(r["score"] - r["base_score"] for r in out) / sum(r["n_tokens"] for r in out) > 0.25
    assert by[0] == by[1]


def some_model(classes=20, counts=None):
    freq = np.concatenate([np.arange(1, lm_score.BUCKETS + 1) % 7, np.random.default_rng(0).integers(1, 50, classes)])
    return lm_score.Model(freq, np.log(np.ones((lm_score.BUCKETS, lm_score.GROUPS)) if counts is None else counts))


def test_probabilities_are_normalised():
    m = some_model()
    words = (lm_score.BUCKETS + np.arange(20).repeat(30) % 20).astype(np.int32)
    before, none = m.contexts(words, [300, 300]), np.full(600, -1)
    score = lambda w, h: m.log_probabilities(w, h, m.parts(), m.normalisers(m.parts())).astype(float)
    first = -score(words, before).mean()
    for i in range(8):
        m.train(words, before, 0.3, i, none)
    assert -score(words, before).mean() < first - 0.5
    every = np.arange(len(m.q))
    for h in (before[0], before[7], before[301]):
        assert np.exp(score(every, np.tile(h, (len(every), 1)))).sum() == pytest.approx(1, abs=1e-4)


def test_words_of_one_class_are_learned_apart():
    counts = np.arange(1, lm_score.BUCKETS * lm_score.GROUPS + 1).reshape(lm_score.BUCKETS, -1) % 5 + 1.0
    m = some_model(counts=counts)
    words = np.random.default_rng(0).permutation(np.arange(20).repeat(30)).astype(np.int32)
    before = m.contexts(words, [600])
    groups = before[:, 0] % 2
    first = -m.log_within(words, before, groups).mean()
    for i in range(20):
        m.train(words, before, 0.3, i, groups)
    assert -m.log_within(words, before, groups).mean() < first - 0.5
    every = np.arange(lm_score.GROUPS)
    at = np.zeros(len(every), int)
    assert (np.exp(m.log_within(words[at], before[at], every).astype(float)) * counts[words[0]]).sum() == pytest.approx(1, abs=1e-5)


def test_words_at_once():
    rng = random.Random(4)
    texts = [b"", b"  ", b"a", "É\x00 x\x00\x00 x\x00 \u3000é A\tb\x0bC\x1cd".encode(), b"0123456789abcdef 0123456789abcdefg " * 3]
    texts += ["".join(rng.choices("abAB\x00 é\n", k=rng.randint(0, 60))).encode() for _ in range(300)]
    words = lm_score.Words(texts)
    every = [w for t in texts for w in lm_score.tokens(t)[:-1]]
    assert words.slices(np.arange(len(words.doc))) == every and words.counts() == Counter(every)
    assert words.doc.tolist() == [i for i, t in enumerate(texts) for _ in lm_score.tokens(t)[:-1]]
    named = list(dict.fromkeys(every))[::2]
    assert lm_score.Places(named).find(words).tolist() == [named.index(w) if w in named else len(named) for w in every]
    assert lm_score.Places([]).find(words).tolist() == [0] * len(every)


def test_cells_agree(spark):
    words = [b"", b"a", b"ab", b"abc", "é".encode(), b"stonston", b"\n"]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "token binary")
    assert [r[0] for r in df.select(lm_score.cell_column(F.col("token"))).collect()] == [lm_score.cell(w) for w in words]


# 4


def test_mix(documents, rows, empty, spark):
    plan = mixing.plan_mix(mixing.sized(common.pick(documents, "doc_id", "text", "source"), "doc_id", "text"))
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, clamped = {}, set()
    while True:
        free = [s for s in names if s not in clamped]
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in clamped)
        target = {s: 2.0 * size[s] if s in clamped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        if not (over := {s for s in free if target[s] > 2 * size[s]}):
            break
        clamped |= over
    got = {r["source"]: r for r in plan.collect()}
    assert {s: round(r["target"], 6) for s, r in got.items()} == {s: round(x, 6) for s, x in target.items()}
    taken = lambda: counted((r["source"], r["text"]) for r in common.pick(mixing.mix(documents), "source", "text").collect())
    once = taken()
    assert once == taken()
    words = defaultdict(int)
    for (s, t), n in once.items():
        words[s] += n * len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(abs(words[s] - target[s]) <= 40 for s in names)
    have = Counter((s, t) for _, t, _, s in rows)
    assert all(n <= 2 * have[k] for k, n in once.items())
    assert mixing.mix(empty).count() == 0 and mixing.mix(documents).columns == documents.columns
    assert from_spark(mixing.taken_words(documents)) == from_sql(mixing.ORACLE_SQL, documents=(DOCUMENTS, rows))
    assert mixing.taken_words(empty).count() == 0


def test_mix_of_repeated_rows(spark, monkeypatch):
    rows = [(1, "five words are in here", "en", "s1")] * 1000 + [(2, "x " * 7, "en", "s2")] * 40 + [(1000 + i, "y " * (i % 50), "en", "s3") for i in range(400)] + [(5, "z " * 1000, "en", "s4")] * 3
    df = frame(spark, rows, 7)
    for broadcast in (mixing.MOST_SOURCES, 0):
        monkeypatch.setattr(mixing, "MOST_SOURCES", broadcast)
        got = mixing.taken_words(df)
        assert from_spark(got) == from_sql(mixing.ORACLE_SQL, documents=(DOCUMENTS, rows))
        for r in got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("size"), F.count(F.when(F.col("taken") > 2 * F.col("size"), 1)).alias("over")).collect():
            assert abs(r["taken"] - r["target"]) <= r["size"] / 2 + 25 and r["over"] == 0
    n = mixing.mix(df).filter("doc_id = 1").count()
    assert n == next(r["t"] for r in got.filter("doc_id = 1").agg((F.sum("taken") / 5).alias("t")).collect())


@pytest.mark.parametrize("table", [[], [(1, None, None, None)], [(1, "", "en", "a"), (2, None, "en", None)]])
def test_mix_without_words(spark, table):
    got = mixing.taken_words(frame(spark, table)).collect()
    assert len(got) == len(table) and all(r["taken"] == r["target"] == 0 for r in got)


def test_mix_keeps_off_python(documents):
    plan = mixing.mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 5


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash_dedup.covering_masks()
    rng = random.Random(3)
    assert len(masks) == 31
    for _ in range(5000):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not d & m for m in masks) and any(not d & m for m in simhash_dedup.covering_masks(depth=2))


def test_near_duplicates(documents, rows, empty, monkeypatch):
    import xxhash

    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t, _, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min([r[0] for r, x in zip(rows, group) if x == g and r[0] is not None], default=None) for g in group}
    got = simhash_dedup.grouped(common.staged(simhash_dedup.fingerprints(documents), "t")).collect()
    assert counted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == counted((r[0], f, least[g]) for r, f, g in zip(rows, fps, group))
    monkeypatch.setattr(simhash_dedup.fingerprint_links, "__defaults__", (simhash_dedup.RADIUS, 2, 1_000_000))
    again = simhash_dedup.grouped(common.staged(simhash_dedup.fingerprints(documents), "t")).collect()
    assert counted((r["doc_id"], r["component_id"]) for r in again) == counted((r["doc_id"], r["component_id"]) for r in got)
    kept = simhash_dedup.keep_one(documents)
    assert kept.columns == documents.columns and kept.count() == len(set(group))
    assert simhash_dedup.keep_one(empty).count() == 0


def connected(n, links):
    label = list(range(n))
    for a, b in links:
        if label[a] != label[b]:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("hot", [simhash_dedup.HOT, 5])
def test_large_buckets_are_dealt_again(spark, hot):
    rng = random.Random(6)
    fps = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in (0, 1 << 63, (1 << 64) - 1, 0x0F0F0F0F0F0F0F0F) for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash_dedup.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), hot=hot, most_broadcast=3).collect()
    at = {f: i for i, f in enumerate(signed)}
    every = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert all((r["a"] ^ r["b"]).bit_count() <= 4 or ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 4 for r in links)
    same = lambda x: [[a == b for b in x] for a in x]
    assert same(connected(len(fps), [(at[r["a"]], at[r["b"]]) for r in links])) == same(connected(len(fps), every))


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(40)]])
    edges = simhash_dedup.forest(fps)
    assert len(edges) == len(fps) - 40 and all(int(fps[a] ^ fps[b]).bit_count() <= 4 for a, b in edges)


# 6


def test_quality_counts(documents, rows, empty):
    def base(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = Counter(grams)
        hit = {k for i, g in enumerate(grams) if often[g] > 1 for k in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    odd = [(900, "a b c\na b c\n#x ##\n" * 9, "en", "s1"), (901, "one two three four five six seven eight nine " * 3, "en", "s1"), (902, "word " * 40_000 + "\n" + "\u3000é #", "en", "")]
    every = documents.union(frame(documents.sparkSession, odd))
    got = quality_rules.verdicts(every).collect()
    assert counted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == counted((i, *base(t)) for i, t, _, _ in [*rows, *odd])
    for limit in (2, 8):
        assert from_spark(quality_rules.verdicts(every, limit=limit)) == from_sql(quality_rules.oracle_sql(limit), documents=(DOCUMENTS, [*rows, *odd]))
    for most in (quality_rules.MOST_BROADCAST, 0):
        kept = quality_rules.keep_good(documents, limit=3, most_broadcast=most)
        assert kept.columns == documents.columns and kept.count() == sum(r["kept"] for r in quality_rules.verdicts(documents, limit=3).collect())
    assert quality_rules.keep_good(empty).count() == 0 and quality_rules.verdicts(empty).count() == 0


def plain_cleaning(rows, limit):
    """Texts by row without the lines that more than limit distinct texts of a host have."""
    form = lambda line: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
    having = defaultdict(set)
    for i, t, _, s in rows:
        for line in (t or "").split("\n"):
            if w := form(line):
                having[s, tuple(w)].add(t)
    often = {k for k, v in having.items() if len(v) > limit}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, tuple(form(x))) not in often) for i, t, _, s in rows]


def test_frequent_lines_are_removed(spark, documents, rows):
    rng = random.Random(2)
    odd = [(2000 + i, "\n".join(["Home 1", "own words " + str(rng.random()) + "\u3000é" * 20, "  HOME \t 2", "", "Home 1 ", "more of its own " * 3]), "en", "menus") for i in range(12)] + [(2100, "home 3\r\nx", "en", None), (2101, "Home 1", "en", "other")]
    every, limit = documents.union(frame(spark, odd)), 5
    want = [(r[0], x) for r, x in zip([*rows, *odd], plain_cleaning([*rows, *odd], limit))]
    for most in (quality_rules.MOST_BROADCAST, 0):
        got = quality_rules.cleaned(every, limit=limit, most_broadcast=most)
        assert got.columns == every.columns
        assert counted(map(tuple, common.pick(got, "doc_id", "text").collect())) == counted(want)
    assert sum(x != r[1] for r, (_, x) in zip([*rows, *odd], want)) >= 12 and "home" not in next(x for i, x in want if i == 2003).lower()
    good = {i for i, k in ((r["doc_id"], r["kept"]) for r in quality_rules.verdicts(every, limit=limit).collect()) if k}
    kept = common.pick(quality_rules.keep_good(every, limit=limit), "doc_id", "text").collect()
    assert {r["doc_id"] for r in kept} == good and all((r["doc_id"], r["text"]) in set(want) for r in kept)


def test_lines_counted_by_id(spark):
    """Copies of one page count one by one when documents are told apart by id."""
    rows = [(i, "the menu of this host has these words\n" + "and a text that all copies of it have, long enough to be kept by the rule on its words " * 2, "en", "h") for i in range(9)]
    df = frame(spark, rows)
    assert not any(r["removed_words"] for r in quality_rules.verdicts(df, limit=5).collect())
    assert all(r["removed_words"] == r["n_words"] for r in quality_rules.verdicts(df, limit=5, by_id=True).collect())
    assert from_spark(quality_rules.verdicts(df, limit=5, by_id=True)) == from_sql(quality_rules.oracle_sql(5, by_id=True), documents=(DOCUMENTS, rows))
    assert quality_rules.keep_good(df, limit=5, by_id=True).count() == 0


@pytest.mark.parametrize("own", [1, 2, 4, 12])
def test_depleted_pages_go(spark, own):
    """Pages of one host with shared navigation lines and lines of their own; nothing but the words' share counts."""
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5))
    docs = []
    for shared in (1, 2, 4, 8, 10, 20):
        menu = [line() for _ in range(shared)]
        docs += [(1000 * shared + i, "\n".join([*menu, *[line() for _ in range(own)], line() + " " + line()]), "en", f"host{shared}") for i in range(40)]
        docs += [(1000 * shared + 500 + i, "\n".join([*menu, *[line() for _ in range(5)]]), "en", f"rare{shared}") for i in range(30)]
    got = quality_rules.verdicts(frame(spark, docs)).collect()
    for r in got:
        shared, rare = r["doc_id"] // 1000, r["doc_id"] % 1000 >= 500
        assert not r["base_failed"] and r["removed_words"] == (0 if rare else 5 * shared)
        assert r["kept"] == (rare or 500 * shared <= 80 * r["n_words"])


# 7


def brute_repeats(rows):
    out, starts = [], defaultdict(list)
    key = lambda i: -(1 << 63) if i is None else i
    for i, t, _, _ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            starts[b[p : p + 50]].append(key(i))
    first = {w: min(x) for w, x in starts.items()}
    for i, t, _, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return counted(out)


@pytest.mark.parametrize("block_bytes, hot", [(8 << 20, suffix_dedup.HOT), (4000, suffix_dedup.HOT), (4000, 9)])
def test_repeats(documents, rows, empty, block_bytes, hot):
    got = suffix_dedup.remove_repeats(documents, block_bytes, hot).collect()
    assert counted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in got) == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 20])
def test_repeats_of_a_phrase_in_all_documents(spark, hot):
    rng = random.Random(12)
    noise = lambda k: "".join(rng.choice("abcdefghij klmnop") for _ in range(k))
    near = [noise(30) for _ in range(4)]
    rows = [(i, noise(rng.randint(0, 90)) + rng.choice([rng.choice(near), noise(20)]) + "a phrase of twenty-eight byte" + rng.choice([rng.choice(near), noise(20)]) + noise(rng.randint(0, 90)), "en", "s") for i in range(150)]
    rows += [(200 + i, c * n, "en", "s") for i, (c, n) in enumerate([("a", 400), ("a", 300), ("ab", 200), ("ba", 120), ("\0", 90), ("\0", 200), ("é", 100)])]
    rows += [(300, rows[0][1] * 3, "en", "s"), (300, rows[1][1] * 2, "en", "s")]
    got = suffix_dedup.remove_repeats(frame(spark, rows), 4000, hot).collect()
    assert counted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in got) == brute_repeats(rows)


def test_sorted_keys_come_back():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 5000):
        keys = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        assert suffix_dedup.unpack_sorted(suffix_dedup.pack_sorted(keys)).tolist() == keys.tolist()


def test_longest_previous_factor():
    rng = np.random.default_rng(2)
    strings, values = rng.integers(0, 2, (300, 12)).astype(np.uint8), rng.integers(0, 20, 300)
    got = suffix_dedup.longest_previous_factor(strings, values, 1)
    for i in range(300):
        best = max((next((k for k in range(12) if strings[i, k] != strings[j, k]), 12) for j in range(300) if values[j] < values[i]), default=0)
        assert got[i] == best


def measured(run):
    """What run returns, and the bytes that it held at once."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_does_not_follow_the_windows_of_a_shard(monkeypatch):
    """Contexts about few grams with surroundings of their own: all their windows must be compared, a few grams at a time."""
    rng = np.random.default_rng(4)
    n = 60_000
    contexts, oid = rng.integers(97, 100, (n, suffix_dedup.CONTEXT)).astype(np.uint8), rng.integers(0, n, n)
    contexts[:, 26:50] = rng.integers(97, 123, (n // 100, 24))[rng.integers(0, n // 100, n)]
    contexts[n // 2 :] = contexts[: n // 2]
    contexts[n // 2 :, :5] = 65
    low, high = rng.integers(0, 27, n).astype(np.uint8), rng.integers(50, 77, n).astype(np.uint8)
    got, held = measured(lambda: suffix_dedup.repeated_windows(contexts, low, high, oid))
    assert held < 40 << 20
    first = {}
    for c, a, b, o in zip(contexts, low.tolist(), high.tolist(), oid.tolist()):
        for s in range(a, b - 49):
            w = c[s : s + 50].tobytes()
            first[w] = min(o, first.get(w, o))
    want = [sum(1 << s for s in range(a, b - 49) if first[c[s : s + 50].tobytes()] < o) for c, a, b, o in zip(contexts[:3000], low.tolist(), high.tolist(), oid.tolist())]
    assert any(want) and got[:3000].tolist() == want
    monkeypatch.setattr(suffix_dedup, "PART_CONTEXTS", n)
    assert np.array_equal(got, suffix_dedup.repeated_windows(contexts, low, high, oid))


def test_memory_of_removed_bytes_follows_the_text():
    rng = np.random.default_rng(6)
    n = 1 << 20
    at = np.sort(rng.choice(np.arange(26, n - 50), n // 14, replace=False))
    mask = rng.integers(0, 1 << 27, len(at)).astype(np.uint32)
    got, held = measured(lambda: suffix_dedup.removed_bytes(n, at, mask))
    assert held < 16 * n
    want = np.zeros(n, bool)
    for a, m in zip(at[:500].tolist(), mask[:500].tolist()):
        for s in range(27):
            if m >> s & 1:
                want[a - 26 + s : a + 24 + s] = True
    end = int(at[499])
    assert np.array_equal(got[: end - 25], want[: end - 25]) and not suffix_dedup.removed_bytes(n, at[:0], mask[:0]).any()


def test_fitting_windows_as_bits():
    low, high = (x.ravel() for x in np.meshgrid(np.arange(27, dtype=np.uint8), np.arange(24, 77, dtype=np.uint8)))
    assert suffix_dedup._all_fit(low, high).tolist() == [sum(1 << s for s in range(27) if s >= a and s + 50 <= b) for a, b in zip(low.tolist(), high.tolist())]


def test_anchors_of_long_documents_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc ") for _ in range(9000))
    whole = suffix_dedup.anchors([b"x", text])
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    for a, b in zip(whole, suffix_dedup.anchors([b"x", text])):
        assert np.array_equal(a, b)


# 8


def test_codes_give_any_token():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.integers(0, 1 << 17, n)
        levels = token_output.unpack_file(token_output.pack_file([1], [n], ids))["levels"]
        assert [token_output.dac_access(levels, i) for i in range(n)] == ids.tolist()
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert token_output.dac_range(levels, a, b).tolist() == ids[a:b].tolist()


def test_tokens_are_read_from_a_file_by_place(tmp_path):
    import pyarrow.fs as pafs

    ids = np.random.default_rng(3).integers(0, 1 << 20, 3000)
    (tmp_path / "x.skdac").write_bytes(token_output.pack_file([1, None], [1000, 2000], ids))
    fs = pafs.LocalFileSystem()
    assert [token_output.token_at(fs, str(tmp_path / "x.skdac"), i) for i in range(0, 3000, 7)] == ids[::7].tolist()


def test_encoder_is_the_library_on_real_documents():
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    for own, ids in zip(token_output.Encoder(path, most=2000).encode_batch(texts), Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(own, "<u4").tolist() == ids.ids


def test_encoder_is_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_output.Encoder(path, most=100)
    rng = random.Random(6)
    texts = ["".join(rng.choice(" \n\t\r\x1c\x85ab'stéß1 .,!?日😀​") for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|> x", "a\n", "\n\na", "it's\n we'll"]
    for t, ids in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_files(documents, rows, empty, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, folder = Tokenizer.from_file(path), common.shared_dir(spark) + "/token-test"
    back = token_output.read_tokens(token_output.write_tokens(documents, path, folder, file_ids=500), folder, want_ids=True)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], tuple(r["ids"])) for r in back.collect())
    want, at = [], 0
    for i, t, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), tuple(ids)))
        at += len(ids)
    assert got == want
    assert token_output.tokenized(empty).count() == 0


# 9


def test_languages(spark):
    rng = random.Random(2)
    words = {"aa": ["".join(rng.choice("abcde") for _ in range(5)) for _ in range(80)], "bb": ["".join(rng.choice("defgh") for _ in range(5)) for _ in range(80)]}
    docs = []
    for i in range(300):
        lang = rng.choice(["aa", "bb"])
        docs.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 90))), lang if rng.random() < 0.9 else None, "s"))
    docs += [(900, None, "aa", "s"), (901, "12 ²", "aa", "s"), (902, "", None, "s"), (903, " ".join(words["aa"][:40] + words["bb"][:10]), None, "s"), (None, "x" * 5000, None, "s")]
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark, docs), per_language=60).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    right = [got[i]["lang_pred"] == lang for i, _, lang, _ in docs if lang and i < 900 and got[i]["held_out"]]
    assert sum(right) >= 0.97 * len(right) and got[903]["lang_pred"] == "aa" and 0.6 < got[903]["score"] < 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language_id.identify(frame(spark, [(1, "abc", None, None)]))
    assert nothing.first()["lang_pred"] == "und"


def test_languages_are_told_apart_inside_a_text():
    rng = random.Random(5)
    words = [["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(120)] for letters in ("abcdeg", "cdefgh", "xyzabc")]
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    field = language_id.Field.fit([(text(k, rng.randint(5, 80)), f"l{k}") for k in range(3) for _ in range(60)])
    # Switches are learned: staying is likelier than any switch, and no switch is out of reach.
    assert all(field.trans[i, i] > field.trans[i, j] > field.trans[i, i] - 9 for i in range(3) for j in range(3) if i != j)
    right = total = 0
    for _ in range(60):
        parts = [(k, rng.randint(4, 14)) for k in rng.sample(range(3), 2)]
        got = field.label(" ".join(text(k, n) for k, n in parts))
        want = [f"l{k}" for k, n in parts for _ in range(n)]
        right, total = right + sum(g == w for (_, g), w in zip(got, want)), total + len(want)
    assert right >= 0.95 * total
    assert [w for w, _ in field.label("y" * 50 + " a")] == ["y" * 24, "y" * 24, "yy", "a"]


def test_every_language_is_learned(spark):
    docs = [(i, " ".join(random.Random(i % 90).choices(["".join(random.Random(1000 * (i % 90) + k).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for k in range(9)], k=30)), f"l{i % 90}", "s") for i in range(540)]
    got = language_id.identify(frame(spark, docs)).collect()
    assert len({r["lang_pred"] for r in got}) == 90 and language_id.identify(frame(spark, docs).limit(0)).count() == 0


def test_forward_backward_is_exact():
    import itertools

    rng = np.random.default_rng(4)
    emit, trans, start = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    chain, place, lengths, _ = language_id.chains([4])
    p, pairs = language_id.forward_backward(emit, chain, place, lengths, trans, start)
    mass, want, both = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        s = np.exp(start[path[0]] + sum(emit[t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        mass += s
        for t, y in enumerate(path):
            want[t, y] += s
        for a, b in zip(path, path[1:]):
            both[a, b] += s
    assert np.allclose(p, want / mass) and np.allclose(pairs, both / mass)


# 10


def test_token_counts(documents, rows, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_count.count_tokens(documents, path, limit=60).collect()
    want = counted((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 60) for i, t, _, _ in rows)
    assert counted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert token_count.count_tokens(empty, path).count() == 0
    rng, made = random.Random(2), token_count.transducer(path)
    pieces = list(made.rank)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(800)] + ["".join(rng.choice(" \n\t\x00abeéñß1.<s></s>日😀▁") for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["a" * 2000, " " * 3000, "ab" * 900, ""]
    assert made.counts(texts).tolist() == [len(x) for x in library.encode(texts)]


def test_token_counts_of_very_long_texts(spark, monkeypatch):
    import time

    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, made = sentencepiece.SentencePieceProcessor(model_file=path), token_count.transducer(path)
    rng = random.Random(3)
    texts = ["a" * 400_000, " " * 100_000, "".join(rng.choices("ACGT", k=60_000)), "".join(rng.choices("0123456789abcdef", k=60_000)), "ha" * 50_000, "word " * 50_000, "日" * 30_000]
    for t in texts:
        assert made.counts([t]).tolist() == [len(library.encode(t))], t[:10]
    assert made.counts(texts).tolist() == [len(library.encode(t)) for t in texts]
    began = time.perf_counter()
    made.counts([texts[0] * 2])
    assert time.perf_counter() - began < 5  # one chunk after the other would take 15 seconds
    monkeypatch.setattr(token_count, "MOST_ENTRIES", 2)
    assert made.counts([texts[2][:9000]]).tolist() == [len(library.encode(texts[2][:9000]))]
    monkeypatch.setattr(token_count, "BATCH_CHARS", 5000)
    t = "".join(rng.choices(["word ", "ACGT", "a" * 30, "é", "\n"], k=9000))
    assert len(made.pieces(t)) > 3 and "".join(made.pieces(t)) == t
    for x in (t, "a" * 30_000, " " * 30_000):
        got = token_count.count_tokens(frame(spark, [(1, x, "en", "s"), (2, "", "en", "s"), (3, "x y", "en", "s")], 1), path).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == {1: len(library.encode(x)), 2: 0, 3: len(library.encode("x y"))}


def test_held_out_rows_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_score.score(docs).filter("held_out").agg((F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).alias("gain")).first()
    assert r["gain"] > 0.05  # log10 a token
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_very_long_texts(spark):
    """One text of a megabyte and more among short ones."""
    from xxhash import xxh64_intdigest

    rng = random.Random(11)
    words = [f"w{rng.randrange(5000):x}é" for _ in range(150_000)]
    long = " ".join(words) + "\n" + "x" * 200_000 + " the end of it all is here and now but not over yet"
    rows = [(1, long, "en", "s"), (2, "short text of a few words only, but enough of them to be kept by all the rules there are in here", "en", "s"), (3, long[:-1], "en", "s")]
    docs = frame(spark, rows, 2)
    bench = spark.createDataFrame([(7, " ".join(words[140_000:140_012])), (8, "the end of it all is here and now but not over")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.find_contamination(docs, bench).collect()}
    assert got[1]["items"] == ["7", "8"] and got[1]["hit_words"][0]["first"] == 140_000 and not got[2]["items"]
    last = got[1]["hit_bytes"][-1]
    assert long.encode()[last["start"] : last["end"]].decode() == "the end of it all is here and now but not over"
    w = long.encode().lower().split()
    h = np.array([xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)], np.uint64)
    fp = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash_dedup.fingerprints(docs).collect()}[1] == fp
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.verdicts(docs).collect()}[1] == len(w)
    assert {r["doc_id"]: r["size"] for r in mixing.taken_words(docs).collect()}[1] == len(w)
    assert {r["doc_id"]: r["n_tokens"] for r in lm_score.score(docs, classes=64).collect()}[1] == len(w) + 1
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()} == {1: "en", 2: "en", 3: "en"}
    spans = {r["doc_id"]: r["spans"] for r in suffix_dedup.remove_repeats(docs, 1 << 16).collect()}
    assert not spans[1] and spans[3][0]["start"] == 0 and spans[3][-1]["end"] == len(rows[2][1].encode()) and len(spans[3]) == 1
    turns = spark.createDataFrame([(1, 0, "assistant", long + "<|im_end|>")], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_turns(turns)).first()["loss_chars"] == len(long) + 10


# As registered.


def test_queries_as_registered(spark, tmp_path, rows):
    """Each opN_ query over small tables: by SQL where there is some, and the columns that its contract names."""
    import duckdb

    from skeinwork.llm import entries

    sf, rows = str(tmp_path), list({r[0]: r for r in rows if r[0] is not None}.values())
    common.pick(frame(spark, rows, 2), "doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    leak = next(t for _, t, _, _ in rows if t and len(t.split()) > 40)
    spark.createDataFrame([(1, leak), (2, "again five"), (3, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b<|im_end|>"), (2, 0, "assistant", "<\\|im_start|>é"), (3, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    names = {
        "op1_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op2_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op3_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score", "op4_mix": "doc_id size source_size target taken", "op5_simhash_dedup": "doc_id fingerprint component_id",
        "op6_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept removed_words", "op7_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op8_token_output": "doc_id start n_tokens ids_crc32", "op9_language_id": "doc_id held_out lang_pred score", "op10_token_count": "doc_id n_bytes n_tokens over_limit",
    }
    assert list(entries.queries()) == list(names)
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    for q, run in entries.queries().items():
        df = run(spark, sf)
        assert df.columns == names[q].split()
        got = from_spark(df)
        if q in entries.oracle_sql():
            r = c.execute(entries.oracle_sql()[q])
            at = sorted(range(len(df.columns)), key=[x[0] for x in r.description].__getitem__)
            assert got == Counter(tuple(x[i] for i in at) for x in r.fetchall()), q
        elif q == "op7_suffix_dedup":
            assert counted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()) == brute_repeats(rows)
        elif q == "op5_simhash_dedup":
            assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) and r["component_id"] <= r["doc_id"] for r in df.collect())
        assert sum(got.values()) == (len(rows) if q != "op1_chat_format" else 4)


@pytest.mark.parametrize("shards", [16, 64])
def test_all_shards_are_learned_from(spark, shards):
    """Held-out gain on real documents with many shards, against 0.299 that one shard of all of them had."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    r = lm_score.score(docs, shards=shards).filter("held_out").agg((F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).alias("gain")).first()
    assert r["gain"] > 0.8 * 0.299 - 0.005
