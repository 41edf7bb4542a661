import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from skeinwork.llm import common, mixing, quality_rules

from test_ops import DOCUMENTS, brute_contamination, frame, from_sql, plain_cleaning, some_documents


def write(spark, rows, items, folder):
    docs = common.pick(frame(spark, rows), "doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_pipeline_is_its_stages_by_hand(spark, tmp_path):
    """Every stage in plain Python or SQL, each on what the one before kept."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = list({r[0]: r for r in some_documents(seed=3, n=150) if r[0] is not None}.values())
    menu = "one line of a menu that all the pages of this host have, in the same words and at the same place"
    rows += [(1000 + i, "\n".join([menu, menu + " and more", f"page {'xyz'[i % 3] * (i + 1)}"]), "en", "menus") for i in range(40)]
    rows += [(2000 + i, f"a line of navigation {i + 10}\n" + " ".join(f"w{i}x{k}" for k in range(30 + i)), "en", "navigated") for i in range(35)]
    leak = next(t for _, t, _, _ in rows if t and len(t.split()) > 40)
    items = [(1, leak), (2, None)]
    write(spark, rows, items, str(tmp_path))

    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words removed_words base_failed kept".split()
    verdict = {dict(zip(sorted(names), r))["doc_id"]: dict(zip(sorted(names), r))["kept"] for r in from_sql(quality_rules.ORACLE_SQL, documents=(DOCUMENTS, rows))}
    kept = [(r[0], t, *r[2:]) for r, t in zip(rows, plain_cleaning(rows, quality_rules.LIMIT)) if verdict[r[0]]]
    assert sum(r[3] == "navigated" and "navigation" not in r[1] for r in kept) == 35
    assert not any(r[3] == "menus" for r in kept) and len(kept) < len(rows)
    fps, group = [fingerprint(r[1]) for r in kept], list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if group[i] != group[j] and (fps[i] ^ fps[j]).bit_count() <= 4:
                group = [group[j] if g == group[i] else g for g in group]
    first: dict = {}
    for r, g in zip(kept, group):
        first[g] = min(first.get(g, r), r, key=lambda r: r[0])
    one = sorted(first.values(), key=lambda r: r[0])
    clean = [r for r in one if not brute_contamination(r[1], items)[1]]
    assert len(kept) > len(one) > len(clean) > 0
    # doc_id, size, source_size, taken, target
    mixed = {r[0]: r[3] // r[1] for r in from_sql(mixing.ORACLE_SQL, documents=(DOCUMENTS, clean))}
    library, want, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter(), 0
    for r in sorted(clean, key=lambda r: r[0]):
        ids = [*library.encode(r[1], add_special_tokens=False).ids, 0]
        for _ in range(mixed[r[0]]):
            want[r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
            at += len(ids)
    got = Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(want) > 10


def test_stages_keep_columns(spark, tmp_path):
    rows = some_documents(seed=3, n=80)
    leak = next(t for _, t, _, _ in rows if t and len(t.split()) > 40)
    write(spark, rows, [(1, leak)], str(tmp_path))
    now = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumns({"_0": F.lit(1), "row": F.lit("x"), "h": F.lit(2), "k1": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = common.staged(stage(spark, now, str(tmp_path)), name)
        assert now.columns == before.columns and now.dtypes == before.dtypes
        assert before.select("doc_id", "text", "source", "row").distinct().intersect(now.select("doc_id", "text", "source", "row")).count() == now.select("doc_id", "text", "source", "row").distinct().count() > 0


def test_empty(spark, tmp_path):
    write(spark, some_documents(n=10)[:0], [], str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
