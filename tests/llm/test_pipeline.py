"""The five stages against a plain Python version on a small corpus."""

import zlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm import BYTE, brute_classes, brute_repeats, brute_spans, prose
from tablesmith.llm import chains, packing, quality


def corpus():
    shared = prose(900, 70)
    texts = [prose(i, 80 + i) for i in range(12)]
    texts += [prose(20, 60) + " " + shared + " " + prose(21, 60), prose(22, 60) + " " + shared + " " + prose(23, 60)]
    texts += [texts[3], texts[4] + " tail", "too short", None, ""]
    texts += ["write to a.b@mail.example.com or +1 (743) 555-3824 " + prose(30, 60), " ".join(w + "%%%" for w in prose(5, 200).split())]
    return list(enumerate(texts))


def test_stages_match_plain_python(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    kept = {r.doc_id for r in quality.measure(docs, labels).where("kept").collect()}
    assert not kept & {16, 17, 18} and kept >= set(range(12))
    left = [(i, t) for i, t in rows if i in kept]
    first = {c for _, c in brute_classes(left)}
    left = [(i, t) for i, t in left if i in first]
    assert not first & {14, 15}
    repeats = brute_repeats(left)
    cut = []
    for i, t in left:
        words = sorted(repeats[i])
        cut.append((i, chains.without(t, [(words[0], words[-1] + 1)]) if words else t))
    assert dict(cut)[13] != dict(left)[13] and dict(cut)[12] == dict(left)[12]
    clean = []
    for i, t in cut:
        for kind, a, b in sorted((s.split(":") for s in brute_spans(t)), key=lambda s: -int(s[1])):
            t = t[: int(a)] + f"[{kind.upper()}]" + t[int(b):]
        clean.append((i, t))
    coder, want = packing.ByteCoder(BYTE, None), Counter()
    for i, t in clean:
        ids = coder.whole(t) + b"\0\0\0\0"
        want[i, 0, 0, len(ids) // 4, zlib.crc32(ids)] += 1

    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == want
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
