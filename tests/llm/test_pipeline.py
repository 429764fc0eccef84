"""The stages of corpus_pipeline as they are called, against plain versions, on odd input and on an empty table."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from trellis.llm import pieces, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone int, row string"
COMMON = "the of and to in a is that it on for with".split()


def prose(seed, n, line=12):
    """Words of which about two in five are common ones, in lines."""
    r = random.Random(seed)
    words = [r.choice(COMMON) if r.random() < 0.4 else "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 8))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


ITEM = prose(999, 40, 40)
RUN = prose(77, 72)
NEAR = prose(50, 300)


def documents():
    rows = [(k, prose(k, 150 + k), "en") for k in range(1, 31)]
    rows += [(40, NEAR, "en"), (41, NEAR.replace(NEAR.split()[100], "changed", 1), "en"), (42, NEAR.upper(), "en")]
    rows += [(50, prose(51, 100) + "\n" + RUN + "\n" + prose(52, 100), "en"), (51, prose(53, 100) + "\n" + RUN, "en")]
    rows += [(60, prose(61, 90) + " " + ITEM + " " + prose(62, 90), "en"), (70, None, None), (71, "", "en"), (72, "short text", "en"), (None, prose(73, 160), "en"), (73, "a b c " * 100, "en")]
    rows += [(30, prose(30, 180), "en")]
    return [(d, t, lang, "s", len(t or ""), 1, "x") for d, t, lang in rows]


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"] and corpus_pipeline.ORACLE_SQL is None


def test_every_stage_and_run(spark, tmp_path):
    folder = write(spark, tmp_path, documents())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = {n: (lambda d, f=f: f(spark, d, folder)) for n, f in corpus_pipeline.STAGES}

    good = stage["quality_rules"](docs)
    clean = [d for d, *_ in documents() if d not in (42, 70, 71, 72, 73)]
    assert good.columns == docs.columns and ids(good) == sorted(clean, key=str)

    lines = stage["line_dedup"](docs).cache()
    text = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    before = {d: t for d, t, *_ in documents()}
    assert lines.columns == docs.columns
    assert text[51][0] == prose(53, 100) and text[50][0] == before[50] and 41 in text and len(text[41][0]) < len(before[41])
    assert all(n == len(t or "") for d, (t, n) in text.items() if d != 70) and set(before) - set(text) <= {71, 72, 73, 41} - {41}

    near = stage["near_dedup"](docs)
    assert near.columns == docs.columns and ids(near) == sorted([d for d, *_ in documents() if d not in (41, 42)], key=str)

    left = stage["decontamination"](docs)
    assert left.columns == docs.columns and ids(left) == sorted([d for d, *_ in documents() if d != 60], key=str)

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = stage["sentencepiece"](docs).collect()
    assert len(out) == len(documents()) and all(r.exact and r.ids == library.encode(before[r.doc_id] or "") for r in out)

    final = corpus_pipeline.run(spark, folder).collect()
    kept = [d for d in clean if d != 60]  # 41 has lost the lines it shares with 40, and what is left is no copy
    assert sorted((r.doc_id for r in final), key=str) == sorted(kept, key=str) and all(r.exact for r in final)
    pieces_of = {r.doc_id: r.ids for r in final}
    assert pieces_of[51] == library.encode(prose(53, 100)) and pieces_of[60 - 59] == library.encode(before[1])


def test_empty_table(spark, tmp_path):
    folder = write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        assert out.count() == 0 and out.columns == [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.mark.parametrize("text", ["x" * 300_000, "word " * 60_000, "\n" * 50_000, "é" * 100_000])
def test_very_long_texts(spark, tmp_path, text):
    docs = spark.createDataFrame([(1, text, "en", "s", len(text), 1, "x")], SCHEMA)
    folder = write(spark, tmp_path, documents()[:1])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == (0 if name == "quality_rules" else 1), name


def test_clashing_column_names(spark, tmp_path):
    folder = write(spark, tmp_path, documents()[:2])
    names = ["_t", "_w", "_row", "_bits", "_keys", "h_lang", "kept", "gone", "k1", "k2", "lines", "signs", "_word", "_bit", "component", "digest", "ids", "score"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({n: F.lit(1) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 2, name
    assert quality.judge(docs, "doc_id").count() == 2
