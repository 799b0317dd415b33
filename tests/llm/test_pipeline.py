import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tapeline.llm import bpe, pii


def test_pipeline_matches_plain_version(spark, tmp_path):
    rng = random.Random(8)
    syllables = {"en": ["the", "ing", "er", "on", "sh", "an"], "fr": ["eau", "tion", "ou", "é", "que", "ment"]}

    def text(lang, n=60):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(2, 5))) for _ in range(n))

    passage = text("en", 20)
    rows = [(k, text("en" if k % 2 else "fr"), "en" if k % 2 else "fr", "s", None) for k in range(60)]
    rows[7] = (7, f"{rows[7][1]} {passage}", "en", "s", 1)
    rows += [(100, rows[3][1], "en", "s", 1), (101, rows[5][1].rsplit(" ", 1)[0] + " other", "en", "s", 1), (102, "12 34 !!", "en", "s", 8), (103, None, None, None, None), (104, "", "en", "s", 0)]
    rows += [(105, text("en", 200) + " 4041894974608795 a.b@mail.example.com <|endoftext|>", "en", "s", 5), (106, passage, "en", "s", 1), (None, text("fr"), "fr", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {r[0]: pii.replace(r[1], pii.session_key(spark))[0] for r in rows if r[0] not in (7, 100, 101, 102, 103, 104, 106)}
    assert got.keys() == want.keys()
    for k, t in want.items():
        assert got[k].decoded == t and np.frombuffer(got[k].ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
    assert "4041894974608795" not in got[105].decoded and "a.b@" not in got[105].decoded


def test_near_copies_from_0_8(spark):
    words = [[f"d{k}w{n}" for n in range(100)] for k in range(40)]
    rows = [(k, " ".join(w), "en", "s", 1) for k, w in enumerate(words)]
    rows += [(100 + k, " ".join([*w[:-10], *(f"x{k}y{n}" for n in range(10))]), "en", "s", 1) for k, w in enumerate(words)]
    rows += [(200 + k, " ".join([*w[:-12], *(f"z{k}y{n}" for n in range(12))]), "en", "s", 1) for k, w in enumerate(words[:1])]
    far = [(300, " ".join([*words[0][:50], *(f"f{n}" for n in range(50))]), "en", "s", 1)]
    sets = [{tuple(w[n : n + 5]) for n in range(len(w) - 4)} for w in (rows[0][1].split(), rows[40][1].split())]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85
    docs = spark.createDataFrame(rows + far, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {*range(40), 200, 300}


def test_stage_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "personal_data", "tokens"]
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.personal_data(spark, docs.limit(0), "").columns == docs.columns
    assert corpus_pipeline.near_duplicates(spark, docs, "").collect() == docs.collect()


def test_empty_tables_and_extra_columns(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, pii string, lang_pred string, row string, kept string"
    rows = [(k, " ".join(f"word{k}{n}" for n in range(40)) + (" a.b@mail.example.com" if k == 3 else ""), "en" if k % 2 else None, "s", 1, "p", "q", "r", "x") for k in range(12)]
    spark.createDataFrame([(1, None)], "item_id long, text string").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows + rows[:1], columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 13 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert {r.pii for r in corpus_pipeline.personal_data(spark, docs, "").collect()} == {"p"}
    for name, kept in (("a", docs), ("b", docs.limit(0))):
        kept.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(tmp_path / name / "benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == (13 if name == "a" else 0)


def test_tokens_take_one_worker_a_task(spark):
    """Encoding and decoding share a worker: two a task passed the memory of an executor."""
    path = P.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b <|endoftext|> \u00e9\u0301 \U0001f600", "x"), (1, "a  b\n", "y"), (2, None, "z"), (None, "", "z")], "doc_id long, text string, lang string")
    done = corpus_pipeline.tokens(spark, docs, "")
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = bpe.decode(bpe.encode(docs, path), path)
    assert done.columns == want.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    key = lambda r: (r.doc_id is None, r.doc_id, r.decoded)
    assert sorted(done.collect(), key=key) == sorted(want.collect(), key=key)
    assert sorted(r.decoded for r in done.collect()) == ["", "", "a  b\n", "a b <|endoftext|> \u00e9\u0301 \U0001f600"]
