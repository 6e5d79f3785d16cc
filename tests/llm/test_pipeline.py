"""The pipeline on a small folder of planted documents, stage by stage and whole."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from sheaf.llm.graph import components
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_substring import brute as substring_brute

KIND = "doc_id long, text string, lang string, source string, n_chars long, extra int"
SYLLABLES = {"aa": ["ba", "lo", "mi", "ra", "su"], "bb": ["sch", "tz", "ung", "ö", "kei"]}


def planted():
    pick = random.Random(8)

    def words(lang, n):
        return ["".join(pick.choice(SYLLABLES[lang]) for _ in range(pick.randint(2, 5))) for _ in range(n)]

    rows, labels, passage = [], [], words("aa", 60)
    for i in range(240):
        lang = "aa" if i % 2 else "bb"
        own, good = words(lang, pick.randint(45, 90)), 1
        if i % 5 == 4:
            own, good = [w.upper() + "!!" for w in own], 0
        elif i % 24 == 1:
            own += passage
        rows.append((i, " ".join(own), lang, f"s{i % 3}", 0, i))
        labels.append((i, good, 0))
    texts = [r[1] for r in rows]
    for k in range(10):
        copy = texts[k * 10].split()
        copy[5] = "edit"
        rows.append((300 + k, " ".join(copy), "bb", "s0", 0, 0))
        rows.append((310 + k, texts[k * 10], "bb", "s0", 0, 0))
    rows += [(400, None, "aa", None, 0, 0), (401, "", "aa", "s1", 0, 0), (402, "123 456", "aa", "s1", 0, 0)]
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, the first entry being the input."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, labels = planted()
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        out.append(docs)
    return folder, out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_are_those_of_documents(stages):
    assert all(df.columns == stages[1][0].columns for df in stages[1][:5])


def test_language_stage_rejects_texts_without_letters(stages):
    assert set(ids(stages[1][0])) - set(ids(stages[1][1])) == {400, 401, 402}


def test_quality_stage_rejects_junk_and_keeps_clean_documents(stages):
    gone = set(ids(stages[1][1])) - set(ids(stages[1][2]))
    assert gone == {i for i in range(240) if i % 5 == 4} | {300 + k for k in range(20) if k * 10 % 5 == 4}


def test_near_duplicate_stage_is_that_of_brute_force(stages):
    rows = [(r.doc_id, r.text) for r in stages[1][2].collect()]
    assert ids(stages[1][3]) == sorted(i for i, _, _, kept in near_brute(rows) if kept)


def test_substring_stage_is_that_of_brute_force(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[1][3].collect())
    want = [(i, kept) for (i, _), (_, _, kept) in zip(rows, substring_brute([t for _, t in rows], 35))]
    got = sorted((r.doc_id, r.text, r.n_chars) for r in stages[1][4].collect())
    assert [(i, t) for i, t, _ in got] == want and all(len(t) == n for _, t, n in got)
    assert any(len(t) < len(dict(rows)[i]) for i, t, _ in got)


def test_packing_stage_holds_every_token(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for r in stages[1][4].collect()}
    got = {}
    for p in sorted(stages[1][5].collect(), key=lambda p: p.start):
        got.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
    assert got == want


def test_run_gives_the_rows_of_the_stages(spark, stages):
    folder, out = stages
    key = ("doc_id", "start", "length", "ids")
    a, b = (Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(*key).collect())
            for df in (pipeline.run(spark, folder), out[-1]))
    # Cuts follow the order of documents in their queues, which files decide; tokens do not.
    assert sum(k[2] * n for k, n in a.items()) == sum(k[2] * n for k, n in b.items())
    assert {k[0] for k in a} == {k[0] for k in b}


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert pipeline.run(spark, folder).collect() == []


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a", "s", 0, 1)] * 3 + [(None, text, "a", "s", 0, 1), (2, text, "a", "s", 0, 1)]
    docs = spark.createDataFrame(rows, KIND).withColumn("kept", F.lit(1))
    got = pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None"]


def test_language_stage_rejects_letters_in_no_language_and_keeps_short_texts(spark):
    pick = random.Random(3)
    rows, _ = planted()
    junk = [(900 + k, " ".join("".join(pick.choice("xqjvwyhdf") for _ in range(7)) for _ in range(40)), None, "s", 0, 0) for k in range(20)]
    short = [(950, "balo mira", "aa", "s", 0, 0), (951, "Schtz ung.", "bb", "s", 0, 0)]
    kept = set(ids(pipeline.language_stage(spark, spark.createDataFrame(rows + junk + short, KIND), "")))
    assert not kept & set(range(900, 920))
    assert {950, 951} <= kept and set(range(240)) <= kept


def whole_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "Mark" in b.getName())


def test_a_stage_begins_with_the_garbage_collected(spark):
    docs = spark.createDataFrame([], KIND)
    for name, stage in pipeline.STAGES[2:4]:
        before = whole_collections(spark)
        stage(spark, docs, "")
        assert whole_collections(spark) > before, name


def test_rounds_of_components_leave_no_garbage(spark):
    before = whole_collections(spark)
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    assert {r.component for r in components(links).collect()} == {0}
    assert whole_collections(spark) >= before + 3
