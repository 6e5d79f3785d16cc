import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sheaf.llm import tokenfiles

FILE = public_tokenizers.path("word_bpe_49k.json")
KIND = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def brute(rows, tokenizer):
    """``doc, start, n, crc`` of rows in the order of their ids, null first; repeated ids hold equal texts here."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def texts(n):
    pick = random.Random(n)
    words = ["one", "Deux", "drei", "#", "1999", "naïve", "<|endoftext|>", "…", "\t", "x" * 50]
    rows = [(i, " ".join(pick.choices(words, k=pick.randrange(0, 60)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "word " * 30_000), (None, "no id"), (3, rows[3][1]), (3, rows[3][1])]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"size": 16, "batch": 4, "file": 8, "task_bytes": 2000}, {"size": 1, "batch": 1, "file": 1}])
def test_read_back_as_encoded(spark, tokenizer, sizes):
    rows = texts(60 if sizes.get("size") != 1 else 5)
    files = tokenfiles.write(spark.createDataFrame(rows, KIND).repartition(5), FILE, **sizes)
    got = [tuple(r) for r in files.documents().collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(rows, tokenizer)


def test_ids_and_masks(spark, tokenizer):
    rows = [(i, t) for i, t in texts(40) if i is not None]
    files = tokenfiles.write(spark.createDataFrame(rows, KIND), FILE, size=32, batch=4, file=16, task_bytes=1000)
    whole = [i for _, t in sorted(rows, key=lambda r: r[0]) for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]]
    seen = files.sequences().orderBy("part", "file", "sequence").collect()
    assert {len(r["ids"]) for r in seen} == {len(r["mask"]) for r in seen} == {32}
    assert [i for r in seen for i, m in zip(r["ids"], r["mask"], strict=True) if m] == whole
    listed = files.files.orderBy("part", "file").collect()
    assert len(listed) > 3 and sum(r["tokens"] for r in listed) == len(whole) and sum(r["documents"] for r in listed) == len(rows)
    assert [r["first"] for r in listed] == [sum(x["tokens"] for x in listed[:i]) for i in range(len(listed))]
    raw = {r["start"]: np.frombuffer(r["ids"], "<u4").tolist() for r in files.documents(ids=True).collect()}
    assert [i for start in sorted(raw) for i in raw[start]] == whole


def test_random_access_without_copies(spark):
    rows = [(i, "some words here " * 500) for i in range(40)]
    files = tokenfiles.write(spark.createDataFrame(rows, KIND).coalesce(1), FILE, size=64, batch=8, task_bytes=1 << 30)
    (path, count), = files.files.select("path", "sequences").collect()
    opened = tokenfiles.Sequences(path)
    in_order = [r["ids"] for r in files.sequences().orderBy("sequence").collect()]
    assert len(in_order) == count and count % 8
    before = pa.total_allocated_bytes()
    places = [count - 1, 0, 17, 8, 7, count // 2]
    views = [opened[p] for p in places]
    assert pa.total_allocated_bytes() - before < 4 * 64
    assert all(not ids.flags.owndata and not ids.flags.writeable for ids, _ in views)
    assert {ids.dtype for ids, _ in views} == {np.dtype("uint16")} and {str(mask.type) for _, mask in views} == {"bool"}
    assert all(mask.to_pylist() == [True] * 64 for _, mask in views[1:]) and not views[0][1].to_pylist()[-1]
    assert [ids.tolist() for ids, _ in views] == [in_order[p] for p in places]
    for wrong in (count, count + 8, 10 * count, -1):
        with pytest.raises(IndexError):
            opened[wrong]


def test_empty_table_and_clashing_names(spark, tokenizer):
    assert tokenfiles.write(spark.createDataFrame([], KIND), FILE).documents().collect() == []
    rows = spark.createDataFrame([("b", "x y", 1, 2), ("a", None, 3, 4)], "doc_id string, text string, ids int, part int")
    got = tokenfiles.write(rows, FILE).documents().orderBy("start").collect()
    assert [(r["doc"], r["start"], r["n_tokens"]) for r in got] == [("a", 0, 1), ("b", 1, 3)]


def test_wide_ids(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(tokenfiles, "is_wide", lambda *_: True)
    rows = [(1, "one two"), (0, "three")]
    files = tokenfiles.write(spark.createDataFrame(rows, KIND), FILE)
    assert sorted((tuple(r) for r in files.documents().collect()), key=lambda r: r[1]) == brute(rows, tokenizer)
    assert tokenfiles.Sequences(files.files.first()["path"])[0][0].dtype == np.uint32
    assert tokenfiles.storage("file:///a/b")[1] == tokenfiles.storage("file:/a/b")[1] == "/a/b"
