"""Text functions against plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tarnlight.functions import text as tx
from tarnlight.operators import docsearch as ds


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_index_tokens(spark):
    said = "The YOLO26n-model, how 프레임 동기화는 x é 42"
    want = [t for t in re.split(r"[^a-z0-9가-힣]+", said.lower()) if len(t) > 1 and t not in tx.INDEX_STOP]
    assert one(spark, tx.index_tokens, said) == want
    assert one(spark, tx.index_tokens, None) == []


@pytest.mark.parametrize("word", ["", "a", "overlay", "프레임아이디", "fnv-1a"])
def test_fnv(spark, word):
    h = 2166136261
    for c in word:
        h = ((h ^ ord(c)) * 16777619) % 2**32
    assert one(spark, tx.fnv1a, word) == h


def test_gate_tokens(spark):
    assert one(spark, tx.gate_tokens, "검색하는 기능은 frameId와") == ["검색", "기능", "frameid"]
    assert one(spark, tx.content_tokens, "what is the overlay 구조") == ["overlay"]


@pytest.mark.parametrize(("text", "want"), [("문제 정의", "문제-정의"), ("  Hello, World!  ", "hello-world"), ("!!!", "section")])
def test_heading_id(spark, text, want):
    assert one(spark, tx.heading_id, text) == want


def test_symbols(spark):
    assert one(spark, tx.exact_symbols, "frameId와 camera_login_id, safety/events") == ["frameId", "camera_login_id", "safety/events"]
    assert one(spark, lambda c: tx.code_symbols(c), "const alpha = beta_1.run(); return xyz") == ["alpha", "beta_1.run"]
    assert one(spark, lambda c: tx.referenced_files(c), "see src/a.ts and b.md, not c.exe") == ["src/a.ts", "b.md"]


def test_string_list(spark):
    for value, want in [("[a, 'b' , ]", ["a", "b"]), ("- a\n- b", ["a", "b"]), ("solo", ["solo"]), ("", []), (None, [])]:
        assert one(spark, tx.string_list, value) == want


def test_summary_and_excerpt(spark):
    long = "word " * 100
    assert one(spark, lambda c: tx.summary(c, 20), long) == "word word word word..."
    assert one(spark, lambda c: tx.excerpt(c, 22), long) == "word word word word…"
    assert one(spark, lambda c: tx.excerpt(c, 22), "short") == "short"


def test_numeric_intent(spark):
    assert one(spark, tx.numeric_intent, "정확도는 몇 퍼센트인가요")
    assert one(spark, tx.numeric_intent, "지연 30 MS 이내")
    assert not one(spark, tx.numeric_intent, "구조를 설명해줘")


def test_search_normal_form(spark):
    said = "ＡＢＣ_file.py — naïve"
    want = unicodedata.normalize("NFKC", said).lower()
    want = re.sub(r"\s+", " ", re.sub(r"[^\w\s-]", " ", re.sub(r"[_/\\.+]+", " ", want))).strip()
    assert one(spark, ds.normal, said) == want
    assert one(spark, ds.normal, None) == ""


def test_chunk_type(spark):
    kind = lambda c: tx.chunk_type(F.lit("H"), c, F.lit("prose"))
    assert [one(spark, kind, t) for t in ("a decision", "recall 0.5", "rollback", "pipeline", "plain", "adrift")] == ["decision", "metric", "bug", "architecture", "prose", "prose"]
