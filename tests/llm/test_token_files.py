"""Token files against the tokenizers library, document by document."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sensorloom.llm.queries import QUERIES
from sensorloom.llm.token_files import read_tokens, write_tokens
from sensorloom.llm.tokens import encoder, vocabulary_path

SF = "/root/testdata/sf0.001"


def expected(rows):
    t = Tokenizer.from_file(vocabulary_path())
    out, start = [], 0
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_library(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = [tuple(r) for r in QUERIES["op6_token_files"](spark, SF).orderBy("start").collect()]
    assert got == expected(docs)


def test_odd_rows(spark):
    rows = [(5, None, 1), (None, "a b", 2), (3, "", 3), (9, "word " * 30_000, 4), (9, "b", 5), (-4, "Don't İ", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range int")
    folder, parts = write_tokens(docs)
    got = [tuple(r) for r in read_tokens(folder, parts).orderBy("start").collect()]
    in_order = [(None, "a b"), (-4, "Don't İ"), (3, ""), (5, None), (9, "b"), (9, "word " * 30_000)]
    want = expected(in_order)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] or 0, r[2], r[3]) for r in want)


def test_empty_table(spark):
    folder, parts = write_tokens(spark.createDataFrame([], "doc_id long, text string"))
    assert read_tokens(folder, parts).collect() == []


@pytest.mark.parametrize(
    "text",
    ["", "İstanbul's DON'T '''s x'reflect 12³ ½ <|endoftext|> a", "Σας ΟΔΥΣΣΕΥΣ", "é a b", "ŉ ſ Ĳ Ŀ it's", "\x1c\x0b",
     "a<|EndOfText|>b", "x_y--z ~` 1234", "Ā-žŸ ŹŻ ß×÷", "| a %%%b"],
)
def test_word_by_word_equals_whole(text):
    e = encoder()
    assert e.encode([text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
