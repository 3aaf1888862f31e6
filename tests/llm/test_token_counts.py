import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contactmill.llm import token_counts as tc
from tests.llm import cases

FILE = public_tokenizers.path("byte_bpe_50k.json")
CONTENT = open(FILE, "rb").read()
LIBRARY = Tokenizer.from_file(FILE)


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


def test_awkward_documents(spark):
    rows = tc.token_counts(spark, cases.awkward(spark), CONTENT).collect()
    want = []
    for doc_id, text, *_ in cases.ROWS:
        n = expected(text)
        want.append((doc_id, len((text or "").encode()), n, n > 1024))
    assert cases.ordered(rows) == cases.ordered(want)
    assert tc.token_counts(spark, cases.empty(spark), CONTENT).collect() == []


def test_whole_table_against_library(spark):
    docs = spark.read.parquet(f"{cases.folder()}/documents.parquet")
    have = {r.doc_id: r.n_tokens for r in tc.token_counts(spark, docs, CONTENT).collect()}
    assert have == {r.doc_id: expected(r.text) for r in docs.collect()}


def test_only_misses_are_encoded(spark, tmp_path):
    docs = cases.awkward(spark)
    cache = str(tmp_path / "cache")
    first = tc.token_counts(spark, docs.where("doc_id <= 4"), CONTENT, cache).collect()
    folder = f"{cache}/tokenizer={tc.tokenizer_version(CONTENT)}"
    before = spark.read.parquet(folder).count()
    again = tc.token_counts(spark, docs.where("doc_id <= 4"), CONTENT, cache).collect()
    assert cases.ordered(first) == cases.ordered(again)
    assert spark.read.parquet(folder).count() == before == 3
    tc.token_counts(spark, docs, CONTENT, cache).count()
    digests = [bytes(r.digest) for r in spark.read.parquet(folder).collect()]
    assert len(digests) == len(set(digests)) == len({t or "" for _, t, *_ in cases.ROWS})


def test_stored_counts_are_used(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    folder = f"{tmp_path}/c/tokenizer={tc.tokenizer_version(CONTENT)}"
    tc.token_counts(spark, docs, CONTENT, f"{tmp_path}/c").count()
    digest = bytes(spark.read.parquet(folder).first().digest)
    spark.createDataFrame([(bytearray(digest), 99)], tc.CACHE).write.mode("append").parquet(folder)
    assert tc.token_counts(spark, docs, CONTENT, f"{tmp_path}/c").first().n_tokens == 99


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abc XYZ'stlm 019.,!\n\t\r\x0b\x1c\x85\xa0éßĀ日🙂<|endoftext|>")), max_size=60))
def test_counts_as_the_library(text):
    assert tc.counter(CONTENT).count(text) == expected(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_tokenizers_of_the_library(name):
    content = open(public_tokenizers.path(name), "rb").read()
    text = "Some Text with  spaces, 12 numbers and Éà."
    assert tc.Counter(content).count(text) == len(Tokenizer.from_buffer(content).encode(text, add_special_tokens=False))
