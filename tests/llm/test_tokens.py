"""Cut-and-cached encoding against encoding whole texts; length histograms against brute force."""
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowglass.llm import token_counts, tokens
from flowglass.llm.store import written

TEXTS = ["", None, " ", "  a  b \n\n c\nd\n e", "it's   we'll\tx  y  z 　w", "a \nb  c  d", "<|endoftext|> x<|endoftext|>", "née ñandú über 中文 字 😀 😀x", "a" * 5000,
         "tail space ", " lead", "\n\nx\n", "1 22 333!! ?? \r\n\r\n q", "\x1c \x1d a \x85 b \x0b c"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokens.vocabulary_path())


def test_same_ids_as_whole_texts(plain):
    enc = tokens.Encoder()
    got = {}
    for first, ids, off in enc.ids(pa.array(TEXTS)):
        for r in range(len(off) - 1):
            got[first + r] = ids[off[r] : off[r + 1]].tolist()
    for i, t in enumerate(TEXTS):
        assert got[i] == plain.encode(t or "", add_special_tokens=False).ids, repr(t)[:50]
    assert enc.counts(pa.array(TEXTS)).tolist() == [len(got[i]) for i in range(len(TEXTS))]


def test_documents_same_counts(spark, plain):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    want = {}
    for r in rows.collect():
        n = len(plain.encode(r.text, add_special_tokens=False).ids)
        want[n] = want.get(n, 0) + 1
    hist = written(token_counts.histogram(rows), "lengths")
    assert {r.length: r.n_docs for r in hist.collect()} == want
    lengths = sorted(n for n, k in want.items() for _ in range(k))
    found = token_counts.suffix_sums(hist).collect()
    assert len(found) == len(want)
    for r in found:
        at = [n for n in lengths if n >= r.length]
        assert (r.docs_at_least, r.tokens_at_least) == (len(at), sum(at))
        assert r.truncated_total == sum(min(n, r.length) for n in lengths)
        assert r.lost_tokens == sum(lengths) - r.truncated_total
        assert abs(r.quantile - sum(n <= r.length for n in lengths) / len(lengths)) < 1e-12
    sums = token_counts.suffix_sums(hist)
    assert token_counts.quantile(sums, 0.5) == lengths[-(-len(lengths) // 2) - 1]
    assert token_counts.quantile(sums, 1.0) == lengths[-1]
    assert token_counts.truncated_total(hist, 100) == sum(min(n, 100) for n in lengths)


def test_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(1, None, 7), (1, None, 7), (2, "", 8), (3, "a b", 9)], "doc_id long, text string, length long")
    assert {r.length: r.n_docs for r in token_counts.histogram(docs).collect()} == {0: 3, 2: 1}
    none = token_counts.histogram(docs.filter("doc_id > 9"))
    assert none.count() == 0 and token_counts.suffix_sums(none).count() == 0
    assert token_counts.truncated_total(none, 5) == 0 and token_counts.quantile(token_counts.suffix_sums(none), 0.5) is None
