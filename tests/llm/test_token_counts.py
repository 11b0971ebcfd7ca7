import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scoreloom.llm.token_counts import chunk_rows, cuts, splice, token_counts, whole_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def library(text):
    return len(TOK.encode(text or "", add_special_tokens=False))


PIECES = st.lists(
    st.sampled_from(["word", " ", "  ", "\n", "\t", "é", "汉字", "123", "!!", "<|endoftext|>", "<|end", "'s", " ", "　", "a b", "\x1c", "🙂"]),
    max_size=60,
).map("".join)


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_whole_counts_are_the_librarys(text):
    assert whole_counts([text], PATH) == [library(text)]


@settings(max_examples=150, deadline=None)
@given(PIECES, st.sampled_from([20, 33, 50]))
def test_a_splice_is_exact_or_refused(text, core):
    overlap, margin = 40, 14
    cuts = [f for f in range(0, max(1, len(text)), core) if f == 0 or f + overlap < len(text)]
    rows = [chunk_rows(text[f : f + core + overlap], f, f + core + overlap >= len(text), core, overlap, margin, PATH) for f in cuts]
    names = ("head_at", "head_before", "tail_at", "tail_before", "n")
    n = splice([dict(zip(names, r)) for r in rows])
    assert n is None or n == library(text)


def test_frame_with_huge_null_empty_and_unbroken_texts(spark):
    texts = {1: "one two  three\n four", 2: None, 3: "", 4: "word and <|endoftext|> more " * 300, 5: "x" * 5000, 6: " ".join(map(str, range(3000))), 7: "汉字汉字" * 900}
    rows = [(k, v, "extra") for k, v in texts.items()] + [(6, texts[6], "again"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts(df, PATH, huge=1000, chunk=600, overlap=120, margin=16).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (library(t), len(t.encode()), library(t) > 512)


def test_an_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_a_text_of_four_megabytes(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice(["alpha", "beta gamma", "汉字", "\n\n", "x" * 50, "12345", "end."]) for _ in range(700_000))
    assert len(text) > 4_000_000
    r = token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert (r.n_tokens, r.n_bytes) == (library(text), len(text.encode())) and r.n_chunks > 130


@given(st.integers(0, 300), st.sampled_from([1, 7, 50]), st.sampled_from([1, 20, 400]))
def test_cuts_cover_a_text_and_overlap(chars, chunk, overlap):
    got = cuts(chars, chunk, overlap)
    assert [c[2] for c in got] == [False] * (len(got) - 1) + [True] * bool(got)
    assert not got or (got[0][0] == 0 and got[-1][1] == chars)
    assert all(a[1] - b[0] == overlap for a, b in zip(got, got[1:]))
