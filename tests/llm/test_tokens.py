import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stowage.llm import tokens

REFERENCE = Tokenizer.from_file(str(Path(tokens.TOKENIZERS) / "byte_bpe_50k.json"))
REFERENCE.encode_special_tokens = True
ENCODER = tokens.encoder_of()
DECODER = tokens.Decoder(ENCODER.tokens)


def check(text):
    ids = ENCODER.encode(text)
    assert ids == REFERENCE.encode(text, add_special_tokens=False).ids
    assert DECODER.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeinrst 'slÄé\n\t1290_-=日本ไท", max_size=120))
def test_texts_of_few_letters(text):
    check(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", " " * 30_000, "a" * 30_000, "ab" * 20_000, "日" * 9_000, "=-" * 9_000, "\r\n\r\n", " ", "don't we'll I'M", "👩‍🚀"])
def test_hard_texts(text):
    check(text)


def test_long_random_piece():
    rng = random.Random(4)
    check("".join(rng.choice("etaoinshrdlu") for _ in range(60_000)))


def test_split_of_tokens_is_theirs():
    rank = {t: i for i, t in enumerate(ENCODER.tokens)}
    for i, t in enumerate(ENCODER.tokens):
        if len(t) > 1:
            a, b = ENCODER.split[i]
            assert ENCODER.tokens[a] + ENCODER.tokens[b] == t and max(a, b) < i == rank[t]


def test_rows(spark):
    data = [(1, None, 5), (2, "", 6), (3, " \n", 7), (4, "Nothing was rewritten.", 8), (4, "Nothing was rewritten.", 8)]
    df = spark.createDataFrame(data, "doc_id long, text string, ids int")
    rows = tokens.encode_texts(df).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in rows)[:2] == [(1, ()), (2, ())]
    assert len(rows) == 5 and all(list(r["ids"]) == ENCODER.encode(r["text"]) for r in rows)
    assert tokens.encode_texts(df.where("doc_id > 9")).collect() == []
    back = tokens.encode_texts(df).select("text", tokens.decoded(df, tokens.F.col("ids")).alias("back")).collect()
    assert all(r["back"] == (r["text"] or "") for r in back)


def test_gaps_are_refused(tmp_path):
    (tmp_path / "x.tiktoken").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        tokens.read_vocabulary(str(tmp_path / "x.tiktoken"))
