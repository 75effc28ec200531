"""Byte-level encoding against the tiktoken library, and decoding back."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(FILE)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    # marks of the literal texts among others
    g = random.Random(4)
    every = [chr(c) for c in [*range(0x250), *range(0x370, 0x600), *range(0x900, 0x980), *range(0x2000, 0x2070), *range(0x3000, 0x3100), *range(0x4E00, 0x4E40), 0x1F600, 0x1D400, 0x10FFFF, 0xFEFF, 0x85, 0x180E]]
    yield from (None, "", " ", "  ", "\n\n \t x", "don't we'll I'VE", "a  b   c", "<|endoftext|>", "x" * 300, "ab" * 200, " " * 500 + "z", "=" * 99, "\x85\xa0　 a", "A" + "́" * 40, "a\1b \2c\3 \1b" * 3)
    yield "".join(g.choice("abcdefgh") for _ in range(700))  # one long word
    yield " ".join("".join(g.choices("etaoinshrdlu", k=g.randint(1, 12))) for _ in range(20_000))
    for _ in range(150):
        yield "".join(g.choices(every, k=g.randint(1, 60)))
    for _ in range(150):
        yield " ".join("".join(g.choices("etaoin", k=g.randint(1, 9))) for _ in range(g.randint(1, 30)))


def check(rows, library):
    for r in rows:
        want = library.encode_ordinary(r.text or "")
        assert r.ids == want, r.text
        assert bytes(r.decoded) == (r.text or "").encode()


def test_ids_are_the_librarys(spark, ranks, library):
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts())], "doc_id long, text string, ids int, words string").repartition(4)
    found = bpe.encode(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    assert all(r.t == " ".join(map(str, r.ids)) for r in bpe.encode(docs.limit(40), as_text="t").collect())
    check(found.withColumn("decoded", bpe.decode(F.col("ids"))).collect(), library)


@pytest.mark.parametrize("most", [0, 3, 40])
def test_ids_do_not_depend_on_how_many_words_are_kept(spark, ranks, library, most):
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    docs = spark.createDataFrame([(t,) for t in list(texts())[-40:]], "text string")
    kept = bpe.frequent(docs, "text", most)
    assert kept is None or kept.size <= most
    if kept:
        words = docs.select(F.explode(bpe.words(F.col("text"))).alias("w")).distinct()
        got = words.select("w", kept.get(kept.literal, F.col("w")).alias("p")).where("p <> ''").collect()
        assert len(got) == kept.size and all(r.p == " ".join(map(str, library.encode_ordinary(r.w))) for r in got)
    check(bpe.encode(docs, most=most).withColumn("decoded", bpe.decode(F.col("ids"))).collect(), library)


def test_merges_and_what_has_none(ranks):
    found = byte_bpe.merges({bytes([b]): b for b in range(256)} | {b"ab": 300, b"abab": 301, b"bc": 302})
    assert found == {"ab": 300, byte_bpe.character(300) * 2: 301, "bc": 302}
    assert len(byte_bpe.merges(ranks)) == len(ranks) - 256
    with pytest.raises(ValueError, match="lower ranks"):
        byte_bpe.merges({b"a": 0, b"b": 1, b"ab": 9, b"abb": 5})
    assert len({byte_bpe.character(r) for r in range(100_000)}) == 100_000 and byte_bpe.character(60_000).encode()


def test_decoding_any_ids(spark, ranks):
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    g, token = random.Random(5), {i: t for t, i in ranks.items()}
    rows = [[g.randrange(len(ranks)) for _ in range(k)] for k in (0, 1, 50, 5000)]
    got = spark.createDataFrame([(r,) for r in rows] + [(None,), ([5, len(ranks)],), ([-1],), ([3, None],)], "ids array<int>").select(bpe.decode(F.col("ids")).alias("d")).collect()
    assert [bytes(r.d) for r in got[:4]] == [b"".join(token[i] for i in r) for r in rows]
    assert [r.d for r in got[4:]] == [None] * 4


def test_the_query(spark, library, tmp_path):
    from lodestone.llm.queries import op13_byte_bpe

    spark.createDataFrame([(i, t) for i, t in enumerate(texts())] + [(None, "tie"), (3, "tie")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    texts_ = {i: t or "" for i, t in enumerate(texts())}
    rows = op13_byte_bpe(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts_) + 2
    for r in rows:
        if r.doc_id is not None and r.doc_id != 3:
            ids = library.encode_ordinary(texts_[r.doc_id])
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts_[r.doc_id].encode()).hexdigest())


def test_empty_table_and_unusable_ranks(spark, ranks):
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    assert bpe.encode(spark.createDataFrame([], "text string")).collect() == []
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe({b"a": 0}, public_tokenizers.PATTERN)
