"""The last step of the encoding holds no tokenizer, and works through a block's words in runs."""

import hashlib

from tokenizers import Tokenizer

from cubelith.llm import bpe
from cubelith.llm.queries import word_bpe_path


def test_room_is_made():
    source = bpe.read_vocabulary(word_bpe_path())
    bpe.encode_words([b"word"], source)
    assert bpe._MADE
    bpe.make_room()
    assert not bpe._MADE


def test_runs_of_words(spark, monkeypatch):
    monkeypatch.setattr(bpe, "RUN_WORDS", 3)
    texts = ["one two three four five", "\u0001 two 中文 unbelievable", "", None, "seven eight nine ten eleven twelve one one", "<|x|> One"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(word_bpe_path())
    t.no_truncation()
    t.no_padding()
    got = {r["doc_id"]: r for r in bpe.encode(rows, word_bpe_path(), with_ids=True).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["token_ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
