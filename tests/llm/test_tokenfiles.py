import numpy as np
import pytest
from tokenizers import Tokenizer

from tickloom.llm import tokenfiles
from tickloom.llm.tokenfiles import read_document, read_tokens, write_tokens


@pytest.mark.parametrize("which", ["small", "odd_docs", "no_docs"])
def test_round_trip(spark, which, request, tmp_path, vocabulary, monkeypatch):
    docs = request.getfixturevalue(which)
    if which == "small":
        monkeypatch.setattr(tokenfiles, "SHARD", 20_000)
    path = f"{tmp_path}/files"
    write_tokens(docs, path, vocabulary)
    tokenizer = Tokenizer.from_file(vocabulary)
    want = [(r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
    got = sorted(read_tokens(spark, path).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r["start"] == at and 4 * r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    key = lambda x: (str(x[0]), x[1])                                                # noqa: E731
    assert sorted([(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got], key=key) == sorted(want, key=key)
    if which == "small":
        assert spark.read.parquet(f"{path}/shards").count() > 3
        for id, tokens in want[::37]:
            one = read_document(spark, path, id).collect()
            assert [np.frombuffer(r["ids"], "<u4").tolist() for r in one] == [tokens]
        assert read_document(spark, path, -5).collect() == []


def test_another_dictionary_is_refused(spark, small, tmp_path, vocabulary):
    write_tokens(small.limit(20), f"{tmp_path}/a", vocabulary)
    write_tokens(small.limit(30), f"{tmp_path}/b", vocabulary)
    spark.read.parquet(f"{tmp_path}/b/dictionary").write.mode("overwrite").parquet(f"{tmp_path}/a/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        read_tokens(spark, f"{tmp_path}/a").collect()
