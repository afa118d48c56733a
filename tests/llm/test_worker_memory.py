"""Workers outlive queries: what they keep must not grow with the number of queries."""

from tablecraft.llm import rank_bpe


def test_queries_share_one_encoder(spark):
    first, second = (rank_bpe._loaded(rank_bpe._Shared(rank_bpe._share(spark, None))) for _ in range(2))
    assert first is second and len(rank_bpe._LOADED) == 1


def test_another_vocabulary_takes_its_place(spark, tmp_path):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        (tmp_path / "other.json").write_text(f.read() + " ", encoding="utf-8")
    for path in (None, str(tmp_path / "other.json")):
        encoder = rank_bpe._loaded(rank_bpe._Shared(rank_bpe._share(spark, path)))
    assert list(rank_bpe._LOADED.values()) == [encoder]
