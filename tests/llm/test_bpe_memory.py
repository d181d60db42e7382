from clinisieve.llm import bpe


def test_memos_of_an_idle_worker_are_small():
    assert bpe.MEMO <= 1 << 17
