import pytest

from pairforge.llm import trie

from .test_trie import brute, rebuilt, some, table_of


@pytest.mark.parametrize("block", [1, 2])
def test_blocks_of_blocks(spark, tmp, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = some(11, 40, 33)
    assert table_of(spark, tmp, rows) == brute(rebuilt(rows))


def test_few_tables_are_written(spark, tmp, monkeypatch):
    names, write = [], trie.written
    monkeypatch.setattr(trie, "written", lambda s, df, name: names.append(name) or write(s, df, name))
    rows = [(c, t, "user", f"t{t // (1 + c % 7)}") for c in range(5) for t in range(60)]
    assert table_of(spark, tmp, rows) == brute(rebuilt(rows))
    assert len(names) <= 10  # 32 by halves: each costs the driver plans, jobs and generated code
