"""Quoted CSV by byte splits against Python's csv module, splits of a few bytes included."""

import csv
import random

import pytest

from tabulens.sources.csv import read_csv
from tabulens.sources.csv_split import read_quoted, records, start_states, _lines


@pytest.fixture()
def tiny_splits(spark):
    """Splits of 400 bytes, so that many records cross one."""
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _cells(rng):
    pool = ["", "x", "a,b", "two\nlines", "\n\n", 'say "hi"', '"', '""', "'", "long " * 30, "é", "tail\n", ",\n,", '"\n"']
    return [rng.choice(pool) for _ in range(3)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2])
def test_records_equal_csv_module(tiny_splits, tmp_path, seed, end):
    rng = random.Random(seed)
    rows = [[str(i), *_cells(rng)] for i in range(300)]
    path = tmp_path / "t.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["id", "b\nb", "c", "d"])
        w.writerows(rows)
    lines = _lines(tiny_splits, str(path), None)
    assert lines.rdd.getNumPartitions() > 8
    states = {r.inside for r in start_states(lines).collect()}
    assert states == {True, False}
    want = sorted(tuple(v or None for v in r) for r in rows)
    for limit in (50_000, 0):           # splits broadcast and joined
        heads = records(tiny_splits, str(path), broadcast_splits=limit).where("first").collect()
        assert [h.text for h in heads] == ['id,"b\nb",c,d']
    got = read_quoted(tiny_splits, str(path), ["id", "b\nb", "c", "d"]).collect()
    assert sorted(tuple(v or None for v in r) for r in got) == want


def test_joined_splits_give_the_same_records(tiny_splits, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,v\n" + "".join(f'{i},"{"line" * (i % 9)}\n{i}"\n' for i in range(200)))
    a, b = (sorted(r.text for r in records(tiny_splits, str(path), broadcast_splits=n).collect()) for n in (50_000, 0))
    assert a == b and len(a) == 201


def test_stray_quotes_blank_lines_bom_and_short_rows(tiny_splits, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('\ufeff"a",b\n5" pipe,x\n\n7,"it\'s\n""fine"""\n8\n9,"never closed\nat all\n', encoding="utf-8")
    got = {tuple(r) for r in read_csv(tiny_splits, str(path)).collect()}
    assert got == {('5" pipe', "x"), ("7", 'it\'s\n"fine"'), ("8", None), ("9", "never closed\nat all\n")} or got == {
        ('5" pipe', "x"), ("7", 'it\'s\n"fine"'), ("8", None), ("9", "never closed\nat all")}


def test_each_file_has_its_header_and_latin1_is_decoded(tiny_splits, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.csv").write_bytes(f'k,v\n{i},"caf\u00e9\n{i}"\n'.encode("latin-1"))
    got = sorted(tuple(r) for r in read_csv(tiny_splits, str(tmp_path)).collect())
    assert got == [(i, f"café\n{i}") for i in range(3)]


def test_states_of_a_batch_equal_line_by_line():
    import numpy as np
    from tabulens.sources.csv_split import _states
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 200):
        for share in (0.0, 0.1, 0.9):
            opens, stays = rng.random(n) < 0.5, rng.random(n) < 0.5
            stays = np.where(rng.random(n) < share, opens, ~opens)          # from swaps and identities only to few of them
            for state in (False, True):
                got, at, want = _states(opens, stays, state), state, []
                for o, s in zip(opens, stays):
                    at = s if at else o
                    want.append(at)
                assert got.tolist() == [bool(w) for w in want]


def test_records_are_put_together_once(tiny_splits, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,v\n" + "".join(f'{i},"a\n{i}"\n' for i in range(100)))
    out = records(tiny_splits, str(path))
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 101
