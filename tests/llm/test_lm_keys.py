import pickle
import sys
import tracemalloc
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from paperloom.llm import lm_scores  # noqa: E402
from paperloom.llm._common import mixed  # noqa: E402


def test_keys_are_found_and_packed():
    keys = np.sort(mixed(np.arange(5000, dtype=np.uint64)))
    for some in (keys, keys[:1], keys[:0]):
        table, wanted = lm_scores.Keys(some), np.concatenate([keys[::-1], np.array([0, (1 << 64) - 1], np.uint64)])
        at = table.find(wanted)
        assert ((at >= 0) == np.isin(wanted, some)).all() and (some[at[at >= 0]] == wanted[at >= 0]).all()
        assert (lm_scores.unpacked(lm_scores.packed(some)) == some).all()
    again = np.sort(np.concatenate([keys, keys[:9]]))
    assert (lm_scores.unpacked(lm_scores.packed(again)) == again).all()


def test_asks_move_as_arrays_of_a_bucket(spark):
    """No row for each n-gram of each text: documents go through two exchanges of packed arrays, and no join."""
    table = spark.createDataFrame([(i, f"a b c {i} a b") for i in range(40)], "doc_id long, text string")
    got = lm_scores.lm_scores(table, hot_tokens=0, most_arcs=0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapGroupsInArrow") == 2
    assert sorted(r.doc_id for r in got.collect()) == list(range(40))


def test_a_bucket_stays_small():
    """A bucket is whole in the memory of a task: its share of the corpus has one size, and isn't up to twice or four times that."""
    for tokens in (0, 1 << 20, 41_000_000, (1 << 31) - 1):
        begins = lm_scores.bucket_begins(tokens)
        assert begins[0] == 0 and (np.diff(begins) > 0).all() and len(begins) >= 16
        assert tokens <= len(begins) << 20
        widths = np.diff(begins)
        assert int(widths.max()) - int(widths.min()) <= 1


def test_windows_hold_one_size():
    """Tokens of a task's memory are held as n-grams of the size that is counted, not of all sizes and their owners at once."""
    tokens, counts = mixed(np.arange(1 << 18, dtype=np.uint64)), np.full(1 << 8, 1 << 10)
    tracemalloc.start()
    context, suffix, key, inside = lm_scores.windows(tokens, counts, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * tokens.nbytes
    assert len(key) == len(tokens) - 2 and len(inside) == len(tokens) - 2 * len(counts)
    assert (key == lm_scores.gram_keys(context, suffix)).all() and (context[1:] == suffix[:-1]).all()
    assert all(len(x) == 0 for x in lm_scores.windows(tokens[:1], np.array([1]), 3))


def test_bitmap_has_both_places_of_each_key(spark):
    keys = mixed(np.arange(3000, dtype=np.uint64))
    table = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long").repartition(3)
    for bits in (1 << 27, 1 << 20, 1 << 10):
        got = np.unpackbits(lm_scores.key_bitmap(table, bits).view(np.uint8), bitorder="little")
        want = np.zeros(bits, np.uint8)
        want[(keys & np.uint64(bits - 1)).astype(np.int64)] = want[((keys >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)] = 1
        assert (got == want).all()
    assert not lm_scores.key_bitmap(table.where("false"), 1 << 20).any()


def test_what_moves_is_packed():
    """Numbers of texts take ten bits, not sixteen, and keys that are sent no byte that is 0 in all differences."""
    for n in (0, 1, 3, 4, 1023, 1024):
        numbers = np.arange(n, dtype=np.uint16)[::-1]
        data = lm_scores.ten_bits(numbers)
        assert len(data) == n + -(-n // 4) and (lm_scores.of_ten_bits(data, n) == numbers).all()
    for n in (0, 1, 1 << 17):
        keys = lm_scores.Keys(np.sort(mixed(np.arange(n, dtype=np.uint64))))
        data = pickle.dumps(keys)
        assert (pickle.loads(data).keys == keys.keys).all() and (n < 2 or len(data) < 7.1 * n)
