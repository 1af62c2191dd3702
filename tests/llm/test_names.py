"""Long sequences of two values whose sums modulo 2**64 agree are still different texts."""

import numpy as np

from grainmill.llm import bytespans, repeats
from grainmill.llm.text import Words, prefix_sums, span_hashes


def twins(k, a, b):
    """The two Thue-Morse sequences of 2**k values."""
    first = [bin(i).count("1") & 1 for i in range(2**k)]
    return [a if x else b for x in first], [b if x else a for x in first]


def test_sums_agree_and_names_do_not():
    one, two = (np.frombuffer("".join(x).encode(), np.uint8) for x in twins(12, "x", "y"))
    both, ends = np.concatenate((one, two)), np.array([4096, 8192])
    sums = prefix_sums(both.astype(np.uint64))
    plain = span_hashes(sums, ends - 4096, ends)
    assert plain[0] == plain[1]
    assert len(set(span_hashes(sums, ends - 4096, ends, both).tolist())) == 2
    # words of that length
    data = np.frombuffer(b"".join([one.tobytes(), b" ", two.tobytes()]), np.uint8)
    assert len(set(Words(data, np.array([0, len(data)])).hashes(data).tolist())) == 2


def documents(spark, glue, units):
    left, right = twins(13, *units)
    rows = []
    for doc, middle in enumerate((left, right)):
        filler = [f"u{doc}x{k}" for k in range(300)]
        rows.append((doc, glue.join(filler[:150] + middle + filler[150:])))
    return spark.createDataFrame(rows, "doc_id long, text string")


def shared_windows(texts, size):
    seen = [{tuple(t[k:k + size]) for k in range(len(t) - size + 1)} for t in texts]
    return seen[0] & seen[1]


def test_words_that_nothing_repeats_stay(spark):
    left, right = twins(13, "one", "two")
    # a window of 5,000 words is in neither twin of the other; shorter ones of such sequences do repeat
    assert not shared_windows([left, right], 5000)
    docs = documents(spark, " ", ("one", "two"))
    assert [r.n_removed for r in repeats.remove_repeats(docs, 5000).collect()] == [0, 0]


def test_bytes_that_nothing_repeats_stay(spark):
    left, right = ("".join(x) for x in twins(13, "p", "q"))
    assert not shared_windows([left, right], 5000)
    docs = documents(spark, "", ("p", "q"))
    assert [r.n_removed for r in bytespans.remove_repeated_bytes(docs, 5000).collect()] == [0, 0]
