import random

from gleanworks.operators.intervals import periods_and_gaps, speech_intervals

HOUR = 3_600_000


def brute(rows, most=HOUR):
    out = []
    for key in {k for k, *_ in rows}:
        periods = []
        for s, e in sorted((s, e) for k, s, e in rows if k == key):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out += [(key, "period", s, e) for s, e in periods]
        out += [(key, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:]) if b[0] - a[1] < most]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, a bigint, b bigint").withColumnRenamed("a", "from").withColumnRenamed("b", "to")
    return sorted(map(tuple, periods_and_gaps(df, "k", "from", "to", **kw).collect()))


def test_random_intervals_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for key in "abc":
        for _ in range(300):
            s = rng.randint(0, 40_000)
            rows.append((key, s, s + rng.choice([0, 1, 10, 90, 2_000])))
    # small blocks, so that periods cross many of them
    assert run(spark, rows, block_ms=1_000) == brute(rows)
    assert run(spark, rows + rows, block_ms=7) == brute(rows)


def test_one_key_holds_most_rows_and_one_interval_spans_all(spark):
    rng = random.Random(2)
    rows = [("hot", s := rng.randint(0, 9_000_000), s + rng.randint(1, 3_000)) for _ in range(4_000)] + [("x", 5, 5), ("y", 0, 10**9), ("y", 10**8, 10**8 + 5)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows_and_empty_table(spark):
    rows = [(None, 1, 2), ("k", None, 2), ("k", 1, None), ("k", 9, 3), ("k", -5, -1), ("k", -1, 4)]
    assert run(spark, rows) == [("k", "period", -5, 4)]
    assert run(spark, []) == []
    assert run(spark, [("k", 0, 1), ("k", HOUR + 1, HOUR + 2), ("k", HOUR + 5, HOUR + 6)]) == [("k", "gap", HOUR + 2, HOUR + 5), ("k", "period", 0, 1), ("k", "period", HOUR + 1, HOUR + 2), ("k", "period", HOUR + 5, HOUR + 6)]


def test_segments_that_count(spark):
    nan = float("nan")
    rows = [("m", 1.0004, 2.0), ("m", 2.0, 2.0), ("m", 3.0, 1.0), ("m", nan, 2.0), ("m", 1.0, nan), ("m", None, 1.0), ("m", 0.0, 1e300)]
    df = spark.createDataFrame([(*r, "key") for r in rows], "media_id string, start_s double, end_s double, key string")
    assert [tuple(r) for r in speech_intervals(df).collect()] == [("m", 1000, 2000)]


def test_merging_two_lists_is_a_walk_over_both():
    import random

    from gleanworks.operators.intervals import _Tree, merge_two

    rng = random.Random(3)

    def some():
        cuts = sorted(rng.sample(range(200), 2 * rng.randint(0, 12)))
        return cuts[::2], cuts[1::2]

    def union(*lists):
        out = []
        for s, e in sorted(x for starts, ends in lists for x in zip(starts, ends)):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [x for x, _ in out], [x for _, x in out]

    for _ in range(300):
        parts = [some() for _ in range(rng.randint(1, 9))]
        assert merge_two(parts[0], parts[-1]) == union(parts[0], parts[-1])
        tree = _Tree()
        for x in parts:
            tree.add(x)
        assert tree.whole() == union(*parts)
