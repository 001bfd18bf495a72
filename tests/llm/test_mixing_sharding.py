import random
from collections import defaultdict

from helpers import clashing, odd_texts, words

from sievework.llm import mixing, sharding

DOC = "doc_id long, text string, source string"


def corpus(spark, n=300):
    r = random.Random(3)
    rows = [(i, words(r, r.choice([1, 5, 30])), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(n)]
    rows += [(i, t, None if i is None or i % 2 else "s9") for i, t in odd_texts()]
    return spark.createDataFrame(rows, DOC)


def test_targets_share_by_weight_up_to_the_cap(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 100), ("c", 1), (None, 199)], "source string, source_size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(sizes).collect()}
    assert got["c"] == (1, 3.0) and abs(sum(t for _, t in got.values()) - 400) < 1e-9
    assert abs(got["b"][1] / got["a"][1] - 2) < 1e-9 and abs(got[None][1] / got["a"][1] - 1) < 1e-9


def test_sources_come_near_their_targets(spark):
    docs = corpus(spark)
    rows = mixing.mix(clashing(docs)).collect()
    assert len(rows) == docs.count()
    sums, goal, size, top = defaultdict(int), {}, {}, defaultdict(int)
    for r in rows:
        sums[r.source] += r.taken
        goal[r.source], size[r.source] = r.target, r.source_size
        top[r.source] = max(top[r.source], r.size)
        assert 0 <= r.taken <= 3 * r.size and (r.first_position is None or 0 <= r.first_position <= 1)
    for s in goal:
        assert abs(sums[s] - goal[s]) <= top[s], s
    again = sorted(map(str, mixing.mix(docs.repartition(7)).select("doc_id", "size", "taken", "first_position").collect()))
    assert again == sorted(str(r) for r in mixing.mix(docs).select("doc_id", "size", "taken", "first_position").collect())


def test_copies_are_ordered_and_complete(spark):
    docs = corpus(spark)
    mixed = mixing.mix(docs)
    want = sum(r.copies for r in mixed.collect())
    got = mixing.materialise(docs, mixed, keep_position=True).collect()
    assert len(got) == want and [r.position for r in got] == sorted(r.position for r in got)
    assert mixing.materialise(docs, mixed).columns == docs.columns


def test_rows_come_in_the_order_of_training(spark):
    """Places of all copies by brute force; the query's rows come in that order."""
    docs = corpus(spark)
    rows = mixing.mix(clashing(docs)).collect()
    copies = []
    for r in rows:
        for k in range(r.copies):
            q = min(1.0, (k * r.source_size + r.start + r.size / 2) / r.target) if r.target else 1.0
            at = q if r.ramp == 0 or not r.target else (r.ramp - 1 + ((1 - r.ramp) ** 2 + 4 * r.ramp * q) ** 0.5) / (2 * r.ramp)
            copies.append((round(at, 12), r.th, r.source is None, r.source or "", k))
    copies.sort()
    got = mixing.sequence(docs.repartition(5)).where("copy is not null").collect()
    assert sorted(r.place for r in got) == list(range(len(copies)))
    assert [(round(r.position, 12), r.th, r.source is None, r.source or "", r.copy) for r in sorted(got, key=lambda r: r.place)] == copies
    places = {(r.th, r.source, r.start): r.place for r in got if r.copy == 0}
    assert all(r.first_place == places[r.th, r.source, r.start] for r in rows if r.copies)
    taken = [r.first_place for r in rows if r.copies]
    assert taken == sorted(taken) and all(r.copies and r.first_place is not None for r in rows[: len(taken)])
    assert len(taken) < len(rows) and all(r.first_place is None for r in rows[len(taken) :])


def test_empty(spark):
    e = spark.createDataFrame([], DOC)
    assert mixing.mix(e).collect() == [] and sharding.shard(e).collect() == []


def test_shards_fit_and_split_no_further_than_needed(spark):
    docs = corpus(spark)
    for limit in (200, 2000, 1 << 30):
        rows = sharding.shard(clashing(docs), limit).collect()
        assert len(rows) == docs.count()
        sums, count = defaultdict(int), defaultdict(int)
        for r in rows:
            sums[r.depth, r.prefix, r.part] += r.bytes
            count[r.depth, r.prefix, r.part] += 1
        for r in rows:
            key = r.depth, r.prefix, r.part
            assert sums[key] == r.shard_bytes and (sums[key] <= limit or count[key] == 1)
        bits = {(d, p) for d, p, _ in sums}
        for d, p in bits:  # prefix free, and the parent was above the limit
            assert not any((d - k, p >> k) in bits for k in range(1, d + 1))
            if d:
                assert sum(s for (e, q, _), s in sums.items() if e >= d - 1 and q >> (e - d + 1) == p >> 1) > limit


def test_alike_rows_are_cut_by_number(spark):
    docs = spark.createDataFrame([(1, "x" * 100, "s")] * 50, DOC)
    rows = sharding.shard(docs, 450).collect()
    sums = defaultdict(int)
    for r in rows:
        sums[r.part] += r.bytes
    assert len(rows) == 50 and max(sums.values()) <= 450


def test_written_shards(spark, tmp_path):
    docs = corpus(spark)
    sharding.write_shards(sharding.shard(docs, 2000), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()
