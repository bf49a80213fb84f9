import random
from collections import Counter, defaultdict

from weblode.llm import packing


def brute(lengths, sources, clusters, capacity, per_source):
    """Best fit by looking at every bin."""
    bins, jobs, placed = [], [], []
    for item, n in enumerate(lengths):
        full = max(0, n - 1) // capacity
        for piece in range(full):
            bins.append(None)
            placed.append((item, piece, len(bins) - 1, 0, capacity))
        jobs.append((n - full * capacity, item, full))
    for n, item, piece in sorted(jobs, key=lambda j: (-j[0], j[1])):
        fit = [
            (left, b) for b, x in enumerate(bins) if x is not None for left in [x[0]]
            if left >= n and (clusters[item] is None or clusters[item] not in x[2]) and (sources[item] is None or x[1][sources[item]] < per_source)
        ]
        if fit:
            left, b = min(fit)
        else:
            bins.append([capacity, Counter(), set()])
            left, b = capacity, len(bins) - 1
        bins[b][0] -= n
        bins[b][1][sources[item]] += 1
        bins[b][2].add(clusters[item])
        placed.append((item, piece, b, capacity - left, n))
    return placed


def test_against_looking_at_every_bin():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(0, 80)
        lengths = [rng.choice([0, 1, 3, rng.randint(0, 30), rng.randint(20, 95)]) for _ in range(n)]
        sources = [rng.choice([None, 0, 0, 0, 1, 2, 3]) for _ in range(n)]
        clusters = [rng.choice([None, *range(12)]) for _ in range(n)]
        assert sorted(packing.pack(lengths, sources, clusters, 30, 2)) == sorted(brute(lengths, sources, clusters, 30, 2))


def test_constraints_over_shards(make, prose):
    rows = [(i, prose(i % 40, 5 + i % 37), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(600)] + [(900, prose(1, 150), "en", "hot")]
    frame = packing.with_measures(make(rows))
    packed = packing.best_fit(frame, "doc_id", "_words", "source", "_copies", capacity=64, shard_rows=100, keep_text="text").collect()
    texts = {i: t for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in packed:
        bins[r.bin_id].append(r)
        pieces[r.doc_id].append(r)
    for inside in bins.values():
        inside.sort(key=lambda r: (r.bin_offset, r.n_tokens))
        assert sum(r.n_tokens for r in inside) <= 64
        assert all(a.bin_offset + a.n_tokens == b.bin_offset for a, b in zip(inside, inside[1:]))
        assert len({texts[r.doc_id] for r in inside}) == len(inside)
        assert max(Counter(source[r.doc_id] for r in inside).values()) <= packing.PER_SOURCE
    assert set(pieces) == set(texts) and len({b >> 32 for b in bins}) > 3
    for i, parts in pieces.items():
        parts.sort(key=lambda r: r.piece)
        assert " ".join(r.text for r in parts) == texts[i] and sum(r.n_tokens for r in parts) == len(texts[i].split())


def test_odd_rows(make, odd):
    frame = packing.with_measures(make([(*r, "en", None) for r in odd]))
    packed = packing.best_fit(frame, "doc_id", "_words", "source", "_copies", keep_text="text").collect()
    assert sum(r.n_tokens for r in packed) == sum(len((t or "").encode().split()) for _, t in odd)
    assert sum(r.piece == 0 for r in packed) == len(odd)
    same = [r.bin_id for r in packed if r.doc_id in (4, 5)]
    assert len(same) == len(set(same)) == 3
    assert packing.best_fit(packing.with_measures(make([])), "doc_id", "_words", "source", "_copies").count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = packing.op7_packing(spark, sf).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(d.doc_id for d in docs)
    fill = Counter()
    for r in rows:
        fill[r.bin_id] += r.n_tokens
    assert max(fill.values()) <= packing.CAPACITY and sum(fill.values()) == sum(len((d.text or "").split()) for d in docs)
    assert len(fill) <= 1.1 * (sum(fill.values()) / packing.CAPACITY) + 5


def test_one_repeated_row_spreads_over_shards(make):
    frame = packing.with_measures(make([(7, "the same row")] * 400 + [(i, f"row {i}") for i in range(100, 300)]))
    packed = packing.best_fit(frame, "doc_id", "_words", "source", "_copies", shard_rows=100).collect()
    here = Counter(r.bin_id >> 32 for r in packed if r.doc_id == 7)
    assert sum(here.values()) == 400 and len(here) == 6 and max(here.values()) < 120
    assert len({r.bin_id for r in packed if r.doc_id == 7}) == 400
