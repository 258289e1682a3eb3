import tracemalloc

import numpy as np
import pyarrow as pa

from ledgerline.llm.suffix_dedup import repeated_by_key, repeated_starts


def test_the_index_of_regions_takes_few_bytes_a_symbol():
    rng = np.random.RandomState(1)
    shared = [rng.randint(97, 123, 300, dtype=np.uint8).tobytes() for _ in range(5)]
    regions = [rng.randint(97, 123, 100, dtype=np.uint8).tobytes() + shared[i % 5]
               + rng.randint(97, 123, 100, dtype=np.uint8).tobytes() for i in range(400)]
    tracemalloc.start()
    got = repeated_starts(regions, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(set(range(100, 201)) <= set(x.tolist()) for x in got)
    assert peak < 100 * sum(len(r) + 1 for r in regions)
    assert [len(x) for x in repeated_starts([b"ab"], 200)] == [0]


def test_the_index_does_not_follow_the_regions_of_a_task():
    rng = np.random.RandomState(2)
    regions, keys = [], []
    for k in range(1200):
        base = rng.randint(97, 110, 700, dtype=np.uint8)
        for _ in range(3):
            part = base[rng.randint(0, 200):rng.randint(450, 700)].copy()
            part[rng.randint(0, len(part))] = 65
            regions.append(part.tobytes())
            keys.append(k * 7919 - 5)
    mixed = rng.permutation(len(keys))
    regions, keys = [regions[i] for i in mixed], np.array(keys)[mixed]
    total, found, column = sum(map(len, regions)), [], pa.array(regions, pa.binary())
    tracemalloc.start()
    for i, places in repeated_by_key(keys, column, 200):
        found.append((i, len(places)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * total  # 60 to 70 for the whole task at once
    assert sorted(found) == [(i, len(x)) for i, x in enumerate(repeated_starts(regions, 200))]
    assert not list(repeated_by_key(np.empty(0, np.int64), pa.array([], pa.binary()), 200))
