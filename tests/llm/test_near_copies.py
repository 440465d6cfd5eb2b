import numpy as np
import pyarrow as pa
import pytest

from cohortlake.llm import near_copies as N
from cohortlake.llm.bktree import Forest


def pair(rng, shingles=450, changed=50):
    """Sets of prints of which ``changed`` differ on either side."""
    common, *own = np.split(rng.integers(0, 1 << 63, shingles + changed, dtype=np.uint64), [shingles - changed, shingles])
    return [np.sort(np.concatenate((common, x))) for x in own]


def simhashes(sets):
    return N.set_fingerprints(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), np.concatenate(sets))


def test_simhash_is_the_majority_of_each_bit():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 7, 254, 255, 256, 511, 3000)] + [np.zeros(0, np.uint64)]
    got = simhashes(sets)
    for s, row in zip(sets, got, strict=True):
        for w in range(N.WORDS):
            want = 0
            for bit in range(64):
                ones = int((N.mix(s ^ N._EACH[w]) >> np.uint64(bit) & np.uint64(1)).sum())
                tie = len(s) and int(N.mix(N.mix(s[:1]) ^ N._EACH[w])[0]) >> bit & 1
                want |= (2 * ones + tie > len(s)) << bit
            assert int(row[w]) == want


@pytest.mark.parametrize(("count", "least"), [(2000, 1.0), (5000, 0.99), (170_000, 0.99), (10_000_000, 0.99)])
def test_shards_by_bits_of_the_simhash_keep_pairs_together(count, least):
    rng = np.random.default_rng(count)
    pairs = simhashes([s for _ in range(1500) for s in pair(rng)])
    tables = N.tables_for(count)
    a, b = (N.shards(pairs[i::2], tables) for i in (0, 1))
    apart = np.bitwise_count(pairs[::2, : N.FINGERPRINT] ^ pairs[1::2, : N.FINGERPRINT]).sum(axis=1)
    assert (((a == b).any(axis=1)) & (apart <= N.RADIUS)).mean() >= least
    # and hold about as many others as they should
    other = (a == np.roll(b, 1, axis=0)).mean()
    assert other * count <= max(2 * N.SHARD, 1.5 * count / (1 << tables.shape[1]))


def test_candidates_are_the_components_within_the_radius_of_each_shard():
    rng = np.random.default_rng(2)
    value = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    near = np.repeat(value, 12, axis=0)
    for row in near:  # chains and stars, some of equal fingerprints
        for bit in rng.integers(0, 128, int(rng.choice([0, 10, 18, 25]))):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    shard, node = np.arange(len(near)) // 12 % 3, rng.permutation(len(near))
    got = N._candidates(pa.table({"shard": shard, "low": near[:, 0].view(np.int64), "high": near[:, 1].view(np.int64), "node": node})).to_pylist()
    close = (np.bitwise_count(near[:, None] ^ near[None]).sum(axis=2) <= N.RADIUS) & (shard[:, None] == shard[None])

    def labels(link):
        label = np.arange(len(near))
        while True:
            low = np.array([label[row].min() for row in link])
            if (low == label).all():
                return label
            label = low

    assert all(e["b"] < e["a"] for e in got) and len({e["a"] for e in got}) == len(got)
    of, mine = {n: i for i, n in enumerate(node.tolist())}, np.eye(len(near), dtype=bool)
    for e in got:
        mine[of[e["a"]], of[e["b"]]] = mine[of[e["b"]], of[e["a"]]] = True
    assert (labels(mine) == labels(close)).all()


def test_forest_of_two_words_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    value = np.unique(rng.integers(0, 1 << 8, (300, 2)).astype(np.uint64), axis=0)
    q, x = Forest(np.zeros(len(value), int), value).search(np.arange(len(value)), 5)
    far = np.bitwise_count(value[:, None] ^ value[None]).sum(axis=2)
    assert set(zip(q.tolist(), x.tolist(), strict=True)) == {(i, j) for i, j in np.argwhere(far <= 5).tolist() if i != j}


def test_many_shards_lose_no_pair(spark, monkeypatch):
    """The whole operator where nodes are dealt to shards, as tables of over ``WHOLE`` nodes are."""
    monkeypatch.setattr(N, "WHOLE", 16)
    monkeypatch.setattr(N, "SHARD", 16)
    rng, rows = np.random.default_rng(4), []
    for i in range(150):
        text = [f"w{x}" for x in rng.integers(0, 1 << 40, 454)]
        copy = list(text)
        for j in range(10):  # similarity 0.8
            copy[10 + 7 * j] = f"x{j}"
        rows += [(3 * i, " ".join(text)), (3 * i + 1, " ".join(copy)), (3 * i + 2, " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 30)))]
    assert len(N.tables_for(450)) > 1
    got = N.near_copies(spark.createDataFrame(rows, "id bigint, text string").repartition(4), "id").collect()
    assert {r.key % 3 for r in got} <= {0, 1} and all(r.component // 3 == r.key // 3 for r in got)
    assert len(got) >= 2 * 147
