import numpy as np
import pytest

from tallyloom.llm import decontamination
from tallyloom.llm import simhash as S


@pytest.fixture
def small_broadcasts(spark):
    """Spark refuses to broadcast more than 1 MB, whatever it took a table's size to be."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def planted(n, near, flips):
    """n random fingerprints, ``near`` of them again with some bits flipped, and the pairs of those."""
    rng = np.random.default_rng(6)
    fps = rng.integers(-(2**63), 2**63, n)
    other = fps[:near] ^ np.int64(flips)
    return np.concatenate((fps, other)), {(min(a, b), max(a, b)) for a, b in zip(fps[:near].tolist(), other.tolist())}


@pytest.mark.parametrize("distance, blocks, flips", [(6, 8, 0b111 << 20), (2, 4, 0b11 << 20)])
def test_keys_of_fingerprints_are_not_broadcast(spark, small_broadcasts, tmp_path, distance, blocks, flips):
    fps, pairs = planted(12_000, 200, flips)
    spark.createDataFrame([(int(x),) for x in fps], "fp long").write.parquet(f"{tmp_path}/fps")
    links = S.fingerprint_links(spark.read.parquet(f"{tmp_path}/fps"), distance, blocks)
    assert {(min(r), max(r)) for r in links.distinct().collect()} == pairs


def test_pairs_of_blocks_are_not_broadcast(spark, small_broadcasts, tmp_path):
    n = 400
    spark.createDataFrame([(1, i, n, [i]) for i in range(n)], "key int, block int, blocks int, inside array<int>").write.parquet(f"{tmp_path}/blocks")
    found = S._pairs_of_blocks(spark.read.parquet(f"{tmp_path}/blocks"), ["key"], "inside").collect()
    assert sorted((r.a[0], r.b[0]) for r in found) == [(i, j) for i in range(n) for j in range(i + 1, n)]


def test_windows_of_items_are_not_broadcast(spark, small_broadcasts, tmp_path):
    text = " ".join(f"w{i}" for i in range(3000))
    spark.createDataFrame([(i, text) for i in range(3)], "item_id int, text string").write.parquet(f"{tmp_path}/items")
    spark.createDataFrame([(i, f"{text} {i}") for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    found = decontamination.scan(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/items"), max_words=10).collect()
    assert [r.n_hit for r in found] == [3000] * 40
