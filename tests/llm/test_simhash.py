import numpy as np
import xxhash

from dockside.llm.simhash import Golay, components, keys_of, near_duplicates


def brute(rows):
    fps = []
    for _, t in rows:
        s = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in s.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if x]
        h = [w[i : i + 4] for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(" ".join(x), 42) for x in h]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(
        ((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr
    )


def test_as_brute_force(make_docs, corpus):
    long = corpus[-7][1]
    rows = corpus + [(500 + i, (long or "") + " tail" * i) for i in range(5)]
    got = sorted((tuple(r) for r in near_duplicates(make_docs(rows)).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([])).collect() == []


def test_golay_decodes():
    code = Golay()
    words = np.arange(1 << 23, step=97)
    centre = words ^ code.error[code.remainder(words)]
    assert (code.remainder(centre) == 0).all()
    assert np.bitwise_count(words ^ centre).max() <= 3
    near = code.near(words)
    assert set((near >= 0).sum(axis=1)) == {1, 6}


def test_keys_meet_all_pairs_within_four_bits():
    code = Golay()
    rng = np.random.default_rng(3)
    n = 4000
    left = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    right = left.copy()
    for i in range(n):
        for bit in rng.choice(64, i % 5, replace=False):
            right[i] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for fps in (left, right):
        k, o = keys_of(fps, code)
        held = [set() for _ in range(n)]
        for key, owner in zip(k.tolist(), o.tolist()):
            held[owner].add(key)
        keys.append(held)
    assert all(a & b for a, b in zip(*keys))


def test_components_of_a_long_path(spark):
    rows = [(i + 1, i) for i in range(40)] + [(102, 100), (102, 101)]
    got = {r.a: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
