"""Fingerprints and vantage-point search against brute force."""

import numpy as np
import xxhash

from worklens.llm import simhash_vptree as vp

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    smallest = {}
    for (doc, _), group in zip(rows, label, strict=True):
        if doc is not None:
            smallest[group] = min(doc, smallest.get(group, doc))
    return sorted(((d, format(p, "016x"), smallest.get(g)) for (d, _), p, g in zip(rows, prints, label, strict=True)), key=str)


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcé"), 3))
    rows = []
    for i in range(60):
        rows.append((1000 - i, " ".join(word() for _ in range(int(rng.integers(0, 40))))))
    rows += [(5, rows[0][1].upper()), (6, rows[1][1] + " "), (7, None), (8, ""), (None, rows[2][1]), (9, "A"), (9, "A"), (None, "only here"), (11, "w " * 30000 + "z")]
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, node string, component_id string")
    got = sorted(map(tuple, vp.digest(frame).collect()), key=str)
    assert got == expected(rows)
    assert vp.digest(frame.limit(0)).collect() == []


def test_tree_and_leaves_find_every_link(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 250, dtype=np.uint64)
    near = [b ^ np.uint64((1 << int(i)) | (1 << int(j))) for b in base[:120] for i, j in [rng.integers(0, 63, 2)]]
    points = np.unique(np.concatenate([base, np.array(near)]))
    nodes = vp.nodes(points[:, None], np.zeros(len(points), int))
    frame = spark.createDataFrame([(bytes(n),) for n in nodes.to_pylist()], "node binary")
    found = vp.links(frame, leaf=16)
    label = {bytes(n): i for i, n in enumerate(nodes.to_pylist())}
    pairs = [(label[bytes(r["a"])], label[bytes(r["b"])]) for r in found.collect()]
    group = list(range(len(points)))
    want = [(i, j) for i in range(len(points)) for j in range(i) if int(points[i] ^ points[j]).bit_count() <= 2]
    def joined(links):
        out = list(group)
        for _ in range(8):
            for a, b in links:
                out[a] = out[b] = min(out[a], out[b])
        return out
    assert want and joined(pairs) == joined(want)


def survivors(rows):
    """(doc_id is null, doc_id) of the rows that stay, by all pairs of fingerprints."""
    prints = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(label[i], []).append((doc is None, doc or 0))
    return sorted(min(g) for g in groups.values())


def test_one_of_each_group_stays_as_by_brute_force(spark):
    rng = np.random.default_rng(5)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]
    rows, number = [(5, None), (6, ""), (7, "short text"), (7, "short text")], iter(rng.permutation(range(10, 1000)).tolist())
    for _ in range(20):
        base = words(int(rng.choice([5, 8, 60, 400, 900])))
        for _ in range(6):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 3))):
                copy[at] = "changed" + str(rng.integers(1000))
            rows.append((next(number), " ".join(copy)))
    frame = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], "doc_id long, text string, node string, root string, c0 string")
    want, got = survivors(rows), vp.one_of_each(frame)
    assert 25 < len(want) < len(rows) - 40 and got.columns == frame.columns
    assert sorted((False, r["doc_id"]) for r in got.collect()) == want
    assert got.where("node <> 'x' or root <> 'y' or c0 <> 'z'").isEmpty()
    assert vp.one_of_each(frame.limit(0)).collect() == []


def test_rows_without_or_with_a_repeated_id(spark):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    t = [text(60) for _ in range(8)]
    rows = [(None, t[1]), (None, t[2]), (None, t[3]), (None, t[3]), (None, t[4]), (2, t[4]), (7, t[5]), (7, t[6]), (7, t[6]), (3, t[0]), (1, t[7]), (1, t[7].upper())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in vp.one_of_each(frame).collect()))
    assert got == sorted([(0, t[1]), (0, t[2]), (0, t[3]), (2, t[4]), (7, t[5]), (7, t[6]), (3, t[0]), (1, t[7].upper())])
