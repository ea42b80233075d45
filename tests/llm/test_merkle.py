import hashlib
import zlib

import pytest

from lagsleuth.llm import merkle
from lagsleuth.llm.queries import MANIFEST_COLUMNS, op12_merkle_manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """All levels, bottom first, one node at a time."""
    out = [nodes]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([h(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return out


def climb(node, i, levels, proof):
    for below in levels[:-1]:
        first = i - i % 16
        run = below[first : first + 16]
        proof += [x for k, x in enumerate(run) if k != i % 16]
        run[i % 16] = node
        node, i = h(*run), i // 16
    return node


def plain(rows):
    """(doc_id, source, lang, n_chars, text) -> the query's rows."""
    leaves = [(r, h(*map(field, r))) for r in rows]
    groups = {}
    for r, leaf in leaves:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf, r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for _, _, leaf, _ in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            changed = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                lower = r[4] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
                changed = h(*map(field, (*r[:4], lower)))
            proof = []
            root = climb(climb(changed, i, trees[s], proof), at, top, proof)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], h(*proof), root, root == top[-1][0]))
    return out


def result(spark, tmp_path, rows, schema="doc_id long, source string, lang string, n_chars long, text string"):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r)[:7] for r in op12_merkle_manifest(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_closed_form_places(arity):
    for n in (1, 2, 3, 15, 16, 17, 18, 33, 255, 256, 257, 300):
        height = merkle.levels(n, arity)
        named, place = {}, []
        def write(level, j):  # children first
            if level:
                for c in range(j * arity, min((j + 1) * arity, -(-n // arity ** (level - 1)))):
                    write(level - 1, c)
            named[level, j] = len(place)
            place.append((level, j))
        write(height, 0)
        assert all(merkle.position(level, j, n, arity) == at for (level, j), at in named.items())
        log = merkle.append_nodes([bytes([i % 256]) * 32 for i in range(n)], height, arity)
        assert len(log) == len(place)


def test_block_logs_equal_the_tree():
    for n in (1, 2, 16, 17, 200, 256):
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        want = tree([x.hex() for x in leaves])
        block = merkle.Block(b"".join(merkle.append_nodes(leaves, len(want) - 1)), n, len(want) - 1)
        for i, path in enumerate(block.paths()):
            assert merkle.fold(leaves[i], path).hex() == want[-1][0]
            assert merkle.unpack(merkle.pack(path)) == path
        assert [[block.node(level, j).hex() for j in range(len(row))] for level, row in enumerate(want)] == want


def test_odd_rows(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"s{i % 40}" if i % 3 else "hot", "en" if i % 5 else None, i if i % 4 else None, [None, "", "Ab é", "x" * i, "AB"][i % 5]) for i in range(900)]
    rows += [(5, "hot", "en", 5, "same"), (5, "hot", "en", 5, "same"), (5, "hot", "en", 5, "other"), (None, "hot", None, None, None), (None, None, None, None, "T"), (1, "", "é", 3, "C" * 100_000)]
    assert sorted(result(spark, tmp_path, rows), key=repr) == sorted(plain(rows), key=repr)


def test_more_rounds(spark, tmp_path):
    """Blocks of one level take as many rounds as the tree has levels."""
    rows = [(i, f"s{i}" if i < 20 else "hot", "en", 1, "Text" if i % 2 else "text") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.manifest(docs, MANIFEST_COLUMNS, "source", "doc_id", height=1)
    assert (len(m.rounds), len(m.top)) == (3, 2)
    got = {r.own_key: (r.leaf, r.subroot, r.root, r.proof_sha256) for r in merkle.verified(m).collect()}
    assert got == {r[0]: r[1:5] for r in plain(rows)}


def test_single_and_empty(spark, tmp_path):
    rows = [(3, "a", "en", 1, "x")]
    assert result(spark, f"{tmp_path}/one", rows) == plain(rows)
    assert result(spark, f"{tmp_path}/none", []) == []


def test_proofs_hold_and_tampering_shows(spark):
    rows = [(i, "s", "en", 1, f"Text {i}", "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, Leaf string")
    m = merkle.manifest(docs, MANIFEST_COLUMNS, "source", "doc_id")
    got = merkle.proofs(m).collect()
    assert len(got) == 300 and {r.root for r in got} == {m.root}
    for r in got:
        path = merkle.unpack(r.proof)
        assert merkle.fold(bytes.fromhex(r.leaf), path).hex() == m.root
        assert merkle.fold(hashlib.sha256(b"other").digest(), path).hex() != m.root
    assert all(r.verified for r in merkle.verified(m).collect())
