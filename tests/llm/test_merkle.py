import hashlib
import zlib
from collections import defaultdict

from parlance.llm import merkle
from tests.llm.cases import LOWER, frame, texts

FAN = 16


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """The root and, for every node, its siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            lo = i // FAN * FAN
            paths[k].append(("".join(nodes[lo:i]), "".join(nodes[i + 1: lo + FAN])))
        nodes = [sha(*nodes[i: i + FAN]) for i in range(0, len(nodes), FAN)]
        at = [i // FAN for i in at]
    return nodes[0], paths


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, source, lang, n_chars in rows:
        text_now = text.translate(LOWER) if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else text
        groups[source].append((doc_id, leaf((doc_id, source, lang, n_chars, text)), leaf((doc_id, source, lang, n_chars, text_now))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = [climb([x[1] for x in groups[s]]) for s in names]
    root, tops = climb([r for r, _ in subs])
    out = []
    for s, (sub, paths), top in zip(names, subs, tops):
        for (i, own, now), path in zip(groups[s], paths):
            acc = now
            for left, right in path + top:
                acc = sha(left, acc, right)
            out.append((i, own, sub, root, sha(*[a + b for a, b in path + top]), acc, acc == root))
    return sorted(out, key=str)


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "source", "lang", "n_chars").collect()]


def test_proofs_equal_brute_force(spark):
    docs = frame(spark)
    assert sorted((tuple(r) for r in merkle.tamper_check(docs).collect()), key=str) == expected(plain(docs))


def test_deep_hot_and_many_sources(spark):
    long = [(i, f"Text {i}", "hot", "en", 6) for i in range(700)]  # three levels
    many = [(1000 + i, f"T{i}" if i % 3 else None, f"s{i}é", None, None) for i in range(300)]  # lone leaves below three levels
    rows = long + many + [(5000, "same", None, "en", 1)] * 40 + [(None, "x", "hot", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = sorted((tuple(r) for r in merkle.tamper_check(docs).collect()), key=str)
    assert got == expected(rows)
    assert {g[-1] for g in got} == {True, False}


def test_small_tables(spark):
    docs = frame(spark)
    assert merkle.tamper_check(docs.limit(0)).count() == 0
    one = docs.where("doc_id = 12")
    row = merkle.tamper_check(one).head()
    assert row.root == row.subroot == row.leaf and row.proof_sha256 == sha("")


def test_requests_of_some_leaves(spark, tmp_path):
    docs = frame(spark)
    m = merkle.build(docs)
    m.write(str(tmp_path / "m"))
    m = merkle.Manifest.read(spark, str(tmp_path / "m"))
    some = m.leaves.where("doc_id IN (5, 9, 21)")
    got = merkle.prove(m, some).collect()
    assert {r.doc_id for r in got} == {5, 9, 21} and all(r.leaf == r.digest for r in got)
    beyond = spark.createDataFrame([("n", 10_000), ("snone", 0)], "tree string, pos long")
    assert merkle.prove(m, beyond).count() == 0
    assert len(texts()) == docs.count()
