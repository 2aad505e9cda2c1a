import random

from oracle import same
from plain import SF, dedup_lines, fingerprint, near_prints

from ledgerlens.llm import linededup, simhash
from ledgerlens.llm.components import components

SCHEMA = "doc_id long, text string"


def test_lines_are_those_of_the_sql(spark, con):
    same(linededup.op8_line_dedup(spark, SF), con, linededup.OP8_SQL)


def test_lines_against_plain_python(spark):
    r = random.Random(3)
    docs = [(i, "\n".join(r.choices(["a", "b", "c", "d", "", " \t", "e"], k=r.randint(0, 14)))) for i in range(60)]
    got = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == dedup_lines(docs)


def test_odd_lines(spark):
    text = "a\nb\nc\nd"
    df = spark.createDataFrame([(2, text, 9), (1, text, 9), (1, text, 9), (3, None, 9), (4, "", 9), (None, "x\ny\nz", 9), (5, "q\nx\ny\nz\nr", 9)], "doc_id long, text string, n_lines int")
    got = sorted(((x["doc_id"], x["text"], x["n_removed"]) for x in linededup.dedup_lines(df).collect()), key=repr)
    assert got == sorted([(1, text, 0), (1, text, 0), (2, "", 4), (3, None, 0), (4, "", 0), (None, "x\ny\nz", 0), (5, "q\nr", 3)], key=repr)
    assert {x["n_lines"] for x in linededup.dedup_lines(df, count=False).collect()} == {9}
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "\n".join(f"l{i % 7}" for i in range(30_000)))], SCHEMA)
    assert linededup.dedup_lines(long).first()["n_removed"] > 29_000


def test_fingerprints(documents):
    texts = ["", None, "A b", "one", "x y z", "É a É", "a\x0bb c d", "w " * 3000, *(d[1] for d in documents[:60])]
    assert [int(x) % (1 << 64) for x in simhash.fingerprints(texts)] == [fingerprint(t) for t in texts]
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    assert int(simhash.fingerprints([long])[0]) % (1 << 64) == fingerprint(long)


def test_golay_keys_meet():
    import numpy as np

    r = random.Random(1)
    for _ in range(300):
        a = r.getrandbits(23)
        b = a ^ (1 << r.randrange(23)) ^ (1 << r.randrange(23))
        ka, kb = (set(simhash.golay_keys(np.array([x]))[0].tolist()) - {-1} for x in (a, b))
        assert ka & kb


def links(spark, prints, **how):
    got = {}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    of = {x["node"] % (1 << 64): x["component"] for x in components(simhash.fingerprint_links(df, **how)).collect()}
    for i, p in enumerate(prints):
        got.setdefault(of.get(p, ("alone", p)), set()).add(i)
    return sorted(map(sorted, got.values()))


def clusters(prints):
    out = {}
    for i, c in enumerate(near_prints(prints)):
        out.setdefault(c, []).append(i)
    return sorted(out.values())


def test_links_against_brute_force(spark):
    r = random.Random(7)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        p = r.getrandbits(64)
        for _ in range(30):
            prints.add(p)
            for _ in range(r.choice((1, 2, 2, 3))):
                p ^= 1 << r.randrange(64)
    prints = sorted(prints)
    want = clusters(prints)
    assert links(spark, prints) == want
    assert links(spark, prints, max_list=3) == want


def test_crowded_lists_are_verified_by_stars(spark):
    """Some 300 different fingerprints around one, in lists beyond the default limit, beside some that are three bits off."""
    r = random.Random(2)
    centre = r.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in r.sample(range(64), k)) for k in (0, 1, 1, 2, 2, 5) for _ in range(60)}
    prints |= {centre ^ (1 << b) for b in range(64)} | {centre ^ 0b111 ^ (7 << 40), r.getrandbits(64)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    lists = df.rdd.flatMap(lambda x: simhash.fingerprint_keys(__import__("numpy").array([x[0]]))[0]).countByValue()
    assert max(lists.values()) > 64
    assert links(spark, prints) == clusters(prints)


def test_query_against_brute_force(spark, documents):
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash.op10_simhash_near_dedup(spark, SF).collect()}
    prints = [fingerprint(d[1]) for d in documents]
    least = {}
    root = near_prints(prints)
    for d, c in zip(documents, root, strict=True):
        least[c] = min(least.get(c, d[0]), d[0])
    assert got == {d[0]: (f"{p:016x}", least[c]) for d, p, c in zip(documents, prints, root, strict=True)}


def test_odd_tables(spark):
    df = spark.createDataFrame([(3, None, 1), (2, "", 1), (2, " \n", 1), (None, "", 1), (None, "some other words here", 1)], "doc_id long, text string, fp int")
    got = sorted(((x["doc_id"], x["fp"] == 0, x["component_id"]) for x in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(3, True, 2), (2, True, 2), (2, True, 2), (None, True, 2), (None, False, None)], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    clash = simhash.keep_one(df.selectExpr("*", "7 AS row", "8 AS _row"))
    assert {(x["row"], x["_row"]) for x in clash.collect()} == {(7, 8)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((x["doc_id"] for x in kept.collect()), key=repr) == [2, None]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, None), (7, 7)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {}
    for a, b in edges:
        if b is not None and a != b:
            nodes.setdefault(a, set()).add(b)
            nodes.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += nodes[x]
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
