"""Lexical search, prefix tables and conversation repair against plain brute force, with awkward rows."""

import base64
import hashlib
import math
import random
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from starbraid.llm import prefixes, repair, search

SF = "/root/testdata/sf0.001"
SHA = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
LONG = " ".join(f"x{i * 7919 % 10007}" for i in range(200_000))
DOCS = [
    (1, "Alpha beta, alpha. KKelvin"), (2, None), (3, ""), (4, " ,;. "), (5, "alpha beta gamma"), (5, "alpha beta gamma"), (None, "alpha beta gamma"), (None, None), (6, LONG), (7, "éa b c  日本 éa"), (8, "beta " * 50),
    (9, "don't  stop\n\n now<|endoftext|>\x85 12,345…"), (10, "a" * 5000), (11, "՘a \U00011de0 x"),
]
ITEMS = [(1, "alpha beta"), (1, "GAMMA alpha"), (2, None), (3, "..."), (4, "absent"), (None, "éa x7919 日本"), (5, "beta"), (6, "k kkelvin kelvin")]


def table(spark, rows, key="doc_id"):
    return spark.createDataFrame([(d, t, "x", 5, "y") for d, t in rows], f"{key} long, text string, term string, rank int, n string")


def plain_ranks(docs, items, k=10):
    terms = lambda t: re.findall(search.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(d, terms(t)) for d, t in docs]
    rows = [r for r in rows if r[1]]
    n_docs, total = len(rows), sum(len(t) for _, t in rows)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    df = {t: sum(t in set(x) for _, x in rows) for t in set().union(*asked.values())} if asked else {}
    out = []
    for i, ts in asked.items():
        scored = []
        for d, x in rows:
            m = 10 + (90 * len(x) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * x.count(t)) // (1000 * x.count(t) + 8 * m)) for t in ts if t in x)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [search.BLOCK, 200])
def test_search_is_the_plain_ranking(spark, bound):
    docs, items = table(spark, DOCS), table(spark, ITEMS, "item_id")
    for d, i in ((docs, items), (docs.limit(0), items), (docs, items.limit(0))):
        got = sorted((tuple(r) for r in search.ranked(d, i, bound=bound).collect()), key=str)
        assert got == plain_ranks([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in i.collect()])


def test_search_keeps_ties_by_id_and_only_the_best(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "tie word").otherwise("other thing entirely").alias("text")).repartition(7)
    got = search.ranked(docs, spark.createDataFrame([(1, "word tie")], "item_id long, text string")).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in got] == [(i + 1, 2 * i) for i in range(10)]


def test_search_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = sorted(tuple(r) for r in search.op11_automaton_scan(spark, SF).select("item_id", "rank", "doc_id", "score").collect())
    assert got == sorted(con.execute(search.ORACLE_SQL).fetchall()) and got


@pytest.fixture(scope="module")
def own():
    return prefixes.vocabularies(prefixes.default_path())


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(prefixes.default_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "b", " ", "  ", "\n", "'", "l", "s", "é", "1", "՘", "the", " the", "\t", "日", ".", "　", "\U00011de0"]


def test_prefix_tables_give_the_ids_of_the_library(spark, library):
    rng = random.Random(3)
    rows = [*DOCS, *((100 + i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))) for i in range(1500))]
    for df in (table(spark, rows), table(spark, rows).limit(0), spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for r in df.collect():
            ids = library.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), SHA(",".join(map(str, ids))), SHA(library.decode_bytes(ids))))
        assert sorted(map(tuple, prefixes.coded(df).collect()), key=str) == sorted(want, key=str)
    got = {r.doc_id: r.data for r in prefixes.decoded(prefixes.encoded(table(spark, rows[11:]))).collect()}
    assert got == {d: bytearray((t or "").encode()) for d, t in rows[11:]}


def test_long_texts_part_where_their_pieces_do(own, library, monkeypatch):
    text = (LONG[:5000] + "  \n x" + "é" * 700 + " don't") * 3
    assert "".join(prefixes.slices(text, 400)) == text
    assert [i for s in prefixes.slices(text, 400) for i in library.encode_ordinary(s)] == library.encode_ordinary(text)


def test_token_pairs_by_their_border_are_those_of_the_merges(own):
    rng = random.Random(7)
    for _ in range(20_000):
        a, b = (rng.randrange(own.size if rng.random() < 0.5 else 600) for _ in range(2))
        pair = [own.token[a], own.token[b]]
        assert own.parted(a, b) == (own.merged(pair[0] + pair[1]) == pair)


def test_edits_and_appends_equal_a_new_encoding(own, library):
    rng = random.Random(5)
    for _ in range(800):
        p = prefixes.Prefixes(own, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))))
        for _ in range(4):
            a = rng.randint(0, len(p.text))
            p.edit(a, rng.randint(a, min(len(p.text), a + 5)), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 4))))
            assert p.ids() == library.encode_ordinary(p.text)
    p = prefixes.Prefixes(own, "ab" * 3000)
    p.edit(3000, 3001, "zq")
    assert p.computed < 4 * own.longest and p.ids() == library.encode_ordinary(p.text)
    p.append("abc")
    assert p.computed == 3 and p.ids() == library.encode_ordinary(p.text)


def test_stored_tables_are_revised_by_a_join(spark, library):
    stored = prefixes.prefixes(table(spark, [(1, "one two three " * 200), (2, None), (3, "keep me")]))
    edits = spark.createDataFrame([(1, 4, 7, "2"), (2, None, None, "new text"), (9, 0, 0, "no such document")], "doc_id long, start int, stop int, put string")
    got = {r.doc_id: r for r in prefixes.revised(stored, edits).collect()}
    assert {d: r.text for d, r in got.items()} == {1: "one 2" + ("one two three " * 200)[7:], 2: "new text", 3: "keep me"}
    assert got[3].computed == 0 and got[1].computed < 10
    again = prefixes.prefixes(spark.createDataFrame([(r.doc_id, r.text) for r in got.values()], "doc_id long, text string"))
    assert {r.doc_id: (r.ends, r.last) for r in again.collect()} == {d: (r.ends, r.last) for d, r in got.items()}


SPACES = "\x20\x09-\x0d"


def plain_repair(rows):
    """(metrics, cost, audit, digest) of rows (turn, role, text) in order: a table over all places, states and edits."""
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(f"[^{SPACES}]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    move = lambda s, x: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, x))
    best = {(0, ""): (0, "", ())}

    def better(key, new):
        if key not in best or new[:2] < best[key][:2]:
            best[key] = new

    for i in range(len(rows) + 1):
        for _ in range(4):
            for s in ("", "s", "u", "a"):
                if (i, s) in best:
                    c, x, out = best[i, s]
                    for name in ("user", "assistant"):
                        if move(s, name[0]):
                            better((i, move(s, name[0])), (c + 3, x + "I", (*out, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            late = 3 * (faults[i] == "truncated")
            for s in ("", "s", "u", "a"):
                if (i, s) in best:
                    c, x, out = best[i, s]
                    better((i + 1, s), (c + 4, x + "D", out))
                    if faults[i] in ("blank", "duplicate"):
                        continue
                    if role and move(s, role[0]):
                        better((i + 1, move(s, role[0])), (c + late, x + "K", (*out, f"{role}:{text}")))
                    for name in ("user", "assistant"):
                        if move(s, name[0]):
                            better((i + 1, move(s, name[0])), (c + 3 + late, x + "R", (*out, f"{name}:{text}")))
    cost, audit, out = min(best[len(rows), s] for s in ("", "a") if (len(rows), s) in best)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, SHA("\n".join(out)))


def plain_table(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            own += [row] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return sorted(((c, *plain_repair(sorted(rows, key=order))) for c, rows in out.items()), key=str)


def talk(rng, conv, n, odd=0.3):
    roles = ["system", "user", "assistant", "tool", "", None, "usher"]
    out = []
    for t in range(n):
        role = rng.choice(roles) if rng.random() < odd else ("user", "assistant")[t % 2]
        text = rng.choice([None, "", " \t", "same.", "no end", "Done!\n ", "é日?", f"row {t}."]) if rng.random() < odd else f"text {rng.randint(0, 10**6)}."
        out.append((conv, None if rng.random() < odd / 10 else t + (rng.random() < odd / 5), role, text))
    return out


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies int")


def got_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_repair_is_the_cheapest_of_all(spark, monkeypatch):
    rng = random.Random(2)
    rows = [r for c in range(300) for r in talk(rng, c, rng.randint(1, 9), rng.choice([0.1, 0.5, 0.9]))] + talk(rng, None, 6)
    rows += [r for r in rows if rng.random() < 0.1] + [(1000, t, "user", "x.") for t in range(200) if zlib.crc32(f"1000:{t}".encode()) % 20 == 0]
    df = talks(spark, rows).repartition(5)
    assert got_rows(repair.repaired(df)) == plain_table(rows)
    assert repair.repaired(df.limit(0)).collect() == []


def test_repair_of_the_driver_rows(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got_rows(repair.op13_edit_lattice(spark, SF)) == plain_table([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_a_conversation_over_many_tasks_is_one(spark):
    """One conversation with most rows, in many blocks and range partitions, and a row repeated thousands of times."""
    rng = random.Random(4)
    rows = [*talk(rng, 7, 1500, 0.4), *talk(rng, 6, 5), *talk(rng, 8, 5), *[(7, 3, "user", "copy.")] * 3000, (9, 1, "user", LONG), (9, 2, "assistant", LONG + ".")]
    assert got_rows(repair.repaired(talks(spark, rows).repartition(6))) == plain_table(rows)


def test_chained_blocks_are_one_search():
    rng = random.Random(9)
    for _ in range(60):
        items = [rng.choice([("u", 0), ("a", 0), ("s", 0), ("u", 3), ("a", 3), ("t", 0), (None, 1), (None, 3)]) for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(items))
        whole = repair.solved(items)
        assert repair.chained(repair.solved(items[:at]), repair.solved(items[at:])) == whole


def test_huge_sets_at_the_threshold_lose_no_link(spark):
    """Half a million shingles each: 1 and 3 fall one shingle short of the threshold, 2 and 3 reach it, 1 and 2 are near; 4 is apart."""
    from starbraid.llm import neardup

    n, k = 490_000, 420_000
    words = [f"w{i:x}" for i in range(n + 4)]
    tail = [f"t{i:x}" for i in range(n)]
    other = [f"u{i:x}" for i in range(n)]
    share = lambda own, m: " ".join(own[: m + 4] + tail[: n - m])
    docs = spark.createDataFrame([(1, share(words, k - 1)), (2, share(words, k)), (3, " ".join(words)), (4, " ".join(other))], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(docs).collect()}
    assert got == {1: (n, 1), 2: (n, 1), 3: (n, 1), 4: (n - 4, 4)}
