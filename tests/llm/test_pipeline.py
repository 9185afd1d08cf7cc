"""The pipeline's stages against brute force of the same decisions, and on awkward rows."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import ROWS, SCHEMA, brute_repeats, shingle_sets  # noqa: E402

from starbraid.llm import secrets  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_on_the_driver_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "repeats", "secrets", "packing"]
    f = dict(corpus_pipeline.STAGES)

    clean = f["toxicity"](spark, docs, SF).cache()
    assert clean.columns == docs.columns and 0.5 * docs.count() < clean.count() < docs.count()

    kept = f["near_dedup"](spark, clean, SF).cache()
    before, after = shingle_sets([(r.doc_id, r.text) for r in clean.collect()]), {r.doc_id for r in kept.collect()}
    for a in after:
        for b in after:
            n = len(before[a] & before[b])
            assert a >= b or not n or 100 * n < 75 * len(before[a] | before[b])
    assert all(any(100 * len(before[d] & before[k]) >= 75 * len(before[d] | before[k]) for k in before if k < d) for d in set(before) - after)

    cut = f["repeats"](spark, kept, SF).cache()
    want = brute_repeats([(r.doc_id, r.text) for r in kept.collect()])
    assert {r.doc_id for r in cut.collect()} == after
    assert all(r.n_chars == len(r.text) and len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1] for r in cut.collect())

    masked = f["secrets"](spark, cut, SF).cache()
    assert masked.count() == cut.count() and masked.columns == docs.columns
    assert not any(re.search(r"[0-9a-f]{24}", r.text) or secrets.ASSIGN.search(r.text) and len(secrets.ASSIGN.search(r.text)[2]) >= 6 for r in masked.collect())
    assert all(r.n_chars == len(r.text) for r in masked.collect())

    assert {r.doc_id for r in f["packing"](spark, masked, SF).select("doc_id").collect()} == after


def test_stages_take_awkward_rows(spark):
    docs = spark.createDataFrame([(d, t, *["clash"] * 4, 5, *["clash"] * 4) for d, t in ROWS], SCHEMA)
    f = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    out = {n: stage(spark, docs, SF) for n, stage in corpus_pipeline.STAGES}
    for name, df in out.items():
        if name != "packing":
            assert df.columns == docs.columns and df.where("doc = 'clash' AND id = 5 AND carried = 'clash'").count() == df.count()
        assert f[name](spark, docs.limit(0), SF).count() == 0

    # Some rows go whole, none changes; rows without text are clean.
    kept = plain(out["toxicity"])
    assert all(kept.count(r) <= ROWS.count(r) for r in kept) and {(2, None), (3, ""), (4, "Short one"), (13, "p q")} <= set(kept)

    # Equal texts and near copies under other ids go; repeated rows, null ids and rows without words stay.
    sets = shingle_sets([(d, t or "") for d, t in ROWS if d is not None])
    alike = lambda a, b: bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    gone = {d for d in sets if any(k < d and alike(k, d) for k in sets)}
    assert 5 in gone and plain(out["near_dedup"]) == sorted((r for r in ROWS if r[0] not in gone), key=str)

    # What is left of each text, incomplete characters dropped.
    ends, texts = brute_kept([(d, t or "") for d, t in ROWS]), plain(out["repeats"])
    assert texts == sorted(((d, ends[d, t or ""]) for d, t in ROWS), key=str)

    secret = re.compile(r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}")
    masked = {7: 'key [secret]" [secret] idiot', 11: "[secret]"}  # 500 times "a" is a hexadecimal run
    got = plain(out["secrets"])
    assert not any(secret.search(t or "") for _, t in got)
    assert got == sorted(((d, masked.get(d, t)) for d, t in ROWS), key=str)

    pieces = out["packing"].collect()
    assert len(pieces) >= len(ROWS) and sum(r.length for r in pieces) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens * sum(d == r.doc_id for d, _ in ROWS) for r in pieces}.values())


def brute_kept(pairs, length=100):
    """(doc, text) -> the text without what occurs earlier, by comparing all windows; null ids come first."""
    seen, out = set(), {}
    for d, t in sorted(set(pairs), key=lambda x: (x[0] is not None, x[0] or 0)):
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out[d, t] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    return out


def test_columns_named_like_the_stages_own(spark):
    docs = spark.createDataFrame([(1, "secret=abcdef12345 x", "keep", 7)], "doc_id long, text string, span_list string, found_id long")
    got = dict(corpus_pipeline.STAGES)["secrets"](spark, docs, SF).first()
    assert tuple(got) == (1, "[secret] x", "keep", 7)


def test_run_gives_pieces(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_secrets_are_masked_in_rows_without_ids_or_with_shared_ids(spark):
    secret, clean = "password = hunter22hunter", "a long clean text that holds no secret at all"
    rows = [(None, f"one {secret} end"), (None, None), (5, f"{secret} first"), (5, clean), (5, f"{clean} {secret}")]
    docs = spark.createDataFrame([(d, t, "x", len(t or "")) for d, t in rows], "doc_id long, text string, carried string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["secrets"](spark, docs, SF)
    want = [(None, "one [secret] end"), (None, None), (5, "[secret] first"), (5, clean), (5, f"{clean} [secret]")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(d, t, "x", None if t is None else len(t)) for d, t in want], key=str)
