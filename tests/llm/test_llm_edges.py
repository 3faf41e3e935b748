"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns with clashing names, for every operator and stage."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from patronus.llm import align, archive, brown, chat, decontaminate, jaccard, lines, middle, mixing, pii, quality, sharding, tokens  # noqa: E402

LONG = " ".join(f"long{i % 977}x{i % 13}" for i in range(60_000))
PROSE = "the old man and the sea is a book that was read by all of us in the winter of that year and it is good"
ROWS = [(1, PROSE, "a"), (2, None, "a"), (3, "", None), (4, " \n\t ", "b"), (5, LONG, "c"), (6, PROSE, "a"), (6, PROSE, "a"),
        (None, "a null id has this text of some words, and a line\nthat others have too", None),
        (8, "that others have too\nTHAT others have too \nshort", "b"), (9, "x", "b"), (10, "é ü ñ 漢字 😀 plain", "c"),
        (11, "mail a.b@c.example.com or 1.2.3.4 and 4111 1111 1111 1111 call +1 (988) 555-2485", "c")]
#: Names that operators use inside or add.
CLASH = ["n_words", "kept", "shard", "slot", "size", "target", "copies", "words", "doc", "id", "row", "in", "t", "t1", "key",
         "source_size", "finish", "n_tokens", "spans", "label", "n", "h", "k", "cell", "n_lines", "n_dropped"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.where(F.lit(False))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x", 0), (None, "é ü", 0), (4, PROSE, 0), (4, PROSE, 0)],
                                 "item_id long, text string, words int")


def ids(df, name="doc"):
    return sorted((r[name] for r in df.collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_quality(odd, none):
    got = quality.judge(odd)
    assert set(got.columns) == {*odd.columns, *quality.FIGURES, "base_failed", "kept"}
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["n_words"] == by[3]["n_words"] == by[4]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"]
    assert by[1]["kept"] and by[5]["n_words"] == 60_000 and by[1]["words"] == "own words"
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 2
    assert quality.keep_good(none).count() == 0


def test_repeated_windows(spark):
    texts = ["a b c d e a b c d e", "a a a a a a", "a b c d", "a b c d e f g", "p q r s t u p q r s t v p q r s t"]
    got = quality.figures(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for t, r in zip(texts, sorted(got, key=lambda r: texts.index(r["text"])), strict=True):
        w, wins, hit = t.split(), {}, set()
        for i in range(len(w) - 4):
            wins.setdefault(tuple(w[i:i + 5]), []).append(i)
        for at in wins.values():
            if len(at) > 1:
                hit |= {j for i in at for j in range(i, i + 5)}
        assert r["n_repeat_words"] == len(hit), t


def test_sharding(odd, none):
    got = sharding.assign(odd, shards=4, virtual_nodes=8)
    assert got.columns == [c for c in odd.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert ids(got, "doc_id") == ALL
    assert sorted(r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()) == [3, 3, 3, 3]
    assert sharding.assign(none).count() == 0


def test_sharding_splits_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("doc_id"))
    got = sharding.assign(df, cell_rows=50).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"),
                                                                F.countDistinct("slot").alias("d")).collect()
    assert len(got) == 16 and all(r["n"] in (187, 188) and r["d"] == r["n"] == r["m"] + 1 for r in got)


def test_slack_moves_fewer_keys(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    free = sharding.assign(df, slack=100.0).withColumnRenamed("shard", "home").drop("slot")
    moved = [sharding.assign(df, slack=s).join(free, "doc_id").where("shard <> home").count() for s in (0.0, 0.25, 1.0)]
    assert moved[0] > moved[1] > moved[2]
    grown = sharding.assign(df, shards=17, slack=0.25).withColumnRenamed("shard", "s17").drop("slot")
    same = sharding.assign(df, slack=0.25).join(grown, "doc_id").where("shard = s17").count()
    assert same > 4000 * 0.7  # plain modulo would keep one in seventeen


def test_mixing(odd, none):
    got = mixing.mix(odd)
    assert len(got.collect()) == len(ROWS) and got.columns[-5:] == ["size", "source_size", "target", "copies", "finish"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["size"] == by[3]["size"] == 0 and by[2]["copies"] == 0 and by[3]["copies"] == 0
    assert by[None]["source_size"] == 16 and by[5]["copies"] <= 2
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0
    again = mixing.repeated(odd)
    assert again.columns == odd.columns
    assert again.count() == sum(r["copies"] for r in got.collect())


def test_many_documents_of_one_finish_time(spark):
    """The cut is the first row beyond the budget, however few rows may be ordered at once."""
    import random
    random.seed(3)
    items = [(random.choice([1.0, 1.0, 1.0, 2.5, 1.0 + 1e-15]), random.choice([0, 1, 7, 8]), q, random.randint(1, 9)) for q in range(300)]
    df = spark.createDataFrame(items, "finish double, nth long, queue long, words long").cache()
    items.sort()
    for budget in (0.0, 3.0, 500.0, 1000.0, float(sum(x[3] for x in items)) - 1, 1e9):
        used, want = 0, None
        for f, n, q, w in items:
            used += w
            if used > budget:
                want = (f, n, q)
                break
        for at_once, slices in ((1, 4), (20, 16), (1000, 64)):
            assert mixing.cut_point(df, budget, slices, at_once) == want


def test_growing_by_a_shard_moves_few_rows(spark):
    """Without slack, as the query has it: one more shard takes rows, few move between the old ones."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"))
    grown = sharding.assign(df, shards=17).withColumnRenamed("shard", "s17").drop("slot")
    both = sharding.assign(df, shards=16).join(grown, "doc_id")
    same, old = both.where("shard = s17").count(), both.where("shard <> s17 and s17 < 16").count()
    assert same > 20_000 * 0.85 and old < 20_000 * 0.08


def test_lines(odd, none):
    maps = lines.keep_bitmaps(odd)
    got = lines.apply_bitmaps(odd, maps)
    texts = {}
    for r in got.collect():
        texts.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_dropped"]))
    assert texts[2] == [("", 1, 0)] and texts[3] == [("", 1, 0)]
    assert texts[6] == [("", 1, 1)] * 2 and texts[1][0][2] == 0
    assert texts[8][0] == (ROWS[8][1], 3, 0)  # the smallest id that holds the line keeps it, repeated or not
    assert texts[None] == [("a null id has this text of some words, and a line", 2, 1)]
    assert lines.apply_bitmaps(none, lines.keep_bitmaps(none)).count() == 0


def test_a_line_in_most_documents(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("a line that all documents share\n"), F.col("id").cast("string"), F.lit(" is a line of its own\nshort")).alias("text"))
    got = lines.apply_bitmaps(df, lines.keep_bitmaps(df)).collect()
    assert all(r["n_dropped"] == (r["doc_id"] > 0) and r["text"].endswith("own\nshort") for r in got)


def test_decontamination(odd, none, bench):
    got = decontaminate.search(odd, bench)
    assert ids(got) == ALL
    by = {r["doc"]: r for r in got.collect()}
    want = brute.contamination([(r[0], r[1]) for r in ROWS], [(3, "x"), (None, "é ü"), (4, PROSE)])
    for i, (n, h, items) in want.items():
        assert (by[i]["n_words"], by[i]["n_hit"], by[i]["items"]) == (n, h, [x for x in items if x != "None"]), i
    left = decontaminate.clean(odd, bench)
    assert left.columns == odd.columns and 1 not in ids(left, "doc_id") and None in ids(left, "doc_id")
    assert decontaminate.search(none, bench).count() == 0
    assert decontaminate.clean(odd, bench.where(F.lit(False))).count() == len(ROWS)


def test_jaccard(odd, none):
    got = {(r["doc"], r["n"], r["component"]) for r in jaccard.near_duplicates(odd).collect()}
    comp, size = brute.components([(r[0], r[1]) for r in ROWS if r[0] is not None])
    assert got == {(i, size[i], comp[i]) for i in comp} | {(None, 12, None)}
    one = jaccard.one_per_group(odd)
    assert one.columns == odd.columns and ids(one, "doc_id") == [1, 2, 3, 4, 5, 8, 9, 10, 11, None]
    assert jaccard.near_duplicates(none).count() == 0


def test_one_per_group_judges_every_row(spark):
    """Repeated rows, null ids, and a row of its own that shares its id with a copy."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, a), (None, c), (None, c), (3, c.upper()), (4, ""), (4, ""), (5, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("own"))
    got = jaccard.one_per_group(df)
    assert got.columns == df.columns
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r[0], r[1]) for r in got.collect()), key=order) == sorted(
        [(1, a), (1, b), (3, c.upper()), (4, ""), (4, ""), (5, None), (None, None)], key=order)
    nulls = jaccard.one_per_group(df.where("doc_id is null and text is not null"))
    assert sorted(r["text"] for r in nulls.collect()) == [a, c]


def test_jaccard_chains_copies_and_shared_passages(spark):
    """Chains of near copies, hundreds of copies, short texts, a passage that all
    hold: the components are those of all pairs."""
    import random
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(55)]
    texts = []
    for _ in range(60):  # mostly passage, and not similar
        own = [word() for _ in range(random.randint(15, 60))]
        texts.append(own[:8] + passage + own[8:])
    chain = [word() for _ in range(120)]
    for _ in range(25):  # each near the one before, the ends far apart
        chain = chain[:]
        chain[random.randrange(len(chain))] = word()
        texts.append(chain)
    base = [word() for _ in range(200)]
    for _ in range(120):
        copy = base[:]
        for _ in range(random.randint(0, 6)):
            copy[random.randrange(len(copy))] = word()
        texts.append(copy)
    for n in range(1, 13):  # tiny sets, all lengths
        tiny = [word() for _ in range(n)]
        texts += [tiny, tiny, tiny[:-1], tiny + [word()]]
    texts += [passage] * 30
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    comp, _ = brute.components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc"]: r["component"] for r in jaccard.near_duplicates(df).collect()} == comp


def test_shared_signatures_come_with_their_ends():
    """Runs that cross batches, repeated rows, common signatures (salt > 0)."""
    import numpy as np
    import pyarrow as pa
    rows = sorted({(1, 0, 5)} | {(2, 0, i) for i in range(-9, 9, 2)} | {(3, 4, i) for i in range(5)} | {(4, 2, 7), (5, 0, 1), (5, 0, 3)})
    rows = sorted(rows + rows[::3])
    want = {(2, i, -9, 7, 9) for i in range(-9, 9, 2)} | {(3, i, None, None, None) for i in range(5)} | {(4, 7, None, None, None), (5, 1, 1, 3, 2), (5, 3, 1, 3, 2)}
    for size in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in (sig, ident, salt)], names=["sig", "id", "salt"])
                   for sig, salt, ident in (zip(*rows[i:i + size], strict=True) for i in range(0, len(rows), size))]
        got = [tuple(r.values()) for b in jaccard._shared_only(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(want) and set(got) == want, size


def test_second_round_in_chunks_or_whole_finds_the_same_pairs(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    sets = [(i, np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 63, 3).astype(np.uint64)]))) for i in range(30)]
    sketches = spark.createDataFrame([(i, len(x), bytearray(jaccard.wide_sketch(x).tobytes())) for i, x in sets], "id long, n long, bits binary")
    rest = spark.createDataFrame([(0, i, 0 if i % 4 == 0 else i) for i in range(30)], "main long, id long, label long")
    pairs = [{(r["a"], r["b"]) for r in jaccard.across(rest, sketches, chunk=c).collect()} for c in (4, 4096)]
    assert pairs[0] == pairs[1]
    need = {(a, b) for a, x in sets for b, y in sets if a < b and (a % 4 or b % 4)
            and 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))}
    assert need and need <= pairs[0]


def test_one_per_group_joins_only_rows_it_may_drop(spark):
    """Rows that surely stay are told by a bitmap; no join has them."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(30))) for i in range(50)] + [(100, text), (101, text)]
    got = jaccard.one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ids(got, "doc_id") == [*range(50), 100]
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()


def test_every_similar_pair_shares_a_signature():
    import numpy as np
    rng = np.random.default_rng(3)
    none = np.zeros(0, dtype=np.uint64)
    for x in [*range(1, 40), 63, 64, 100, 250, 255, 256, 300, 1000]:
        for _ in range(30):
            a = rng.integers(0, 1 << 63, x, dtype=np.uint64) * np.uint64(2)
            drop, add = rng.integers(0, x // 4 + 1), rng.integers(0, x // 3 + 1)
            b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= 75 * (len(a) + len(b) - common):
                hot = np.sort(rng.choice(a, len(a) // 2, replace=False)) if rng.random() < 0.5 else none
                assert set(jaccard.signatures(a, hot)[0]) & set(jaccard.signatures(b, hot)[0]), (x, drop, add)


def test_tokens(spark, odd, none):
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = tokens.load(path)
    got = tokens.count_tokens(odd, path).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(sp.encode(t or "")) for _, t, _ in ROWS)
    assert tokens.count_tokens(none, path).count() == 0
    lengths = tokens.Lengths(sp, {})
    for t in ["a  b", " a", "a\n b", "▁x▁", "\n\n", "  ", "a ", " \n ", "<s> </s>", "\t\x00", "a▁ b", "x" * 5000, "😀" * 50]:
        assert lengths.total(t) == len(sp.encode(t)), repr(t)


def test_brown(spark, odd, none):
    got = brown.score(odd, rounds=2)
    assert ids(got) == ALL
    by = {r["doc"]: r for r in got.collect()}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[4]["n_tokens"] == 1 and by[5]["n_tokens"] == 60_001
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in by.values())
    assert brown.score(none, rounds=2).count() == 0


def test_class_model_is_a_distribution(spark):
    """Transitions and emissions sum to one with the room for an unseen word."""
    import numpy as np
    words, counts = np.arange(3000) * 7 + 5, np.sort(np.random.default_rng(1).integers(2, 500, 3000))[::-1]
    t = brown.Table(words, counts)
    classes = np.concatenate([np.arange(brown.CLUSTERED) % 64, 64 + np.arange(brown.UNITS - brown.CLUSTERED)])
    n = np.random.default_rng(2).integers(0, 9, (106, 106)).astype(float)
    m = brown.Model(t, classes, n, int(counts.sum()) + 50, 3031, 40, 30)
    assert np.allclose((10 ** m.step).sum(1), 1)
    assert np.allclose(np.bincount(classes[t.units], weights=10 ** m.emit)[np.unique(classes[t.units])], 1)
    assert np.isclose((40 + 30 + 1) * 10 ** m.rest, 1)


def test_exchange_raises_the_likelihood(spark):
    """Two kinds of words that alternate end up in classes of their own."""
    rows = [(i, j, 20) for i in range(0, 40, 2) for j in range(1, 40, 2)] + [(j, i, 20) for i in range(0, 40, 2) for j in range(1, 40, 2)]
    classes, n = brown.cluster(spark.createDataFrame(rows, "i int, j int, n long"), rounds=8)
    assert not set(classes[0:40:2]) & set(classes[1:40:2])
    start = spark.createDataFrame(rows, "i int, j int, n long")
    assert brown._likelihood(n) >= brown._likelihood(brown.cluster(start, rounds=1)[1])


def test_pii(odd, none):
    got = pii.find(odd)
    assert ids(got) == ALL
    by = {r["doc"]: r for r in got.collect()}
    assert [pii.KINDS[s["kind"]] for s in by[11]["base"]] == ["email", "ip", "card", "phone"] and not by[2]["spans"]
    assert pii.find(none).count() == 0


def test_pii_linear_scans():
    for t in ["9" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" + " (" * 100_000, "a@b." * 50_000, "-@" * 50_000,
              "10.0.0.1 key12345abcdefgh9876 a@b.cd (555) 123-4567 " * 4_000]:
        pii.candidates(t)


def test_pii_learns_keys(spark):
    """Keys without a fixed form are found by what the other labelers say."""
    rows = [(i, f"some text here password=ab{i:03d}cd98ef76{i:04d}gh and more words") for i in range(60)]
    rows += [(100 + i, f"a long plainwordwithoutdigits{'x' * (i % 5)} and version 1.2.3.4 of it") for i in range(60)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc"]: [pii.KINDS[s["kind"]] for s in r["spans"]] for r in got}
    assert all("secret" in found[i] for i in range(60)) and not any("secret" in found[100 + i] for i in range(60))


def test_reliabilities():
    """A poor labeler is told from good ones (three that vote apart are needed for that:
    beside two, one that only guesses would leave open which of the two is better)."""
    import numpy as np
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.4
    good = lambda p: np.where(rng.random(5000) < p, truth, ~truth).astype(int)
    v = np.stack([good(0.95), good(0.9), good(0.7)], 1)
    q, prior, rate = pii.reliabilities(v, np.ones(5000))
    assert abs(prior - 0.4) < 0.05 and rate[1, 0] > 0.85 and rate[0, 0] < 0.15 and 0.2 < rate[1, 2] - rate[0, 2] < 0.6
    assert ((q > 0.5) == truth).mean() > 0.93


def test_archive_round_trip(spark):
    big = "<html>" + "é" * 200 + "</html>"
    rows = [(3, "http://a", big), (1, None, big), (2, "http://b\r\nX: y", "small"), (4, "http://c", "small"), (5, "u", None),
            (6, "u", ""), (None, "n", big), (1, "twice", big), (7, "own", big + "!")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    path = archive.write(df)
    got = archive.read(spark, path)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got.collect())
    assert kinds == sorted([(3, "revisit", "1"), (1, "response", None), (1, "response", None), (2, "response", None),
                            (4, "response", None), (5, "response", None), (6, "response", None), (0, "revisit", "1"), (7, "response", None)])
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    heads = {(r["page_id"], r["header"]) for r in got.collect()}
    bodies = {(p, (h or "").encode()) for p, _, h in rows}
    for r in archive.records(spark, path).collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        assert (r["page_id"], head.decode() + "\r\n") in heads and block.endswith(b"\r\n\r\n")
        block = block[:-4]
        assert int(head.split(b"Content-Length: ")[1]) == len(block)
        assert b"revisit" in head and not block or (r["page_id"], block) in bodies
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    known = lambda x: sorted(map(str, x.select(columns).collect()))
    assert known(archive.rebuilt(spark, path)) == known(got)
    nothing = archive.write(df.where(F.lit(False)))
    assert archive.read(spark, nothing).count() == 0 and archive.rebuilt(spark, nothing).count() == 0


@pytest.mark.parametrize("what", ["digest", "length", "missing"])
def test_rebuilding_finds_damage(spark, what):
    """Another block under the digest, another length in the header, or no block at all end the job."""
    big = "<p>" + "x" * 300
    path = archive.write(spark.createDataFrame([(1, "u", big), (2, "v", big), (3, "w", "z")], "page_id long, url string, html string"))
    if what == "length":
        bad = spark.read.parquet(f"{path}/records").withColumn("header", F.regexp_replace("header", "Content-Length: 303", "Content-Length: 302"))
        bad.write.parquet(f"{path}-bad/records")
        spark.read.parquet(f"{path}/payloads").write.parquet(f"{path}-bad/payloads")
    else:
        kept = spark.read.parquet(f"{path}/payloads")
        kept = kept.withColumn("payload", F.reverse(F.col("payload").cast("string")).cast("binary")) if what == "digest" else kept.where(F.lit(False))
        kept.write.parquet(f"{path}-bad/payloads")
        spark.read.parquet(f"{path}/records").write.parquet(f"{path}-bad/records")
    with pytest.raises(Exception, match="differs from its header|refers to no response"):
        archive.rebuilt(spark, f"{path}-bad").collect()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, none, bench, name, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, str(tmp_path))
    assert name == "shard" or got.columns == odd.columns
    got.collect()
    assert stage(spark, none, str(tmp_path)).count() == 0


@pytest.mark.parametrize("most", [4, 40])
def test_gains_are_those_of_the_likelihood(most):
    """A word's gain is the difference of whole likelihoods, for every class."""
    import numpy as np
    rng = np.random.default_rng(4)
    n = rng.integers(0, most, (30, 30))
    classes = rng.integers(0, brown.CLASSES, 30)
    classes[:3], classes[-1] = classes[3], brown.LAST
    k = np.eye(brown.LAST + 1)

    def table(c):
        return k[c].T @ n @ k[c]
    got = brown.gains(table(classes), np.where(classes == brown.LAST, -1, classes), np.diag(n).astype(float), n @ k[classes], n.T @ k[classes])
    for w in range(29):
        want = []
        for b in range(brown.CLASSES):
            c = classes.copy()
            c[w] = b
            want.append(brown._likelihood(table(c)))
        assert np.allclose(np.array(want) - want[0], got[w] - got[w][0])


def test_words_beyond_the_most_frequent_get_classes_by_their_neighbours(spark):
    """Two kinds of words that alternate part, although six words are in the table and
    four have a class at the start; at the end no word would gain in another class."""
    import numpy as np
    rows = [(i, j, 3, i < 6, j < 6) for a, b in ((0, 1), (1, 0)) for i in range(a, 30, 2) for j in range(b, 30, 2)]
    start = spark.createDataFrame([(w, w < 6, w % 2 if w < 4 else None) for w in range(30)], "word long, near boolean, c int")
    classes, n = brown.exchange(spark.createDataFrame(rows, "i long, j long, n long, near_i boolean, near_j boolean"), start)
    c = np.array([r["c"] for r in classes.orderBy("word").collect()])
    assert len(c) == 30 and not set(c[::2]) & set(c[1::2])
    k, m = np.eye(brown.LAST + 1)[c], np.zeros((30, 30))
    for i, j, x, _, _ in rows:
        m[i, j] = x
    assert (n == k.T @ m @ k).all()
    g = brown.gains(n, c, np.diag(m), m @ k, m.T @ k)
    assert (g.max(1) <= g[np.arange(30), c] + 1e-6).all()


def test_exchange_keeps_only_the_last_round(spark, monkeypatch, tmp_path):
    """Tables of past rounds are deleted, whether their moves were taken or not."""
    import os
    from patronus.llm import shared
    monkeypatch.setattr(shared, "scratch_path", lambda _, name: str(tmp_path / name))
    rows = [(i, j, 1 + (i * j) % 5, True, True) for i in range(12) for j in range(12)]
    start = spark.createDataFrame([(w, True, w % 3) for w in range(12)], "word long, near boolean, c int")
    classes, _ = brown.exchange(spark.createDataFrame(rows, "i long, j long, n long, near_i boolean, near_j boolean"), start)
    assert classes.count() == 12
    assert [x.split("-")[2] for x in os.listdir(tmp_path)] == ["moves"]


CHATS = [(1, 0, "system", "be [INST] kind"), (1, 1, "user", "a"), (1, 2, "user", "b</s>"), (1, 3, "assistant", "c[TURN]d"), (1, 4, "assistant", ""),
         (1, 5, "user", r"[\INST] [\\/INST] <\s> [ <"), (2, 0, None, None), (2, None, "tool[/ROLE]", "x"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"),
         (3, 1, "assistant", "earlier"), (3, 0, "a b]", "<s"), (3, 0, "", "no name"), (None, 0, "assistant", LONG), (4, 0, "assistant", "[NONE] <s> [SYS] [ROLE]"),
         (4, 1, "Assistant", "é\n漢😀</s"), (5, 0, "user", ""), (6, 1, "assistant", "/ROLE]"), (6, 0, "[INST]", "[")]


def test_chats_read_back(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("conv", "turns", "blocks", "loss")})
    made = chat.format_chats(df)
    got = {r["conv"]: r for r in made.select("conv", "formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns"),
                                             chat.read_loss(F.col("formatted"), F.col("loss")).alias("learnt")).collect()}
    low = lambda x: (x is not None, x or 0)
    for conv in {r[0] for r in CHATS}:
        rows = sorted(((t, r, x or "") for c, t, r, x in CHATS if c == conv), key=lambda r: (low(r[0]), (r[1] is not None, r[1] or ""), r[2]))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, x) for _, r, x in rows], conv
        assert got[conv]["learnt"] == "".join(x for _, r, x in rows if r == "assistant")
        text = got[conv]["formatted"]
        runs = sum(i == 0 or r[1] != rows[i - 1][1] for i, r in enumerate(rows))
        assert text.startswith("<s>") and text.count("</s>") == runs and text.count("[TURN]") == len(rows) - runs
    assert got[1]["formatted"] == ("<s>[SYS] be [\\INST] kind</s>[INST] a[TURN]b<\\/s></s>[/INST] c[\\TURN]d[TURN]</s>"
                                   r"[INST] [\\INST] [\\\/INST] <\\s> [ <</s>")
    assert chat.format_chats(df.where(F.lit(False))).count() == 0


def test_fill_in_middle(spark, odd, none):
    marks = spark.createDataFrame([(i, t) for i, t in enumerate(["a<P>b", "<S>", "x<M>", "<P", "\n\n\n", "no end\nof line", "one line\n", "\r\n a\x0b\n", "<\n<\nP>\n>"])],
                                  "doc_id long, text string")
    df = odd.select("doc_id", "text", *[F.lit(c).alias(c) for c in ("n", "form", "output", "row", "id")])
    made = middle.fill_in_middle(df)
    assert made.columns == ["doc_id", "row", "id", "n", "form", "prefix_chars", "middle_chars", "output"]
    texts = sorted((r[1] or "") for r in ROWS)
    back = middle.restored(F.col("output"), F.col("form")).alias("t")
    assert sorted(r["t"] for r in made.select(back).collect()) == texts
    forms = {r["doc_id"]: r for r in made.collect()}
    assert forms[2]["form"] == forms[3]["form"] == "plain" and forms[2]["n"] == 0 and forms[2]["prefix_chars"] is None
    got = middle.fill_in_middle(marks).join(marks, "doc_id").select("*", back).collect()
    for r in got:
        assert r["t"] == r["text"] and (r["form"] == "plain") == any(m in r["text"] for m in ("<P>", "<S>", "<M>"))
        assert r["n"] == len(r["text"].splitlines()) if "\x0b" not in r["text"] else r["n"] == 2
    assert middle.fill_in_middle(none).count() == 0
    assert {r["form"] for r in middle.fill_in_middle(marks, rate=0).collect()} == {"plain"}


def test_group_ends_are_the_common_ends():
    import numpy as np
    rng = np.random.default_rng(6)
    for _ in range(400):
        total = int(rng.integers(1, 300))
        share = rng.choice([0.05, 0.5, 0.95])
        ea, eb = ([*np.flatnonzero(rng.random(total - 1) < share) + 1, total] for _ in range(2))
        if rng.random() < 0.5:
            eb = sorted({*ea, *eb[::7]})
        ea, eb = [int(x) for x in ea], [int(x) for x in eb]
        gi, gj = (g.tolist() for g in align.group_ends(np.array(ea), np.array(eb)))
        assert [ea[i - 1] for i in gi] == [eb[j - 1] for j in gj] == sorted(set(ea) & set(eb)) and (gi[-1], gj[-1]) == (len(ea), len(eb))
        a, b = rng.integers(0, 9, len(ea)), rng.integers(0, 9, len(eb))
        groups = [(a[i:p], b[j:q]) for i, p, j, q in zip([0, *gi], gi, [0, *gj], gj)]
        names = np.array([str(i) for i in range(9)], dtype=object)
        want = Counter(int(x) << 32 | int(y) for xs, ys in groups for x in xs for y in ys)
        for large in (4096, 3, 1):
            keys, times = align._links(a, b, np.array(gi), np.array(gj), large)
            assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()
        assert align._shown(names[a], names[b], np.array(gi), np.array(gj)) == ";".join(
            ",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)


def test_byte_level_tokens_are_those_of_the_library():
    import public_tokenizers
    import random
    side = align.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"))
    assert side.fast is not None
    random.seed(2)
    texts = [t for _, t, _ in ROWS if t] + ["it's I'LL don't", "a \n b\t c\n \nd  e \u00a0 f\u3000g  ", "<|endoftext|>", "x\x1cy\x85z\u180e w", "Ａ①ﬁ ½²x", "\u0870 \U00010400"]
    texts += ["".join(chr(random.choice([random.randrange(32, 127), random.randrange(0xa0, 0x2000), random.randrange(0x3000, 0xd800), 32, 10]))
                      for _ in range(300)) for _ in range(200)]
    texts += ["".join(random.choice("aeinorst hl") for _ in range(400)) for _ in range(200)]
    assert 200 <= sum(side.plain.fullmatch(t) is not None for t in texts) < len(texts)
    for t, ids in zip(texts, side.encode(texts), strict=True):
        assert ids.tolist() == side.lib.encode(" " + t, add_special_tokens=False).ids, t


def test_alignment(spark, odd, none):
    import public_tokenizers
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    more = [(20, "</s><|endoftext|> <s> <0x41>"), (21, "\u2581 is a blank there"), (22, "a\x00b \n\n\t x"), (23, "=" * 3000 + "1234567890" * 300), (24, "ab" * 2000),
            (25, "a \n b\t c\n \nd  e \u00a0 f\u00a0g \u3000h it's I'll  "), (26, " lead and trail "), (27, "\n \n x \x1c y\x85 z"), (28, " ")]
    df = odd.select("doc_id", "text", *[F.lit(c).alias(c) for c in ("row", "n_a", "pairs", "in", "groups")]).unionByName(
        spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).where("doc_id is not null and doc_id <> 6")
    rows = [(i, t) for i, t, _ in ROWS if i not in (None, 6)] + more
    want = brute.alignments(rows, *paths)
    for frequent in (align.FREQUENT, 5, 0):
        got = align.align_texts(df, *paths, whole=True, frequent=frequent)
        assert got.columns[:4] == ["doc_id", "row", "pairs", "in"] and got.columns[-1] == "groups"
        have = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got.collect()}
        assert have == want
    assert want[21][0] == 0 and want[2] == (0, 0, 0, 0, 0, 0, "") and want[20][0] > 0
    assert align.align_texts(none, *paths).count() == 0
    twice = align.align_texts(odd.where("doc_id = 6").select("doc_id", "text"), *paths).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0]["count_sum"] == 2 * twice[0]["n_links"]
