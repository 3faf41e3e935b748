"""Registered queries against SQL or a brute-force restatement (sf0.001)."""

import hashlib
import math
import sys
import zlib
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import __spark_entry__ as E  # noqa: E402
import corpus_pipeline  # noqa: E402
from patronus.llm import decontaminate, pii, queries, sharding, tokens  # noqa: E402
from patronus.llm.shared import table  # noqa: E402


@pytest.fixture(scope="module")
def docs(sf_small):
    return pd.read_parquet(f"{sf_small}/documents.parquet")


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(None if pd.isna(x) else getattr(x, "item", lambda x=x: x)() for x in r)
                        for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    got, want = rows(queries.QUERIES[name](spark, sf_small).toPandas()), rows(con.execute(queries.ORACLE[name]).df())
    key = lambda r: [str(x) for x in r]
    assert got[0] == want[0] and sorted(got[1], key=key) == sorted(want[1], key=key)


def test_all_are_registered():
    names = set(E.queries())
    assert {*queries.QUERIES, "pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_op1_base_spans(spark, sf_small, docs):
    got = queries.op1_weak_supervision_pii(spark, sf_small).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        want = brute.base_spans(t)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in want)
        r = got.loc[i]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        assert {x for x in text.split(",") if x} <= set(r.spans.split(","))


def test_op3_is_the_bounded_ring(spark, sf_small, docs):
    got = queries.op3_bounded_ring_shards(spark, sf_small).toPandas()
    assert len(got) == len(docs)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sizes = got.shard.value_counts().reindex(range(16), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    by = docs.set_index("doc_id").text
    assert all(s == len(by[i].encode()) + 1 and c == zlib.crc32(by[i].encode())
               for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    # one key at a time around the ring, in any order: the counts per arc and shard are the same
    nodes = sharding.ring(16, 64)
    place = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in docs.doc_id}
    arc = {i: next((k for k, (p, _) in enumerate(nodes) if p >= place[i]), 0) for i in docs.doc_id}
    free = sharding.bounds_for(len(docs), 16, 0)
    waiting = [[(a,) for a in sorted(arc.values()) if a == k] for k in range(len(nodes))]
    want = {}
    while any(waiting):
        moved = [[] for _ in nodes]
        for k, (_, s) in enumerate(nodes):
            for (a,) in waiting[k]:
                if free[s]:
                    free[s] -= 1
                    want[a, s] = want.get((a, s), 0) + 1
                else:
                    moved[(k + 1) % len(nodes)].append((a,))
        waiting = moved
    have = {}
    for i, s in zip(got.doc_id, got.shard, strict=True):
        have[arc[i], s] = have.get((arc[i], s), 0) + 1
    assert have == want


def test_op4_counts(spark, sf_small, docs):
    import public_tokenizers
    sp = tokens.load(public_tokenizers.path("piece_bpe_32k.model"))
    got = queries.op4_two_tier_token_counts(spark, sf_small).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        n = len(sp.encode(t))
        assert tuple(got.loc[i][["n_bytes", "n_tokens", "over_limit"]]) == (len(t.encode()), n, n > 4096)


def test_op12_equals_brute_force(spark, sf_small, docs):
    import public_tokenizers
    got = queries.op12_diagonal_token_alignment(spark, sf_small).toPandas().set_index("doc_id")
    want = brute.alignments(list(zip(docs.doc_id, docs.text, strict=True)), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {i: tuple(got.loc[i][columns]) for i in got.index} == want


def test_op5_components(spark, sf_small, docs):
    got = queries.op5_partenum_jaccard_join(spark, sf_small).toPandas().set_index("doc_id")
    comp, size = brute.components(list(zip(docs.doc_id, docs.text, strict=True)))
    assert {i: got.component_id[i] for i in comp} == comp and {i: got.n_shingles[i] for i in size} == size


def test_op6_base_and_model(spark, sf_small, docs):
    got = queries.op6_brown_class_scores(spark, sf_small).toPandas().set_index("doc_id")
    fold = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.doc_id}
    c = brute.word_counts(t for i, t in zip(docs.doc_id, docs.text, strict=True) if not fold[i])
    n, v = sum(c.values()), len(c)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w, r = [*brute.words(t), None], got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()  # better than the unigrams on texts it has not seen


def test_pipeline_stage_by_stage(spark, sf_small):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "decontamination", "mix_sources", "shard"]
    docs = table(spark, sf_small, "documents")
    columns = docs.columns
    judged = queries.op10_quality_rules(spark, sf_small).toPandas().set_index("doc_id").kept
    one = stages["quality_rules"](spark, docs, sf_small)
    assert one.columns == columns
    a = one.toPandas()
    assert set(a.doc_id) == set(judged[judged].index)
    b = stages["near_duplicates"](spark, one, sf_small)
    comp, _ = brute.components(list(zip(a.doc_id, a.text, strict=True)))
    assert b.columns == columns and sorted(r[0] for r in b.select("doc_id").collect()) == sorted(set(comp.values()))
    bp = b.toPandas()
    items = pd.read_parquet(f"{sf_small}/benchmark.parquet")
    hit = brute.contamination(list(zip(bp.doc_id, bp.text, strict=True)), list(zip(items.item_id, items.text, strict=True)))
    c = stages["decontamination"](spark, b, sf_small)
    left = {i for i, (n, h, _) in hit.items() if not (h and 20 * h >= n)}
    assert c.columns == columns and sorted(r[0] for r in c.select("doc_id").collect()) == sorted(left)
    cp = c.toPandas()
    d = stages["mix_sources"](spark, c, sf_small)
    assert d.columns == columns
    dp = d.toPandas()
    assert set(dp.doc_id) <= set(cp.doc_id) and dp.doc_id.value_counts().max() <= 2
    taken, total = sum(len(brute.words(t)) for t in dp.text), sum(len(brute.words(t)) for t in cp.text)
    assert 1.5 * total - max(len(brute.words(t)) for t in cp.text) <= taken <= 1.5 * total
    e = stages["shard"](spark, d, sf_small).toPandas()
    sizes = e.shard.value_counts().reindex(range(16), fill_value=0)
    assert sorted(e.doc_id) == sorted(dp.doc_id) and sizes.max() - sizes.min() <= 1


def test_native_operators_run_no_python(spark, sf_small):
    for name in ("op3_bounded_ring_shards", "op8_line_dedup", "op10_quality_rules", "op11_relational_chat_format"):
        plan = queries.QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name


def test_windows_found_by_winnowing_only_need_their_words(spark):
    """Every 13 words shared are found, wherever they start; 12 are not."""
    item = " ".join(f"w{i}" for i in range(40))
    texts = [f"before {' '.join(item.split()[i:i + 13])} after" for i in range(28)] + [" ".join(item.split()[3:15])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.search(df, spark.createDataFrame([(7, item), (8, "tiny item")], "item_id long, text string")).toPandas()
    assert sorted(zip(got["doc"], got.n_hit, strict=True)) == [(i, 13) for i in range(28)] + [(28, 0)]
