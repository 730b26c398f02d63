"""The pipeline, stage by stage, against plain versions on a small corpus; and its registration."""

from __future__ import annotations

import random
import re
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from framelake.llm import queries
from framelake.llm.common import Scratch
from framelake.session import shared_dir

from .test_duplicates import near_groups, plain_removal
from .test_models import BAD

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    out = f"file://{tmp_path_factory.mktemp('sf')}"
    shared = " ".join(f"s{i}" for i in range(60))
    docs, labels = [], []
    for i in range(260):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 90))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if i % 7 == 0:
            words.insert(5, shared)
        docs.append((i, " ".join(words), "en", f"src{i % 3}"))
        labels.append((i, 1, int(bad)))
    docs += [(300 + i, docs[i][1] + " again", "en", "src1") for i in range(1, 40)] + [(400, None, None, None), (401, "", "en", "src0")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{sf_dir}/out-{name}")
        docs = spark.read.parquet(f"{sf_dir}/out-{name}")
        results.append(docs.collect())
        assert name == "packing" or docs.columns == COLUMNS
    given = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    clean, single, cut, mix, packed = results

    bad = {i for i, r in given.items() if any(b in (r.text or "") for b in BAD)}
    kept = {r.doc_id for r in clean}
    assert len(kept & bad) <= 0.05 * len(bad) and len(kept - bad) >= 0.97 * (len(given) - len(bad))
    assert all(tuple(r) == tuple(given[r.doc_id]) for r in clean)

    groups, _ = near_groups([(r.doc_id, r.text) for r in clean], 5, 80)
    assert {r.doc_id for r in single} == {i for i, g in groups.items() if i == g} and len(single) < len(clean)

    want = {w[0]: w[5] for w in plain_removal([(r.doc_id, (r.text or "").encode()) for r in single], 50)}
    assert {r.doc_id: r.text for r in cut} == want and any(len(r.text) < len(given[r.doc_id].text or "") for r in cut)
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (given[r.doc_id].lang, given[r.doc_id].source) for r in cut)

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total, taken = {}, {}
    for r in cut:
        total[r.source] = total.get(r.source, 0) + words(r.text)
    for r in mix:
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
        assert r.text == want[r.doc_id]
    from .test_models import plain_targets

    for s, t in plain_targets(total, (1, 2, 3), 3).items():
        assert abs(taken.get(s, 0) - t) <= max((words(r.text) for r in cut if r.source == s), default=0)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mix)
    assert sum(r.length for r in packed) == n
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in used.values():
        v.sort()
        assert [o for o, _ in v] == np.cumsum([0] + [k for _, k in v])[:-1].tolist() and sum(k for _, k in v) <= 2048


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_deletes_what_it_no_longer_reads(spark, sf_dir):
    from urllib.parse import urlparse

    root = Path(urlparse(shared_dir(spark)).path)
    before = set(root.glob("framelake-*/*"))
    out = corpus_pipeline.run(spark, sf_dir)
    left = set(root.glob("framelake-*/*")) - before
    assert len([p for p in left if list(p.glob("*.parquet"))]) <= 2  # the last stage's documents and their pieces
    assert out.count() > 0


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op2_minhash_dedup", "op7_embedding_dedup", "op10_mixing", "op11_fill_middle", "op12_divergence", "op13_decontamination"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    ours, sql = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns) and plain(ours) == plain(sql)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op1_token_output", "op3_token_counts", "op4_toxicity", "op5_packing", "op6_suffix_dedup", "op8_quality"])
def test_registered_queries_return_whole_tables(spark, name):
    sf = "/root/testdata/sf0.001"
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in queries.QUERIES[name](spark, sf).select("doc_id").collect()} == ids


def test_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names
    sql = __spark_entry__.oracle_sql()
    assert {"op2_minhash_dedup", "op7_embedding_dedup", "op10_mixing", "op11_fill_middle", "op12_divergence", "op13_decontamination"} <= set(sql) and set(sql) <= names


def test_stages_keep_other_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    extra = ["_toxicity", "score", "kept", "size", "target", "times", "n_bytes", "kept_text", "k_lang", "h", "y"]
    docs = docs.withColumns({c: F.col("doc_id") for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark).cut(stage(spark, docs, sf_dir))
        assert docs.columns == COLUMNS + extra, name
        assert all(r[c] == r.doc_id for r in docs.collect() for c in extra)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_stages_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
