"""BPE, token files, vector search, mixing and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from sqlrun.llm import queries as q
from sqlrun.llm.bpe import RankArrayBPE, _encoder, decode_documents, encode_documents
from sqlrun.llm.mixing import mix_hash, mix_sources
from sqlrun.llm.projection_search import chi_square_quantile, nearest
from sqlrun.llm.token_files import _library, read_token_files, write_token_files
from sqlrun.llm.common import word_count
from tools.oracle_compare import compare, duck

from .conftest import SCHEMA

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoders_equal_the_library(library):
    rng, bpe = random.Random(1), RankArrayBPE(PATH)
    parts = ["a", "the", "'s", "'ll", " ", "  ", "\n", "\t", "1", "23", "é", "ñ", "!", "--", "<|endoftext|>", "中文", "²",
             "½", "Ⅷ", "　", "\x1c", "\U0001F642", "é", "_", "\r\n", "x" * 300, "Word.", "Word\nNext", "***", "end$$$\n", "_|~", "\""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    want = [ids_of(library, t) for t in texts]
    assert [bpe.encode(t) for t in texts] == want
    assert [bpe.decode(w) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]
    for encoder in (_encoder(PATH), _library(PATH)[0]):
        got = [x.tolist() for flat, ends in encoder.encode_many(pa.array(texts)) for x in np.split(flat, ends[:-1])]
        assert got == want
    some = [[rng.randrange(50257) for _ in range(20)] for _ in range(100)]
    assert [bpe.decode(x) for x in some] == [library.decode(x, skip_special_tokens=False) for x in some]


def test_long_words_merge_alike(library):
    rng, bpe = random.Random(2), RankArrayBPE(PATH)
    for n in (255, 256, 257, 2000):
        word = "".join(rng.choice("etaoinshr") for _ in range(n))
        assert bpe.encode(word) == ids_of(library, word)


def test_bpe_query(spark, docs, folder, library, none):
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(library, r.text)
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in q.op7_bpe_rank_array(spark, folder).collect()) == want
    kept = decode_documents(encode_documents(docs, PATH, keep=("row",)), PATH, keep=("row",))
    assert {r.row: r.text for r in kept.collect()} == {r.row: r.text or "" for r in docs.collect()}
    assert encode_documents(none, PATH).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert {tuple(r) for r in decode_documents(nulls, PATH).collect()} == {(1, ""), (2, "")}


def test_token_files(spark, docs, folder, library, empty_folder):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(q.op8_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    ids = Counter((r.doc_id, zlib.crc32(np.array(ids_of(library, r.text) + [2], "<u4").tobytes())) for r in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == ids
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    manifest = write_token_files(docs, PATH, 2)
    assert manifest.filter("dtype = '<u2'").count() == manifest.count()  # 50,257 ids fit in 16 bits
    stored = {r.start: list(r.ids) for r in read_token_files(manifest).collect()}
    want = {tuple(ids_of(library, r.text) + [2]) for r in rows}
    assert {tuple(v) for v in stored.values()} == want
    assert q.op8_token_files(spark, empty_folder).collect() == []


def brute_nearest(rows, k, every):
    size = Counter(len(v) for _, v in rows).most_common(1)[0][0]
    x = {i: np.array(v, float) for i, v in rows if len(v) == size}
    out = {}
    for i in x:
        if i % every == 0:
            found = sorted(((-float((x[j] * x[i]).sum()), j) for j in x if j != i))[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


def test_search_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_nearest(rows, 20, 20)
    got: dict = {}
    for r in q.op6_projection_search(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in want[i]} & {j for j, _ in got[i]}) for i in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = dict(rows)
    for i, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        for j, s in found:
            assert abs(s - float(np.dot(np.array(exact[i], float), np.array(exact[j], float)))) < 1e-12


def test_search_over_cells_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, v) for k, v in enumerate((rng.standard_normal((600, 8)) * rng.uniform(0.2, 4, (600, 1))).tolist())]
    rows += [(1000 + k, rows[5][1]) for k in range(300)]  # copies of one vector: a hot cell
    bad = [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [float("nan")]), (2060, [1.0] * 7 + [None]),
           (2080, [float("inf")] * 8), (2100, [1.0] * 5), (None, [1.0] * 8), (2120, [])]
    df = spark.createDataFrame(rows + bad + rows[:20], "vec_id long, embedding array<double>").repartition(4)
    got: dict = {}
    for r in nearest(df, __import__("pyspark").sql.functions.col("id") % 20 == 0, cell_rows=64).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(rows, 20, 20)
    assert set(got) == set(want)
    assert sum(len(set(got[i]) & {j for j, _ in want[i]}) for i in want) >= 0.9 * 20 * len(want)
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert nearest(few, __import__("pyspark").sql.functions.col("id") == 0).count() == 4


def test_search_of_nothing(spark, empty_folder):
    assert q.op6_projection_search(spark, empty_folder).collect() == []
    assert abs(chi_square_quantile(0.95, 16) - 26.296) < 0.01


def test_mix_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(q.op10_mix_sources(spark, sf), duck(sf), q.ORACLES["op10_mix_sources"], strict=True) == []


def test_mix_of_edge_cases_matches_sql(spark, folder, docs):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert compare(q.op10_mix_sources(spark, folder), con, q.ORACLES["op10_mix_sources"], strict=True) == []
    got = q.op10_mix_sources(spark, folder).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in got)


def test_mix_targets_are_met_and_capped(spark, none):
    rows = [(k, "w " * (1 + k % 40), s) for k, s in enumerate("a" * 30 + "b" * 600 + "c" * 900)]
    rows += [(5000, None, "d"), (5001, "", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df, word_count(df.text), mix_hash(df.doc_id, df.text)).select("*", "mix.*").collect()
    total = sum(r.size for r in got)
    targets = {r.source: r.target for r in got}
    sizes = {r.source: r.source_size for r in got}
    assert targets["a"] == 3 * sizes["a"] and targets["d"] == 0  # as much as there is, thrice
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    assert abs(targets["b"] / targets["c"] - 2) < 1e-9
    for s in "abc":
        taken = sum(r.copies * r.size for r in got if r.source == s)
        assert abs(taken - targets[s]) <= 40
    empty = mix_sources(none, word_count(none.text), mix_hash(none.doc_id, none.text))
    assert empty.collect() == [] and empty.columns == [*none.columns, "mix"]


def test_mix_plan_stays_in_the_jvm(spark, folder):
    plan = q.op10_mix_sources(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def stage(spark, k, docs):
    return cp.STAGES[k][1](spark, docs, "")


def test_stages_take_effect(spark, docs, none):
    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_join", "suffix_dedup", "mix_sources", "bpe"]
    a = stage(spark, 0, docs)
    ids = {r.doc_id for r in a.collect()}
    assert a.schema.names == docs.columns and not {500, 502, 503, 504} & ids and {0, 1, 2} <= ids
    for k in range(4):
        out = stage(spark, k, none)
        assert out.collect() == [] and out.columns == none.columns
    cut = stage(spark, 2, docs)
    assert all(r.text is None or r.n_chars == len(r.text) for r in cut.collect())
    mixed = stage(spark, 3, docs)
    assert mixed.columns == docs.columns
    times = Counter(r.row for r in mixed.collect())
    want = mix_sources(docs, word_count(docs.text), mix_hash(docs.doc_id, docs.text)).collect()
    assert times == Counter({r.row: r.mix.copies for r in want if r.mix.copies})


def test_stages_keep_columns_of_any_name_and_type(spark, docs):
    from pyspark.sql import functions as F
    odd = docs.select("*", F.create_map(F.lit("k"), F.col("size")).alias("a.b"), F.array("row").alias("digit"),
                      F.struct("size").alias("kept"), F.lit(1).alias("sid"), F.lit("x").alias("mix"),
                      F.lit(2).alias("lang_pred"), F.lit(3).alias("k1"), F.lit(4).alias("plan`s"))
    for k in range(4):
        out = stage(spark, k, odd)
        assert out.columns == odd.columns and 0 < len(out.collect())
        assert {r.size: r["a.b"] for r in out.collect()}.items() <= {
            r.size: {"k": r.size} for r in odd.select("size").collect()}.items()


def test_pipeline_runs_the_stages_in_order(spark, folder, docs, library):
    now = docs
    for k in range(4):
        now = spark.createDataFrame(stage(spark, k, now).collect(), SCHEMA)
    want = Counter((r.doc_id, r.source, tuple(ids_of(library, r.text))) for r in now.collect())
    got = cp.run(spark, folder).collect()
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert cp.ORACLE_SQL is None


def test_pipeline_of_nothing(spark, empty_folder):
    assert cp.run(spark, empty_folder).collect() == []


def test_words_that_a_worker_knows_are_not_encoded_again():
    from sqlrun.llm.pieces import PieceEncoder
    singly, together = [], []

    def ids(word):
        return bytes(len(word) * [ord(word[-1]) % 100])

    encoder = PieceEncoder(lambda w: singly.append(w) or ids(w), [], "u1",
                           lambda words: together.extend(words) or [ids(w) for w in words], entries=8)
    text = " ".join("x" + c for c in "abcdefghijkl")
    found = [next(encoder.encode_many(pa.array([text])))[0].tobytes() for _ in range(3)]
    assert found == 3 * [b"".join(ids((" " if k else "") + w) for k, w in enumerate(text.split(" ")))]
    assert not singly and len(together) == len(set(together)) == 13  # one of them without a space, too
