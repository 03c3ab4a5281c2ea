"""Suffix dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from sqlrun.llm import queries as q
from sqlrun.llm.ngram_join import jaccard_classes, one_of_each, runs_for, shingles
from sqlrun.llm import suffix_dedup
from sqlrun.llm.suffix_dedup import text_key, without_repeats

from .conftest import SCHEMA


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s:s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_suffix_query_is_exact(spark, docs, folder):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w[:4]) for r, w in zip(rows, brute_repeats([r.text for r in rows], 400)))
    got = Counter(tuple(r) for r in q.op1_suffix_dedup(spark, folder).collect())
    assert got == want
    assert sum(r[2] > 0 for r in want) > 20


def test_planted_passages_go_from_400_bytes_on(spark, tmp_path):
    """Passages of over 50 words in pairs of documents: the contract counts bytes, not words."""
    rng = random.Random(9)
    own = lambda k, n: " ".join(f"{k}w{j}" for j in range(n))
    rows, passages = [], []
    for k, (words, size) in enumerate([(51, 399), (51, 400), (60, 399), (60, 400), (90, 390), (90, 600)]):
        long = [size // words - 1] * (words - 1)
        passage = " ".join(f"{rng.randrange(10 ** n):0{n}}" for n in [*long, size - sum(long) - words + 1])
        passages.append(passage)
        # Nothing beside the passage is equal.
        rows += [(2 * k, f"{own(f'a{k}', 70)}x{passage}u{own(f'c{k}', 20)}"),
                 (2 * k + 1, f"{own(f'b{k}', 70)}y{passage}v{own(f'd{k}', 20)}")]
    rows += [(100 + k, own(f"clean{k}", 90)) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in q.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [len(p) for p in passages] == [399, 400, 399, 400, 390, 600]
    assert [(got[2 * k].n_removed, got[2 * k + 1].n_removed) for k in range(6)] == [
        (0, 0), (400, 400), (0, 0), (400, 400), (0, 0), (600, 600)]
    for k, text in rows:  # n_bytes is the input's length, whatever goes
        assert got[k].n_bytes == len(text) and (k < 100 or got[k].n_removed == 0)
        kept = text.replace(passages[k // 2], "") if k < 100 and got[k].n_removed else text
        assert got[k].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("length", [32, 60, 150])
def test_other_lengths(spark, docs, length):
    rows = docs.select("row", "text").collect()
    want = {r.row: None if r.text is None else w[4].decode("utf-8", "ignore")
            for r, w in zip(rows, brute_repeats([r.text for r in rows], length))}
    cut = without_repeats(docs, length=length)
    assert cut.schema == docs.schema
    assert {r.row: r.text for r in cut.collect()} == want


def brute_words(texts, words):
    """The texts without the strings of more than `words` words that occur twice."""
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    windows = [[(p[k][0], p[k + words][1]) for k in range(len(p) - words)] for p in places]
    seen = Counter((t or "").encode()[a:b] for t, w in zip(texts, windows) for a, b in w)
    out = []
    for t, w, p in zip(texts, windows, places):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for a, b in w:
            if seen[data[a:b]] > 1:
                gone[a:b] = b"\1" * (b - a)
        if len(p) > words and texts.count(t) > 1:  # copies go as a whole
            gone = b"\1" * len(data)
        out.append(None if t is None else bytes(x for x, g in zip(data, gone) if not g).decode())
    return out


@pytest.mark.parametrize("words", [16, 50])
def test_windows_of_words(spark, docs, words):
    rng = random.Random(6)
    short = " ".join(rng.choice("abcdefghijklmnop") for _ in range(51))  # 101 bytes
    fewer = " ".join(rng.choice("abcdefghijklmnop") + "x" * 40 for _ in range(50))  # 2,099 bytes, fifty words
    own = lambda k, n: " ".join(f"w{k}y{j}" for j in range(n))
    texts = [f"{own(1, 60)}\n{short}\n{own(2, 9)}", f" {own(3, 7)} {short} {own(4, 70)} ", f"{own(5, 9)} {short}",
             f"{own(6, 9)} {fewer} {own(7, 9)}", f"{own(8, 9)} {fewer} {own(9, 9)}",
             f"{own(10, 9)} {short.replace(' ', '  ', 1)}", f"{own(11, 9)} q{short}", " " + "ab " * 300,
             f"{own(12, 3)} {fewer}", f"{own(12, 3)} {fewer}", "z" * 120, "z" * 120,
             "y" * 300_000 + f" {short}", f"{own(13, 5)} " + "y" * 300_000 + f" {short}"]
    extra = spark.createDataFrame([(1000 + k, t, "en", "a", 1, f"x{k}", 0, "") for k, t in enumerate(texts)], SCHEMA)
    every = docs.unionByName(extra)
    rows = every.select("row", "text").collect()
    want = dict(zip([r.row for r in rows], brute_words([r.text for r in rows], words)))
    cut = without_repeats(every, words=words)
    assert cut.schema == docs.schema
    got = {r.row: r.text for r in cut.collect()}
    assert got == want
    assert short not in got["x0"] + got["x1"] + got["x2"]
    assert words < 50 or fewer in got["x3"] and fewer in got["x4"]


def test_pipeline_cuts_passages_of_short_words(spark):
    import corpus_pipeline
    rng = random.Random(7)
    passage = " ".join(rng.choice("abcdefghijklmnop") for _ in range(51))
    rows = [(k, f"{' '.join(f'w{k}y{j}' for j in range(80))} {passage} end{k}", "en", "a", 1, "", 0, "")
            for k in range(3)]
    cut = corpus_pipeline.repeat_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.text for r in cut) == sorted(r[1].replace(passage, "") for r in rows)
    assert all(r.n_chars == len(r.text) for r in cut)


def test_only_texts_that_may_lose_bytes_are_shuffled(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(450))
    rows = [(k, f"{k} " + "".join(rng.choice("abcdefgh ") for _ in range(600)) + (passage if k % 50 == 7 else ""))
            for k in range(500)]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", *text_key("text"))
    wanted = keyed.filter("doc_id % 50 = 7")
    passed = {r.doc_id for r in suffix_dedup._sieved(keyed, suffix_dedup._sieve(wanted)).filter("maybe").collect()}
    assert {k for k, _ in rows if k % 50 == 7} <= passed and len(passed) < 30
    cut = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" in plan and "Union" in plan
    want = brute_repeats([t for _, t in rows], 400)
    assert {r.doc_id: r.text for r in cut.collect()} == {k: w[4].decode() for (k, _), w in zip(rows, want)}


def test_texts_that_share_a_bit_of_the_sieve(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SIEVE_SLOTS", 1)
    rows = docs.select("row", "text").collect()
    want = {r.row: None if r.text is None else w[4].decode("utf-8", "ignore")
            for r, w in zip(rows, brute_repeats([r.text for r in rows], 60))}
    assert {r.row: r.text for r in without_repeats(docs, length=60).collect()} == want


def test_suffix_of_few_texts(spark, none):
    assert without_repeats(none).collect() == [] and without_repeats(none).columns == none.columns
    one = spark.createDataFrame([(1, "ab" * 500, "en", "a", 1000, "", 0, "")], SCHEMA)
    assert without_repeats(one).first().text == ""  # a text can repeat itself
    with pytest.raises(ValueError):
        without_repeats(one, length=10)


def brute_classes(rows, threshold=0.8):
    sets = [frozenset(shingles(r.text).tolist()) for r in rows]
    links, root = defaultdict(set), {s: s for s in sets}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x
    distinct = [s for s in set(sets) if s]
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if len(a & b) >= threshold * len(a | b):
                links[a].add(b)
                links[b].add(a)
                root[find(a)] = find(b)
    least = {}
    for r, s in zip(rows, sets):
        if s and r.doc_id is not None:
            c = find(s)
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    return [(r.doc_id, least.get(find(s)) if s else r.doc_id, len(links[s]), sets.count(s) if s else 1)
            for r, s in zip(rows, sets)]


def test_join_query_is_exact(spark, docs, folder):
    want = Counter(brute_classes(docs.select("doc_id", "text").collect()))
    got = Counter(tuple(r) for r in q.op2_ngram_join(spark, folder).collect())
    assert got == want
    assert sum(r[2] >= 8 for r in want) == 9  # the group of near copies, all linked


def test_one_row_of_each_class_stays(spark, docs, none):
    kept = one_of_each(docs)
    assert kept.schema == docs.schema
    rows = docs.select("doc_id", "text").collect()
    classes = {c[1] if c[0] is not None else ("null", k) for k, (c, r) in enumerate(zip(brute_classes(rows), rows))
               if shingles(r.text).size}
    wordless = sum(not shingles(r.text).size for r in rows)
    got = kept.collect()
    assert len([r for r in got if not shingles(r.text).size]) == wordless
    ids = [r.doc_id for r in got if shingles(r.text).size]
    # rows without an id join the class of their text, or are one of their own
    assert len(ids) == len({c for c in classes if not isinstance(c, tuple)}) + 1
    assert 3 in ids and 5 in ids and not {100, 105, 200, 207} & set(ids)
    assert ids.count(600) == 0 and ids.count(9) == 1
    assert one_of_each(none).collect() == []


def test_a_large_group_is_cut_into_blocks(spark, monkeypatch):
    import sqlrun.llm.ngram_join as nj
    monkeypatch.setattr(nj, "SMALL", 8)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*words[:150], f"own{k}", *words[150:]])) for k in range(40)]
    rows += [(100 + k, " ".join([*words[:40], *(f"x{k}y{j}" for j in range(200))])) for k in range(40)]
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc, r.class_id, r.n_links) for r in got} == (
        {(k, 0, 39) for k in range(40)} | {(100 + k, 100 + k, 0) for k in range(40)})


def test_runs_reach_the_recall():
    assert runs_for(0.8, 0.9999) == 4
    assert runs_for(0.8, 0.9) == 1
