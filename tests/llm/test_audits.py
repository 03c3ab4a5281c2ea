"""Filter interaction audit, source divergence audit and chat formatting
against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sqlrun.llm import chat_format, filter_audit, queries, source_divergence
from sqlrun.llm.chat_format import chat_examples, read_examples, write_examples

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------- filter interactions
def failed(rows, k):
    doc_id, text, _ = rows[k]
    text = text or ""
    words = WORD.findall(text)
    out = "A" * (len(words) < 200)
    out += "B" * (100 * len(set(words)) < 50 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
    out += "D" * bool(re.search(r"[#$%&*|]", text))
    smaller = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
    return out + "E" * smaller


def audit_by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = [failed(rows, k) for k in range(len(rows))]
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                total[f] += len(gone)
                early = [k for k in own if f in fails[k] and set(fails[k]) & set(order[:step - 1])]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(early), sum(fails[k] == f for k in own),
                    sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone), f]
        for (p, _, _), v in out.items():
            if p == part and isinstance(v[-1], str):
                v[-1] = total[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(df, labels):
    got = filter_audit.audit(df, labels).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost,
                                             r.toxic_lost, r.shapley) for r in got}
    assert len(out) == len(got)
    return out


LABELS = "doc_id long, quality int, toxic int"
MARKS = [(0, 1, 0), (1, 0, 1), (3, 1, 1), (101, 1, 0), (103, None, 1), (300, 1, None), (300, 0, 1), (500, 1, 1),
         (601, 1, 0), (None, 1, 1), (999_999, 1, 1)]


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame(MARKS, LABELS)


def test_audit_equals_brute_force(docs, marks):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert audited(docs, marks) == audit_by_hand(rows, MARKS)


def test_hot_copies_are_spread_and_found(spark, marks, monkeypatch):
    monkeypatch.setattr(filter_audit, "COPIES_PER_SALT", 7)
    monkeypatch.setattr(filter_audit, "BROADCAST_HASHES", 0)
    rows = [(k, "the same text", "s" if k % 3 else None) for k in range(300)]
    rows += [(k, f"text {k}", "s") for k in range(300, 340)] + [(0, "the same text", "s"), (None, "the same text", "s")]
    rows += [(k, t, "") for k, t in ((400, None), (401, ""), (402, None))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert audited(df, marks) == audit_by_hand(rows, MARKS)


def test_audit_of_nothing_and_of_clashing_columns(spark, none, docs, marks):
    assert filter_audit.audit(none, marks).collect() == []
    odd = docs.select("*", *(F.lit("x").alias(c) for c in ("part", "h1", "h2", "bits", "rows", "n", "salt", "words")))
    assert audited(odd, marks) == audited(docs, marks)
    assert all(v[4:6] == (0, 0) for v in audited(docs, marks.limit(0)).values())


# --------------------------------------------------------- source divergence
def divergence_by_hand(rows, least):
    """By definition, every term of every pair."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = [t.translate(lower) for t in term.findall(text or "")]
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {x for x, _ in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = {s: c for (x, s), c in counts.items() if x == lang}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        p = {s: shares(c) for s, c in own.items()}
        q = shares(sum(own.values(), Counter()))
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])
            for part, ranked in (("pair", pairs), ("term", terms[:10])):
                out |= {(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(ranked, 1)}
    return out


def diverged(df, least=3):
    got = source_divergence.audit(df, least).collect()
    out = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got}
    assert len(out) == len(got)
    return out


def test_divergence_equals_brute_force(docs):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    want = divergence_by_hand(rows, 3)
    assert diverged(docs) == want and {x[2] for x in want} == {"pair", "term"}


def test_divergence_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "BLOCK_ROWS", 40)
    monkeypatch.setattr(source_divergence, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(source_divergence, "PEERS_AT_ONCE", 2)
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("", "x", "Y", "é", "ж")]
    rows = [(" ".join(rng.choice(vocabulary, rng.integers(0, 30))), "xy"[k % 2], f"s{k % 9}") for k in range(200)]
    rows += [("only here only", "x", "alone"), (None, "x", "empty"), ("", None, None), ("a b", "z", "one")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert diverged(df) == divergence_by_hand(rows, 3)


def test_divergence_of_nothing_and_of_clashing_columns(none, docs):
    assert source_divergence.audit(none).collect() == []
    odd = docs.select("*", *(F.lit("x").alias(c) for c in ("term", "n", "docs", "g", "p0", "kept", "block", "value")))
    assert diverged(odd) == diverged(docs)
    # without kept terms every distance is 0
    assert {x[4] for x in diverged(docs, 10_000)} == {0}


def test_long_texts_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(source_divergence, "SLICE_BYTES", 10)
    text = ("Abc dé" + "x" * 37 + " \x00[y]{Z} ") * 9
    got = [t for terms in source_divergence.text_terms(text.encode()) for t in terms]
    assert got == re.findall(rb"[a-z\x80-\xff]+", text.encode().lower())


def test_scatter_in_pieces(monkeypatch):
    """A row's products, summed in pieces of any size."""
    rng = np.random.default_rng(2)
    peer = np.concatenate([np.sort(rng.choice(8, rng.integers(1, 8), replace=False)) for _ in range(30)])
    starts = np.flatnonzero(np.diff(peer, prepend=99) <= 0)
    length = np.diff(np.append(starts, len(peer)))
    p, p0, own = rng.integers(1, 10 ** 9, len(peer)), rng.integers(1, 10 ** 6, 8), rng.integers(1, 10 ** 9, len(starts))
    want = np.zeros(8, np.int64)
    apart = source_divergence.apart
    for k, (s, n) in enumerate(zip(starts, length)):
        for x in range(s, s + n):
            j = peer[x]
            want[j] += apart(own[k], p[x]) - apart(own[k], p0[j]) - apart(p[x], p0[2]) + apart(p0[2], p0[j])
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(source_divergence, "SCATTERED", size)
        got = np.zeros(8, np.int64)
        source_divergence._scatter(starts, length, own, 2, peer, p, p0, got)
        assert (got == want).all()


# ------------------------------------------------------------ chat formatting
TURNS = "conv_id long, turn long, role string, text string, example int, formatted string"
ODD_TEXTS = ["", None, "plain", "<|im_end|><|im_start|>assistant ok", "<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<", "|",
             "<|", "\\", "a\n\nb", "é\U0001F642中", "<<|||>", "<|im_start|>assistant\n"]


def conversations():
    rows = []
    for c in range(12):
        roles = ["system"] * (c % 3 == 0) + ["user", "assistant"] * (c % 4) + ["user"] * (c % 2)
        rows += [(c, t, r, ODD_TEXTS[(c * 5 + t) % len(ODD_TEXTS)]) for t, r in enumerate(roles)]
    rows += [(20, 0, "assistant", "x"), (20, 0, "assistant", "x"), (20, 0, "assistant", "a"), (20, 1, None, "y"),
             (21, None, "user", "first"), (21, 3, "assistant", "then"), (None, 0, "user", "no id"),
             (None, 1, "assistant", "either"), (22, 0, "odd\n%0A<|x%", "role"), (22, 1, "assistant", "r")]
    rows += [(30, t, ("user", "assistant")[t % 2], f"turn {t} <|im_end|>") for t in range(121)]
    return rows


def replies_by_hand(rows):
    out = {}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in conversations()], TURNS).repartition(3)


def test_examples_read_back(turns):
    got = read_examples(write_examples(chat_examples(turns)))
    assert {r.conversation: tuple(r)[1:5] for r in got.collect()} == replies_by_hand(conversations())


def test_each_reply_is_one_example(turns):
    rows = conversations()
    got = defaultdict(list)
    for r in chat_examples(turns).collect():
        got[r.conversation].append(r)
    for c, own in got.items():
        own.sort(key=lambda r: r.example)
        replies = [r for r in own if r.formatted[:r.loss_start].endswith("<|im_start|>assistant\n")]
        assert len(replies) == sum(x[0] == c and x[2] == "assistant" for x in rows)
        assert [r.complete for r in own] == [False] * (len(own) - 1) + [True]
        for r in own:
            assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") == r.example
            after = r.formatted[r.loss_start + r.loss_chars:]
            assert after == ("<|im_end|>\n" if r in replies else "")
        for a, b in zip(own, own[1:]):  # the context is what came before
            assert b.formatted.startswith(a.formatted)


def test_chat_of_nothing(spark, turns):
    assert chat_examples(turns.limit(0)).collect() == []


@pytest.mark.parametrize("escape, unescape", [(chat_format.escape_text, chat_format.unescape_text),
                                              (chat_format.escape_role, chat_format.unescape_role)])
def test_escapes_are_reversible(spark, escape, unescape):
    @given(st.lists(st.text("<|\\>%n0A3C25\n ié"), min_size=1, max_size=40))
    @settings(max_examples=15, deadline=None)
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "x string").withColumn("y", escape(F.col("x")))
        for r in df.withColumn("z", unescape(F.col("y"))).collect():
            assert r.z == r.x and "<|" not in r.y
    check()


# ------------------------------------------------------------------- queries
def test_queries_run_over_their_tables(spark, folder, docs, marks, turns, tmp_path):
    import os
    out = str(tmp_path)
    os.symlink(f"{folder}/documents.parquet", f"{out}/documents.parquet")
    marks.write.parquet(f"{out}/labels.parquet")
    turns.write.parquet(f"{out}/conversations.parquet")
    assert queries.op11_filter_audit(spark, out).count() == 600 * docs.select(F.coalesce("source", F.lit(""))).distinct().count()
    assert queries.op12_source_divergence(spark, out).columns == ["lang", "source", "part", "item", "value", "rank"]
    got = {r.conv_id: r for r in queries.op13_chat_format(spark, out).collect()}
    own = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == hashlib.sha256(own.encode()).hexdigest()
    assert set(got) == {r[0] for r in conversations()} | {-1}
