"""Licence notices, line quality, edit-aware counts and language ID."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex

from sqlrun.llm import queries as q
from sqlrun.llm.edit_counts import CountTree, counter, edit_trees, redactions, token_trees
from sqlrun.llm.language_id import KneserNey, LanguageModels, identify, text_codes, text_letters
from sqlrun.llm.license_scan import BASE_NOTICES, EDIT_EVERY, MORE_NOTICES, scan_notices
from sqlrun.llm.line_quality import line_quality, normal_line, without_lines

from .conftest import SCHEMA, WORDS, corpus

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(k, label) for label, phrase in BASE_NOTICES for k in range(len(words))
              if words[k:k + len(phrase.split())] == phrase.split()]
    return words, places


def test_licence_base_places(spark, docs, folder):
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        words, places = brute_base(r.text)
        want[(r.doc_id, len(words), len(places), min((p for p, _ in places), default=None),
              max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places})))] += 1
    got = q.op3_license_notices(spark, folder).collect()
    assert Counter(tuple(r[:6]) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert (by_id[601].labels, by_id[601].score) == ("cc-by-nc,mit", 1.0)
    assert by_id[602].base_labels == "apache-2" and by_id[602].labels == "apache-2,mit"
    assert by_id[603].n_base == 2 and by_id[603].labels == "apache-2,cc-by-nc"
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_seeds_lose_no_fuzzy_match(spark):
    """The whole pattern, run over whole texts without seeds, finds the same notices."""
    rng = random.Random(4)
    notices = BASE_NOTICES + MORE_NOTICES
    texts = []
    for _ in range(150):
        _, phrase = rng.choice(notices)
        chars = list(phrase)
        for _ in range(rng.randrange(0, len(phrase) // EDIT_EVERY + 2)):
            k = rng.randrange(len(chars))
            chars[k:k + rng.randrange(2)] = rng.choice("abcdefg") * rng.randrange(2)
        texts.append(f"some words {''.join(chars)} and more words")
    got = scan_notices(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    found = {r.doc_id: {s.notice for s in r.spans} for r in got}
    for k, t in enumerate(texts):
        norm = " " + " ".join(re.findall(r"[0-9a-z]+", t)) + " "
        want = {p for _, p in notices
                if regex.search(rf"(?<= )(?:{regex.escape(p)}){{e<={len(p) // EDIT_EVERY}}}(?= )", norm)}
        assert found[k] == want, t
    for r in got:
        for s in r.spans:
            assert 0 <= s.first_word <= s.last_word < r.n_words and s.edits <= len(s.notice) // EDIT_EVERY


def edit_distances(phrase, text):
    """Edits between the phrase and each prefix of the text."""
    row = list(range(len(text) + 1))
    for k, c in enumerate(phrase, 1):
        before, row = row, [k]
        for j, d in enumerate(text):
            row.append(min(before[j] + (c != d), before[j + 1] + 1, row[j] + 1))
    return row


def brute_places(words, phrase):
    """Places (first word, last word, edits): unchanged ones, then edited ones
    that overlap none taken before, fewest edits and leftmost first."""
    places = []
    for a in range(len(words)):
        rest = " ".join(words[a:])[:2 * len(phrase)]
        edits = edit_distances(phrase, rest)
        end = -1
        for b in range(a, len(words)):
            end += len(words[b]) + 1
            if end > len(rest):
                break
            if edits[end] <= len(phrase) // EDIT_EVERY:
                places.append((edits[end], a, b))
    taken = []
    for e, a, b in sorted(places):
        if not e or all(b < c or d < a for c, d, _ in taken):
            taken.append((a, b, e))
    return set(taken)


def test_neighbouring_notices_are_all_found(spark):
    rng = random.Random(8)
    texts = ["under the mit licence and under the mit license",
             "under the mit lisence under the mit licence under the mit license"]
    notices = BASE_NOTICES + MORE_NOTICES
    for _ in range(120):
        _, phrase = rng.choice(notices)
        parts = []
        for _ in range(rng.randrange(1, 5)):
            chars = list(phrase)
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                k = rng.randrange(len(chars))
                chars[k:k + rng.randrange(2)] = rng.choice("abcdefg ") * rng.randrange(2)
            parts += "".join(chars), *rng.choices(("and", "or", "under the", "license"), k=rng.randrange(3))
        texts.append(" ".join(parts))
    texts.append("under the mit licence " * 3000)  # takes time in proportion to its length
    got = scan_notices(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    found = {r.doc_id: {(s.notice, s.first_word, s.last_word, s.edits) for s in r.spans} for r in got}
    assert sorted(x[1:] for x in found[0] if x[0] == BASE_NOTICES[0][1]) == [(0, 3, 1), (5, 8, 0)]
    assert sorted(x[1:] for x in found[1] if x[0] == BASE_NOTICES[0][1]) == [(0, 3, 2), (4, 7, 1), (8, 11, 0)]
    for k, t in enumerate(texts[:-1]):
        assert found[k] == {(p, *place) for _, p in notices for place in brute_places(t.split(), p)}, t
    assert len(found[len(texts) - 1]) == 3000


def test_licence_empty(spark, none):
    assert scan_notices(none).collect() == []


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in often for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_quality_base(spark, docs, folder):
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        stats = brute_quality(r.text)
        want[(r.doc_id, *stats, stats[0] < 50 or 100 * stats[4] > 50 * stats[0])] += 1
    got = q.op4_line_quality(spark, folder).collect()
    assert Counter(tuple(r[:7]) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_frequent_lines_go(spark, docs, none):
    verdicts, frequent = line_quality(docs, min_documents=2, max_share=0.0, min_words=5, min_left=0.6)
    rows = docs.select("row", "doc_id", "text", "source").collect()
    held = Counter((r.source, x) for r in rows for x in {normal_line(y.encode()) for y in (r.text or "").split("\n")} if x)
    often = {k for k, n in held.items() if n > 2}
    assert frequent.count() == len(often) > 0
    want = {}
    for r in rows:
        stay = [x for x in (r.text or "").split("\n") if (r.source, normal_line(x.encode())) not in often]
        want[r.row] = None if r.text is None else "\n".join(stay)
    cleaned = without_lines(docs, frequent)
    assert cleaned.schema == docs.schema
    assert {r.row: r.text for r in cleaned.collect()} == want
    left = Counter((r.doc_id, len((want[r.row] or "").encode().split())) for r in rows)
    assert Counter((r.doc, r.words_left) for r in verdicts.collect()) == left
    for r in verdicts.collect():
        assert r.kept == (not r.base_failed and r.words_left >= 5 and r.words_left >= 0.6 * r.n_words)
    empty, lines = line_quality(none)
    assert empty.collect() == [] and lines.collect() == []


def test_counts_follow_edits():
    tokens, rng = counter(RANKS), random.Random(3)
    parts = ["a", "the", "'s", "'ll", "'", " ", "  ", "\n", "\t", "1", "23", "é", "ñ", "!", "--", "word", "中文", "²", "ll"]
    some = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    for _ in range(300):
        tree = CountTree(some(rng.choice([3, 30, 900])), tokens)
        for _ in range(4):
            a = rng.randint(0, len(tree.text))
            b, new = min(len(tree.text), a + rng.choice([0, 1, 5, 200])), some(rng.choice([0, 2, 60, 2000]))
            want = tree.text[:a] + new + tree.text[b:]
            tree.edit(a, b, new)
            assert tree.text == want and tree.n_tokens == len(tokens.whole(want))
            assert tree.state()[0] == [len(x) for x in tokens.words.findall(want)]


def test_few_pre_tokens_are_encoded_anew():
    tree = CountTree("word after word " * 20_000, counter(RANKS))
    tree.encoded = 0
    tree.edit(100_000, 100_004, "another thing")
    assert tree.encoded < 20 and tree.n_tokens == len(tree.tokens.whole(tree.text))


def apply(text, edits):
    out, at = [], 0
    for a, b, new in sorted(edits):
        out += text[at:a], new
        at = b
    return "".join(out) + text[at:]


def test_edit_query(spark, docs, folder):
    whole = counter(RANKS).whole
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        after = apply(r.text or "", redactions(r.text or ""))
        want[(r.doc_id, len(whole(r.text or "")), len(redactions(r.text or "")), len(whole(after)),
              hashlib.sha256(after.encode()).hexdigest())] += 1
    got = q.op5_edit_counts(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_edited, r.edited_sha256) for r in got) == want


def test_edits_in_a_column(spark, none):
    rows = [(1, "mail a@b.cd now", [(5, 11, "X")]), (2, "plain", None), (3, None, [(0, 9, "new text")]),
            (4, "ends", [(2, 99, "!"), (0, 0, "<<")])]
    df = spark.createDataFrame(rows, "doc_id int, text string, edits array<struct<start:int,end:int,text:string>>")
    trees = token_trees(df, RANKS, keep=("doc_id", "edits"))
    got = {r.doc_id: r for r in edit_trees(trees, RANKS, "edits").collect()}
    assert [got[k].text for k in (1, 2, 3, 4)] == ["mail X now", "plain", "new text", "<<en!"]
    assert all(r.n_tokens == len(counter(RANKS).whole(r.text)) for r in got.values())
    assert edit_trees(token_trees(none, RANKS), RANKS, redactions).collect() == []
    assert sorted(redactions("call 555 123 4567 or a.b@c.org\nx\nx")) == [
        (5, 17, "<number>"), (21, 30, "<mail>"), (33, 34, "")]


def test_languages_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in q.op9_language_id(spark, sf).collect()}
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(truth)
    held = [r for r in truth if got[r.doc_id].held_out]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in truth)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held) > 100
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = [r[:2] + (("en" if k % 2 else "de") if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 != 1 else "zz",)
            for k, r in enumerate(corpus())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F
    got = identify(df, F.coalesce(q.fold() != 1, F.lit(False))).collect()
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}


def test_language_edge_cases(spark, docs, none, folder, empty_folder):
    got = q.op9_language_id(spark, folder).collect()
    assert len(got) == docs.count()
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(pred[k] == ("und", 0.0) for k in (500, 502, 503, 504))
    assert all(pred[k][0] in ("en", "de") for k in (505, 507, 509))
    assert q.op9_language_id(spark, empty_folder).collect() == []
    from pyspark.sql import functions as F
    unlabelled = identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {(r.lang_pred, r.rejected) for r in unlabelled} == {("und", True)}
    foreign = spark.createDataFrame([(k, t, "en", None, 1, "", 0, "") for k, t in enumerate(
        ["the people of the house and the garden by the river %d" % k for k in range(400)] + ["zqxj vkqz jxqv " * 40])],
        SCHEMA)
    rejected = {r.doc_id for r in identify(foreign, F.col("doc_id") < 400).filter("rejected").collect()}
    assert rejected == {400}


@pytest.mark.parametrize("size", [50, 500])
def test_a_line_in_a_tenth_of_a_host_goes_at_every_size(spark, size):
    """At the production limits: a share of the host's documents decides."""
    rng = random.Random(size)
    rows = []
    for k in range(size):
        own = " ".join(f"{rng.choice(WORDS)}{rng.randrange(10 ** 6)}" for _ in range(80))
        rows.append((k, "Subscribe to our newsletter today\n" * (k % 10 == 0) + own, "host"))
    verdicts, frequent = line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r.doc: r for r in verdicts.collect()}
    assert frequent.count() == 1
    assert all(r.lines_removed == (k % 10 == 0) and r.kept for k, r in got.items())


def kneser_ney(texts, characters):
    """p(w | context) by the definition, on tuples of characters."""
    grams = [Counter() for _ in range(5)]
    for t in texts:
        own = [0, 0, *text_letters(t).tolist()]
        grams[4].update(tuple(own[k:k + 4]) for k in range(len(own) - 3))
    for n in (3, 2, 1):  # how many characters stand before
        grams[n] = Counter(g[1:] for g in grams[n + 1])

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / characters
        counts = grams[n]
        ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
        discount = ones / (ones + 2 * twos) if ones else 0.5
        after = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return (max(counts[gram] - discount, 0) + discount * len(after) * p(gram[1:])) / sum(after)
    return p, sorted(grams[4])


def test_kneser_ney_by_definition():
    texts = ["the cat sat on the mat", "a cat, a hat", "été à l'été", "\u4e00\u4e8c\u4e09 \u4e00\u4e8c", "x\U00020000y"]
    p, seen = kneser_ney(texts, 40)
    codes = np.concatenate([text_codes(t) for t in texts])
    model = KneserNey(*np.unique(codes, return_counts=True), 40)
    pack = lambda g: sum(c << 16 * (3 - k) for k, c in enumerate(g))
    wanted = seen + [(0, 0, 0, ord("q")), (ord("t"), ord("h"), ord("e"), ord("z")), (ord("q"),) * 4,
                     (ord("q"), ord("h"), ord("e"), 0)]
    got = model.probability(np.array([pack(g) for g in wanted], np.uint64))
    assert np.allclose(got, [p(g) for g in wanted], rtol=1e-12, atol=0)
    # (probabilities of all that can follow add up to one)
    letters = sorted({g[3] for g in seen})
    total = model.probability(np.array([pack((ord("t"), ord("h"), ord("e"), c)) for c in letters], np.uint64)).sum()
    assert abs(total + (40 - len(letters)) * p((ord("t"), ord("h"), ord("e"), 0xFFFF)) - 1) < 1e-12


def test_languages_of_one_large_script_are_told_apart():
    rng = random.Random(3)
    scripts = {lang: [chr(0x4E00 + 37 * (2 * k + odd)) for k in range(200)] for lang, odd in (("a", 0), ("b", 1))}
    write = lambda lang, n: "".join(rng.choice(scripts[lang]) for _ in range(n))
    counts = {x: np.unique(np.concatenate([text_codes(write(x, 50)) for _ in range(60)]), return_counts=True)
              for x in scripts}
    models = LanguageModels(counts)
    for lang in scripts:
        for _ in range(20):
            n, entropy = models.entropies(write(lang, 30))
            assert n == 31 and models.langs[int(np.argmin(entropy))] == lang


def test_redactions_by_definition_and_in_linear_time():
    import time

    def plain(text):
        out, seen, at = [], set(), 0
        for line in text.split("\n"):
            if line.strip() and line in seen:
                out.append((at, min(len(text), at + len(line) + 1), ""))
            else:
                seen.add(line)
                mails = [(at + m.start(), at + m.end()) for m in re.finditer(r"[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64})+", line)]
                out += [(a, b, "<mail>") for a, b in mails]
                out += [(at + m.start(), at + m.end(), "<number>") for m in re.finditer(r"\d(?:[ -]?\d){6,}", line)
                        if not any(at + m.start() < y and x < at + m.end() for x, y in mails)]
            at += len(line) + 1
        return out
    rng = random.Random(4)
    parts = ["a.b@c.org", "555 123 4567", "x1234567@y.de", "12345678@z.fr", "word", "0000000", " ", "\n", "\n\n"]
    for _ in range(200):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert redactions(text) == plain(text)
    took = []
    for n in (8000, 16000):
        text = "\n".join(f"line {k} a{k}@b.org 555 123 {k:07d}" for k in range(n))
        start = time.process_time()
        assert len(redactions(text)) == 2 * n
        took.append(time.process_time() - start)
    assert took[1] < 2.5 * took[0] + 0.05
