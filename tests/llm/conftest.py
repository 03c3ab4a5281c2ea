import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, text_1 string"
WORDS = ("the of and to licence data model token stream river stone house under light paper morning "
         "window garden silver winter summer letter number people market window").split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "s", "ing", "ed", str(rng.randrange(99)))) for _ in range(n))


def text(rng: random.Random, lines: int = 4, words: int = 30) -> str:
    return "\n".join(sentence(rng, words) + "." for _ in range(lines))


def corpus(seed: int = 1) -> list[tuple]:
    """Documents with copies, near copies, shared passages and lines, nulls,
    empty, symbol-only and very long texts, repeated rows, and columns whose
    names clash with the operators' own."""
    rng = random.Random(seed)
    base = [text(rng) for _ in range(25)]
    passage, line = sentence(rng, 90), sentence(rng, 12)
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[3]) for k in range(6)]
    for k in range(8):  # near copies, each another
        words = base[5].split(" ")
        words[rng.randrange(len(words))] = f"edit{k}"
        rows.append((200 + k, " ".join(words)))
    rows += [(300 + k, f"{text(rng, 2)} {passage} {text(rng, 1)}") for k in range(4)]
    rows += [(400 + k, f"{line}\n{text(rng, 3)}\n{line}") for k in range(9)]
    rows += [(500, None), (501, None), (502, ""), (503, " \n\t "), (504, "### $$$ !!!"), (505, "x"),
             (506, "ab " * 400), (507, "é\U0001F642 中文 ſ ½ ² Ⅷ <|endoftext|>\r\n  y"), (508, text(rng, 150, 60)),
             (509, "z" * 3000), (None, base[7]), (None, None), (None, "no id " * 90), (600, base[9]), (600, base[9]),
             (601, "Released under the MIT license, see CC-BY-NC."), (602, "under the mlt license\nApache License, Version 2"),
             (603, "apache licence version 2 (cc by nc; cc by nc)")]
    langs, sources = ("en", "de", None), ("a", "b", "a", None, "a", "Z")
    return [(i, t, langs[k % 3], sources[k % 6], None if t is None else len(t), f"r{k}", k, "other")
            for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """A folder with the small `documents`, as the queries read it."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{out}/documents.parquet")
    return out


@pytest.fixture(scope="session")
def empty_folder(spark, none, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    none.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{out}/embeddings.parquet")
    return out
