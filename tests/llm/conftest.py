import random

import pytest

#: Columns of documents and some with names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, n_chars long, n_words long, shard int, _row long, kept boolean, fingerprint string, size string, _text string"


def make_rows():
    """Null, empty and blank texts, null ids, a very long text, ties, repeated rows, near copies and shared passages."""
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäöéñ") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]

    def prose(n):
        words = [rnd.choice(vocabulary) for _ in range(n)]
        return "".join(w + rnd.choice([" ", " ", " ", " ", ". ", "\n", "  ", "\t"]) for w in words).strip()

    passage, item = prose(60), prose(14)
    texts = [prose(rnd.randint(5, 200)) for _ in range(60)]
    texts += [f"{prose(30)} {passage} {prose(20)}" for _ in range(6)]
    texts += [texts[0]] * 5 + [texts[1].upper()] + [f"{texts[2]} one"]
    texts += [f"{prose(25)}\n{item.upper()}, {prose(9)}", f"{prose(8)} the short one here {prose(60)}"]
    texts += [None, "", "   ", "\n\n", "x", "one two", "\x0b\x0c\r", "a " * 300, prose(30_000), "Released under the MIT License.\n" + prose(80), "☃" * 400]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, texts[3]), (3, texts[3]), (5, "another text with the id of five"), (None, texts[4]), (None, None), (None, "no id, some words")]
    return [(i, t, "en", None if t is None else len(t), -1, 9, 4, True, "zz", "q", "w") for i, t in rows], item


@pytest.fixture(scope="session")
def made():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, made, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(made[0], SCHEMA).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(spark, made):
    rows = [(1, made[1]), (10, made[1]), (2, "The SHORT one, here!"), (3, None), (4, ""), (None, "the short one here"), (10, "..."), (5, "never seen anywhere words")]
    return spark.createDataFrame(rows, "item_id long, text string")
