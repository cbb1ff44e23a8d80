import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, shard string"


def rows():
    """Documents with the awkward cases: no text, empty and blank texts, a very long one, repeats, near copies,
    missing ids and sources, letters outside ASCII, and extra columns with names that operators also use."""
    rnd = random.Random(5)
    words = [a + b for a in "ba ce di fo gu ñe ÄX".split() for b in "ra se ti lo mu nd the of".split()]

    def text(n):
        out = []
        for i in range(n):
            out.append(rnd.choice(words))
            out.append(rnd.choice([" ", " ", " ", "  ", "\n", "\t", ". "]))
        return "".join(out)

    texts = [None, "", "   \n\t", "one", "Ä ä İ ı ẞ", "a b", "the of and to", "é x y z \x1c q"]
    base = [text(n) for n in (30, 60, 120, 300, 300, 500)]
    passage = " ".join(text(70).split())
    texts += base + [base[3].upper(), base[3].lower(), base[4], base[4], passage, "x y " + passage + " z",
                     base[0] + passage + base[1], "w " * 50, text(8000), "<|endoftext|> ▁ 日本語のテキスト" * 3]
    for i in range(12):
        words_of = base[5].split()
        words_of[7 * i + 3] = f"new{i}"
        texts.append(" ".join(words_of))
    texts += ["".join(chr(rnd.randrange(33, 0x3000)) for _ in range(3000)), "line\nline\nother\nline\n" * 8]
    out = [(i, t, "en", f"s{i % 4}", None, "own", "own", "own") for i, t in enumerate(texts)]
    out += [(1000, base[2], None, None, 1, None, None, None), (1000, base[2], None, None, 1, None, None, None),
            (-5, base[1], None, "S0", 1, None, None, None), (None, base[1], "x", None, 0, "a", "b", "c"),
            (None, "only here " * 4, "x", None, 0, "a", "b", "c")]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
