"""Small tables with the cases that every operator has to define."""

import random

import pytest

#: Columns of names that operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, cls bigint, label string, score double, row bigint, id bigint, shard int, slot bigint, kept boolean, token string, ids string, digest string, place int, group_size string"

EN = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split()


def sentence(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "er", "ing", "lich"]) for _ in range(n)).capitalize() + "."


def row(doc_id, text, lang="en", source="s"):
    n = len(text) if text is not None else None
    return (doc_id, text, lang, source, n, n, 1, "x", 0.5, 7, 9, 3, 4, True, "t", "i", "d", 2, "g")


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(3)
    out = [row(i, "\n".join(sentence(rng, EN if i % 2 else DE, rng.randint(6, 30)) for _ in range(4)), "en" if i % 2 else "de") for i in range(60)]
    base = " ".join(rng.choice(EN) + str(rng.randint(0, 400)) for _ in range(120))
    for i in range(60, 75):  # near copies
        words = base.split()
        words[rng.randrange(120)] = f"w{i}"
        out.append(row(i, " ".join(words)))
    out += [row(i, f"  {base}\n") for i in range(75, 80)]  # copies but for white space
    out += [row(80, None), row(81, ""), row(82, " \t\n"), row(83, None, None, None), row(None, "no id at all here my friend"), row(None, "no id at all here my friend")]
    out += [row(84, "a b c"), row(85, "A B  C"), row(86, "!!! ### $$$ %%%"), row(87, "word " * 30), row(88, "x" * 5000), row(89, "nbsp here   日本語 \U0001f600 <|endoftext|> ▁ end")]
    out += [row(90, " ".join(sentence(rng, EN, 40) for _ in range(500)))]  # very long
    out += [row(5, out[5][1]), row(91, out[7][1], "de"), row(5, out[5][1])]  # repeated rows, equal texts
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    known = [(r[0], 0 if (r[0] or 0) in (86, 87) else 1, 0) for r in rows if r[0] is not None and r[0] % 2 == 0 or r[0] in (86, 87)]
    return spark.createDataFrame([*known, (None, 1, 0), (3, None, None), (999, 1, 0)], "doc_id bigint, quality int, toxic int")


def table(df):
    """Rows as a list, in an order of their own."""
    return sorted(map(tuple, df.collect()), key=repr)
