"""Small inputs with what operators must bear: nulls, empty and long texts, ties, rows that repeat, clashing columns."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, th long, n_words string, found int, queue string, h1 double"

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"


def texts(n: int = 60, seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    words = ["the", "a", "of", "é", "wort", "Haus", "x1", "lorem", "ipsum", "dolor"]
    out: list[str | None] = []
    for i in range(n):
        body = [rng.choice(words) + (str(rng.randrange(9)) if rng.random() < 0.5 else "") for _ in range(rng.randrange(1, 80))]
        if i % 4 == 0:
            body[rng.randrange(len(body)) : 0] = PASSAGE.split()
        sep = rng.choice([" ", "\n", " \t "])
        out.append(sep.join(body))
    out += [None, "", " \n", "word", out[4], out[4], out[8] + " tail", "long " * 30_000, " ".join(f"w{i}" for i in range(40_000))]
    return out


def documents(spark, partitions: int = 5):
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], i, 1, "x", None, "q", None) for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (None, PASSAGE, None, None, None, None, None, None, None, None), (7, "another text of an id that comes twice", "en", "s2", 3, 4, "y", 1, "q", 0.5)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(partitions)


def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
