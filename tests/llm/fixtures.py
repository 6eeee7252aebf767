"""A small corpus with every odd case, and helpers."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", ",", "."])) for _ in range(n))


def corpus(seed=0, n=40):
    rng = random.Random(seed)
    rows = []
    shared = [sentence(rng, 60) for _ in range(3)]
    for i in range(n):
        lines = [sentence(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 8))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        rows.append((i, "\n".join(lines)))
    base = rows[1][1]
    rows += [(n, base), (n + 1, base), (n + 2, base + " omega"), (n + 3, base.replace("alpha", "omega", 1))]
    rows += [(n + 4, None), (n + 5, ""), (n + 6, "  \n\n \n"), (n + 7, "one"), (n + 8, "Été où ça ß 東京 語\n語 東京"), (n + 9, "\n".join(["same line here"] * 30))]
    rows += [(n + 10, " ".join(sentence(rng, 12) for _ in range(900))), (2, rows[2][1]), (3, "another text under a known id"), (None, "no id " + base), (None, base)]
    return rows


def documents(spark, rows=None, extra=True):
    """``rows`` as documents, with columns whose names clash with what operators compute."""
    rows = corpus() if rows is None else rows
    clash = ", key string, rank int, dead string, fp string, d string, n int, cls int, seq int, score double, unit int, hit int, items int, media int"
    if not extra:
        return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.createDataFrame(
        [(i, t, None, "s", None if t is None else len(t), "k", 1, "x", "f", "d", 7, 3, 2, 0.5, 9, 1, 2, 3) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long" + clash,
    )


def empty(spark):
    return documents(spark, []).limit(0)
