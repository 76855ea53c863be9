"""Small documents with every edge that the operators define."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, own int, lo string, __ string"


def rows(seed=7, n=60, words=40):
    """Copies, near copies, shared passages, short, empty and null texts, repeated rows and ids, and columns whose
    names the operators use themselves."""
    pick = random.Random(seed)
    vocabulary = [f"w{pick.randrange(900)}" for _ in range(700)] + ["the", "of", "Ünï", "a b"]
    make = lambda k: [pick.choice(vocabulary) for _ in range(k)]
    base, passage = make(120), make(70)
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            words_ = list(base)
            for _ in range(pick.randrange(0, 14)):
                words_[pick.randrange(len(words_))] = f"e{pick.randrange(10**6)}"
        elif kind == 1:
            words_ = make(pick.randrange(1, words)) + passage[: pick.randrange(45, 71)] + make(pick.randrange(1, words))
        elif kind == 2 and out:
            words_ = pick.choice(out)[1].split() if out[-1][1] else []
        else:
            words_ = make(pick.randrange(1, 3 * words))
        gap = pick.choice([" ", "\n", "\t ", "\x0b"])
        out.append((i * 3, gap.join(words_)))
    out += [(1, None), (4, ""), (7, " \n\t"), (10, "one"), (13, "one"), (16, "One two"), (19, "one two three"), (22, " ".join(make(4000))), (25, "the " * 300), (28, "the " * 290)]
    out += [(None, " ".join(base)), (0, out[0][1]), (0, out[0][1]), (3, out[7][1])]
    pick.shuffle(out)
    return [(i, t, pick.choice(["en", "de", None]), pick.choice(["s0", "s0", "s1", None]), len(t or ""), "x", 1, "y", "z") for i, t in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
