"""Small tables for the corpus operators."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = COLUMNS + ", key string, node long, row_no long, kept boolean, part int, `_n` long, `group` string, `range` int"
WORDS = "the of and stream river house green seven walking under letter tower market silver often never again child".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") if rng.random() < 0.5 else "") for _ in range(n))


def text(rng, n):
    words, out = sentence(rng, n).split(), []
    for i in range(0, n, 9):
        out.append(" ".join(words[i : i + 9]).capitalize() + ".")
    return "\n".join(" ".join(out[i : i + 3]) for i in range(0, len(out), 3))


def near(rng, base, changes=1):
    words = base.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def corpus(seed=3, n=60):
    """Texts with exact, spaced and near copies, and every odd case."""
    rng = random.Random(seed)
    base = [text(rng, rng.randint(5, 150)) for _ in range(n)]
    out = list(base)
    out += [base[0]] * 25 + [base[1].replace(" ", "  ")] * 3 + [base[2].upper()] * 2
    for k in range(3, 15):
        out += [near(rng, base[k], c) for c in (1, 1, 2, 4)]
    hub = text(rng, 120)
    out += [near(rng, hub, 2) for _ in range(30)]
    out += ["", None, None, " \t\n", "one", "one", "One", "two words", "two  words", "a b c", "...", "12 34", "é", "ß ΣΣ İ ǅ"]
    out += ["word " * 30_000, "x" * 150_000, "tab\tand\r\nreturn  twice   thrice   nbsp   end "]
    rng.shuffle(out)
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None]), None if t is None else len(t)) for i, t in enumerate(out)]


def frame(spark, rows, schema=COLUMNS, parts=5):
    return spark.createDataFrame(rows, schema).repartition(parts)


def odd_rows():
    """Repeated rows, null ids and extra columns with names that operators use inside."""
    extra = ("k", 1, 2, True, 3, 4, "g", 5)
    return [
        (*r, *extra)
        for r in [
            (1, "same text here now", "en", "s", 18), (1, "same text here now", "en", "s", 18), (2, "same text here now", None, None, None),
            (None, "same text here now", "en", "s", 18), (None, None, None, None, None), (None, None, None, None, None),
            (3, "other text stands here", "en", "s", 22), (3, "third text stands there", "en", "s", 23), (4, "", "en", "s", 0),
        ]
    ]
