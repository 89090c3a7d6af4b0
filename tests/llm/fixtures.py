"""Small inputs that every operator must take: nulls, empty and long texts, repeats, ties and clashing column names."""

import random

WORDS = "the of and stone river light under winter morning silver house gentle walk number paper garden".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n))


def changed(text: str, seed: int, words: int = 1) -> str:
    rng = random.Random(seed)
    parts = text.split(" ")
    for k in rng.sample(range(len(parts)), words):
        parts[k] = f"edit{seed}x{k}"
    return " ".join(parts)


BASE = prose(200, 1)
TEXTS = [
    None, "", " ", "one", "one two three four", "One two three FOUR", BASE, BASE, BASE.upper(), changed(BASE, 2), changed(BASE, 3, 30),
    prose(30, 4), "a\na\n\nb\na", "word " * 300, prose(4000, 5), "😀 ñandú é x  y\n z ", "x" * 5000, "\n\n\n", "mail me at a.b@c-d.example.org or +1 (555) 123-4567",
]


def documents(spark, texts=TEXTS, langs=("en", None, "de")):
    """Documents with a null id, a repeated id and columns whose names clash with those that operators add."""
    rows = [(k, t, langs[k % len(langs)], "src0", None if t is None else len(t), "kept", 7) for k, t in enumerate(texts)]
    if texts is TEXTS:
        rows += [(None, BASE, "en", None, 1, "x", 1), (6, "another text of the id six for once", "en", None, 1, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, piece int")


def empty(spark):
    return documents(spark, [])
