"""Small corpora and brute-force versions of the operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h int, rank string, kept string, toxicity string, copy_no string, n_lines string"
ODD = [None, "", " ", "\n\n\n", "a", "word " * 3, "é😀" * 40, "<|endoftext|> x", "x" * 5000]


def frame(spark, rows):
    """rows: (doc_id, text, source); further columns clash with names that operators use."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", 1, "r", "k", "t", "c", "n") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n))


def corpus(seed=1, n=60):
    """Random texts, exact and near copies, shared passages and lines, and odd texts; one hot source."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 60), sentence(rng, 14)
    out = []
    for i in range(n):
        kind = rng.randint(0, 5)
        text = "\n".join(sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6)))
        if kind == 1 and out:
            text = rng.choice(out)[1]
        elif kind == 2 and out and rng.choice(out)[1]:
            words = (rng.choice(out)[1] or "z").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 3:
            text = f"{text} {passage} {sentence(rng, 5)}"
        elif kind == 4:
            text = f"{sentence(rng, 4)}\n{line}\n{text}"
        out.append((i, text, "hot" if rng.random() < 0.5 else rng.choice(["s1", "s2", None])))
    return out + [(n + i, t, "odd") for i, t in enumerate(ODD)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


class Union:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def find(self, n):
        while self.parent[n] != n:
            n = self.parent[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
