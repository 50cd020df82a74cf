"""Small documents with the odd cases that every operator must take."""

from collections import Counter, defaultdict

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
WORDS = [f"w{i}" for i in range(40)]
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (3, "", "en", "b"),
    (4, None, None, None),
    (None, "no id here", "en", "a"),
    (5, LONG, "en", "b"),
    (6, " \t\n ", None, "b"),
    (7, "Ünïcode ＴＥＸＴ 你好 😀 naïve", "de", "c"),
    (8, " ".join(WORDS), "en", None),
    (9, " ".join([*WORDS[:38], "x", "y"]), "fr", "a"),
    (10, "one two", "fr", "a"),
    (11, "one two", "fr", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = "score double, size long, digest string, kept boolean, id long, a int, b int, __text string"


def odd_docs(spark, extra=True):
    """The odd documents, with columns whose names operators use themselves."""
    if not extra:
        return spark.createDataFrame(ODD, SCHEMA)
    return spark.createDataFrame([(*r, 0.5, 7, "d", True, -1, 1, 2, "t") for r in ODD], f"{SCHEMA}, {EXTRA}")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    """Distinct runs of five words, by definition."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_components(docs):
    """Number of shingles and smallest reachable id of each id, by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        common = Counter(e for x in s for e in holders[x] if e > d)
        for e, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                p, q = find(d), find(e)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}
