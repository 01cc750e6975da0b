"""Plain Python versions of what the operators return, and awkward rows."""

import collections
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (3, "   \n\t ", "en", "b", 1),
    (4, "one", "en", "b", 3),
    (5, "one two three", "en", "", 3),
    (6, "One two THREE", "en", "a", 3),
    (7, "é ü x　y ẞ \x0b z " * 5, "de", "a", 3),
    (8, LONG, "en", "a", 9),
    (9, LONG + " end", "en", None, 9),
    (9, LONG + " end", "en", None, 9),
    (10, "a b c d e f g h " * 40, "en", "ü", 9),
    (11, "x" * 5000, "en", "ü", 9),
    (12, "MIT License. Apache-License cc\nby GNU General Public License mit license", "en", "ü", 9),
    (13, "same line\nsame line\n\nsame line\nother", "en", "z", 9),
    (None, "no id here at all, five words and more", "en", "z", 9),
]


def docs(spark, rows=None):
    return spark.createDataFrame(AWKWARD if rows is None else rows, DOCS)


def words(text, pattern=SPACE, lower=True):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard_components(rows, percent=75):
    """[(doc_id, n, component)] in the order of rows."""
    sets, root = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    have = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            have[x].append(i)
    shared = collections.Counter((a, b) for ids in have.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[find(b)] = find(a)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]
