"""Plain-Python versions of the operators, and rows that are hard to handle."""

import math
import re
import zlib
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(30_000))

#: (doc_id, text): nulls, empty and blank texts, short and very long ones, ties, repeated rows, a null id.
HARD = [
    (1, None), (2, ""), (3, " \n\t \r\n"), (4, "one two"), (5, "one two"), (5, "one two"), (6, "ONE\ttwo"),
    (None, "a text without an id, long enough to have shingles"), (None, None), (8, LONG), (9, LONG + " end"),
    (10, "the same line here now\n" * 40), (11, "é ü 漢字 🙂 <|endoftext|> " * 9), (12, "nospace" * 3000),
    (-3, "minus three is an id too and this is its text"),
]


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(fold(text))


def shingle_set(text, k=5):
    w = words(text)
    if len(w) >= k:
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def near_components(rows):
    """[(n_shingles, component)] of each row; a row without words is alone (None)."""
    sets = [shingle_set(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for group in holders.values():
        for a in range(len(group)):
            for b in group[a + 1:]:
                shared[group[a], b] += 1
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            top[find(a)] = find(b)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(len(s), least[find(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def tiling(text, item, k):
    """(tiles, covered words) by marking the longest match of unmarked words again and again."""
    a, b = words(text), words(item)
    marked_a, marked_b, tiles = [False] * len(a), [False] * len(b), 0
    while True:
        best, at = 0, None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while (i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not marked_a[i + n]
                       and not marked_b[j + n]):
                    n += 1
                if n > best:
                    best, at = n, (i, j)
        if best < k:
            return tiles, sum(marked_b)
        for t in range(best):
            marked_a[at[0] + t] = marked_b[at[1] + t] = True
        tiles += 1


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


class ByteModel:
    """Prediction by partial matching, method C with exclusion, over the training rows."""

    def __init__(self, rows, order):
        self.order, self.next, self.words = order, defaultdict(Counter), Counter()
        for doc_id, text in rows:
            if held_out(doc_id):
                continue
            self.words.update(words(text))
            self.words["\0end"] += 1
            s = self.symbols(text)
            for i in range(order, len(s)):
                for j in range(order + 1):
                    self.next[tuple(s[i - j:i])][s[i]] += 1
        self.total = sum(self.words.values())

    def symbols(self, text):
        return [256] * self.order + list((text or "").encode()) + [257]

    def step(self, context, symbol):
        gone, out = set(), 0.0
        for j in range(self.order, -1, -1):
            seen = self.next.get(tuple(context[len(context) - j:]))
            if not seen:
                continue
            n = sum(c for s, c in seen.items() if s not in gone)
            fresh = len(set(seen) - gone)
            if symbol in seen and symbol not in gone:
                return out + math.log10(seen[symbol] / (n + fresh))
            if fresh:
                out += math.log10(fresh / (n + fresh))
            gone |= set(seen)
        return out - math.log10(257 - len(gone))

    def score(self, text):
        s = self.symbols(text)
        return sum(self.step(s[:i], s[i]) for i in range(self.order, len(s)))

    def base(self, text):
        tokens = [*words(text), "\0end"]
        size = self.total + 0.5 * (len(self.words) + 1)
        return len(tokens), sum(t in self.words for t in tokens), sum(
            math.log10((self.words[t] + 0.5) / size) for t in tokens)


def python_nodes(df):
    """Operators of the plan that run Python."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("Python", "Pandas", "Arrow") if x in plan]
